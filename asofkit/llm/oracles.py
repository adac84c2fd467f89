"""DuckDB SQL for the queries that SQL can express: plain statements of what must come out, by all pairs."""

_COMPONENTS = "reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, e.y FROM reach r JOIN e ON e.x = r.b), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGITS, _BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NIBBLE = f"(instr('{_DIGITS}', substr(h, CAST((5 * i) // 4 + {{}} AS BIGINT), 1)) - 1)"
_BASE32_OF_H = f"array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', CAST(((({_NIBBLE.format(1)} * 16 + {_NIBBLE.format(2)}) >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '')"

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(n: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", f"({n})", "text")) + ")"


def _crc(text: str) -> str:
    """Unsigned crc32 of a text, bit by bit."""
    bits = "list_reduce(list_prepend({0}, CAST(range(0, 8) AS BIGINT[])), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)"
    start = f"list_prepend(4294967295, list_transform(range(0, strlen({text})), lambda k: CAST(('0x' || substr(hex({text}), CAST(2 * k + 1 AS BIGINT), 2)) AS BIGINT)))"
    return f"xor(4294967295, list_reduce({start}, lambda a, b: {bits.format('xor(a, b)')}))"


def _tree(text: str) -> str:
    """Paragraphs of a text as (hash, phrase hashes)."""
    lines = f"regexp_extract_all({text}, '[^\\n]*\\n|[^\\n]+')"
    cut = "list_transform(regexp_extract_all(p, '[^.!?,;:\\n]{1,32}[.!?,;:\\n]*|[.!?,;:\\n]+'), lambda x: sha256(x))"
    return f"list_transform({lines}, lambda p: {{'h': sha256(array_to_string({cut}, '')), 'x': {cut}}})"


_TRIM = "regexp_replace(array_to_string(list_transform({}, lambda p: {} || CASE WHEN p.h < '4' THEN ';' ELSE '|' END), ''), '[;|]$', '')"


def _body(tree: str) -> str:
    return _TRIM.format(tree, "p.h || ':' || array_to_string(list_transform(p.x, lambda y: substr(y, 1, 6)), ',')")


def _runs(tree: str) -> str:
    return f"string_split({_body(tree)}, ';')"


def _print(tree: str) -> str:
    return f"sha256(array_to_string(list_transform(string_split({_TRIM.format(tree, 'p.h')}, ';'), lambda s: sha256(s)), '')) || '=' || {_body(tree)}"


def _leaves(tree: str) -> str:
    return f"list_distinct(flatten(list_transform({tree}, lambda p: list_transform(p.x, lambda y: substr(y, 1, 6)))))"


def _like(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _first(a: str, b: str) -> str:
    return f"list_position(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] IS NOT DISTINCT FROM {b}[i]), false) - 1"


SQL = {
    "op3_warc_index_merge": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32_OF_H} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d""",
    "op9_binary_code_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), ids AS (SELECT vec_id AS id FROM v),
ok AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.l * b.l) >= 0.9),
{_COMPONENTS}, n AS (SELECT x AS id, count(*) AS n FROM e GROUP BY 1)
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN n USING (id)""",
    "op10_tensored_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), ids AS (SELECT doc_id AS id FROM w),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id AS id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
{_COMPONENTS}
SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM comp LEFT JOIN n USING (id)""",
    "op13_postorder_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS tampered FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
lv(lang, l, i, n, node) AS (SELECT lang, 0, i, n, leaf FROM r UNION ALL SELECT lang, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY lang, l, i // 2, n),
subs AS (SELECT lang, l AS h, node AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
tp(l, i, n, node) AS (SELECT 0, i, n, subroot FROM subs UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM tp WHERE n > 1 GROUP BY l, i // 2, n),
f(doc_id, lang, leaf, i, l, cur, proof) AS (SELECT doc_id, lang, leaf, i, 0, coalesce(tampered, leaf), '' FROM r UNION ALL
  SELECT f.doc_id, f.lang, f.leaf, f.i // 2, f.l + 1, sha256(CASE WHEN s.node IS NULL THEN cur WHEN f.i % 2 = 1 THEN s.node || cur ELSE cur || s.node END), proof || coalesce(s.node, '')
  FROM f JOIN subs ON subs.lang IS NOT DISTINCT FROM f.lang AND f.l < subs.h LEFT JOIN lv s ON s.lang IS NOT DISTINCT FROM f.lang AND s.l = f.l AND s.i = xor(f.i, 1)),
g(doc_id, leaf, subroot, i, l, cur, proof) AS (SELECT f.doc_id, f.leaf, subs.subroot, subs.i, 0, f.cur, f.proof FROM f JOIN subs ON subs.lang IS NOT DISTINCT FROM f.lang AND f.l = subs.h UNION ALL
  SELECT g.doc_id, g.leaf, g.subroot, g.i // 2, g.l + 1, sha256(CASE WHEN s.node IS NULL THEN cur WHEN g.i % 2 = 1 THEN s.node || cur ELSE cur || s.node END), proof || coalesce(s.node, '')
  FROM g JOIN (SELECT max(l) AS h FROM tp) ON g.l < h LEFT JOIN tp s ON s.l = g.l AND s.i = xor(g.i, 1)),
top AS (SELECT node AS root, l AS h FROM tp WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM g JOIN top ON g.l = top.h""",
    "op12_merkle_fingerprints": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nx,
  coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, text, nx, next_id, substr(text, 1, length(text) - length(text) // 3) || substr(nx, 1, length(text) // 3) AS ed FROM t),
f AS (SELECT *, {_tree('text')} AS a, {_tree('ed')} AS b, {_tree('nx')} AS c FROM e),
g AS (SELECT *, {_print('a')} AS fingerprint, {_print('b')} AS edited_fingerprint, {_leaves('a')} AS la, {_leaves('b')} AS lb, {_leaves('c')} AS lc, {_runs('a')} AS sa, {_runs('b')} AS sb FROM f),
h AS (SELECT *, CASE WHEN fingerprint <> edited_fingerprint THEN {_first('sa', 'sb')} END AS edit_section FROM g)
SELECT doc_id, length(text) AS n_chars, sha256(ed) AS edited_sha256, fingerprint, edited_fingerprint, {_like('la', 'lb')} AS near_edited, {_like('la', 'lc')} AS near_next, next_id, edit_section,
 CASE WHEN edit_section IS NOT NULL THEN {_first("string_split(coalesce(sa[edit_section + 1], ''), '|')", "string_split(coalesce(sb[edit_section + 1], ''), '|')")} END AS edit_paragraph FROM h""",
}
