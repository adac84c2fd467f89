import hashlib
import random
import re

from pyspark.sql import functions as F

from asofkit.llm import fingerprint as fp


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(text):
    """(fingerprint, phrase hashes) by the definition."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    leaves = [[h(x) for x in re.findall(r"[^.!?,;:\n]{1,32}[.!?,;:\n]*|[.!?,;:\n]+", line)] for line in lines]
    hashes = [h("".join(p)) for p in leaves]
    sections = [[]]
    for k, x in enumerate(hashes):
        sections[-1].append(k)
        if x < "4" and k + 1 < len(hashes):
            sections.append([])
    root = h("".join(h("".join(hashes[k] + ("" if i == len(s) - 1 else "|") for i, k in enumerate(s))) for s in sections))
    body = ";".join("|".join(hashes[k] + ":" + ",".join(x[:6] for x in leaves[k]) for k in s) for s in sections)
    return f"{root}={body}", {x[:6] for p in leaves for x in p}


def like(a, b):
    return 1.0 if not a and not b else 2.0 * len(a & b) / (len(a) + len(b))


def texts():
    r = random.Random(5)
    words = ["alpha", "beta,", "gamma.", "δέλτα", "\n", "x" * 90, "!!", "𝄞 clef", "\r\n", "end;"]
    out = [None, "", "a", "\n", "\n\n\n", "." * 50, "no marks at all " * 40, "one line. " * 3000]
    return out + [" ".join(r.choice(words) for _ in range(r.randint(1, 200))) for _ in range(40)] + ["same text, twice.\nyes"] * 3


def test_against_plain_version(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in fp.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text").collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        t, nxt = t or "", rows[i - 1][1] or ""  # descending ids: the next one is one less; after 0 comes the largest
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        (a, la), (b, lb), (_, ln) = plain(t), plain(e), plain(nxt)
        g = got[i]
        assert (g.n_chars, g.edited, g.fingerprint, g.edited_fingerprint) == (len(t), e, a, b)
        assert (g.near_edited, g.near_next) == (like(la, lb), like(la, ln))
        if t == e:
            assert g.edit_section is None and g.edit_paragraph is None
        else:
            x, y = a[65:].split(";"), b[65:].split(";")
            s = next(j for j in range(max(len(x), len(y))) if x[j : j + 1] != y[j : j + 1])
            assert g.edit_section == s and g.edit_paragraph is not None


def test_cases(spark):
    df = spark.createDataFrame([(None, "a b. c", 1, 2), (None, "a b. c", 1, 2), (5, None, 1, 2), (5, "", 1, 2), (7, "zz", 1, 2)], "doc_id long, text string, place int, fingerprint int")
    got = fp.edited(df, "doc_id", "text").collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.text == "a b. c"}) == 1 and len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    assert fp.edited(df.limit(0), "doc_id", "text").collect() == []
    one = fp.edited(df.filter("doc_id = 7"), "doc_id", "text").collect()
    assert [(r.edited, r.near_next, r.edit_section) for r in one] == [("zz", 1.0, None)]
    kept = fp.with_fingerprint(df, "text", "phrases").collect()
    assert [r.place for r in kept] == [1] * 5 and all(r.phrases[64] == "=" for r in kept)


def test_changed_branches_locate_an_edit(spark):
    lines = [f"line {i} has words, and more." for i in range(60)]
    new = [*lines[:20], "a new line.", *lines[20:40], "another one.", *lines[41:]]
    frame = lambda t: fp.with_fingerprint(spark.createDataFrame([(1, "\n".join(t)), (2, "same\ntext")], "doc_id long, text string"), "text", "fp")
    got = fp.changed_branches(frame(lines), frame(new), "doc_id", "fp").collect()
    body = plain("\n".join(new))[0][65:].split(";")
    flat = [(s, p) for s, x in enumerate(body) for p in range(len(x.split("|")))]
    assert sorted((r.section, r.paragraph) for r in got) == sorted([flat[20], flat[41]]) and {r.doc_id for r in got} == {1}


def test_native_and_texts_shuffled_once(spark):
    from asofkit.llm.queries import op12_merkle_fingerprints

    df = op12_merkle_fingerprints(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    assert "ReusedExchange" in final
    assert df.agg(F.avg("near_edited") - F.avg("near_next")).first()[0] > 0.4
