import hashlib

import pytest
from pyspark.sql import functions as F

from asofkit.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(nodes):
    """Levels of the tree over ``nodes``, by the definition."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([h(*a[i : i + 2]) for i in range(0, len(a), 2)])
    return levels


def test_positions_follow_the_completion_order():
    for n in range(1, 40):
        leaves = [h(str(i)) for i in range(n)]
        levels, log = plain(leaves), merkle.segment(leaves, merkle.height(n))
        assert len(log) == sum(map(len, levels)) and log[-1] == levels[-1][0]
        for level, nodes in enumerate(levels):
            for i, node in enumerate(nodes):
                assert log[merkle.position(min((i + 1) << level, n) - 1, level)] == node


def expected(rows):
    """(group, id, leaf) to (leaf, subroot, root, siblings)."""
    groups = {}
    for g, i, leaf in rows:
        groups.setdefault(g, []).append((i is not None, i, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain([x[2] for x in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))]) for g in order}
    top = plain([trees[g][-1][0] for g in order])
    out = []

    def up(levels, i):
        for level in levels[:-1]:
            j = i ^ 1
            if j < len(level):
                yield level[j]
            i >>= 1

    for k, g in enumerate(order):
        for i, leaf in enumerate(trees[g][0]):
            out.append((leaf, trees[g][-1][0], top[-1][0], tuple([*up(trees[g], i), *up(top, k)])))
    return sorted(out)


def run(spark, rows, bits):
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string")
    got = merkle.proofs(df, "lang", ["doc_id"], "leaf", bits).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).collect()
    assert all(r.folded == r.root for r in got)
    return sorted((r.leaf, r.subroot, r.root, tuple(s[1:] for s in r.steps if s)) for r in got)


@pytest.mark.parametrize("bits", [1, 2, 11])
def test_against_plain_trees(spark, bits):
    rows = [("en", i, h("en", str(i))) for i in range(37)] + [(None, i, h("n", str(i))) for i in range(9)] + [("é", 5, h("x"))] + [("z", i, h("z", str(i))) for i in range(16)]
    assert run(spark, rows, bits) == expected(rows)


def test_ties_repeats_and_null_ids(spark):
    rows = [("", 1, h("a")), ("", 1, h("a")), ("", 1, h("b")), ("", None, h("c")), (None, None, h("c")), ("de", 7, h("d"))]
    assert run(spark, rows, 1) == expected(rows)
    assert run(spark, [("en", 3, h("only"))], 2) == [(h("only"), h("only"), h("only"), ())]
    assert run(spark, [], 2) == []


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(f"t{i}", i, h(str(i)), "en", 2 * i) for i in range(5)], "tree string, rank int, leaf string, lang string, block int")
    got = merkle.proofs(df, "lang", ["rank"], "leaf", 1).collect()
    assert sorted((r.tree, r.rank, r.leaf, r.block) for r in got) == [(f"t{i}", i, h(str(i)), 2 * i) for i in range(5)]


def test_leaf_fields(spark):
    df = spark.createDataFrame([(1, None, "é", ""), (None, "s", None, "x" * 100000)], "a long, b string, c string, d string")
    got = [r[0] for r in df.select(merkle.leaf(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [h("1:1", "-", "2:é", "0:"), h("-", "1:s", "-", "100000:" + "x" * 100000)]


def test_query_flags_changed_rows(spark):
    from zlib import crc32

    from asofkit.llm.queries import op13_postorder_manifest

    sf = "/root/testdata/sf0.001"
    nulls = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars IS NULL").collect()}
    for r in op13_postorder_manifest(spark, sf).collect():
        assert r.verified == (crc32(str(r.doc_id).encode()) % 7 != 0 or r.doc_id in nulls)
