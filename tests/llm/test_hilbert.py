from collections import Counter
from zlib import crc32

import numpy as np

from asofkit.llm import hilbert
from asofkit.llm.queries import op7_hilbert_shards


def test_curve_is_a_path_of_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        h = hilbert.curve_index(grid, bits)
        assert sorted(h) == list(range(len(grid)))
        path = grid[np.argsort(h)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, texts, shards):
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min([n[s] for s in range(shards)]) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_hilbert_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == crc32(texts[r.doc_id]) for r in rows)
    check(rows, texts, 40)
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_cases(spark):
    df = spark.createDataFrame([(None, None, None)] * 7 + [(1, "en", 2.5)] * 90 + [(2, "de", float("nan"))] * 4, "doc_id long, lang string, slot double")
    got = hilbert.cut_runs(hilbert.along_curve(df, ["lang", "slot", "doc_id"]).drop("slot"), "curve", ["doc_id"], 8).collect()
    assert len(got) == 101
    check(got, None, 8)
    assert hilbert.cut_runs(hilbert.along_curve(df.limit(0), ["lang", "doc_id"]).drop("slot"), "curve", ["doc_id"], 8).count() == 0
    few = hilbert.cut_runs(hilbert.along_curve(df.limit(3), ["lang"]).drop("slot"), "curve", [], 8).collect()
    assert len({r.shard for r in few}) == 3


def test_files_prune(spark, tmp_path):
    df = spark.range(4000).selectExpr("id doc_id", "concat('s', id % 16) source", "cast(pow(id % 97, 2) as long) size")
    got = hilbert.cut_runs(hilbert.along_curve(df, ["source", "size"]), "curve", ["doc_id"], 16)
    hilbert.write_shards(got, str(tmp_path / "out"))
    spans = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg({"source": "max", "size": "min"}).count()
    per = got.groupBy("shard").agg({"source": "approx_count_distinct"}).collect()
    assert spans == 16 and np.mean([r[1] for r in per]) < 9


def test_text_is_cut_by_whole_values(spark):
    """Values that part only after a long common head fall into cells of equal depth, as an exact sort gives them."""
    rows = [(f"https://www.example.com/a{i % 40:02d}",) for i in range(400)] + [(None,)] * 20 + [("https://www.example.com/a07",)] * 200
    df = spark.createDataFrame(rows, "source string").repartition(5)
    line = sorted((r[0] for r in rows), key=lambda v: (v is not None, v or ""))
    want = [line[-(-i * len(line) // 16) - 1] for i in range(1, 16)]
    edges = hilbert.text_edges(df, "source", 4)
    assert edges == want
    cells = df.select("source", hilbert.text_cell("source", edges).alias("c")).distinct().collect()
    for r in cells:
        assert r.c == (0 if r.source is None else sum(e is None or e < r.source for e in want))
    assert len({r.c for r in cells}) >= 9
    mostly = spark.createDataFrame([(None,)] * 9 + [("a",), ("b",)], "source string")
    low = hilbert.text_edges(mostly, "source", 2)
    assert low == [None, None, None]
    assert {r.source: r.c for r in mostly.select("source", hilbert.text_cell("source", low).alias("c")).collect()} == {None: 0, "a": 3, "b": 3}
    assert hilbert.text_edges(mostly.limit(0), "source", 2) == []
    assert hilbert.text_edges(spark.createDataFrame([(b"x\x00",), (b"x\x01",)], "source binary"), "source", 1) == [bytearray(b"x\x00")]
