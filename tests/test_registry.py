import pytest
from pyspark.sql import functions as F

from asofkit.functions import labels as L
from asofkit.operators import quality as Q
from asofkit.plans.ingest import SPECS
from asofkit.sources import files as S


def test_registry_inherits_and_fails_closed(spark, tmp_path):
    rows = [("base", None, None, None, 5, 0.0, None), ("child", "base", ["id"], ["id"], None, None, None), ("grandchild", "child", None, None, 1, None, {"id": 0.0}),
            ("lost", "nobody", ["id"], None, None, None, None), ("a", "b", ["id"], None, None, None, None), ("b", "a", ["id"], None, None, None, None)]
    specs = spark.createDataFrame(rows, SPECS)
    good, broken = Q.registry(specs)
    assert good["child"].min_rows == 5 and good["child"].columns == ["id"]
    assert good["grandchild"].min_rows == 1 and good["grandchild"].key == ["id"] and good["grandchild"].numeric == {"id": 0.0}
    assert broken == {"lost": "parent nobody is not registered", "a": "parent a is its own ancestor", "b": "parent b is its own ancestor"}
    for name in ("child", "grandchild", "lost", "stranger"):
        spark.createDataFrame([(1,), (1,)], "id long").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = Q.validate_files(spark, [str(tmp_path / f"{n}.parquet") for n in ("child", "grandchild", "lost", "stranger")], specs)
    assert sorted(map(tuple, got.collect())) == [("child", "key", "duplicates 1"), ("child", "rows", "rows 2"), ("grandchild", "key", "duplicates 1"),
                                                 ("lost", "contract", "parent nobody is not registered"), ("stranger", "contract", "not registered")]


def test_newest_version_is_the_only_one_read(spark, tmp_path):
    base = str(tmp_path / "slates")
    rows = [("2024-01-05", 1), ("2024-01-05_v2", 2), ("2024-01-05_v10", 10), ("2024-01-06", 3), ("draft", 4)]
    df = spark.createDataFrame(rows, "slate string, x int")
    df.write.partitionBy("slate").parquet(base)
    got = S.read_newest(spark, base, r"slate=(\d{4}-\d{2}-\d{2})(?:_v(\d+))?/", df.schema)
    assert sorted(r.x for r in got.collect()) == [3, 10]
    read = got.inputFiles()
    assert len(read) == 2 and all("_v10/" in f or "2024-01-06/" in f for f in read)
    spark.range(1).write.parquet(str(tmp_path / "none"))
    assert S.read_newest(spark, str(tmp_path / "none"), r"slate=(\d+)(?:_v(\d+))?/", df.schema).count() == 0


@pytest.mark.parametrize(("market", "line", "name"), [
    ("batter_hits", 0.5, "1+ hit"), ("batter_hits", 1.5, "2+ hits"), ("batter_walks", 1.5, "1+ walk"), ("batter_rbis", 0.5, "1+ RBI"),
    ("pitcher_outs", 17.5, "pitcher outs o17.5"), ("other", 0.5, "other"), (None, 0.5, None), ("batter_total_bases", None, "batter_total_bases")])
def test_shown_name(spark, market, line, name):
    df = spark.createDataFrame([(market, line)], "m string, l double")
    assert df.select(L.shown_name("m", "l")).first()[0] == name


def test_ladder_label_reads_back(spark):
    df = spark.createDataFrame([("pitcher_outs", 17.5), ("pitcher_walks", 1.5), (None, None)], "m string, l double").withColumn("x", L.market_label("m", "l"))
    assert [tuple(r) for r in df.select("x", L.line_of("x"), L.line_stat(F.col("x"))).collect()] == [("Outs > 17.5", 17.5, "outs"), (None, None, None), (None, None, None)]
