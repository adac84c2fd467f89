"""Columns of a caller that bear the stages' own names, and repeated ids."""

import corpus_pipeline
from asofkit.llm.common import written
from asofkit.llm.queries import op10_tensored_minhash

SF = "/root/testdata/sf0.001"
NAMES = ["__file", "__pos", "__text", "__f", "__p", "__doc", "__l", "__when", "file", "pos", "left", "n_words", "kept"]


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *[docs.doc_id.alias(n) for n in NAMES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, docs = docs, written(stage(spark, docs, SF), name)
        wide = written(stage(spark, wide, SF), name)
        assert wide.columns == [*plain.columns, *NAMES]
        assert wide.exceptAll(docs.select("*", *[docs.doc_id.alias(n) for n in NAMES])).count() == 0 and wide.count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() > 0


def test_kept_of_repeated_ids(spark, tmp_path):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, None), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_tensored_minhash(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]
