import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from asofkit.llm.common import written  # noqa: E402
from test_minhash import brute as all_pairs  # noqa: E402
from test_packing import checked  # noqa: E402
from test_suffix import brute as all_windows  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    rules, classified, single, cut = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(classified) <= set(rules)
    assert sum(labels.get(d) == 1 for d in classified) >= 0.97 * sum(labels.get(d) == 1 for d in rules)
    ids = sorted(classified)
    roots, _ = all_pairs([classified[d] for d in ids], 5)
    assert set(single) == {ids[i] for i, r in enumerate(roots) if i == r}
    ids = sorted(single)
    removed = all_windows([single[d] for d in ids], 200)
    assert set(cut) == set(single)
    assert all((len(cut[d].encode()) == n - gone) or (gone and len(cut[d].encode()) >= n - gone - 6) for d, (n, gone, _, _) in zip(ids, removed))
    checked(corpus_pipeline.run(spark, SF).collect(), cut, 2048)


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
