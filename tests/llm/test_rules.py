import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from asofkit.llm import rules
from asofkit.llm.queries import op4_quality_rules


def plain(text):
    """The same counts, slowly."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t#é\x0b\x85　"), max_size=120))
def test_counts(text):
    assert rules.measure(text)[:5] == plain(text)


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c d e a b c d e", "x\n\nx\n \n ", "w " * 5000])
def test_odd_counts(text):
    assert rules.measure(text)[:5] == plain(text)


def rows():
    good = [(i, "one two three four five six seven eight nine ten eleven %d" % i, "en" if i % 3 else "de", "s0") for i in range(600)]
    return good + [(1000, "A## B## C## D## E## F## G## H## I## J## K##", "en", "s0"), (1001, None, None, None), (1002, "", "en", None), (1003, "LOUD WORDS GO ON AND ON FOR EVER IN THIS VERY ODD TEXT", "fr", "s9"), (1003, "LOUD WORDS GO ON AND ON FOR EVER IN THIS VERY ODD TEXT", "fr", "s9")]


def test_verdicts_and_stage(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").withColumnRenamed("doc_id", "doc_id")
    counts = rules.written(rules.measured(docs, ["doc_id", "lang", "source"]), "m")
    got = {(r.doc_id, r.kept) for r in rules.judged(counts, rules.limits(counts)).collect()}
    assert {k for k, kept in got if not kept} == {1000, 1001, 1002, 1003}
    kept = rules.stage(spark, docs.selectExpr("*", "'x' as n_words"), "")
    assert kept.columns == [*docs.columns, "n_words"] and kept.count() == 600
    assert rules.stage(spark, docs.limit(0), "").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.kept or r.base_failed for r in got if labels.get(r.doc_id) == 1)


def test_sketch_limits_follow_the_group(spark):
    """A fence comes from the group's own quartiles: exact for groups smaller than the sketch."""
    df = spark.createDataFrame([(i, "ab " * 10 if i % 2 else "abcdefgh " * 10, "en", "s") for i in range(400)], "doc_id long, text string, lang string, source string")
    lim = rules.limits(rules.written(rules.measured(df, ["doc_id", "lang", "source"]), "m")).first()
    assert lim.mean_word_hi - lim.mean_word_lo == pytest.approx(2 * rules.FENCE * 6)


def test_limits_come_from_the_groups_values(spark):
    """Tails of the groups set the limits, not fixed widths, and repeats below the base rule's line can be rejected."""
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    clean = lambda i: " ".join(words[(i + 7 * k) % 100] for k in range(60))
    few = " ".join(["the"] * 8 + words[:60])  # 8 of 68 words repeat
    docs = spark.createDataFrame([(i, clean(i), "en", "s") for i in range(600)] + [(1000, few, "en", "s"), (1001, clean(0).replace(words[7], words[7].upper() + "##"), "en", "s")], "doc_id long, text string, lang string, source string")
    counts = rules.written(rules.measured(docs, ["doc_id", "lang", "source"]), "m")
    lim = rules.limits(counts)
    assert {r.doc_id for r in rules.judged(counts, lim).where("not kept and not base_failed").collect()} == {1000, 1001}
    loud = spark.createDataFrame([(i, clean(i).replace("a", "A").replace("k", "K") if i % 20 == 0 else clean(i), "en", "s") for i in range(600)], docs.schema)
    own = rules.limits(rules.written(rules.measured(loud, ["doc_id", "lang", "source"]), "m")).first()
    assert lim.first().upper_rate_hi_by == "least" and own.upper_rate_hi_by == "tail" and own.upper_rate_hi > lim.first().upper_rate_hi


def test_small_groups_are_drawn_towards_their_language(spark):
    rows = [(i, " ".join(["abcd" if i % 2 else "abc"] * 20), "en", "big") for i in range(400)] + [(i, " ".join(["abcdefgh" if i % 2 else "ab"] * 20), "en", "small") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lim = {r.source: r.mean_word_hi for r in rules.limits(rules.written(rules.measured(df, ["doc_id", "lang", "source"]), "m")).collect()}
    assert lim["big"] < lim["small"] < 2 + rules.FENCE * 6
