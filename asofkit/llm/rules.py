"""Quality rules with adaptive thresholds.

Every text is measured once. Mergeable quantile sketches (KLL) of each measure
are kept per (language, source), over the documents that pass the base rule (all
of them where none does); sketches merge upwards. The limits of a group lie
around its median, as far out as its quartiles or its tail say, and are drawn
towards those of its language, and these towards the whole corpus, by weights
that follow the numbers of documents. Documents are then joined with the limits
of their group and filtered.

Cases: a null text has no words and fails; null languages and sources form
groups of their own; repeated rows get equal verdicts; a very long text is
measured whole; an empty table gives an empty result; other columns pass
through ``keep`` only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import slices, written

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Sketch size: a rank error of about 0.1 %.
SKETCH_K = 2048
#: A group of so many documents weighs as much as what it is drawn towards.
GROUP_ROWS = 200
#: Width of the fence in interquartile ranges, and in distances of the tail from the median: the larger one holds.
FENCE, STRETCH = 6.0, 2.0
#: measure -> (sides, tail quantile, least width). Symbols have junk of up to a tenth beyond the base rule, so their tail starts below it.
#: The least width is a small change to a text of a group whose values are all alike.
MEASURES = {"mean_word": ("both", 0.95, 0.25), "symbol_rate": ("high", 0.85, 0.02), "upper_rate": ("high", 0.99, 0.02), "dup_line_rate": ("high", 0.99, 0.05), "repeat_rate": ("high", 0.99, 0.02)}
ENDS = [f"{m}_{e}" for m, (s, _, _) in MEASURES.items() for e in (("hi", "lo") if s == "both" else ("hi",))]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0)
    solid = len(raw.translate(None, SPACE))
    chars = len(text) - (len(raw) - solid)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        end = 0  # words before this place are counted
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + 5 - max(i, end)
                end = i + 5
    return (n, chars, symbols, len(lines) - len(set(lines)), repeated, sum(w.isupper() for w in words), len(lines))


def measured(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and COUNTS per row; ``text`` may be a field of a kept struct (``column.field``)."""
    whole, _, field = text.partition(".")
    source = df.select(*[F.col(f"`{c}`") for c in keep], *([] if field else [F.col(f"`{text}`").alias("__text")]))
    at = [f.name.lower() for f in source.schema[whole].dataType.fields].index(field) if field else None
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, 2048)):
            texts = b.column("__text") if at is None else b.column(whole).field(at)
            rows = [measure(t.as_py()) for t in texts]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + cols, [*keep, *COUNTS])

    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rates() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "mean_word": F.col("word_chars") / words,
        "symbol_rate": F.col("n_symbols") / words,
        "upper_rate": F.col("n_upper") / words,
        "dup_line_rate": F.col("n_dup_lines") / lines,
        "repeat_rate": F.col("n_repeat_words") / words,
    }


def sketches(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of ``keys``: rows and a sketch of each measure. Partial sketches merge before the shuffle."""
    r, good = rates(), ~base_failed()
    sketch = lambda c: F.kll_sketch_agg_double(c, F.lit(SKETCH_K))
    both = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("all_rows"), F.count_if(good).alias("good_rows"),
        *[sketch(r[m]).alias(f"all_{m}") for m in MEASURES], *[sketch(F.when(good, r[m])).alias(f"good_{m}") for m in MEASURES],
    )
    return both.select(*keys, *[F.when(F.col("good_rows") > 0, F.col(f"good_{c}")).otherwise(F.col(f"all_{c}")).alias(c) for c in ["rows", *MEASURES]])


def merged(leaf: DataFrame, keys: list[str]) -> DataFrame:
    return leaf.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES])


def fences(sketched: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Limits of each group from its own quantiles, and what set each: quartiles, tail or least."""
    out = []
    for m, (sides, tail, least) in MEASURES.items():
        at = lambda q, m=m: F.kll_sketch_get_quantile_double(F.col(m), F.lit(q))
        q2, spread = at(0.5), FENCE * (at(0.75) - at(0.25))
        for end, sign, q in (("hi", 1, tail), ("lo", -1, 1 - tail))[: 2 if sides == "both" else 1]:
            far = STRETCH * sign * (at(q) - q2)
            width = F.greatest(spread, far, F.lit(least))
            by = F.when(spread >= width, "quartiles").when(far >= width, "tail").otherwise("least")
            out += [(q2 + sign * width).alias(f"{tag}_{m}_{end}"), by.alias(f"{tag}_{m}_{end}_by")]
    return sketched.where("rows > 0").select(*keys, F.col("rows").alias(f"{tag}_rows"), *out)


def limits(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Limits per (lang, source), drawn towards the larger groups: one row each, with what in the group's own values set each limit (``_by``)."""
    usable = counts.where("n_words > 0")
    leaf = written(sketches(usable, [lang, source]), "sketches")
    by_lang = merged(leaf, [lang])
    whole = fences(merged(leaf, []), [], "w").first()  # one row of numbers
    own, mid = fences(leaf, [lang, source], "o"), fences(by_lang, [lang], "l")
    mid = mid.withColumnRenamed(lang, "__lang")
    both = own.join(mid, own[lang].eqNullSafe(mid["__lang"]), "left")
    drawn = lambda tag, e, to: (F.col(f"{tag}_rows") * F.col(f"{tag}_{e}") + GROUP_ROWS * to) / (F.col(f"{tag}_rows") + GROUP_ROWS)
    pick = [drawn("o", e, drawn("l", e, F.lit(whole[f"w_{e}"] if whole else None))).alias(e) for e in ENDS]
    return written(both.select(own[lang], own[source], *pick, *[F.col(f"o_{e}_by").alias(f"{e}_by") for e in ENDS]), "limits")


def judged(counts: DataFrame, lim: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``counts`` with base_failed and kept by the limits ``lim``: a small written table, which Spark broadcasts by its size."""
    lim = lim.withColumnsRenamed({lang: "__lang", source: "__source"})
    joined = counts.join(lim, counts[lang].eqNullSafe(lim["__lang"]) & counts[source].eqNullSafe(lim["__source"]), "left")
    good = F.lit(True)
    for m, c in rates().items():
        good = good & F.coalesce(c <= F.col(f"{m}_hi"), F.lit(True))
        if MEASURES[m][0] == "both":
            good = good & F.coalesce(c >= F.col(f"{m}_lo"), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & good).select(*counts.columns, "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass. Texts are measured again with the limits known, so they are never shuffled."""
    groups = [F.col("lang").alias("__l"), F.col("source").alias("__s")]
    lim = limits(written(measured(docs.select(*groups, "text"), ["__l", "__s"]), "measures"), "__l", "__s")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    counts = measured(rows, ["__doc"], "__doc.text").select("*", F.col("__doc.lang").alias("__l"), F.col("__doc.source").alias("__s"))
    return judged(counts, lim, "__l", "__s").where("kept").select("__doc.*")
