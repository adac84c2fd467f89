"""Document fingerprints: a Merkle tree over the phrases, paragraphs and sections of a text, in Spark functions only.

A paragraph is a line with its line end; a phrase is a stretch of a paragraph up
to its punctuation, 32 characters at most before it. Pieces joined give the text
back. Phrases hash by sha256, a paragraph by the hashes of its phrases, a section
by those of its paragraphs, the root by those of its sections. A section ends
with a paragraph whose hash starts below ``4`` (of sixteen digits), so about every
fourth, and an edit moves no other section's border but its own.

The fingerprint is a text, ``root=section;section;...``: a section is its
paragraphs joined by ``|``, a paragraph its hash, a colon and six digits of each
phrase's hash joined by commas. Equal roots mean equal texts. Different ones are
walked down: sections from either end that agree are skipped, then paragraphs
(``edited_span``); the phrases say how much agrees (``likeness``).

Cases: a null text counts as empty and has a fingerprint of its own, like any
text without characters; long texts are cut in their row with work in proportion
to their length; repeated rows have equal fingerprints; an empty table gives no
rows; other columns stay unless they bear the names that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import fresh, row_keyed
from asofkit.llm.order import placed

PARAGRAPH = r"[^\n]*\n|[^\n]+"
PHRASE = r"[^.!?,;:\n]{1,32}[.!?,;:\n]*|[.!?,;:\n]+"


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the fingerprint of column ``text``."""
    phrases, paragraphs, sections, body = (fresh(n, [*df.columns, out]) for n in ("phrases", "paragraphs", "sections", "body"))
    lines = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    df = df.withColumn(phrases, F.transform(lines, lambda p: F.transform(F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)), sha)))
    df = df.withColumn(paragraphs, F.transform(phrases, lambda p: sha(F.array_join(p, ""))))
    mark = lambda h: F.when(h < "4", ";").otherwise("|")  # noqa: E731 - the border after a paragraph
    inner = F.array_join(F.transform(paragraphs, lambda h: F.concat(h, mark(h))), "")
    df = df.withColumn(sections, F.transform(F.split(F.regexp_replace(inner, "[;|]$", ""), ";"), sha))
    printed = F.zip_with(paragraphs, phrases, lambda h, p: F.concat(h, F.lit(":"), F.array_join(F.transform(p, lambda x: F.substring(x, 1, 6)), ","), mark(h)))
    df = df.withColumn(body, F.regexp_replace(F.array_join(printed, ""), "[;|]$", ""))
    return df.withColumn(out, F.concat(sha(F.array_join(sections, "")), F.lit("="), F.col(body))).drop(phrases, paragraphs, sections, body)


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def parts(fingerprint: Column) -> Column:
    """Sections of a fingerprint, each the text of its paragraphs."""
    return F.split(F.element_at(F.split(fingerprint, "="), 2), ";")


def phrases(fingerprint: Column) -> Column:
    """Distinct phrase hashes of a fingerprint."""
    body = F.regexp_replace(F.element_at(F.split(fingerprint, "="), 2), "[0-9a-f]{64}:", "")
    return F.array_distinct(F.filter(F.split(body, "[;|,]"), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared phrases over all phrases of two arrays; 1 where both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def first_difference(a: Column, b: Column) -> Column:
    """Index (from 0) of the first entry in which two arrays differ; null where they agree."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1)


def edited_span(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with the branch where fingerprint ``b`` leaves ``a`` first: edit_section and edit_paragraph in it (from 0, null if equal).

    The walk goes down the tree: sections that agree are not looked into.
    """
    df = df.withColumn("edit_section", F.when(root(F.col(a)) != root(F.col(b)), first_difference(parts(F.col(a)), parts(F.col(b)))))
    lines = lambda c: F.split(F.coalesce(F.get(parts(F.col(c)), F.col("edit_section").cast("int")), F.lit("")), r"\|")
    return df.withColumn("edit_paragraph", F.when(F.col("edit_section").isNotNull(), first_difference(lines(a), lines(b))))


def changed_branches(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows (key, section, paragraph) of ``new`` whose paragraph hash its ``old`` text does not hold, for stored fingerprints.

    Texts with equal roots drop out first, then sections that the old text holds,
    then paragraphs; each step is a join on hashes.
    """
    pairs = new.select(key, F.col(fingerprint).alias("fp")).join(old.select(key, F.col(fingerprint).alias("was")), key).filter(root(F.col("fp")) != root(F.col("was")))
    cut = lambda c: pairs.select(key, F.posexplode(parts(F.col(c))).alias("section", "body"))
    news = cut("fp").join(cut("was").select(key, "body").distinct(), [key, "body"], "left_anti")
    lines = news.select(key, "section", F.posexplode(F.split("body", r"\|")).alias("paragraph", "line"))
    known = cut("was").select(key, F.explode(F.split("body", r"\|")).alias("line")).distinct()
    return lines.join(known, [key, "line"], "left_anti").select(key, "section", "paragraph")


def phrases_of(text: Column) -> Column:
    """The same straight from a text."""
    cut = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)), lambda x: F.substring(sha(x), 1, 6))
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), cut)))


def head_of_next(docs: DataFrame, share: int) -> DataFrame:
    """``docs`` (file, pos, doc_id, text) with as many first characters of the next text in descending id as 1/``share`` of this one, and its phrases.

    Only keys, ids and lengths are sorted. Texts are shuffled by their key, once for
    both joins (each takes the same four columns); a text sends its head and its
    phrases on to the one before it. After the last comes the first.
    """
    narrow = docs.select("file", "pos", "doc_id", F.length("text").alias("size"), F.xxhash64("text").alias("h"))
    lined = placed(narrow, [F.col("doc_id").desc_nulls_last(), F.col("h").asc(), F.col("file").asc(), F.col("pos").asc()], "place", "part").select("file", "pos", "size", "place")
    total = lined.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    take = lined.select(F.pmod(F.col("place") + 1, F.lit(max(total, 1))).alias("place"), F.col("file").alias("to_file"), F.col("pos").alias("to_pos"), F.floor(F.col("size") / share).cast("int").alias("take"))
    sends = lined.select("file", "pos", "place").join(take, "place").drop("place")
    head = F.substring(F.col("text"), F.lit(1), F.col("take"))
    heads = docs.join(sends, ["file", "pos"]).select(F.col("to_file").alias("file"), F.col("to_pos").alias("pos"), head.alias("head"), F.col("doc_id").alias("next_id"), phrases_of(F.col("text")).alias("next_phrases"))
    return docs.join(heads, ["file", "pos"])


def edited(df: DataFrame, id_: str, text: str, share: int = 3) -> DataFrame:
    """Every text beside its edit (its last 1/``share`` replaced by the head of the next text), with both fingerprints and their likeness."""
    rows = row_keyed(df.select(F.col(f"`{id_}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), "file", "pos").select("file", "pos", "doc_id", "text")
    rows = head_of_next(rows, share)
    n = F.length("text")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / share)).cast("int")), F.col("head")))
    rows = with_fingerprint(with_fingerprint(rows, "text", "fingerprint"), "edited", "edited_fingerprint")
    rows = edited_span(rows.withColumn("own", phrases(F.col("fingerprint"))), "fingerprint", "edited_fingerprint")
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "text", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), phrases(F.col("edited_fingerprint"))).alias("near_edited"), likeness(F.col("own"), F.col("next_phrases")).alias("near_next"), "next_id", "edit_section", "edit_paragraph",
    )
