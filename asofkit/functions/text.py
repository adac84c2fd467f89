"""Names, keys and free-text fields."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofkit.functions.prob import _c

# Letters that a compatibility decomposition turns into one plain letter; others that are not ASCII (such as a slashed o) are dropped.
_LETTERS = {c: d for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if len(d := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1}
ACCENTED, PLAIN = "".join(_LETTERS), "".join(_LETTERS.values())
# Position tokens.
POSITION_TOKENS = (
    "p", "c", "1b", "2b", "3b", "ss", "lf", "cf", "rf", "of", "dh", "if", "sp", "rp", "ph", "pr", "util",
)


def norm_name(name) -> Column:
    """Lower-case plain letters and single spaces; generation suffixes dropped."""
    s = F.lower(F.translate(F.regexp_replace(_c(name), "-", " "), ACCENTED, PLAIN))
    s = F.regexp_replace(s, r"[^\x00-\x7f]", "")
    s = F.regexp_replace(s, r"\b(jr|sr|ii|iii|iv)\b", " ")
    s = F.regexp_replace(s, "[^a-z ]", " ")
    return F.trim(F.regexp_replace(s, r" +", " "))


def strip_position(name) -> Column:
    """Drop a trailing position token of a dashed or spaced name of three or more parts."""
    parts = F.filter(F.split(F.regexp_replace(_c(name), "-", " "), r"\s+"), lambda x: x != "")
    n = F.size(parts)
    tail = F.lower(F.get(parts, n - 1))
    cut = (n > 2) & tail.isin(*POSITION_TOKENS)
    return F.array_join(F.when(cut, F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(parts), " ")


def collapsed(norm) -> Column:
    return F.regexp_replace(_c(norm), " ", "")


def last_name(norm) -> Column:
    return F.element_at(F.split(_c(norm), " "), -1)


def first_initial(norm) -> Column:
    return F.substring(_c(norm), 1, 1)


def key_text(v) -> Column:
    """Canonical key text: blanks and NaN words to '', 777.0 to 777, 1.50 to 1.5."""
    s = F.trim(F.coalesce(_c(v).cast("string"), F.lit("")))
    blank = s.isin("", "nan", "None", "none", "NaN", "<NA>")
    # Ordinary decimals are normalised as text; only unusual spellings go through a cast, because a
    # failing cast costs an exception per row.
    plain = s.rlike(r"^(0|-?[1-9][0-9]*)([.](0+|[0-9]{1,10}))?$")
    trimmed = F.regexp_replace(s, r"[.]0+$|([.][0-9]*[1-9])0+$", "$1")
    odd = s.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    d = s.try_cast("double")
    whole = (F.abs(d) < 1e38) & (d == F.round(d))
    spelled = F.when(whole, d.cast("decimal(38,0)").cast("string")).otherwise(d.cast("string"))
    return F.when(blank, F.lit("")).when(plain, trimmed).when(odd, F.coalesce(spelled, s)).otherwise(s)


def weather_temp(text) -> Column:
    return F.regexp_extract(_c(text), r"^(-?\d+)\s*degrees", 1).try_cast("int")


def weather_condition(text) -> Column:
    return F.trim(F.regexp_extract(_c(text), r"^-?\d+\s*degrees,?\s*(.*?)\.?$", 1))


def wind_speed(text) -> Column:
    return F.regexp_extract(_c(text), r"^(\d+)\s*mph", 1).try_cast("int")


def wind_direction(text) -> Column:
    return F.trim(F.regexp_extract(_c(text), r"^\d+\s*mph,?\s*(.*?)\.?$", 1))


def roof_closed(condition) -> Column:
    return F.coalesce(_c(condition).rlike("(?i)dome|roof closed"), F.lit(False))


def dimension(text, side: str) -> Column:
    """Feet for side L, C or R in text such as '332-L, 400-C, 325-R', in any order."""
    return F.regexp_extract(_c(text), rf"(\d+)-{side}", 1).try_cast("int")


def height_inches(text) -> Column:
    """Height such as 6' 2" in inches."""
    ft = F.regexp_extract(_c(text), r"(\d+)'", 1).try_cast("int")
    inch = F.regexp_extract(_c(text), r"'\s*(\d+)", 1).try_cast("int")
    return ft * 12 + F.coalesce(inch, F.lit(0))


def bet_side(label) -> Column:
    """over/yes -> over, under/no -> under, else NULL."""
    n = F.lower(F.trim(F.coalesce(_c(label), F.lit(""))))
    return F.when(n.isin("over", "yes"), "over").when(n.isin("under", "no"), "under")
