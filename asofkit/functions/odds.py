"""Prices: American odds, fair probabilities, stakes and profit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofkit.functions.prob import _c


def american_to_prob(price) -> Column:
    """Implied probability with the margin; NULL for a blank, zero or non-finite price."""
    p = _c(price).try_cast("double")
    ok = p.isNotNull() & ~F.isnan(p) & (p != 0) & (F.abs(p) != F.lit(float("inf")))
    return F.when(ok & (p < 0), -p / (-p + 100.0)).when(ok, 100.0 / (p + 100.0))


def decimal_odds(price) -> Column:
    return F.lit(1.0) / F.nullif(american_to_prob(price), F.lit(0.0))


def no_vig(over, under) -> Column:
    """Fair over-probability by proportional margin removal; NULL unless two-sided."""
    a, b = american_to_prob(over), american_to_prob(under)
    return F.when(a + b > 0, a / (a + b))


def shin_no_vig(over, under) -> Column:
    """Fair over-probability of the two-outcome insider-share model, solved in closed form.

    With booksum B and unknown share z each fair price solves a quadratic; requiring
    both to sum to one leaves one linear equation for a = (1 - z) / B. Falls back to
    the proportional price when there is no margin or the share leaves [0, 1).
    """
    pair = F.array(F.struct(american_to_prob(over).alias("a"), american_to_prob(under).alias("b")))
    return F.transform(pair, lambda x: shin_from_probs(x["a"], x["b"]))[0]


def shin_from_probs(a: Column, b: Column) -> Column:
    """The same from implied probabilities; inner values are bound once by one-element transforms."""
    def solve(v: Column) -> Column:
        fair = (1.0 + v["share"] * v["gap"] - v["z"]) / (2.0 * (1.0 - v["z"]))
        usable = (v["book"] > 1.0) & v["share"].isNotNull() & (v["z"] >= 0.0) & (v["z"] < 1.0)
        return F.when(v["book"] <= 0, None).when(F.coalesce(usable, F.lit(False)), fair).otherwise(v["a"] / v["book"])

    def with_z(v: Column) -> Column:
        share = 2.0 * (v["sq"] - v["book"]) / F.nullif(v["gap"] * v["gap"] - v["book"] * v["book"], F.lit(0.0))
        return F.transform(F.array(share), lambda s: F.struct(v["a"], v["book"], v["gap"], s.alias("share"), (1.0 - s * v["book"]).alias("z")))[0]

    first = F.array(F.struct(a.alias("a"), (a + b).alias("book"), (a * a - b * b).alias("gap"), (a * a + b * b).alias("sq")))
    return F.transform(F.transform(first, with_z), solve)[0]


def expected_value(p, price) -> Column:
    return _c(p) * decimal_odds(price) - 1.0


def kelly(p, price, fraction: float = 0.25) -> Column:
    d = decimal_odds(price)
    return F.greatest(F.lit(0.0), F.lit(fraction) * (_c(p) * d - 1.0) / F.nullif(d - 1.0, F.lit(0.0)))


def profit(outcome, stake, price) -> Column:
    """Units won or lost for win / lose / push (0 for anything else)."""
    o = _c(outcome)
    win = F.coalesce(_c(stake) * (decimal_odds(price) - 1.0), F.lit(0.0))
    return F.when(o == "win", win).when(o == "lose", -_c(stake)).otherwise(F.lit(0.0))


def closing_value(p_close_side, implied) -> Column:
    """Closing-line value: fair closing probability of the side less the implied one taken."""
    return _c(p_close_side) - _c(implied)
