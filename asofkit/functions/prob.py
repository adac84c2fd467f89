"""Probabilities: clipping, logit maps, shrinkage, losses, tails, score qualities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LOSS_EPS = 1e-6


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value, keeping NULL as NULL (greatest/least alone skip NULLs)."""
    v = _c(x)
    y = v
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(v.isNotNull(), y)


def nan_to_null(x) -> Column:
    v = _c(x)
    return F.when(~F.isnan(v), v)


def num(x) -> Column:
    """Lenient numeric coercion: anything unreadable (or NaN) becomes NULL."""
    return nan_to_null(_c(x).try_cast("double"))


def safe_div(a, b) -> Column:
    return F.try_divide(_c(a).cast("double"), F.nullif(_c(b).cast("double"), F.lit(0.0)))


def ratio_floor(a, b, floor: float = 1e-9) -> Column:
    """a / max(b, floor), NULL when either is missing."""
    return _c(a) / clip(b, floor)


def logit(p, eps: float = LOSS_EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q) - F.log(F.lit(1.0) - q)


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def platt(p, a, b) -> Column:
    """Two-parameter map in logit space; strictly monotone for b > 0."""
    return sigmoid(_c(a) + _c(b) * logit(p))


def logit_blend(p, q, w: float = 0.5) -> Column:
    """Weighted mean of two probabilities in logit space; p alone when q is missing."""
    mixed = sigmoid((1 - w) * logit(p) + w * logit(q))
    return F.when(_c(q).isNull(), _c(p)).otherwise(mixed)


def anchor_shrink(p, sigma, anchor, lam: float = 1.0) -> Column:
    """Pull an uncertain probability toward its anchor in logit space, weight 1 / (1 + lam * sigma^2)."""
    za = logit(anchor)
    w = F.lit(1.0) / (F.lit(1.0) + F.lit(float(lam)) * _c(sigma) * _c(sigma))
    return sigmoid(za + w * (logit(p) - za))


def log_odds_margin(p1, p2) -> Column:
    return logit(p1) - logit(p2)


def eb_rate(x, n, prior, k) -> Column:
    """Empirical-Bayes rate (x + k*prior) / (n + k); missing history counts as zero."""
    zero = F.lit(0.0)
    return (F.coalesce(_c(x), zero) + _c(k) * _c(prior)) / (F.coalesce(_c(n), zero) + _c(k))


def shrunk_rates(
    classes: Sequence[str], counts: Mapping[str, Column], n, priors: Mapping[str, Column], k: Mapping[str, Column],
    prefix: str = "", own_priors: Mapping[str, Column] | None = None, min_own: float = 400.0,
) -> list[Column]:
    """Rate columns for a class list plus log1p of the exposure. A personal prior stands
    in for the league prior while the exposure is below ``min_own``."""
    own = own_priors or {}
    seen = F.coalesce(_c(n), F.lit(0.0))
    out = []
    for c in classes:
        prior = priors[c]
        if c in own:
            prior = F.when((seen < min_own) & own[c].isNotNull(), own[c]).otherwise(prior)
        out.append(eb_rate(counts[c], n, prior, k[c]).alias(f"{prefix}{c}_rate"))
    out.append(F.log1p(seen).alias(f"{prefix}log_n"))
    return out


def log_loss(y, p) -> Column:
    q = clip(p, LOSS_EPS, 1 - LOSS_EPS)
    return -(_c(y) * F.log(q) + (F.lit(1.0) - _c(y)) * F.log(F.lit(1.0) - q))


def brier(y, p) -> Column:
    return (_c(p) - _c(y)) * (_c(p) - _c(y))


def entropy2(b) -> Column:
    q = clip(b, 1e-12, 1 - 1e-12)
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def variance_from_sums(n, s, ss) -> Column:
    """Population variance from count, sum and sum of squares (not below zero)."""
    m = safe_div(s, n)
    return clip(safe_div(ss, n) - m * m, 0.0)


def odds_ratio_lift(lift, base) -> Column:
    """Hit odds of the top picks over the base odds; NULL for a degenerate base."""
    top = F.least(_c(lift) * _c(base), F.lit(1 - 1e-6))
    ok = _c(lift).isNotNull() & (_c(base) > 0) & (_c(base) < 1)
    return F.when(ok, (top / (1 - top)) / (_c(base) / (1 - _c(base))))


def poisson_tail(mean, k: int | Column) -> Column:
    """P(X > k) for a Poisson count, by the pmf recurrence."""
    m = _c(mean)
    kk = _c(k).cast("int")
    start = F.struct(F.exp(-m).alias("pmf"), F.exp(-m).alias("cdf"))
    step = F.aggregate(
        F.when(kk >= 1, F.sequence(F.lit(1), kk)).otherwise(F.array().cast("array<int>")),
        start,
        lambda a, i: F.struct((a["pmf"] * m / i).alias("pmf"), (a["cdf"] + a["pmf"] * m / i).alias("cdf")),
        lambda a: a["cdf"],
    )
    return F.greatest(F.lit(0.0), F.lit(1.0) - step)


def negbin_tail(mean, var, k: int | Column) -> Column:
    """P(X > k) for a negative binomial matched to mean and variance."""
    m, v = _c(mean), _c(var)
    r = m * m / (v - m)
    q = r / (r + m)
    kk = _c(k).cast("int")
    p0 = F.pow(q, r)
    step = F.aggregate(
        F.when(kk >= 1, F.sequence(F.lit(1), kk)).otherwise(F.array().cast("array<int>")),
        F.struct(p0.alias("pmf"), p0.alias("cdf")),
        lambda a, i: F.struct(
            (a["pmf"] * (i - 1 + r) / i * (1 - q)).alias("pmf"),
            (a["cdf"] + a["pmf"] * (i - 1 + r) / i * (1 - q)).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )
    return F.greatest(F.lit(0.0), F.lit(1.0) - step)


def count_tail(mean, var, k: int | Column) -> Column:
    """Negative binomial when the counts are over-dispersed, Poisson otherwise."""
    m, v = _c(mean), _c(var)
    safe_v = F.when(v > m * 1.0001, v).otherwise(m + 1.0)
    return F.when(v > m * 1.0001, negbin_tail(m, safe_v, k)).otherwise(poisson_tail(m, k))


def recency_weight(age_days, half_life_years: float) -> Column:
    return F.pow(F.lit(0.5), _c(age_days) / F.lit(365.25) / F.lit(float(half_life_years)))


# Fixed values of the composite score: pillar weights, sample floor, full-quality edge, tier cuts.
PILLAR_WEIGHTS = {"edge": 0.40, "auc": 0.20, "cal": 0.20, "lift": 0.10, "vsclose": 0.10}
VSCLOSE_FULL = 0.02
TIER_CUTS = (
    (72.0, "1 ELITE"), (60.0, "2 STRONG"), (48.0, "3 SOLID"), (44.0, "4 DECENT"), (41.0, "5 LOW CEILING"),
)
TIER_FLOOR = "6 AVOID"


def _unit(x: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(0.0))


def composite_score(rel, auc, ece_rel, slope, or_lift, vsclose) -> Column:
    """0-100 score; a missing market pillar drops out and the rest renormalise."""
    zero = F.lit(0.0)

    def q(v: Column, x: Column) -> Column:
        return F.when(v.isNotNull(), _unit(x)).otherwise(zero)

    parts = {
        "edge": q(_c(rel), _c(rel) / 8.0),
        "auc": q(_c(auc), (_c(auc) - 0.5) / 0.20),
        "cal": 0.5 * q(_c(ece_rel), 1 - _c(ece_rel) / 0.10) + 0.5 * q(_c(slope), 1 - F.abs(_c(slope) - 1) / 0.5),
        "lift": q(_c(or_lift), (_c(or_lift) - 1) / 1.5),
    }
    total = sum((F.lit(PILLAR_WEIGHTS[k]) * v for k, v in parts.items()), zero)
    wsum = sum(PILLAR_WEIGHTS[k] for k in parts)
    vs = _c(vsclose)
    with_vs = (total + PILLAR_WEIGHTS["vsclose"] * _unit(vs / VSCLOSE_FULL)) / (wsum + PILLAR_WEIGHTS["vsclose"])
    return 100 * F.when(vs.isNotNull(), with_vs).otherwise(total / wsum)


def tier_of(score) -> Column:
    s = _c(score)
    out = F.when(s.isNull(), "-")
    for cut, label in TIER_CUTS:
        out = out.when(s >= cut, label)
    return out.otherwise(TIER_FLOOR)
