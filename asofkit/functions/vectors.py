"""Class-probability vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofkit.functions.prob import _c


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalise(v) -> Column:
    a = _c(v)
    total = asum(a)
    return F.transform(a, lambda x: x / total)


def tree_compose(gate, kind, outcome_by_kind) -> Column:
    """Flatten a three-level tree.

    ``gate`` = [p1..pm, p_in]; ``kind`` = shares of m2 kinds given "in";
    ``outcome_by_kind`` = per kind an outcome vector. Result: the first m gate
    classes, then p_in times the kind-weighted outcome vector.
    """
    g, k, o = _c(gate), _c(kind), _c(outcome_by_kind)
    joint = F.zip_with(k, o, lambda w, v: F.transform(v, lambda x: x * w))
    zero = F.transform(F.element_at(o, 1), lambda x: F.lit(0.0))
    marg = F.aggregate(joint, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    p_in = F.element_at(g, -1)
    return F.concat(F.slice(g, F.lit(1), F.size(g) - 1), F.transform(marg, lambda x: x * p_in))


def kind_given_outcome(kind, outcome_by_kind) -> Column:
    """P(kind | outcome) for each outcome: array over outcomes of arrays over kinds."""
    k, o = _c(kind), _c(outcome_by_kind)
    n_out = F.size(F.element_at(o, 1))

    def one(j: Column) -> Column:
        col = F.zip_with(k, o, lambda w, v: w * F.element_at(v, j))
        return F.transform(col, lambda x: x / F.greatest(asum(col), F.lit(1e-12)))

    return F.transform(F.sequence(F.lit(1), n_out), one)


def blend_mean(members) -> Column:
    """Arithmetic mean of member vectors, renormalised."""
    m = _c(members)
    zero = F.transform(F.element_at(m, 1), lambda x: F.lit(0.0))
    return normalise(F.aggregate(m, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)))


def blend_geometric(members) -> Column:
    m = _c(members)
    zero = F.transform(F.element_at(m, 1), lambda x: F.lit(0.0))
    logs = F.aggregate(
        m, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + F.log(F.greatest(y, F.lit(1e-12))))
    )
    n = F.size(m)
    return normalise(F.transform(logs, lambda x: F.exp(x / n)))


def member_logit_std(members, j: int) -> Column:
    """Population standard deviation across members of the logit of class j (1-based), probabilities kept off 0 and 1 by 1e-12."""
    inner = lambda v: F.greatest(F.least(F.element_at(v, j), F.lit(1 - 1e-12)), F.lit(1e-12))
    z = F.transform(_c(members), lambda v: F.log(inner(v) / (1 - inner(v))))
    n = F.size(z)
    mean = asum(z) / n
    return F.sqrt(asum(F.transform(z, lambda x: (x - mean) * (x - mean))) / n)


def class_tilt(v, betas: list[float], f) -> Column:
    """Multiply class i by exp(beta_i * f), then renormalise."""
    b = F.array(*[F.lit(float(x)) for x in betas])
    return normalise(F.zip_with(_c(v), b, lambda p, beta: p * F.exp(beta * _c(f))))


def vector_log_loss(v, label_index) -> Column:
    return -F.log(F.greatest(F.element_at(_c(v), _c(label_index).cast("int")), F.lit(1e-9)))
