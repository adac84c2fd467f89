"""Deterministic draws that any SQL engine can repeat (no rand())."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofkit.functions.prob import _c

M = 2147483648  # 2^31


def mix(a, b, seed: int = 7) -> Column:
    """Integer in [0, 2^31): two linear-congruential rounds over two small integers."""
    x = (_c(a).cast("long") * 1103515245 + _c(b).cast("long") * 12345 + F.lit(seed).cast("long")) % M
    y = (x * 69069 + 1) % M
    return (y * 1103515245 + 12345) % M


def draw(a, b, n, seed: int = 7) -> Column:
    """Integer in [0, n) from the high bits of ``mix``."""
    return F.floor(mix(a, b, seed) / F.lit(4096)).cast("long") % _c(n).cast("long")


def mix_sql(a: str, b: str, seed: int = 7) -> str:
    x = f"(CAST({a} AS BIGINT)*1103515245 + CAST({b} AS BIGINT)*12345 + {seed}) % {M}"
    return f"((((({x})*69069 + 1) % {M})*1103515245 + 12345) % {M})"


def draw_sql(a: str, b: str, n: str, seed: int = 7) -> str:
    return f"(({mix_sql(a, b, seed)} // 4096) % ({n}))"
