"""Scalar functions with known values."""

import math

from pyspark.sql import functions as F

from asofkit.functions import physics as Y
from asofkit.functions import prob as P
from asofkit.functions import rules as R
from asofkit.functions import text as T
from asofkit.functions import timefn as D
from asofkit.functions import vectors as V
from asofkit.sources.flatten import classify_transaction


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]


def test_text(spark):
    r = one(spark, T.norm_name(F.lit("José Ramírez Jr.")), T.norm_name(F.lit("jose-ramirez")), T.strip_position(F.lit("josh-lowe-3b")), T.strip_position(F.lit("al-c")), T.key_text(F.lit("777.0")),
            T.key_text(F.lit("nan")), T.key_text(F.lit("1.50")), T.dimension(F.lit("400-C, 325-R, 332-L"), "L"), T.height_inches(F.lit("6' 2\"")), T.bet_side(F.lit(" YES ")), T.bet_side(F.lit("x")))
    assert tuple(r) == ("jose ramirez", "jose ramirez", "josh lowe", "al c", "777", "", "1.5", 332, 74, "over", None)


def test_clock_and_season(spark):
    r = one(spark, D.clock_24h(F.lit("7:10 PM ET")), D.clock_24h(F.lit("12:05 am")), D.clock_24h(F.lit("soon")), D.season_of(F.lit("2024-02-10").cast("date")), D.slate_date(F.lit("2024-07-02 01:40:00").cast("timestamp_ntz")).cast("string"))
    assert tuple(r) == ("19:10", "00:05", None, 2023, "2024-07-01")


def test_numbers(spark):
    r = one(spark, Y.ip_to_outs(F.lit("5.2")), Y.haversine_km(F.lit(40.0), F.lit(-74.0), F.lit(40.0), F.lit(-74.0)), P.clip(F.lit(None).cast("double"), 0.0), P.num(F.lit("x")), P.eb_rate(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.3), 50))
    assert tuple(r) == (17, 0.0, None, None, 0.3)


def test_tails_match_direct_sums(spark):
    m, v, k = 2.3, 4.1, 5
    r = one(spark, P.poisson_tail(F.lit(m), k), P.negbin_tail(F.lit(m), F.lit(v), k), P.count_tail(F.lit(m), F.lit(1.0), 0))
    pois = 1 - sum(math.exp(-m) * m**i / math.factorial(i) for i in range(k + 1))
    rr = m * m / (v - m)
    q = rr / (rr + m)
    nb = 1 - sum(math.exp(math.lgamma(i + rr) - math.lgamma(rr) - math.lgamma(i + 1)) * q**rr * (1 - q) ** i for i in range(k + 1))
    assert abs(r[0] - pois) < 1e-12 and abs(r[1] - nb) < 1e-10 and abs(r[2] - (1 - math.exp(-m))) < 1e-12


def test_tree_and_blends_keep_mass(spark):
    gate, kind = F.array(*map(F.lit, (0.2, 0.1, 0.05, 0.65))), F.array(*map(F.lit, (0.5, 0.3, 0.2)))
    out = F.array(*[F.array(*map(F.lit, v)) for v in ((0.7, 0.3), (0.6, 0.4), (0.1, 0.9))])
    r = one(spark, V.tree_compose(gate, kind, out), V.kind_given_outcome(kind, out), V.blend_geometric(F.array(gate, gate)), V.class_tilt(gate, [0.5, 0, 0, 0], F.lit(0.0)))
    assert abs(sum(r[0]) - 1) < 1e-12 and len(r[0]) == 5
    assert all(abs(sum(x) - 1) < 1e-12 for x in r[1])
    assert all(abs(a - b) < 1e-12 for a, b in zip(r[2], (0.2, 0.1, 0.05, 0.65))) and abs(r[3][0] - 0.2) < 1e-12


def test_score_and_tiers(spark):
    r = one(spark, P.composite_score(F.lit(8.0), F.lit(0.70), F.lit(0.0), F.lit(1.0), F.lit(2.5), F.lit(None).cast("double")), P.tier_of(F.lit(72.0)), P.tier_of(F.lit(10.0)), P.tier_of(F.lit(None).cast("double")))
    assert abs(r[0] - 100) < 1e-9 and tuple(r)[1:] == ("1 ELITE", "6 AVOID", "-")


def test_rules(spark):
    ids = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    nine = ids(*range(9))
    r = one(spark, R.side_source(ids(), nine), R.side_source(ids(1, 2), ids(1, 2)), R.side_source(ids(1), ids(1, 2)), R.slate_floor(F.lit(0), F.lit(3)), R.slate_floor(F.lit(2), F.lit(3)),
            R.capture_verdict(F.lit(5), F.lit(5), F.lit(0), F.lit(False)), R.capture_verdict(F.lit(0), F.lit(0), F.lit(0), F.lit(False)), R.capture_verdict(F.lit(5), F.lit(0), F.lit(0), F.lit(False)))
    assert (r[0].tag, r[0].completed) == ("full", True) and r[1].tag == "mlb" and r[2].tag == "top"
    assert tuple(r)[3:] == ("REFUSE empty", "OK short", "FAILED", "OK", "DEGRADED empty")


def test_transactions(spark):
    r = one(spark, classify_transaction(F.lit("X placed Y on the 10-day injured list")), classify_transaction(F.lit("sent on a rehab assignment")), classify_transaction(F.lit("signed Y")))
    assert (r[0].kind, r[0].days) == ("place", 10) and r[1].kind == "rehab" and r[2].kind is None


def test_key_text_keeps_digits(spark):
    from asofkit.functions.text import key_text

    want = {"1234567890123456789": "1234567890123456789", "1234567890123456788": "1234567890123456788", "777.0": "777", "1.50": "1.5", "1e3": "1000", "nan": "", " 5 ": "5", "abc": "abc", "12345678901234567.000": "12345678901234567", "2.5e17": "250000000000000000"}
    got = {r.s: r.k for r in spark.createDataFrame([(s,) for s in want], "s string").select("s", key_text("s").alias("k")).collect()}
    assert got == want


def test_rank_over_wide_deviations(spark):
    from pyspark.sql import functions as F

    from asofkit.operators.ranking import global_rank

    rows = [(1, 0, 3000.0), (2, 0, 6000.0), (3, 1, 2.5e6), (4, 1, 10.0), (5, 1, None)]
    s = spark.createDataFrame(rows, "k int, tier int, dev double")
    chunk = F.struct("tier", (-F.floor(F.coalesce("dev", F.lit(-1.0)))).alias("depth"))
    got = global_rank(s, [F.col("tier"), F.desc_nulls_last("dev"), F.col("k")], chunk, "r").orderBy("r").collect()
    assert [r.k for r in got] == [2, 1, 3, 4, 5]


def test_names_follow_the_decomposition_rule(spark):
    import unicodedata

    from asofkit.functions.text import norm_name

    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).isalpha()]
    plain = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in letters}
    rows = [(f"x{c}y", f"x{p}y".lower()) for c, p in plain.items() if len(p) < 2]
    got = spark.createDataFrame(rows, "s string, want string").withColumn("got", norm_name("s")).filter("got <> want")
    assert [(r.s, r.got) for r in got.collect()] == []
