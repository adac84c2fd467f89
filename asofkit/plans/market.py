"""Captures, prices and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions import odds as O
from asofkit.functions import prob as P
from asofkit.functions.hashing import draw_sql
from asofkit.operators import evaluation as E
from asofkit.operators import market as M
from asofkit.plans._roles import CAP, EV, LED, captures, events, ledger, prob_sql
from asofkit.plans.evaluation import ll_sql, logit_sql, r6
from asofkit.registry import query
from asofkit.session import cut_lineage

KEY = ["entity", "market", "line", "book", "game"]

# state machine replayed as set logic on the event log: eligible two-sided rows against the newest one-sided seen
COMPACT = """x AS (SELECT *, over IS NOT NULL AND under IS NOT NULL AS two, row_number() OVER (PARTITION BY entity, market, line, book, game ORDER BY arr) AS o FROM arr),
m AS (SELECT a.*, (SELECT max(b.ts) FROM x b WHERE b.entity = a.entity AND b.market = a.market AND b.line = a.line AND b.book = a.book AND b.game IS NOT DISTINCT FROM a.game AND NOT b.two AND b.arr < a.arr) AS mx FROM x a),
i0 AS (SELECT entity, market, line, book, game, min(arr) FILTER (WHERE two AND (mx IS NULL OR ts >= mx)) AS i0 FROM m GROUP BY ALL),
store AS (SELECT m.entity, m.market, m.line, m.book, m.game, min(ts) AS open_ts, arg_min(struct_pack(o := over, u := under), (ts, arr)) AS op,
  CASE WHEN any_value(i0.i0) IS NOT NULL THEN arg_max(struct_pack(t := ts, o := over, u := under), (ts, -arr)) FILTER (WHERE two AND arr >= i0.i0) ELSE arg_max(struct_pack(t := ts, o := over, u := under), (ts, -arr)) FILTER (WHERE NOT two) END AS cl, count(*) AS n_captures
  FROM m JOIN i0 ON m.entity = i0.entity AND m.market = i0.market AND m.line = i0.line AND m.book = i0.book AND m.game IS NOT DISTINCT FROM i0.game GROUP BY ALL)"""
ARR = "arr AS (SELECT *, (seq * 7919) % 1000003 AS arr FROM cap)"
STORE_SEL = """s AS (SELECT entity, market, CAST(line AS DOUBLE) AS line, book, game, open_ts, op.o AS open_over, op.u AS open_under, cl.t AS close_ts, cl.o AS close_over, cl.u AS close_under, n_captures FROM store)"""


def store(spark, d, shuffled=False):
    """Compacted store; ``shuffled`` lets rows arrive out of time order."""
    c = captures(spark, d)
    arr = (F.col("seq") * 7919) % 1000003 if shuffled else F.col("seq")
    c = c.withColumn("arr", arr).withColumn("line", F.col("line").cast("double")).withColumn("game", F.coalesce("game", F.lit(-1)))
    s = M.compact_captures(c, KEY, "ts", "over", "under", "arr", F.floor(F.col("arr") / 1000), in_order=not shuffled)
    return s.withColumn("game", F.when(F.col("game") != -1, F.col("game")))


ARR_T = "arr AS (SELECT *, seq AS arr FROM cap)"


@query("D7 ST5", f"WITH {EV}, {CAP}, {ARR}, {COMPACT}, {STORE_SEL} SELECT * FROM s")
def capture_compaction(spark, d):
    """Open/close per key from captures that arrive out of order."""
    return store(spark, d, shuffled=True)


@query("D7", f"WITH {EV}, {CAP}, {ARR_T}, {COMPACT}, {STORE_SEL} SELECT * FROM s")
def capture_compaction_ordered(spark, d):
    return store(spark, d)


FOLD = """n AS (SELECT entity, market, line, book, count(*) AS n, min(open_ts) AS so FROM s WHERE game IS NOT NULL GROUP BY 1, 2, 3, 4),
f AS (SELECT s.*, coalesce(n.n = 1 AND s.close_ts < n.so, FALSE) AS fold FROM s LEFT JOIN n USING (entity, market, line, book) WHERE s.game IS NULL)"""


@query("D8", f"""WITH {EV}, {CAP}, {ARR_T}, {COMPACT}, {STORE_SEL}, {FOLD}
SELECT s.entity, s.market, s.line, s.book, s.game, CASE WHEN f.open_ts < s.open_ts THEN f.open_ts ELSE s.open_ts END AS open_ts, CASE WHEN f.open_ts < s.open_ts THEN f.open_over ELSE s.open_over END AS open_over, s.close_ts
FROM s LEFT JOIN f ON f.fold AND f.entity = s.entity AND f.market = s.market AND f.line = s.line AND f.book = s.book WHERE s.game IS NOT NULL
UNION ALL SELECT entity, market, line, book, game, open_ts, open_over, close_ts FROM f WHERE NOT fold""")
def legacy_key_fold(spark, d):
    r = M.fold_legacy(store(spark, d), ["entity", "market", "line", "book"], "game")
    return r.select("entity", "market", "line", "book", "game", "open_ts", "open_over", "close_ts")


def shin_sql(o: str, u: str) -> str:
    a, b = prob_sql(o), prob_sql(u)
    return f"""(SELECT CASE WHEN bk <= 1 OR den = 0 OR z < 0 OR z >= 1 THEN a / bk ELSE (1 + sh * gap - z) / (2 * (1 - z)) END FROM (SELECT *, 1 - sh * bk AS z FROM (SELECT *, 2 * (a*a + b*b - bk) / nullif(den, 0) AS sh FROM (SELECT *, gap*gap - bk*bk AS den FROM (SELECT {a} AS a, {b} AS b, {a} + {b} AS bk, {a}*{a} - {b}*{b} AS gap)))))"""


@query("X17 X18", f"""WITH {EV}, {CAP} SELECT seq, round({prob_sql('over')}, 8) AS p_over, round(1 / {prob_sql('over')}, 8) AS dec_over,
 round({prob_sql('over')} / ({prob_sql('over')} + {prob_sql('under')}), 8) AS fair, round({shin_sql('over', 'under')}, 8) AS shin FROM cap""")
def odds_functions(spark, d):
    c = captures(spark, d)  # blank prices give NULL
    return r6(c.select("seq", O.american_to_prob("over").alias("p_over"), O.decimal_odds("over").alias("dec_over"), O.no_vig("over", "under").alias("fair"),
                       O.shin_no_vig("over", "under").alias("shin")), "seq", n=8)


PK = ["entity", "market", "line"]
FAIR = f"q AS (SELECT *, {prob_sql('close_over')} / ({prob_sql('close_over')} + {prob_sql('close_under')}) AS f FROM s), fair AS (SELECT entity, market, line, coalesce(avg(f) FILTER (WHERE book = 'purchase'), median(f)) AS fair, count(DISTINCT book) AS two_sided_books FROM q WHERE f IS NOT NULL GROUP BY 1, 2, 3)"


def _named(spark, d):
    """The compacted store with one event type standing in for the preferred book."""
    return store(spark, d).withColumn("book", F.when(F.col("book") == "purchase", "pinnacle").otherwise(F.col("book")))


@query("A35", f"WITH {EV}, {CAP}, {ARR_T}, {COMPACT}, {STORE_SEL}, {FAIR} SELECT entity, market, line, round(fair, 6) AS fair, two_sided_books FROM fair")
def consensus_fair_price(spark, d):
    return r6(M.consensus_fair(_named(spark, d), PK, "close_over", "close_under", "book"), *PK, "two_sided_books")


@query("A35", f"""WITH {EV}, {CAP}, {ARR_T}, {COMPACT}, {STORE_SEL}, {FAIR}, o AS (SELECT entity, market, line, book, game, median({prob_sql('close_over')}) AS o, median({prob_sql('close_under')}) AS u,
 median({prob_sql('close_over')} / ({prob_sql('close_over')} + {prob_sql('close_under')})) AS f2 FROM s GROUP BY ALL)
SELECT entity, market, line, book, game, round(coalesce(f2, CASE WHEN o IS NOT NULL THEN least(greatest(o * 0.9336, 1e-6), 1 - 1e-6) END, CASE WHEN u IS NOT NULL THEN least(greatest(1 - u * 0.9336, 1e-6), 1 - 1e-6) END), 6) AS fair,
 CASE WHEN f2 IS NOT NULL THEN 'two_sided' WHEN o IS NOT NULL OR u IS NOT NULL THEN 'one_sided' END AS fair_via FROM o""")
def one_sided_fair_price(spark, d):
    s = store(spark, d).withColumn("game", F.coalesce("game", F.lit(-1)))
    r = M.soft_fair(s, KEY, "close_over", "close_under", "book")
    return r.select(*KEY[:4], F.when(F.col("game") != -1, F.col("game")).alias("game"), F.round("fair", 6).alias("fair"), "fair_via")


@query("A36", f"""WITH {EV}, {CAP}, {ARR_T}, {COMPACT}, {STORE_SEL}, p AS (SELECT *, 1 / {prob_sql('close_over')} AS dec FROM s WHERE close_over IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, market, line ORDER BY dec DESC, CASE book WHEN 'purchase' THEN 'pinnacle' ELSE book END, close_over) AS rn FROM p)
SELECT r.entity, r.market, r.line, CAST(close_over AS BIGINT) AS best_price, CASE book WHEN 'purchase' THEN 'pinnacle' ELSE book END AS best_book, round(dec, 6) AS best_decimal, b.books FROM r JOIN (SELECT entity, market, line, count(DISTINCT book) AS books FROM p GROUP BY 1, 2, 3) b USING (entity, market, line) WHERE rn = 1""")
def best_price_per_side(spark, d):
    r = M.best_price(_named(spark, d), PK, "close_over", "book")
    return r.select(*PK, F.col("best_price").cast("long").alias("best_price"), "best_book", F.round("best_decimal", 6).alias("best_decimal"), "books")


@query("A37", f"""WITH {EV}, {CAP}, {ARR_T}, {COMPACT}, {STORE_SEL}, g AS (SELECT entity, market, line, max(greatest(0, (epoch_us(close_ts) - epoch_us(open_ts)) / 6e7)) AS gap FROM s GROUP BY 1, 2, 3)
SELECT market, count(*) AS n, round(avg((gap <= 0)::INT), 6) AS pct_1cap, round(median(gap) FILTER (WHERE gap > 0), 4) AS med_gap_min FROM g GROUP BY 1""")
def close_quality(spark, d):
    from asofkit.operators.scan import exact_quantiles

    q = M.close_quality(store(spark, d), PK)
    med = exact_quantiles(q.filter("gap_min > 0"), ["market"], "gap_min", [0.5], F.floor("gap_min"))
    r = q.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.avg("one_cap").alias("pct_1cap")).join(med, "market", "left")
    return r.select("market", "n", F.round("pct_1cap", 6).alias("pct_1cap"), F.round("quantile", 4).alias("med_gap_min"))


@query("G1 W14 J24", f"""WITH {EV}, {CAP}, {ARR_T}, {COMPACT}, {STORE_SEL}, {FAIR}, mdl AS (SELECT user_id AS entity, 'm' || CAST(k % 2 AS VARCHAR) AS market, CAST(k % 2 + 0.5 AS DOUBLE) AS line, avg(1.0 / (1.0 + exp(-((value - 50.0) / 40.0)))) AS p FROM ev GROUP BY 1, 2, 3),
bo AS (SELECT entity, market, line, max(1 / {prob_sql('close_over')}) AS dec FROM s GROUP BY 1, 2, 3), bu AS (SELECT entity, market, line, max(1 / {prob_sql('close_under')}) AS dec FROM s GROUP BY 1, 2, 3),
bk AS (SELECT entity, market, line, count(DISTINCT book) AS books FROM s GROUP BY 1, 2, 3),
u AS (SELECT m.*, books, 'Over' AS side, p AS ps, fair AS fs, bo.dec FROM mdl m JOIN fair USING (entity, market, line) JOIN bk USING (entity, market, line) LEFT JOIN bo USING (entity, market, line)
 UNION ALL SELECT m.*, books, 'Under', 1 - p, 1 - fair, bu.dec FROM mdl m JOIN fair USING (entity, market, line) JOIN bk USING (entity, market, line) LEFT JOIN bu USING (entity, market, line))
SELECT entity, market, line, side, books, round(ps, 6) AS p_side, round(fs, 6) AS fair_side, round(ps * dec - 1, 6) AS ev, nullif(concat_ws('; ', CASE WHEN books = 1 THEN '1 book' END, CASE WHEN dec > 5 THEN 'longshot' END), '') AS note FROM u WHERE ps * dec - 1 >= 0.05""")
def value_screen(spark, d):
    e = events(spark, d)
    m = e.groupBy(F.col("user_id").alias("entity"), F.concat(F.lit("m"), (F.col("k") % 2).cast("string")).alias("market"),
                  (F.col("k") % 2 + F.lit(0.5)).cast("double").alias("line")).agg(F.avg(P.sigmoid((F.col("value") - 50.0) / 40.0)).alias("p"))
    r = M.value_screen(m, _named(spark, d), PK, "p")
    return r.select(*PK, "side", "books", *[F.round(c, 6).alias(c) for c in ("p_side", "fair_side", "ev")], "note")


@query("G2 X19 W14", f"""WITH {EV}, {CAP}, {ARR_T}, {COMPACT}, {STORE_SEL}, {FAIR}, mdl AS (SELECT user_id AS entity, CAST(k % 2 + 0.5 AS DOUBLE) AS line, 'm' || CAST(k % 2 AS VARCHAR) AS market, avg(1.0 / (1.0 + exp(-((value - 50.0) / 40.0)))) AS p FROM ev GROUP BY 1, 2, 3),
b AS (SELECT m.entity, m.line, m.p AS p_pure, CASE WHEN fair IS NULL THEN p ELSE 1 / (1 + exp(-(0.5 * {logit_sql('p')} + 0.5 * {logit_sql('fair')}))) END AS pb FROM mdl m LEFT JOIN fair f ON f.entity = m.entity AND f.market = m.market AND f.line = m.line)
SELECT entity, line, round(p_pure, 6) AS p_pure, round(min(pb) OVER (PARTITION BY entity ORDER BY line), 6) AS p_shown FROM b""")
def market_blend(spark, d):
    """Displayed numbers move half-way to the market in logit space, then the ladder is clamped again."""
    from asofkit.operators.windows import ladder_clamp

    e = events(spark, d)
    m = e.groupBy(F.col("user_id").alias("entity"), (F.col("k") % 2 + F.lit(0.5)).cast("double").alias("line"), F.concat(F.lit("m"), (F.col("k") % 2).cast("string")).alias("market")).agg(
        F.avg(P.sigmoid((F.col("value") - 50.0) / 40.0)).alias("p_pure"))
    f = M.consensus_fair(_named(spark, d), PK, "close_over", "close_under", "book").select(*PK, "fair")
    b = m.join(f, PK, "left").withColumn("pb", P.logit_blend("p_pure", "fair", 0.5))
    return r6(ladder_clamp(b, ["entity"], "line", "pb", "p_shown").select("entity", "line", "p_pure", "p_shown"), "entity", "line")


# --- bets, boxes and finals out of the events ------------------------------------------
BETS = """bets AS (SELECT event_id AS seq, ts, d, CASE WHEN event_id % 6 <> 0 THEN day(d) * 100 + user_id % 10 END AS game, user_id AS entity, 'T' || CAST(user_id % 2 AS VARCHAR) AS team,
  CASE k % 4 WHEN 0 THEN 'batter_hits' WHEN 1 THEN 'pitcher_strikeouts' WHEN 2 THEN 'totals' ELSE 'h2h' END AS market, CASE WHEN k % 4 = 2 THEN 30.0 + k % 3 ELSE k % 3 * 0.5 + 0.5 END AS line,
  'A@H' AS label, 1 AS gnum, CASE WHEN event_id % 2 = 0 THEN 'Over' ELSE 'Under' END AS side, CASE WHEN event_id % 2 = 0 THEN -(100 + (event_id * 31) % 150) ELSE 100 + (event_id * 17) % 200 END AS price,
  1.0 / (1.0 + exp(-((value - 50.0) / 40.0))) AS p_model, CASE WHEN event_id % 8 <> 0 THEN 0.3 + (event_id * 13 % 40) / 100.0 END AS p_close, CAST(1 + event_id % 3 AS BIGINT) AS books, event_type AS family FROM ev),
kb AS (SELECT *, strftime(d, '%Y-%m-%d') || '|' || coalesce(CAST(game AS VARCHAR), '') || '|' || entity || '|' || CASE WHEN market = 'h2h' THEN '' ELSE team END || '|' || market || '|' ||
  CASE WHEN line = floor(line) THEN CAST(CAST(line AS BIGINT) AS VARCHAR) ELSE CAST(CAST(line AS DOUBLE) AS VARCHAR) END || '|' || CASE WHEN game IS NULL THEN label ELSE '' END || '|' || CASE WHEN game IS NULL THEN '1' ELSE '' END AS bet_key FROM bets)"""


def bets(spark, d):
    e, k = F.col("event_id"), F.col("k")
    b = events(spark, d).select(
        e.alias("seq"), "ts", "d", F.when(e % 6 != 0, F.day("d") * 100 + F.col("user_id") % 10).alias("game"), F.col("user_id").alias("entity"),
        F.concat(F.lit("T"), (F.col("user_id") % 2).cast("string")).alias("team"),
        F.when(k % 4 == 0, "batter_hits").when(k % 4 == 1, "pitcher_strikeouts").when(k % 4 == 2, "totals").otherwise("h2h").alias("market"),
        F.when(k % 4 == 2, 30.0 + k % 3).otherwise(k % 3 * 0.5 + 0.5).alias("line"), F.lit("A@H").alias("label"), F.lit(1).alias("gnum"),
        F.when(e % 2 == 0, "Over").otherwise("Under").alias("side"), F.when(e % 2 == 0, -(100 + (e * 31) % 150)).otherwise(100 + (e * 17) % 200).alias("price"),
        P.sigmoid((F.col("value") - 50.0) / 40.0).alias("p_model"), F.when(e % 8 != 0, 0.3 + (e * 13 % 40) / 100.0).alias("p_close"), (1 + e % 3).alias("books"),
        F.col("event_type").alias("family"))
    return M.with_bet_key(b)


@query("G3 X3", f"WITH {EV}, {BETS} SELECT seq, bet_key FROM kb")
def bet_identity(spark, d):
    return bets(spark, d).select("seq", "bet_key")


ENRICH = f"""e1 AS (SELECT *, {prob_sql('price')} AS implied, 0.5 * p_model + 0.5 * p_close AS p_bet FROM kb WHERE p_close IS NOT NULL), e2 AS (SELECT *, p_bet - implied AS edge, p_bet / implied - 1 AS ev, greatest(0, 0.25 * (p_bet / implied - 1) / (1 / implied - 1)) AS fk FROM e1),
e3 AS (SELECT *, CASE WHEN family NOT IN ('click', 'view') THEN 'family-not-PASS' WHEN edge < 0.03 THEN 'edge<0.03' WHEN ev <= 0 THEN 'EV<=0' WHEN implied < 0.2 THEN 'longshot-band' WHEN books < 2 THEN 'single-book' WHEN fk > 0.01 THEN 'per-bet-1%' ELSE '' END AS why FROM e2),
en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bet_key ORDER BY ev DESC, seq) AS rn FROM e3) WHERE rn = 1)"""


@query("G4 X22", f"""WITH {EV}, {BETS}, {ENRICH} SELECT seq, bet_key, round(edge, 6) AS edge, round(ev, 6) AS ev, round(fk, 6) AS f_kelly, CASE WHEN why IN ('per-bet-1%', '') THEN 'paper' ELSE 'track' END AS status, why AS stake_capped_by,
 round(CASE WHEN why IN ('per-bet-1%', '') THEN least(fk, 0.01) * 100.0 ELSE 0 END, 6) AS stake FROM en""")
def enrich_bets(spark, d):
    b = bets(spark, d)
    passing = b.filter("family IN ('click', 'view')").select("family").distinct()
    r = M.enrich(b.filter("p_close IS NOT NULL"), passing, "family", M.START_BANKROLL, [F.asc("seq")])
    return r.select("seq", "bet_key", *[F.round(c, 6).alias(c) for c in ("edge", "ev", "f_kelly")], "status", "stake_capped_by", F.round("stake", 6).alias("stake"))


LEDG = """lg AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'track' ELSE 'paper' END AS status, CASE WHEN seq % 14 = 0 THEN 'win' ELSE '' END AS outcome, 1.0 + seq % 3 AS stake, '' AS stake_capped_by, CASE WHEN seq % 14 = 0 THEN 1.5 ELSE 0.0 END AS pnl FROM kb)"""


def _ledger_rows(spark, d):
    s = F.col("seq")
    return bets(spark, d).withColumn("status", F.when(s % 5 == 0, "track").otherwise("paper")).withColumn("outcome", F.when(s % 14 == 0, "win").otherwise("")).withColumn(
        "stake", 1.0 + s % 3).withColumn("stake_capped_by", F.lit("")).withColumn("pnl", F.when(s % 14 == 0, 1.5).otherwise(0.0))


@query("G5 ST11 D3", f"""WITH {EV}, {BETS}, {LEDG}, old AS (SELECT * FROM lg WHERE seq % 2 = 0), nw AS (SELECT * FROM lg WHERE seq % 2 = 1 AND bet_key NOT IN (SELECT bet_key FROM old WHERE outcome = 'win')),
o2 AS (SELECT *, outcome = '' AND bet_key IN (SELECT bet_key FROM nw) AS ret FROM old)
SELECT seq, bet_key, status, CASE WHEN ret THEN 'superseded' ELSE outcome END AS outcome, CAST(stake AS DOUBLE) AS stake, stake_capped_by FROM o2 UNION ALL SELECT seq, bet_key, 'void', outcome, 0.0, 'superseded-by-re-serve' FROM o2 WHERE ret
UNION ALL SELECT seq, bet_key, status, outcome, CAST(stake AS DOUBLE), stake_capped_by FROM nw""")
def append_superseding(spark, d):
    led = _ledger_rows(spark, d)
    return M.append_superseding(led.filter("seq % 2 = 0"), led.filter("seq % 2 = 1")).select("seq", "bet_key", "status", "outcome", "stake", "stake_capped_by")


BOX = """bx AS (SELECT day(d) * 100 + user_id % 10 AS game, user_id AS entity, count(*) AS h, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS so, user_id % 3 AS started, CAST(count(*) FILTER (WHERE event_type <> 'signup') AS BIGINT) AS pa FROM ev GROUP BY d, user_id),
fin AS (SELECT game, 'T0' AS home, 'T1' AS away, CAST(sum(h) AS BIGINT) AS home_score, CAST(sum(h) FILTER (WHERE entity % 2 = 1) AS BIGINT) AS aw FROM bx GROUP BY 1),
fins AS (SELECT game, home, away, home_score - coalesce(aw, 0) AS home_score, coalesce(aw, 0) AS away_score FROM fin WHERE game % 13 <> 0)"""
GRADE = """gr AS (SELECT kb.*, CASE WHEN market = 'totals' THEN f.home_score + f.away_score WHEN market = 'batter_hits' AND b.pa > 0 THEN b.h WHEN market = 'pitcher_strikeouts' AND b.started = 1 THEN b.so END AS actual, f.game IS NOT NULL AS final, f.home_score > f.away_score AS hw FROM kb LEFT JOIN bx b ON kb.game = b.game AND kb.entity = b.entity LEFT JOIN fins f ON kb.game = f.game),
gy AS (SELECT *, CASE WHEN market = 'h2h' THEN CASE WHEN final THEN hw::INT END WHEN actual <> line THEN (actual > line)::INT END AS y, coalesce(market <> 'h2h' AND actual = line, FALSE) AS push FROM gr)"""


def _box(spark, d):
    e = events(spark, d)
    box = e.groupBy((F.day("d") * 100 + F.col("user_id") % 10).alias("game"), F.col("user_id").alias("entity"), "d").agg(
        F.count(F.lit(1)).alias("H"), F.count_if(F.col("event_type") == "error").alias("SO"), F.max(F.col("user_id") % 3).alias("started"),
        F.count_if(F.col("event_type") != "signup").alias("exposure"))
    odd = F.col("entity") % 2 == 1
    fin = box.groupBy("game").agg(F.sum(F.when(~odd, F.col("H")).otherwise(0)).alias("home_score"), F.sum(F.when(odd, F.col("H")).otherwise(0)).alias("away_score"))
    fin = fin.filter("game % 13 <> 0").withColumn("home", F.lit("T0")).withColumn("away", F.lit("T1"))
    long = box.unpivot(["game", "entity", "started", "exposure"], ["H", "SO"], "stat", "value")
    cfg = spark.createDataFrame([("batter_hits", "player", "H"), ("pitcher_strikeouts", "starter", "SO"), ("totals", "total", None), ("h2h", "side", None)], "market string, scope string, stat string")
    return long, fin, cfg


@query("G6 P6 A53", f"WITH {EV}, {BETS}, {BOX}, {GRADE} SELECT seq, CAST(actual AS DOUBLE) AS actual, final, y, push FROM gy")
def market_outcomes(spark, d):
    return M.market_outcomes(bets(spark, d), *_box(spark, d)).select("seq", "actual", "final", "y", "push")


SETTLE = """s1 AS (SELECT lg.*, max(seq) FILTER (WHERE outcome = '') OVER (PARTITION BY bet_key) AS top, max(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END) OVER (PARTITION BY bet_key) AS dn FROM lg),
s2 AS (SELECT *, CASE WHEN outcome = '' AND (dn = 1 OR seq < top) THEN 'superseded' ELSE outcome END AS o1 FROM s1),
s3 AS (SELECT s2.*, y, push, final, CASE WHEN y IS NOT NULL AND final THEN CASE WHEN (CASE WHEN s2.market = 'h2h' THEN (s2.team = 'T0') = (y = 1) ELSE (s2.side = 'Over') = (y = 1) END) THEN 'win' ELSE 'lose' END WHEN push AND final THEN 'push' END AS res FROM s2 JOIN (SELECT seq, y, push, final FROM gy) g USING (seq)),
s4 AS (SELECT *, o1 = '' AND d <= DATE '2024-01-25' AND res IS NOT NULL AS nw FROM s3)"""


@query("G7 G10 A46", f"""WITH {EV}, {BETS}, {LEDG}, {BOX}, {GRADE}, {SETTLE}
SELECT seq, bet_key, status, CASE WHEN nw THEN res ELSE o1 END AS outcome, round(CASE WHEN nw THEN CASE res WHEN 'win' THEN stake * (1 / {prob_sql('price')} - 1) WHEN 'lose' THEN -stake ELSE 0 END ELSE pnl END, 6) AS pnl FROM s4""")
def settle_ledger(spark, d):
    """All open dates settle together; running the operator on its own result changes nothing."""
    s = M.settle(_ledger_rows(spark, d), *_box(spark, d), F.lit("2024-01-25").cast("date"))
    return s.select("seq", "bet_key", "status", "outcome", F.round("pnl", 6).alias("pnl"))


@query("G9", f"""WITH {EV}, {BETS}, {LEDG}, {BOX}, j AS (SELECT lg.*, market IN ('batter_hits', 'pitcher_strikeouts') AS pl, EXISTS (SELECT 1 FROM bx WHERE bx.game = lg.game) AS boxed, EXISTS (SELECT 1 FROM fins WHERE fins.game = lg.game) AS fnl,
 EXISTS (SELECT 1 FROM bx WHERE bx.game = lg.game AND bx.entity = lg.entity AND CASE WHEN lg.market = 'pitcher_strikeouts' THEN bx.started = 1 ELSE bx.pa > 0 END) AS ok FROM lg), v AS (SELECT *, outcome = '' AND d < DATE '2024-01-20' AND pl AND boxed AND fnl AND NOT ok AS vd FROM j)
SELECT seq, CASE WHEN vd THEN 'void' ELSE status END AS status, CASE WHEN vd THEN 'void' ELSE outcome END AS outcome FROM v""")
def void_unplayed(spark, d):
    r = M.void_unplayed(_ledger_rows(spark, d), *_box(spark, d), F.lit("2024-01-20").cast("date"))
    return r.select("seq", "status", "outcome")




@query("G8 J14 A46", f"""WITH {EV}, {BETS}, {CAP}, {ARR_T}, {COMPACT}, {STORE_SEL}, qq AS (SELECT *, {prob_sql('close_over')} / ({prob_sql('close_over')} + {prob_sql('close_under')}) AS f FROM s),
bt AS (SELECT seq, entity, 'm' || CAST(seq % 2 AS VARCHAR) AS market, CASE WHEN seq % 5 = 0 THEN 999 ELSE entity % 7 + 700 END AS game, side, price, seq % 4 = 0 AS dh FROM bets),
ng AS (SELECT game, CASE WHEN game % 2 = 0 THEN 2 ELSE 1 END AS n_games FROM (SELECT DISTINCT game FROM bt)),
ex AS (SELECT entity, market, game, coalesce(avg(f) FILTER (WHERE book = 'purchase'), median(f)) AS x FROM qq WHERE game IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2, 3), bl AS (SELECT entity, market, coalesce(avg(f) FILTER (WHERE book = 'purchase'), median(f)) AS b FROM qq WHERE game IS NULL AND f IS NOT NULL GROUP BY 1, 2),
has AS (SELECT DISTINCT entity, market, game FROM qq WHERE game IS NOT NULL),
z AS (SELECT bt.*, coalesce(ex.x, CASE WHEN has.game IS NULL AND n_games = 1 THEN bl.b END) AS fair FROM bt LEFT JOIN ex USING (entity, market, game) LEFT JOIN has USING (entity, market, game) LEFT JOIN bl USING (entity, market) LEFT JOIN ng USING (game))
SELECT seq, round(CASE WHEN side = 'Over' THEN fair ELSE 1 - fair END, 6) AS p_close_final, round(CASE WHEN side = 'Over' THEN fair ELSE 1 - fair END - {prob_sql('price')}, 6) AS clv FROM z""")
def closing_line_value(spark, d):
    s = F.col("seq")
    bt = bets(spark, d).select("seq", "entity", F.concat(F.lit("m"), (s % 2).cast("string")).alias("market"),
                               F.when(s % 5 == 0, 999).otherwise(F.col("entity") % 7 + 700).alias("game"), "side", "price")
    ng = bt.select("game").distinct().withColumn("n_games", F.when(F.col("game") % 2 == 0, 2).otherwise(1))
    return r6(M.fill_clv(bt, _named(spark, d), ng, ["entity", "market"]).select("seq", "p_close_final", "clv"), "seq")


@query("A46", f"""WITH {EV}, {BETS}, {LEDG}, {BOX}, {GRADE}, {SETTLE}, f AS (SELECT market, CASE WHEN nw THEN res ELSE o1 END AS outcome, CASE WHEN nw THEN CASE res WHEN 'win' THEN stake * (1 / {prob_sql('price')} - 1) WHEN 'lose' THEN -stake ELSE 0 END ELSE pnl END AS pnl, p_close - {prob_sql('price')} AS clv FROM s4)
SELECT market, count(*) AS n, CAST(count(*) FILTER (WHERE outcome = 'win') AS BIGINT) AS won, CAST(count(*) FILTER (WHERE outcome = 'push') AS BIGINT) AS push, round(sum(pnl), 4) AS pnl, round(avg(clv), 6) AS mean_clv, round(100.0 + (SELECT sum(pnl) FROM f), 4) AS bankroll FROM f WHERE outcome IN ('win', 'lose', 'push') GROUP BY 1""")
def ledger_report(spark, d):
    s = M.settle(_ledger_rows(spark, d), *_box(spark, d), F.lit("2024-01-25").cast("date")).withColumn("clv", F.col("p_close") - O.american_to_prob("price"))
    return M.ledger_report(s).withColumn("bankroll", F.round(M.bankroll(s), 4)).select("market", "n", "won", "push", F.round("pnl", 4).alias("pnl"), F.round("mean_clv", 6).alias("mean_clv"), "bankroll")


GREPS = 500


def _gate_sql() -> str:
    pc = f"{prob_sql('close_over')} / ({prob_sql('close_over')} + {prob_sql('close_under')})"
    po = f"{prob_sql('open_over')} / ({prob_sql('open_over')} + {prob_sql('open_under')})"
    return f"""WITH {EV}, {CAP}, {LED}, {ARR_T}, {COMPACT}, {STORE_SEL}, q AS (SELECT entity, market, {pc} AS pc, {po} AS po, CASE WHEN close_over IS NOT NULL AND close_under IS NOT NULL THEN {shin_sql('close_over', 'close_under')} END AS sh, greatest(0, (epoch_us(close_ts) - epoch_us(open_ts)) / 6e7) AS gap FROM s),
fair AS (SELECT entity, market, median(pc) AS pc, median(po) AS po, median(sh) AS sh, max(gap) AS gap FROM q GROUP BY 1, 2),
r AS (SELECT led.family, led.d, led.y, led.p, f.* FROM led JOIN fair f ON led.entity = f.entity AND f.market = 'm' || CAST(led.game % 2 AS VARCHAR) WHERE f.pc IS NOT NULL),
day AS (SELECT family, d, sum({ll_sql('y', 'pc')} - {ll_sql('y', 'p')}) AS s, count(*) AS n FROM r GROUP BY 1, 2), dts AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT d FROM day)),
w AS (SELECT rep, {draw_sql('rep', 'i', 'nd', 5)} AS j FROM dts, (SELECT unnest(generate_series(1, {GREPS})) AS rep)),
bt AS (SELECT family, rep, sum(s) / sum(n) AS stat FROM w JOIN dts ON w.j = dts.i JOIN day ON day.d = dts.d GROUP BY 1, 2), ci AS (SELECT family, quantile_cont(stat, 0.05) AS ci_lo, avg((stat <= 0)::INT) AS p_raw FROM bt GROUP BY 1),
t AS (SELECT family, count(*) AS n, avg({ll_sql('y', 'p')}) AS ll_model, avg({ll_sql('y', 'pc')}) AS ll_close, avg({ll_sql('y', 'sh')}) AS ll_shin, count(*) FILTER (WHERE po IS NOT NULL AND abs(po - pc) > 1e-9) AS n_moved,
 avg({ll_sql('y', 'po')} - {ll_sql('y', 'p')}) FILTER (WHERE po IS NOT NULL AND abs(po - pc) > 1e-9) AS d_open, avg((gap <= 0)::INT) AS pct FROM r GROUP BY 1),
k AS (SELECT family, p_raw, row_number() OVER (ORDER BY p_raw, family) AS rk, count(*) OVER () AS nf FROM ci), b AS (SELECT family, least(min(p_raw * nf / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS p_bh FROM k)
SELECT family, n, round(ll_model, 6) AS ll_model, round(ll_close, 6) AS ll_close, round(ll_close - ll_model, 6) AS delta, round(ll_shin - ll_model, 6) AS delta_shin, round(ci_lo, 6) AS ci_lo, round(p_raw, 6) AS p_raw, round(p_bh, 6) AS p_bh, n_moved,
 round(d_open, 6) AS d_vs_open, round(pct, 6) AS pct_1cap, CASE WHEN n < 800 THEN 'INSUFFICIENT n' WHEN p_bh < 0.05 AND ci_lo > 0 THEN 'PASS' ELSE 'NO-EDGE' END AS verdict FROM t JOIN ci USING (family) JOIN b USING (family)"""


@query("G11 A32 A33 A35 A37 A38", _gate_sql())
def market_gate(spark, d):
    """Model against the close on graded prices with resampled slates, Shin and opening-move diagnostics."""
    s = store(spark, d)
    k = ["entity", "market"]
    q = M.consensus_many(s, k, "book", {"pc": ("close_over", "close_under", "proportional"), "po": ("open_over", "open_under", "proportional"),
                                        "sh": ("close_over", "close_under", "shin")}, [F.max(M.capture_span()).alias("gap")])
    q = q.filter("pc IS NOT NULL").withColumnRenamed("market", "mk")
    led = ledger(spark, d).withColumn("mk", F.concat(F.lit("m"), (F.col("game") % 2).cast("string")))
    r = led.join(q, ["entity", "mk"])
    lm, lc, ls = P.log_loss("y", "p"), P.log_loss("y", "pc"), P.log_loss("y", "sh")
    moved = F.col("po").isNotNull() & (F.abs(F.col("po") - F.col("pc")) > 1e-9)
    # one pass over the graded prices; everything below reads family-day sums
    day = cut_lineage(r.groupBy("family", "d").agg(
        F.sum(lc - lm).alias("s"), F.count(F.lit(1)).alias("n"), F.sum(lm).alias("lm"), F.sum(lc).alias("lc"), F.sum(ls).alias("ls"), F.count(ls).alias("ns"),
        F.count_if(moved).alias("nm"), F.sum(F.when(moved, P.log_loss("y", "po") - lm)).alias("dm"), F.sum((F.col("gap") <= 0).cast("int")).alias("oc")))
    ci = E.bootstrap_summary(E.block_bootstrap(day, ["family"], "d", "s", "n", GREPS, 5, shared=True), ["family"])
    per = lambda a, b: F.sum(a) / F.sum(b)
    t = day.groupBy("family").agg(F.sum("n").alias("n"), per("lm", "n").alias("ll_model"), per("lc", "n").alias("ll_close"), per("ls", "ns").alias("ll_shin"), F.sum("nm").alias("n_moved"),
                                  F.try_divide(F.sum("dm"), F.sum("nm")).alias("d_vs_open"), per("oc", "n").alias("pct_1cap"))
    rep = E.bh_adjust(t.join(ci.select("family", "ci_lo", F.col("p_one").alias("p_raw")), "family"), "p_raw", "family")
    v = F.when(F.col("n") < 800, "INSUFFICIENT n").when((F.col("p_bh") < 0.05) & (F.col("ci_lo") > 0), "PASS").otherwise("NO-EDGE")
    rep = rep.select("family", "n", "ll_model", "ll_close", (F.col("ll_close") - F.col("ll_model")).alias("delta"), (F.col("ll_shin") - F.col("ll_model")).alias("delta_shin"), "ci_lo", "p_raw", "p_bh",
                     "n_moved", "d_vs_open", "pct_1cap", v.alias("verdict"))
    return r6(rep, "family", "n", "n_moved", "verdict")


@query("G13 J17 W19 J20", f"""WITH {EV}, us AS (SELECT user_id, d, CAST(sum(k) AS BIGINT) AS np, max(user_id % 6 + CASE WHEN k > 97 THEN 1 ELSE 0 END) AS grp FROM ev GROUP BY 1, 2),
ro AS (SELECT user_id % 6 AS grp, user_id, DATE '2024-01-20' AS d FROM (SELECT DISTINCT user_id FROM ev) UNION ALL SELECT user_id % 6, user_id, DATE '2024-01-24' FROM (SELECT DISTINCT user_id FROM ev)),
iv AS (SELECT user_id, d AS place, CASE WHEN event_id % 3 <> 0 THEN d + CAST(k % 10 AS INT) END AS act FROM ev WHERE event_type = 'signup' AND k > 60),
a AS (SELECT ro.*, coalesce(l1.np, 0) AS n1, coalesce(l2.np, 0) AS n2, (SELECT count(*) FROM us WHERE us.user_id = ro.user_id AND us.d < ro.d AND us.d >= ro.d - 30) AS uses,
 (SELECT max(place) FROM iv WHERE iv.user_id = ro.user_id AND place <= ro.d AND (act IS NULL OR act > ro.d)) AS since, (SELECT max(d) FROM us WHERE us.user_id = ro.user_id AND us.d < ro.d) AS seen FROM ro LEFT JOIN us l1 ON l1.user_id = ro.user_id AND l1.d = ro.d - 1 LEFT JOIN us l2 ON l2.user_id = ro.user_id AND l2.d = ro.d - 2),
b AS (SELECT a.*, us.grp AS lgp FROM a LEFT JOIN us ON us.user_id = a.user_id AND us.d = a.seen), e AS (SELECT *, row_number() OVER (PARTITION BY grp, d ORDER BY uses DESC, user_id) AS pos FROM b WHERE NOT (n1 > 0 AND n2 > 0) AND n1 < 25 AND NOT (since IS NOT NULL AND NOT coalesce(seen >= since, FALSE)) AND (lgp IS NULL OR lgp = grp))
SELECT grp, d, user_id, uses, CAST(pos AS INT) AS pos FROM e WHERE pos <= 8""")
def available_pool(spark, d):
    ev = events(spark, d)
    use = ev.select("user_id", "d", F.col("k").alias("np"), (F.col("user_id") % 6 + F.when(F.col("k") > 97, 1).otherwise(0)).alias("grp"))
    roster = ev.select("user_id").distinct().select((F.col("user_id") % 6).alias("grp"), "user_id", F.explode(F.array(F.lit("2024-01-20").cast("date"), F.lit("2024-01-24").cast("date"))).alias("d"))
    iv = ev.filter("event_type = 'signup' AND k > 60").select("user_id", F.col("d").alias("place"), F.when(F.col("event_id") % 3 != 0, F.date_add("d", F.col("k") % 10)).alias("act"))
    return M.available_pool(roster, use, iv, "grp", "user_id", "d")
