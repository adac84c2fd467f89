"""Streams over the given rows, delivered in several arrivals; results equal their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.plans._roles import CAP, EV, captures, events
from asofkit.plans.market import ARR_T, BETS, COMPACT, LEDG, STORE_SEL, _ledger_rows
from asofkit.registry import query
from asofkit.sources.files import shared_path
from asofkit.streaming import aggregates as A
from asofkit.streaming import merges as M
from asofkit.streaming.core import drain, drain_updates, open_stream, stage
from asofkit.streaming.stateful import stint_stream

PARTS = 3


def _part(day="d"):
    """Arrival number of a row: a third of the month each."""
    return F.least(F.floor(F.day(day) / 11), F.lit(PARTS - 1)).cast("int")


def _event_stream(spark, d, df=None, part=None):
    df = events(spark, d) if df is None else df
    arrivals = stage(df, _part() if part is None else part, PARTS, "arrivals")
    return open_stream(arrivals), arrivals


def _delayed():
    """Arrival number where every twentieth row comes with the last one, whatever its day."""
    return F.when(F.col("event_id") % 20 == 0, PARTS - 1).otherwise(_part())


#: Rows with their arrival; the watermark an arrival meets, from the newest row of those before it; and the last one.
MARKS = f"""{EV}, p AS (SELECT *, CASE WHEN event_id % 20 = 0 THEN 2 ELSE least(day(d) // 11, 2) END AS part FROM ev),
wm AS (SELECT a.part, coalesce(date_trunc('millisecond', max(b.ts)) - INTERVAL 3 DAY, TIMESTAMP '1970-01-01') AS wm FROM (SELECT DISTINCT part FROM p) a LEFT JOIN p b ON b.part < a.part GROUP BY 1),
q AS (SELECT p.*, wm.wm, (SELECT max(ts) FROM p) - INTERVAL 3 DAY AS last_wm FROM p JOIN wm USING (part))"""
DELAY = "3 days"

@query("ST5 D7", f"WITH {EV}, {CAP}, {ARR_T}, {COMPACT}, {STORE_SEL} SELECT entity, market, line, book, game, open_ts, open_over, open_under, close_ts, close_over, close_under FROM s")
def stream_capture_store(spark, d):
    c = captures(spark, d).select("entity", "market", F.col("line").cast("double").alias("line"), "book", F.coalesce("game", F.lit(-1)).alias("game"), "ts", "d", "over", "under",
                                  F.col("seq").alias("arr"), (F.col("entity") % 8).alias("slot"))
    path = shared_path(spark, "capture-store")
    keys = ["entity", "market", "line", "book", "game"]
    stream, arrivals = _event_stream(spark, d, c)
    drain(stream, arrivals, M.capture_merge(path, keys, "slot"), "captures")
    s = spark.read.parquet(path)
    return s.select(*keys[:4], F.when(F.col("game") != -1, F.col("game")).alias("game"), "open_ts", "open_over", "open_under", "close_ts", "close_over", "close_under")


@query("ST8", f"WITH {MARKS} SELECT d, user_id, count(*) AS n, round(sum(value), 4) AS v FROM q WHERE d + 1 > wm AND d + 1 <= last_wm GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    """Days are emitted once, when the watermark has passed them; rows that come later than that are left out (and kept by ``stream_late_windows``)."""
    stream, arrivals = _event_stream(spark, d, part=_delayed())
    s = A.daily_counts(stream, "ts", ["user_id"], DELAY, {"n": F.count(F.lit(1)), "v": F.sum("value")})
    return drain_updates(s, arrivals, "daily", ["d", "user_id"], "append").select("d", "user_id", "n", F.round("v", 4).alias("v"))


@query("ST8 ST2", f"WITH {MARKS} SELECT d, count(*) AS n, CAST(count(*) FILTER (WHERE d + 1 <= wm) AS BIGINT) AS late FROM q GROUP BY 1")
def stream_late_windows(spark, d):
    """Rows per day, and how many of them came behind the watermark of their day."""
    path = shared_path(spark, "late-windows")
    stream, arrivals = _event_stream(spark, d, part=_delayed())
    end = F.date_add("d", 1).cast("timestamp")
    drain(stream, arrivals, M.late_split(path, F.date_trunc("millisecond", F.col("ts").cast("timestamp")), lambda top: end <= top - F.expr("INTERVAL 3 DAYS")), "late-windows")
    return spark.read.parquet(f"{path}/rows").groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))


@query("ST9", f"""WITH {MARKS}, w AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM ev) - 6, (SELECT max(d) FROM ev), INTERVAL 1 DAY)) AS DATE) AS start)
SELECT w.start, w.start + 7 AS "end", event_type, count(*) AS n FROM w JOIN q ON q.d >= w.start AND q.d < w.start + 7 WHERE w.start + 7 > wm AND w.start + 7 <= last_wm GROUP BY 1, 2, 3""")
def stream_sliding_counts(spark, d):
    """A late row still counts in those of its windows that the watermark has not passed."""
    stream, arrivals = _event_stream(spark, d, part=_delayed())
    s = A.sliding_sums(stream, "ts", ["event_type"], "7 days", "1 day", DELAY, {"n": F.count(F.lit(1))})
    return drain_updates(s, arrivals, "sliding", ["start", "end", "event_type"], "append")


@query("ST10", f"WITH {MARKS} SELECT event_id, user_id FROM q WHERE ts > wm")
def stream_deduplicated(spark, d):
    """Every second row is delivered again in the next arrival; each key comes out once, rows behind the watermark not at all."""
    e = events(spark, d).withColumn("part", _delayed())
    again = e.filter("event_id % 2 = 0").withColumn("part", F.least(F.col("part") + 1, F.lit(PARTS - 1)))
    stream, arrivals = _event_stream(spark, d, e.unionByName(again), F.col("part"))
    s = A.deduplicated(stream, "ts", ["event_id"], DELAY)
    return drain_updates(s, arrivals, "dedupe", ["event_id"], "append").select("event_id", "user_id")


@query("ST11 G5", f"""WITH {EV}, {BETS}, {LEDG}, g AS (SELECT *, CAST(seq % 3 AS INT) AS gen FROM lg), n0 AS (SELECT * FROM g WHERE gen = 0), n1 AS (SELECT * FROM g WHERE gen = 1 AND bet_key NOT IN (SELECT bet_key FROM n0 WHERE outcome = 'win')),
l1 AS (SELECT seq, bet_key, status, CASE WHEN outcome = '' AND bet_key IN (SELECT bet_key FROM n1) THEN 'superseded' ELSE outcome END AS outcome, stake FROM n0 UNION ALL SELECT seq, bet_key, 'void', outcome, 0 FROM n0 WHERE outcome = '' AND bet_key IN (SELECT bet_key FROM n1) UNION ALL SELECT seq, bet_key, status, outcome, stake FROM n1),
n2 AS (SELECT * FROM g WHERE gen = 2 AND bet_key NOT IN (SELECT bet_key FROM l1 WHERE outcome = 'win')), m2 AS (SELECT *, outcome = '' AND status IN ('paper', 'track') AND bet_key IN (SELECT bet_key FROM n2) AS ret FROM l1)
SELECT seq, bet_key, status, CASE WHEN ret THEN 'superseded' ELSE outcome END AS outcome, CAST(stake AS DOUBLE) AS stake FROM m2 UNION ALL SELECT seq, bet_key, 'void', outcome, 0 FROM m2 WHERE ret UNION ALL SELECT seq, bet_key, status, outcome, CAST(stake AS DOUBLE) FROM n2""")
def stream_ledger_generations(spark, d):
    """Three servings of the ledger; newer generations retire older live rows, settled ones stay."""
    led = _ledger_rows(spark, d).drop("ts")
    path = shared_path(spark, "ledger")
    stream, arrivals = _event_stream(spark, d, led, (F.col("seq") % 3).cast("int"))
    drain(stream, arrivals, M.ledger_merge(path), "ledger")
    return spark.read.parquet(path).select("seq", "bet_key", "status", "outcome", "stake")


@query("ST3 U3", """WITH ev AS (SELECT event_id, ts, CAST(ts AS DATE) AS d, user_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events), e AS (SELECT user_id, d, event_id, CASE event_type WHEN 'signup' THEN 'place' WHEN 'error' THEN 'transfer' WHEN 'purchase' THEN 'activate' WHEN 'view' THEN 'rehab' END AS kind, k AS days FROM ev WHERE event_type <> 'click'),
g AS (SELECT *, coalesce(sum(CASE WHEN kind = 'activate' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY d, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM e),
o AS (SELECT user_id, grp, min((d, event_id)) FILTER (WHERE kind IN ('place', 'transfer')) AS op, max(d) FILTER (WHERE kind = 'activate') AS act_date,
  max(CASE WHEN coalesce(days, 0) >= 60 THEN 1 ELSE 0 END) FILTER (WHERE kind IN ('place', 'transfer')) AS il60, max((d, event_id)) FILTER (WHERE kind = 'rehab') AS rh FROM g GROUP BY 1, 2),
s AS (SELECT user_id, op[1] AS place_date, act_date, il60, CASE WHEN rh > op THEN 1 ELSE 0 END AS rehab FROM o WHERE op IS NOT NULL)
SELECT user_id, count(*) AS stints, count(act_date) AS closed, CAST(sum(il60) AS BIGINT) AS il60, CAST(sum(rehab) AS BIGINT) AS rehabs, CAST(sum(date_diff('day', place_date, act_date)) AS BIGINT) AS days FROM s GROUP BY 1""")
def stream_stints(spark, d):
    """Keyed state per player. A stint that stays open is emitted again with every batch, so only its last version counts."""
    t = F.col("event_type")
    kind = F.when(t == "signup", "place").when(t == "error", "transfer").when(t == "purchase", "activate").when(t == "view", "rehab")
    e = events(spark, d).filter("event_type <> 'click'").select("user_id", "d", "event_id", kind.alias("kind"), "k")
    path = shared_path(spark, "stints")

    def each(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/e={epoch}")

    stream, arrivals = _event_stream(spark, d, e)
    drain(stint_stream(stream), arrivals, each, "stints", "update")
    s = spark.read.parquet(path)
    closed = s.filter("act_date IS NOT NULL").select("user_id", "place_date", "act_date", "il60", "rehab")
    # an open version counts only if it came with the newest batch that emitted anything for its player
    newest = s.groupBy("user_id").agg(F.max("epoch").alias("epoch"))
    open_ = s.filter("act_date IS NULL").join(newest, ["user_id", "epoch"]).select(*closed.columns)
    both = closed.unionByName(open_)
    return both.groupBy("user_id").agg(F.count(F.lit(1)).alias("stints"), F.count("act_date").alias("closed"), F.sum("il60").alias("il60"), F.sum("rehab").alias("rehabs"),
                                       F.sum(F.datediff("act_date", "place_date")).alias("days"))


@query("ST6", f"""WITH {EV}, l AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS got FROM ev), h AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE got > 0) AS hit FROM l GROUP BY 1)
SELECT user_id, CAST(count(*) FILTER (WHERE hit IS NULL OR (ts, event_id) > hit) AS BIGINT) AS misses FROM l JOIN h USING (user_id) GROUP BY 1""")
def stream_negative_cache(spark, d):
    e = events(spark, d).select("user_id", "ts", "d", "event_id", (F.col("event_type") == "purchase").cast("int").alias("got"))
    path = shared_path(spark, "retries")
    stream, arrivals = _event_stream(spark, d, e)
    drain(stream, arrivals, M.retry_merge(path, "user_id", ["ts", "event_id"], "got"), "retries")
    return spark.read.parquet(path).filter(F.col("v") == PARTS - 1).select("user_id", "misses")


@query("ST2 ST1", f"""WITH {EV}, p AS (SELECT *, CASE WHEN event_id % 20 = 0 THEN 2 ELSE least(day(d) // 11, 2) END AS part FROM ev), t AS (SELECT a.part, max(b.d) AS top FROM (SELECT DISTINCT part FROM p) a LEFT JOIN p b ON b.part < a.part GROUP BY 1)
SELECT event_id, coalesce(p.d < t.top - 3, FALSE) AS late FROM p JOIN t USING (part)""")
def stream_late_rows(spark, d):
    """Rows that arrive long after their day go to a repair table."""
    path = shared_path(spark, "late")
    stream, arrivals = _event_stream(spark, d, part=_delayed())
    drain(stream, arrivals, M.late_split(path, F.col("d"), lambda top: F.col("d") < F.date_sub(top, 3)), "late")
    return spark.read.parquet(f"{path}/rows").select("event_id", "late")


@query("ST12", f"""WITH {EV} SELECT CAST(least(day(d) // 11, 2) AS INT) AS epoch, event_type, max(d) AS newest, CAST(date_diff('day', max(d), DATE '2024-02-01') AS INT) AS age_days, date_diff('day', max(d), DATE '2024-02-01') > 5 AS stale FROM ev GROUP BY 1, 2""")
def stream_freshness(spark, d):
    path = shared_path(spark, "freshness")
    stream, arrivals = _event_stream(spark, d)
    drain(stream, arrivals, M.freshness_watch(path, "d", "2024-02-01", 5, ["event_type"]), "freshness")
    return spark.read.parquet(path).select("epoch", "event_type", "newest", "age_days", "stale")


@query("ST4", f"""WITH {EV}, r AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 DAY THEN 0 ELSE 1 END AS nw FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM r),
c AS (SELECT user_id, s, count(*) AS n FROM g GROUP BY 1, 2 HAVING max(ts) + INTERVAL 2 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM ev) - INTERVAL 2 DAY)
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def stream_sessions(spark, d):
    """Runs of activity with gaps of two days at most, merged across arrivals; a session is emitted once the watermark has passed its end, and its state is dropped."""
    stream, arrivals = _event_stream(spark, d)
    s = A.sessions(stream, "ts", ["user_id"], "2 days", "2 days")
    r = drain_updates(s, arrivals, "sessions", ["user_id", "start"], "append")
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))
