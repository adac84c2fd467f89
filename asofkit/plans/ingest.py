"""Sources, flatteners, repair, dedupe and quality queries on documents and tables made from the given rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.operators import quality as Q
from asofkit.operators.scan import group_totals, pick_one
from asofkit.plans._roles import EV, GAMES, LED, PA, appearances, events, games, ledger, table
from asofkit.registry import query
from asofkit.session import cut_lineage
from asofkit.sources import files as S
from asofkit.sources import flatten as J
from asofkit.sources import repair as R


SPECS = "name string, parent string, columns array<string>, key array<string>, min_rows long, max_dup_frac double, numeric map<string,double>"
SLATE = r"slate=(\d{4}-\d{2}-\d{2})(?:_v(\d+))?/"


def _docs(spark, d, body, *keep):
    """One JSON document per event row."""
    e = events(spark, d)
    return e.select(*keep, F.to_json(body).alias("body"))


@query("S4 X27", """SELECT event_id AS GamePk, r.i AS "PlayIndex", a.i AS "AtBatIndex", user_id + r.i AS "RunnerId", CASE WHEN r.i = 0 THEN '' ELSE '1B' END AS "StartBase", CASE WHEN r.i = 0 THEN '1B' ELSE 'H' END AS "EndBase", (a.i = 1)::INT AS "IsOut",
 CASE WHEN r.i = 1 THEN 'putout:SS:' || user_id || ';assist:2B:' || (user_id + 1) ELSE '' END AS "Credits", (r.i = 1)::INT AS "RBI", event_type AS "PlayEvent" FROM events, (SELECT unnest([0, 1]) AS i) a, (SELECT unnest([0, 1]) AS i) r""")
def play_by_play_movements(spark, d):
    u = F.col("user_id")

    def runner(i: int, ab: int):
        cred = F.array(F.struct(F.lit("f_putout").alias("credit"), F.struct(F.lit("SS").alias("abbreviation")).alias("position"), F.struct(u.alias("id")).alias("player")),
                       F.struct(F.lit("assist").alias("credit"), F.struct(F.lit("2B").alias("abbreviation")).alias("position"), F.struct((u + 1).alias("id")).alias("player")))
        return F.struct(
            F.struct(F.lit(None if i == 0 else "1B").cast("string").alias("start"), F.lit("1B" if i == 0 else "score").alias("end"), F.lit(ab == 1).alias("isOut")).alias("movement"),
            F.struct(F.lit(i).alias("playIndex"), F.struct((u + i).alias("id")).alias("runner"), F.lit(i == 1).alias("rbi")).alias("details"),
            (cred if i == 1 else F.lit(None).cast("array<struct<credit:string,position:struct<abbreviation:string>,player:struct<id:bigint>>>")).alias("credits"))

    plays = F.array(*[F.struct(F.lit(ab).alias("atBatIndex"), F.struct(F.col("event_type").alias("event")).alias("result"), F.array(*[runner(i, ab) for i in (0, 1)]).alias("runners")) for ab in (0, 1)])
    docs = _docs(spark, d, F.struct(plays.alias("allPlays")), F.col("event_id").alias("GamePk"), F.year("d").alias("Season"), F.col("d").alias("Date"))
    return J.runner_movements(docs).select("GamePk", "PlayIndex", "AtBatIndex", "RunnerId", "StartBase", "EndBase", "IsOut", "Credits", "RBI", "PlayEvent")


def _box_docs(spark, d):
    u, k = F.col("user_id"), F.col("k")
    player = lambda off: F.struct(
        F.struct((u + off).alias("id"), F.concat(F.lit("P"), (u + off).cast("string")).alias("fullName")).alias("person"), F.when(k % 3 == 0, "100").alias("battingOrder"), F.struct(F.lit("SS").alias("abbreviation")).alias("position"),
        F.struct(F.create_map(F.lit("gamesPlayed"), F.lit("1"), F.lit("hits"), k.cast("string")).alias("batting"), F.create_map(F.lit("gamesPlayed"), F.when(k % 2 == 0, "1").otherwise("0"), F.lit("outs"), (k + 1).cast("string")).alias("pitching")).alias("stats"))
    side = lambda off: F.struct(F.create_map(F.concat(F.lit("ID"), (u + off).cast("string")), player(off)).alias("players"))
    info = F.array(F.struct(F.lit("Weather").alias("label"), F.concat((k + 10).cast("string"), F.lit(" degrees, Clear.")).alias("value")), F.struct(F.lit("Wind").alias("label"), F.concat((k % 20).cast("string"), F.lit(" mph, Out To CF.")).alias("value")))
    body = F.struct(info.alias("info"), F.struct(side(0).alias("away"), side(1000).alias("home")).alias("teams"))
    return _docs(spark, d, body, F.col("event_id").alias("GamePk"), F.year("d").alias("Season"), F.col("d").alias("Date"), F.lit("AWY").alias("away"), F.lit("HOM").alias("home"))


@query("S5 X4", f"""WITH {EV} SELECT event_id AS "GamePk", 'bat' AS kind, user_id + h * 1000 AS "PlayerId", CASE h WHEN 0 THEN 'AWY' ELSE 'HOM' END AS "Team", k AS v FROM ev, (SELECT unnest([0, 1]) AS h)
UNION ALL SELECT event_id, 'pit', user_id + h * 1000, CASE h WHEN 0 THEN 'AWY' ELSE 'HOM' END, k + 1 FROM ev, (SELECT unnest([0, 1]) AS h) WHERE k % 2 = 0 UNION ALL SELECT event_id, 'game', k % 20, 'Out To CF', k + 10 FROM ev""")
def boxscore_rows(spark, d):
    r = J.boxscore_records(_box_docs(spark, d), ["hits"], ["outs"])
    game = F.col("kind") == "game"
    return r.select("GamePk", "kind", F.when(game, F.col("WindSpeed").cast("long")).otherwise(F.col("PlayerId")).alias("PlayerId"), F.when(game, F.col("WindDir")).otherwise(F.col("Team")).alias("Team"),
                    F.when(game, F.col("Temp")).otherwise(F.coalesce("bat_hits", "pit_outs").cast("int")).alias("v"))


def _odds_docs(spark, d):
    k, e = F.col("k"), F.col("event_id")
    out = lambda name, who, point, price: F.struct(F.lit(name).alias("name"), who.alias("description"), point.cast("double").alias("point"), price.cast("int").alias("price"))
    pl = F.concat(F.lit("P"), F.col("user_id").cast("string"))
    none = F.lit(None)
    hits = F.array(out("Over", pl, k % 3 + 0.5, -(100 + k)), out("Under", pl, k % 3 + 0.5, 100 + k), out("Over", pl, F.lit(9.5), F.lit(500)), out("Maybe", pl, F.lit(1.5), F.lit(1)))
    hr = F.array(out("Yes", pl, none, 200 + k))
    tot = F.array(out("Over", none.cast("string"), F.lit(8.5), F.lit(-110)), out("Under", none.cast("string"), F.lit(8.5), -(100 + k)), out("Over", none.cast("string"), F.lit(7.5), F.lit(120)))
    h2h = F.array(out("HOM", none.cast("string"), none, -(100 + k)), out("AWY", none.cast("string"), none, 100 + k))
    mk = lambda key, o: F.struct(F.lit(key).alias("key"), o.alias("outcomes"))
    books = F.array(F.struct(F.col("event_type").alias("key"), F.array(mk("batter_hits", hits), mk("batter_home_runs", hr), mk("totals", tot), mk("h2h", h2h), mk("other", hr)).alias("markets")))
    return _docs(spark, d, F.struct(books.alias("bookmakers")), e.alias("game"), F.col("d").alias("date"), F.lit("HOM").alias("home"), F.lit("AWY").alias("away"))


@query("S6 X6", f"""WITH {EV} SELECT event_id AS game, event_type AS "Book", 'batter_hits' AS "Market", 'P' || user_id AS "PlayerName", CAST(k % 3 + 0.5 AS DOUBLE) AS "Line", -(100 + k) AS "OverPrice", 100 + k AS "UnderPrice" FROM ev
UNION ALL SELECT event_id, event_type, 'batter_hits', 'P' || user_id, 9.5, 500, NULL FROM ev UNION ALL SELECT event_id, event_type, 'batter_home_runs', 'P' || user_id, 0.5, 200 + k, NULL FROM ev""")
def odds_prop_rows(spark, d):
    r = J.prop_prices(_odds_docs(spark, d), {"batter_hits": "batter_hits", "batter_hits_alternate": "batter_hits", "batter_home_runs": "batter_home_runs"})
    return r.select("game", "Book", "Market", "PlayerName", "Line", "OverPrice", "UnderPrice")


@query("S7", f"""WITH {EV} SELECT event_id AS game, event_type AS "Book", 'totals' AS "Market", 'HOM' AS "Team", CAST(8.5 AS DOUBLE) AS line, -110 AS over, -(100 + k) AS under FROM ev UNION ALL SELECT event_id, event_type, 'h2h', 'HOM', NULL, -(100 + k), 100 + k FROM ev""")
def odds_game_rows(spark, d):
    return J.game_prices(_odds_docs(spark, d)).select("game", "Book", "Market", "Team", "line", "over", "under")


@query("S8", f"""WITH {EV} SELECT event_id AS "GamePk", CAST(i AS INT) AS "Inning", CAST(k % (i + 1) AS INT) AS "AwayRuns", CASE WHEN i < 3 THEN CAST(k % (i + 2) AS INT) END AS "HomeRuns" FROM ev, (SELECT unnest([1, 2, 3]) AS i)""")
def inning_linescores(spark, d):
    k = F.col("k")
    inn = F.array(*[F.struct(F.lit(i).alias("num"), F.struct((k % (i + 1)).alias("runs")).alias("away"), F.struct((k % (i + 2)).alias("runs") if i < 3 else F.lit(None).cast("int").alias("runs")).alias("home")) for i in (1, 2, 3)])
    return J.linescores(_docs(spark, d, F.struct(inn.alias("innings")), F.col("event_id").alias("GamePk")))


@query("S9", f"""WITH {GAMES}, days AS (SELECT n_nationkey AS place, CAST(unnest(generate_series((SELECT min(d) FROM games), (SELECT max(d) FROM games), INTERVAL 1 DAY)) AS DATE) AS dd FROM nation WHERE n_nationkey < 20),
hr AS (SELECT place, dd, h, (place * 7 + h * 3 + day(dd)) % 50 + 30.0 AS hum, (place + h) % 9 * 0.1 AS rain FROM days, (SELECT unnest([13, 14, 15, 19, 20, 21]) AS h)),
g AS (SELECT game, home AS place, d, CASE daynight WHEN 'night' THEN 19 ELSE 13 END AS h FROM games)
SELECT g.game, CAST(max(hum) FILTER (WHERE hr.h = g.h) AS DOUBLE) AS humidity, round(CASE WHEN max(hum) FILTER (WHERE hr.h = g.h) IS NOT NULL THEN sum(rain) END, 6)::DOUBLE AS precip FROM g LEFT JOIN hr ON hr.place = g.place AND hr.dd = g.d AND hr.h >= g.h AND hr.h < g.h + 3 GROUP BY 1""")
def hourly_weather_join(spark, d):
    """Hourly payloads per place and day, joined to games at their start hour; places without data stay NULL."""
    all_games = games(spark, d)
    ends = [all_games.select(f("d")).scalar() for f in (F.min, F.max)]
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("place"), F.explode(F.sequence(*ends)).alias("dd"))
    hs = [13, 14, 15, 19, 20, 21]
    arr = lambda f: F.array(*[f(h) for h in hs])
    p = F.col("place")
    body = F.struct(F.struct(arr(lambda h: F.concat(F.col("dd").cast("string"), F.lit(f"T{h:02d}:00"))).alias("time"), arr(lambda h: (p * 7 + h * 3 + F.day("dd")) % 50 + 30.0).alias("relative_humidity_2m"),
                             arr(lambda h: F.lit(1000.0)).alias("surface_pressure"), arr(lambda h: (p + h) % 9 * 0.1).alias("precipitation")).alias("hourly"))
    hours = J.hourly_weather(n.select("place", F.when(p < 20, F.to_json(body)).alias("body")))
    g = all_games.select("game", F.col("home").alias("place"), (
        F.col("d").cast("timestamp_ntz") + F.make_dt_interval(hours=F.when(F.col("daynight") == "night", 19).otherwise(13))).alias("start"))
    r = J.game_weather(g, hours, "game", "start", "place")
    return r.select("game", "humidity", F.round("precip", 6).alias("precip"))


TXT = """CASE event_id % 6 WHEN 0 THEN 'Club placed P on the 10-day injured list.' WHEN 1 THEN 'Club transferred P from the 10-day to the 60-day Injured List.' WHEN 2 THEN 'Club activated P from the 15-day disabled list.' WHEN 3 THEN 'Sent on a rehab assignment to X.' WHEN 4 THEN 'Signed P.' ELSE 'Reinstated P from the injured list' END"""


@query("S10", f"""WITH {EV} SELECT DISTINCT user_id AS "PlayerId", d AS "Date", CASE event_id % 6 WHEN 0 THEN 'place' WHEN 1 THEN 'transfer' WHEN 3 THEN 'rehab' ELSE 'activate' END AS "Kind", CASE event_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 60 WHEN 2 THEN 15 END AS "ILDays" FROM ev WHERE event_id % 6 <> 4""")
def transaction_events(spark, d):
    txt = F.expr(TXT)
    body = F.struct(F.array(F.struct(F.struct(F.col("user_id").alias("id")).alias("person"), F.col("d").cast("string").alias("date"), txt.alias("description"))).alias("transactions"))
    return J.transactions(_docs(spark, d, body))


@query("S11 J25", f"""WITH {EV}, g AS (SELECT user_id, max(event_id) AS snap FROM ev WHERE d <= DATE '2024-01-20' GROUP BY 1)
SELECT event_id AS game_pk, s.side, user_id * 10 + s.o + i AS player, CAST(i AS INT) AS slot FROM ev JOIN g USING (user_id), (SELECT unnest([1, 2, 3]) AS i), (SELECT 'away' AS side, 0 AS o UNION ALL SELECT 'home', 5) s WHERE event_id = snap AND event_id % 4 <> 0""")
def slate_lineups(spark, d):
    """Newest snapshot per slate before the serve time, both sides from the trusted source."""
    u = F.col("user_id")
    ln = lambda off: F.array(*[F.array(u * 10 + off + i, F.lit(i).cast("long")) for i in (1, 2, 3)])
    g = F.struct(F.col("event_id").alias("game_pk"), F.lit("A").alias("away_team"), F.lit("H").alias("home_team"), ln(0).alias("away_lineup"), ln(5).alias("home_lineup"), F.lit("mlb").alias("away_lineup_src"),
                 F.when(F.col("event_id") % 4 != 0, "mlb").otherwise("full").alias("home_lineup_src"))
    ev = events(spark, d).filter("d <= DATE'2024-01-20'")
    last = ev.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    docs = ev.join(last, ["user_id", "event_id"]).select(F.to_json(F.struct(F.col("ts").cast("string").alias("scraped_at"), F.col("d").cast("string").alias("date"), F.array(g).alias("games"))).alias("body"))
    return J.slate_lineups(docs).select("game_pk", "side", "player", "slot")


@query("S12 P1", """SELECT l_orderkey AS game, try_cast(l_quantity AS DOUBLE) AS qty, CAST(NULL AS VARCHAR) AS extra, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def source_schema_mapping(spark, d):
    """Canonical names and types; a column the source lacks is an error, or NULL in lax mode."""
    m = S.map_schema(table(spark, d, "lineitem"), {"game": ("l_orderkey", "long"), "qty": ("l_quantity", "double"), "extra": ("l_extra", "string")}, "lineitem", lax=True)
    return m.groupBy("game", "qty", "extra").agg(F.count(F.lit(1)).alias("n"))


@query("S1 S2 S14", """SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) IN (1996, 1999) GROUP BY 1""")
def season_partitioned_store(spark, d):
    """Written once by season in the shared folder, read back with two partitions and two columns."""
    path = S.shared_path(spark, "orders-by-season")
    S.write_store(table(spark, d, "orders").withColumn("season", F.year("o_orderdate")), path, ["season"])
    return S.read_seasons(spark, path, ["season", "o_totalprice"], [1996, 1999]).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("S1", """SELECT s_suppkey, s_name, s_acctbal FROM supplier""")
def csv_with_mark(spark, d):
    """A CSV copy whose header starts with a byte-order mark, read with the contract schema and pruned."""
    path = S.shared_path(spark, "supplier-csv")
    s = table(spark, d, "supplier")
    s.select(F.col("s_suppkey").alias("﻿s_suppkey"), "s_name", "s_nationkey", "s_acctbal").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_nationkey", T.IntegerType()), T.StructField("s_acctbal", T.DoubleType())])
    return S.read_csv(spark, path, schema, ["s_suppkey", "s_name", "s_acctbal"])


@query("S3 D1", """SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END AS pri FROM orders WHERE year(o_orderdate) <> 1996""")
def schema_tolerant_union(spark, d):
    """Early seasons lack a column (NULL), one season lacks the needed one (skipped)."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    early = o.filter("y IN (1995, 1997)").select("o_orderkey", "y")
    bad = o.filter("y = 1996").select("y")
    late = o.filter("y >= 1998").select("o_orderkey", "y", F.col("o_orderpriority").alias("pri"))
    return S.tolerant_union([early, bad, late], "o_orderkey").select("o_orderkey", "pri")


@query("S13", """SELECT o_orderkey, CASE WHEN year(o_orderdate) = 2001 THEN o_totalprice + 1 ELSE o_totalprice END AS total FROM orders WHERE year(o_orderdate) < 2001 OR o_orderkey % 10 <> 0""")
def season_cached_source(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), F.col("o_totalprice").alias("total"))
    fresh = o.filter("o_orderkey % 10 <> 0").withColumn("total", F.col("total") + 1)
    return R.season_cache(o, fresh, "season", 2001).select("o_orderkey", "total")


@query("S15 D3", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, 'old' AS src FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 50 = 0) UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), 'new' FROM orders WHERE o_orderkey % 50 = 0""")
def upsert_by_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return R.upsert_keys(o.withColumn("src", F.lit("old")), o.filter("o_orderkey % 50 = 0").withColumn("src", F.lit("new")), ["d"])


@query("S16", """SELECT c_custkey, u.c AS "column", u.v AS p FROM (SELECT c_custkey, unnest([{'c': 'bal', 'v': c_acctbal}, {'c': 'half', 'v': c_acctbal / 2}]) AS u FROM customer)""")
def melted_sidecar(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), (F.col("c_acctbal") / 2).alias("half"))
    return S.melt_sidecar(c, ["c_custkey"])


@query("S17 S14", """SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1""")
def appended_archive(spark, d):
    """Two appends to an archive in the shared folder, then measured."""
    path = S.shared_path(spark, "archive")
    n = table(spark, d, "nation")
    S.append_archive(n.filter("n_nationkey < 10"), path)
    S.append_archive(n.filter("n_nationkey >= 10"), path)
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("S18", f"""WITH {EV} SELECT CAST(d AS VARCHAR) AS d, max(1 + k % 3) AS version, 'slate_' || CAST(d AS VARCHAR) || '_v' || max(1 + k % 3) || '.json' AS path FROM ev GROUP BY ev.d""")
def newest_version_per_date(spark, d):
    """Highest suffix per date out of the file names."""
    e = events(spark, d).select(F.concat(F.lit("slate_"), F.col("d").cast("string"), F.lit("_v"), (1 + F.col("k") % 3).cast("string"), F.lit(".json")).alias("path"))
    day, ver = S.file_versions(F.col("path"), r"slate_(\d{4}-\d{2}-\d{2})_v(\d+)")
    return R.newest_version(e.select("path", day.alias("d"), ver.alias("version")), "d", "version", "path").select("d", "version", "path")


@query("S18", f"""WITH {EV}, v AS (SELECT d, max(1 + k % 3) AS version FROM ev GROUP BY 1) SELECT ev.d, version, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM ev JOIN v ON ev.d = v.d AND 1 + k % 3 = version GROUP BY 1, 2""")
def newest_version_files(spark, d):
    """Slates written as versioned folders (the first without a suffix); only the newest of a date is read back."""
    e = events(spark, d).withColumn("version", 1 + F.col("k") % 3)
    suffix = F.when(F.col("version") > 1, F.concat(F.lit("_v"), F.col("version").cast("string"))).otherwise("")
    out = e.select("event_id", "d", "version", F.concat(F.col("d").cast("string"), suffix).alias("slate"))
    base = S.shared_path(spark, "slates")
    out.hint("rebalance", "slate").write.partitionBy("slate").parquet(base)
    return S.read_newest(spark, base, SLATE, out.schema).groupBy("d", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("S20 J26 W18", f"""WITH {EV}, s AS (SELECT event_id % 5000 AS pk, min(event_id) AS e FROM ev WHERE k % 7 <> 0 GROUP BY 1), f AS (SELECT s.pk, ev.d, user_id % 30 AS h, ts, user_id FROM s JOIN ev ON ev.event_id = s.e)
SELECT pk AS "GamePk", d AS "Date", CASE WHEN h % 4 <> 0 THEN 'T' || h ELSE CAST(h AS VARCHAR) END AS home_code, row_number() OVER (PARTITION BY d, h ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S'), pk) AS game_order FROM f""")
def schedule_rows(spark, d):
    """Schedule documents with postponed rows, second listings and season codes."""
    e = F.col("event_id")
    g = F.struct((e % 5000).alias("gamePk"), F.col("d").cast("string").alias("officialDate"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("gameDate"), F.struct(F.when(F.col("k") % 7 != 0, "F").otherwise("D").alias("codedGameState")).alias("status"),
                 F.struct(F.struct(F.struct(F.lit(1).cast("long").alias("id")).alias("team")).alias("away"), F.struct(F.struct((F.col("user_id") % 30).alias("id")).alias("team")).alias("home")).alias("teams"))
    docs = _docs(spark, d, F.struct(F.array(F.struct(F.array(g).alias("games"))).alias("dates")), (F.year("d") * 0 + e).alias("season"))
    codes = events(spark, d).select(e.alias("season"), (F.col("user_id") % 30).alias("id")).filter("id % 4 <> 0").withColumn("code", F.concat(F.lit("T"), F.col("id").cast("string")))
    return J.schedule_games(docs, codes).select("GamePk", "Date", "home_code", "game_order")


@query("S21 D4", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'S' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'L' END) AS game_type FROM orders""")
def backfilled_partition(spark, d):
    """Only missing keys are added; a column older rows lack comes from a lookup."""
    o = table(spark, d, "orders").select("o_orderkey")
    stored = o.filter("o_orderkey % 3 = 0").withColumn("game_type", F.when(F.col("o_orderkey") % 2 == 0, "S"))
    lk = o.filter("o_orderkey % 5 <> 0").withColumn("game_type", F.lit("L"))
    return R.add_missing_keys(stored, o, ["o_orderkey"], "game_type", lk)


@query("D2 ST1", """SELECT least((SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderkey % 2 = 0), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) - 2 AS start, (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT l_orderkey FROM lineitem)) AS n_both""")
def paired_watermark(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("d"))
    both = o.select("k").intersect(li.select("k")).agg(F.count(F.lit(1))).scalar()
    return R.watermark([o, li], "d", 2).withColumn("n_both", both)


@query("ST1 D4", f"""WITH {EV}, st AS (SELECT * FROM ev WHERE d <= DATE '2024-01-20' AND event_id % 7 <> 0), w AS (SELECT max(d) - 2 AS s FROM st)
SELECT event_id, d, CASE WHEN d >= s THEN value + 1 ELSE value END AS v FROM ev, w WHERE (d < s AND event_id % 7 <> 0) OR d >= s""")
def refetch_with_overlap(spark, d):
    """Two days of overlap are fetched again: late rows appear, refetched rows win."""
    ev = events(spark, d).select("event_id", "d", F.col("value").alias("v"))
    stored = ev.filter("d <= DATE'2024-01-20' AND event_id % 7 <> 0")
    return R.refetch_merge(stored, ev.withColumn("v", F.col("v") + 1), ["event_id"], "d", 2)


@query("D4", f"""WITH {EV} SELECT user_id, d, arg_max(event_id, (ts, event_id)) AS event_id FROM ev GROUP BY 1, 2""")
def keep_last_per_key(spark, d):
    return R.keep_last(events(spark, d).select("user_id", "d", "ts", "event_id"), ["user_id", "d"], ["ts", "event_id"]).select("user_id", "d", "event_id")


@query("D5 D11", """SELECT l_orderkey, l_suppkey AS best_supp, l_quantity AS qty FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END) DESC, l_quantity DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def keep_best_row(spark, d):
    """Rows with a value outrank rows without, then the largest exposure."""
    li = table(spark, d, "lineitem")
    has = F.when(F.col("l_tax") > 0.02, 1).otherwise(0)
    return pick_one(li, ["l_orderkey"], [F.desc(has), F.desc("l_quantity"), F.desc("l_suppkey")]).select("l_orderkey", F.col("l_suppkey").alias("best_supp"), F.col("l_quantity").alias("qty"))


@query("D6", f"""WITH {EV} SELECT user_id, d, min(event_id) AS event_id FROM ev GROUP BY 1, 2 HAVING count(*) = 1""")
def drop_ambiguous(spark, d):
    return group_totals(events(spark, d), ["user_id", "d"], c=F.count(F.lit(1))).filter("c = 1").select("user_id", "d", "event_id")


@query("D10", """SELECT DISTINCT id FROM (SELECT l_suppkey AS id FROM lineitem UNION SELECT s_suppkey + 50 FROM supplier UNION SELECT o_custkey FROM orders)""")
def id_universe(spark, d):
    li, s, o = (table(spark, d, t) for t in ("lineitem", "supplier", "orders"))
    return li.select(F.col("l_suppkey").alias("id")).union(s.select(F.col("s_suppkey") + 50)).union(o.select("o_custkey")).distinct()


@query("D11 S9", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS v, o_orderkey % 4 = 0 AS hole FROM orders""")
def visible_holes(spark, d):
    o = table(spark, d, "orders")
    vals = o.filter("o_orderkey % 4 <> 0").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return R.hole_filling(o.select("o_orderkey"), vals, ["o_orderkey"], ["v"])


@query("ST2 A49", f"""WITH {GAMES}, f AS (SELECT game, d FROM games WHERE home_score IS NOT NULL AND d >= DATE '2001-05-01' AND d <= DATE '2001-05-31'), c AS (SELECT l_orderkey AS game, count(*) AS n FROM lineitem GROUP BY 1)
SELECT f.d, f.game, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (game) WHERE coalesce(n, 0) < 4 AND NOT (f.game % 2 = 0 AND coalesce(n, 0) = 2)""")
def late_data_repairs(spark, d):
    """Finals with too few rows that a memo of unchanged counts has not settled."""
    f = games(spark, d).filter("home_score IS NOT NULL").select("game", "d")
    stubs = R.stub_counts(f, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game")), "game", "d", "2001-05-31", 30, 4)
    memo = f.filter("game % 2 = 0").select("game", F.lit(2).cast("long").alias("n"))
    return R.open_repairs(stubs, memo, "game").select("d", "game", "n")


@query("ST6", f"""WITH {EV}, l AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS got FROM ev), h AS (SELECT user_id, max(ts) FILTER (WHERE got > 0) AS hit FROM l GROUP BY 1)
SELECT user_id, CAST(count(*) FILTER (WHERE hit IS NULL OR ts > hit) AS BIGINT) AS misses, count(*) FILTER (WHERE hit IS NULL OR ts > hit) >= 3 AS give_up FROM l JOIN h USING (user_id) GROUP BY 1""")
def negative_cache(spark, d):
    ev = events(spark, d).select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").cast("int").alias("got"))
    return R.empty_attempts(ev, "user_id", ["ts", "event_id"], "got", 3)


@query("Q1 Q2", """SELECT * FROM (VALUES ('key', 'duplicates ' || (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)), ('numeric:l_returnflag', 'unreadable 1.0'), ('stale', (SELECT CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) FROM lineitem))) t("check", detail)""")
def table_contract(spark, d):
    """Every number in one pass; problems come out as rows."""
    c = Q.Contract(columns=("l_orderkey", "l_linenumber", "l_shipdate"), key=("l_orderkey", "l_linenumber"), max_dup_frac=0.01, date="day", max_age_days=30, numeric={"l_quantity": 0.0, "l_returnflag": 0.1})
    li = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate").cast("string"))
    return Q.validate(li, c, today="2003-01-01")


@query("Q2 Q1", """SELECT * FROM (VALUES ('region', 'contract', 'not registered'), ('part', 'contract', 'parent ghost is not registered'), ('supplier', 'rows', 'rows ' || (SELECT count(*) FROM supplier)), ('orders', 'numeric:o_orderstatus', 'unreadable 1.0'),
 ('lineitem', 'key', 'duplicates ' || (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)), ('nation', 'columns', 'missing n_flag')) t(file, "check", detail)""")
def contract_registry(spark, d):
    """Files held against the contract of their name; parents hand down what a child leaves open, and a file without a contract is an error."""
    specs = spark.createDataFrame([
        ("store", None, None, None, 1, 0.0, None), ("customer", "store", ["c_custkey", "c_nationkey"], ["c_custkey"], None, None, None),
        ("supplier", "customer", ["s_suppkey"], ["s_suppkey"], 1 << 60, None, None), ("part", "ghost", ["p_partkey"], ["p_partkey"], None, None, None),
        ("orders", "store", ["o_orderkey"], ["o_orderkey"], None, None, {"o_orderstatus": 0.1}), ("lineitem", "store", ["l_orderkey"], ["l_orderkey", "l_linenumber"], None, None, None),
        ("nation", "store", ["n_nationkey", "n_flag"], None, None, None, None)], SPECS)
    return Q.validate_files(spark, [f"{d}/{t}.parquet" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")], specs)


@query("Q1 D3 Q3", """SELECT 'shrink' AS "check", (SELECT count(*) FROM orders) || ' -> ' || (SELECT count(*) FROM orders WHERE year(o_orderdate) <> 1997) AS detail UNION ALL SELECT 'season', 'vanished 1997'""")
def version_continuity(spark, d):
    """A candidate that lost a season and too many rows against its previous version."""
    o = table(spark, d, "orders").withColumn("season", F.year("o_orderdate"))
    c = Q.Contract(columns=("o_orderkey",), key=("o_orderkey",), season="season", shrink_ratio=0.98)
    return Q.validate(o.filter("season <> 1997"), c, prev=o)


@query("Q3", """SELECT count(*) AS n FROM orders""")
def validated_publish(spark, d):
    """The candidate breaks its contract, so the previous version is served."""
    o = table(spark, d, "orders")
    c = Q.Contract(columns=("o_orderkey",), key=("o_orderkey",), shrink_ratio=0.98)
    served, _ = Q.publish(o.filter("o_orderkey % 2 = 0"), o, c)
    return served.agg(F.count(F.lit(1)).alias("n"))


@query("Q6", """SELECT 'customer' AS side, (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS matched, round((SELECT avg((c_acctbal < 0)::INT) FROM customer), 6) AS null_rate""")
def coverage_report(spark, d):
    c = table(spark, d, "customer")
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("m", F.lit(1))
    bal = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return c.join(seen, "c_custkey", "left").agg(F.lit("customer").alias("side"), F.count(F.lit(1)).alias("n"), F.count("m").alias("matched"), F.round(F.avg(bal.isNull().cast("int")), 6).alias("null_rate"))


@query("Q7 S14", f"""WITH {LED} SELECT 'ledger' AS source, min(d) AS first_date, max(d) AS last_date, count(*) AS n_rows, count(DISTINCT entity) AS n_units FROM led""")
def provenance_report(spark, d):
    return Q.provenance(ledger(spark, d), "ledger", "d", "entity")


@query("ST12 Q7", f"""WITH {EV} SELECT event_type, max(d) AS newest, CAST(date_diff('day', max(d), DATE '2024-02-03') AS INT) AS age_days, date_diff('day', max(d), DATE '2024-02-03') > 4 AS stale FROM (SELECT event_type, CASE WHEN NOT (event_type = 'view' AND d > DATE '2024-01-28') THEN d END AS d FROM ev) GROUP BY 1""")
def freshness_report(spark, d):
    ev = events(spark, d).withColumn("d", F.expr("CASE WHEN NOT (event_type = 'view' AND d > DATE'2024-01-28') THEN d END"))
    return Q.freshness(ev, "d", "2024-02-03", 4, ["event_type"])


@query("S14", """SELECT 'region' AS store, (SELECT count(*) FROM region) AS n_rows, 2 AS n_columns UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 6""")
def store_manifest(spark, d):
    return S.manifest(spark, {t: table(spark, d, t) for t in ("region", "orders")}).select("store", "n_rows", "n_columns")


@query("G14", f"""WITH {GAMES}, tg AS (SELECT game, d, season, home AS team, home_score AS rf FROM games WHERE home_score IS NOT NULL UNION ALL SELECT game, d, season, away, away_score FROM games WHERE home_score IS NOT NULL),
up AS (SELECT DISTINCT team, DATE '2001-07-15' AS d FROM tg) SELECT up.team, count(tg.game) FILTER (WHERE tg.season = 2001) AS games, round(avg(rf) FILTER (WHERE tg.season = 2001), 6) AS rf_mean, CAST(date_diff('day', max(tg.d), up.d) AS INT) AS rest FROM up LEFT JOIN tg ON tg.team = up.team AND tg.d < up.d GROUP BY up.team, up.d""")
def upcoming_slate_context(spark, d):
    """Scoreless pseudo-rows for an upcoming date ride through the same history operators."""
    from asofkit.operators.asof import asof_join
    from asofkit.operators.windows import season_totals_before
    from asofkit.plans.windows import _team_games

    tg = _team_games(spark, d)
    up = tg.select("team").distinct().select("team", F.lit(2001).alias("season"), F.lit("2001-07-15").cast("date").alias("d"))
    hist = tg.select("team", "season", "d", F.lit(1).alias("one"), "rf").unionByName(up.withColumn("one", F.lit(0)), allowMissingColumns=True)
    t = season_totals_before(hist, "team", "season", "d", ["one", "rf"]).join(up, ["team", "season", "d"])
    prev = tg.select("team", "d").distinct().withColumn("pd", F.col("d"))
    j = asof_join(t, prev, ["team"], ["pd"])
    return j.select("team", F.col("one_sofar").cast("long").alias("games"), F.round(F.col("rf_sofar") / F.nullif("one_sofar", F.lit(0)), 6).alias("rf_mean"), F.datediff("d", "pd").alias("rest"))


@query("M8", f"""WITH {PA}, f AS (SELECT * FROM (VALUES (1998, 1996, 1997), (1999, 1997, 1998), (2000, 1998, 1999), (2001, 2001, 2000)) t(fold, train_to, cal)),
c AS (SELECT pitcher, season, count(*) AS n, sum((label = 'cR')::INT) AS k, min(d) AS d0, max(d) AS d1 FROM pa GROUP BY 1, 2), x AS (SELECT * FROM f, c),
w AS (SELECT fold, min(d0) AS fit_start, max(d1) AS fit_end FROM x WHERE season <= train_to OR season = cal GROUP BY 1), lg AS (SELECT fold, sum(k) * 1.0 / sum(n) AS q FROM x WHERE season <= train_to GROUP BY 1),
tr AS (SELECT fold, pitcher, sum(n) AS tn, sum(k) AS tk FROM x WHERE season <= train_to GROUP BY 1, 2),
p AS (SELECT x.*, (coalesce(tk, 0) + 100.0 * q) / (coalesce(tn, 0) + 100.0) AS p FROM x JOIN lg ON x.fold = lg.fold LEFT JOIN tr ON x.fold = tr.fold AND x.pitcher = tr.pitcher WHERE season = cal OR season = x.fold),
a AS (SELECT fold, sum(k) * 1.0 / sum(n) AS truth, sum(n * p) / sum(n) AS mean FROM p WHERE season = cal GROUP BY 1),
s AS (SELECT p.*, 1 / (1 + exp(-(ln(p / (1 - p)) + ln(truth / (1 - truth)) - ln(mean / (1 - mean))))) AS pa FROM p JOIN a ON p.fold = a.fold WHERE season = p.fold),
r AS (SELECT s.fold, any_value(fit_end) AS fit_end, min(d0) AS eval_start, any_value(fit_end) < min(d0) AS honest, sum(n) AS n, -sum(k * ln(pa) + (n - k) * ln(1 - pa)) AS nll FROM s JOIN w ON s.fold = w.fold GROUP BY 1)
SELECT CAST(fold AS INT) AS fold, fit_end, eval_start, honest, CAST(n AS BIGINT) AS n, round(nll / n, 6) AS ll FROM r UNION ALL SELECT NULL, NULL, NULL, TRUE, CAST(sum(n) AS BIGINT), round(sum(nll) / sum(n), 6) FROM r WHERE honest""")
def honest_folds(spark, d):
    """Shrunk rates per fold, level set on the calibration season, scored on the next: the fit's own days decide which folds are pooled.

    The last fold is fitted through its own season, as a model in use is, and falls out.
    """
    from asofkit.operators.learn import anchored, fit_window, judge_folds

    hit = (F.col("label") == "cR").cast("int")
    cells = appearances(spark, d).groupBy("pitcher", "season").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("k"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    folds = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(t).alias("train_to"), F.lit(c).alias("cal")) for f, t, c in ((1998, 1996, 1997), (1999, 1997, 1998), (2000, 1998, 1999), (2001, 2001, 2000))])
    x = cut_lineage(cells).withColumn("f", F.explode(folds)).select("pitcher", "season", "n", "k", "d0", "d1", "f.*")
    train, cal, score = F.col("season") <= F.col("train_to"), F.col("season") == F.col("cal"), F.col("season") == F.col("fold")
    days = lambda rows: rows.select("fold", F.explode(F.array("d0", "d1")).alias("d"))
    own = x.filter(train).groupBy("fold", "pitcher").agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    league = own.groupBy("fold").agg((F.sum("tk") / F.sum("tn")).alias("q"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    p = x.filter(cal | score).join(league, "fold").join(own, ["fold", "pitcher"], "left").withColumn("p", (zero("tk") + 100.0 * F.col("q")) / (zero("tn") + 100.0))
    level = p.filter(cal).groupBy("fold").agg((F.sum("k") / F.sum("n")).alias("truth"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("mean"))
    s = p.filter(score).join(level, "fold").withColumn("pa", anchored(F.col("p"), F.col("truth"), F.col("mean")))
    nll = -F.sum(F.col("k") * F.log("pa") + (F.col("n") - F.col("k")) * F.log(1 - F.col("pa")))
    judged = judge_folds(days(x.filter(score)), fit_window(days(x.filter(train | cal)), "fold", "d"), "fold", "d")
    r = s.groupBy("fold").agg(F.sum("n").alias("n"), nll.alias("nll")).join(judged, "fold")
    r = r.select("fold", "fit_end", "eval_start", "honest", "n", "nll")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    pool = r.filter("honest").agg(F.sum("n").alias("n"), F.sum("nll").alias("nll")).select(none("fold", "int"), none("fit_end", "date"), none("eval_start", "date"), F.lit(True).alias("honest"), "n", "nll")
    return r.unionByName(pool).select("fold", "fit_end", "eval_start", "honest", "n", F.round(F.col("nll") / F.col("n"), 6).alias("ll"))


@query("M8 M2", """SELECT f AS fold, f - 2 AS train_to, f - 1 AS calibrate, f AS score, count(*) FILTER (WHERE year(o_orderdate) <= f - 2) AS n_train, count(*) FILTER (WHERE year(o_orderdate) = f - 1) AS n_cal, count(*) FILTER (WHERE year(o_orderdate) = f) AS n_score FROM orders, (SELECT CAST(unnest([1998, 1999, 2000, 2001]) AS INT) AS f) GROUP BY 1""")
def walk_forward_folds(spark, d):
    """Rolling-origin windows and their sizes, from season counts."""
    from asofkit.operators.learn import walk_forward_windows

    return walk_forward_windows(table(spark, d, "orders").withColumn("season", F.year("o_orderdate")), "season", [1998, 1999, 2000, 2001])


