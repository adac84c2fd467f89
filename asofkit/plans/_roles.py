"""The given tables seen through the roles the operators work on, with the same frames as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions.prob import sigmoid


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- user events: entity, day, class label, value -------------------------------------
def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", "ts", F.to_date("ts").alias("d"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EV = """ev AS (SELECT event_id, ts, CAST(ts AS DATE) AS d, user_id, event_type, value,
  CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)"""

EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]


# --- line items as plate appearances: game, order in game, two entities, outcome ------
PA_ORDER = ["seq", "d", "batter", "pitcher", "qty", "price", "disc", "tax", "label", "status"]


def appearances(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("batter"),
        F.col("l_suppkey").alias("pitcher"), day.alias("d"), F.year(day).alias("season"),
        F.concat(F.lit("c"), "l_returnflag").alias("label"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
    )


PA = """pa AS (SELECT l_orderkey AS game, l_linenumber AS seq, l_partkey AS batter, l_suppkey AS pitcher,
  CAST(l_shipdate AS DATE) AS d, CAST(year(l_shipdate) AS INT) AS season, 'c' || l_returnflag AS label,
  l_linestatus AS status, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax FROM lineitem)"""
PA_ORD = ", ".join(PA_ORDER)
LABELS = ["cA", "cN", "cR"]


# --- orders as games between a home nation (customer) and the order key's away nation --
def games(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(
        table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    return o.select(
        key.alias("game"), day.alias("d"), F.year(day).alias("season"),
        F.col("c_nationkey").cast("long").alias("home"), ((F.col("c_nationkey") + 1 + key % 24) % 25).alias("away"),
        F.when(key % 2 == 0, "night").otherwise("day").alias("daynight"),
        F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("long") % 11).alias("home_score"),
        F.when(F.col("o_orderstatus") != "P", (F.floor("o_totalprice") / 11).cast("long") % 9).alias("away_score"),
        (F.col("c_nationkey").cast("long") % 25).alias("venue"),
    )


GAMES = """games AS (SELECT o_orderkey AS game, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INT) AS season,
  CAST(c_nationkey AS BIGINT) AS home, (c_nationkey + 1 + o_orderkey % 24) % 25 AS away,
  CASE WHEN o_orderkey % 2 = 0 THEN 'night' ELSE 'day' END AS daynight,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) % 11 END AS home_score,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(floor(o_totalprice) / 11) AS BIGINT) % 9 END AS away_score,
  CAST(c_nationkey AS BIGINT) % 25 AS venue FROM orders JOIN customer ON o_custkey = c_custkey)"""


# --- forecast ledger: game, day, family, market, stated p, outcome y, entity ----------
def ledger(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    p = sigmoid((F.col("value") - 50.0) / 40.0)
    u = ((F.col("event_id") * 7919 + 13) % 1000) / 1000.0
    return e.select(
        F.col("event_id").alias("game"), "d", F.col("event_type").alias("family"),
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 3).cast("string")).alias("market"),
        F.col("user_id").alias("entity"), p.alias("p"), (u < 0.15 + 0.6 * p).cast("int").alias("y"),
    )


LED = """led AS (SELECT event_id AS game, CAST(ts AS DATE) AS d, event_type AS family,
  event_type || '_' || CAST(user_id % 3 AS VARCHAR) AS market, user_id AS entity, p,
  CASE WHEN ((event_id * 7919 + 13) % 1000) / 1000.0 < 0.15 + 0.6 * p THEN 1 ELSE 0 END AS y
  FROM (SELECT *, 1.0 / (1.0 + exp(-((value - 50.0) / 40.0))) AS p FROM events))"""


def ledger_b(spark: SparkSession, d: str) -> DataFrame:
    """A second stack over the same games: sharper odds, some games missing, some outcomes in dispute."""
    a = ledger(spark, d).filter(F.col("game") % 11 != 0)
    z = F.log(F.col("p")) - F.log(1 - F.col("p"))
    y = F.when(F.col("game") % 97 == 0, 1 - F.col("y")).otherwise(F.col("y"))
    return a.withColumn("p", sigmoid(0.6 * z - 0.2)).withColumn("y", y)


LED_B = """led_b AS (SELECT game, d, family, market, entity,
  1.0 / (1.0 + exp(-(0.6 * (ln(p) - ln(1 - p)) - 0.2))) AS p, CASE WHEN game % 97 = 0 THEN 1 - y ELSE y END AS y
  FROM led WHERE game % 11 <> 0)"""


# --- price captures: key (day-free), book, two American prices, capture time ----------
def captures(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    fav = -(100 + (e * 31) % 150)
    dog = 100 + (e * 17) % 200
    home_fav = e % 2 == 0
    return events(spark, d).select(
        e.alias("seq"), "ts", "d", F.col("user_id").alias("entity"),
        F.concat(F.lit("m"), (F.col("k") % 2).cast("string")).alias("market"),
        (F.col("k") % 2 + 0.5).alias("line"), F.col("event_type").alias("book"),
        F.when(e % 9 == 0, None).otherwise(F.when(home_fav, fav).otherwise(dog)).alias("over"),
        F.when(e % 5 == 0, None).otherwise(F.when(home_fav, dog).otherwise(fav)).alias("under"),
        F.when(e % 4 != 0, F.col("user_id") % 7 + 700).alias("game"),
    )


CAP = """cap AS (SELECT event_id AS seq, ts, d, user_id AS entity, 'm' || CAST(k % 2 AS VARCHAR) AS market,
  k % 2 + 0.5 AS line, event_type AS book,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN -(100 + (event_id * 31) % 150)
       ELSE 100 + (event_id * 17) % 200 END AS over,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 100 + (event_id * 17) % 200
       ELSE -(100 + (event_id * 31) % 150) END AS under,
  CASE WHEN event_id % 4 <> 0 THEN user_id % 7 + 700 END AS game FROM ev)"""


def prob_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN -{x} / (-{x} + 100.0) WHEN {x} > 0 THEN 100.0 / ({x} + 100.0) END)"
