"""Guarded joins on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.operators import joins as J
from asofkit.plans._roles import CAP, EV, GAMES, PA, appearances, captures, events, games, table
from asofkit.registry import query


@query("J1 Q4 D5", """
WITH best AS (SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1)
SELECT c_custkey, c_nationkey, o_orderkey AS top_order, o_totalprice AS top_total FROM customer LEFT JOIN best ON c_custkey = o_custkey""")
def guarded_dimension_join(spark, d):
    """Many orders per customer: only the best one joins, so customers never multiply."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("top_order"),
                                         F.col("o_totalprice").alias("top_total"))
    return J.guarded_lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), o, ["c_custkey"],
                            [F.desc("top_total"), F.asc("top_order")], ["top_order", "top_total"])


@query("J8 X26", f"""
WITH {PA}, v AS (SELECT p_partkey, p_retailprice AS v FROM part WHERE p_size > 5), r AS (SELECT o_orderkey AS row_id,
  o_orderkey % 2000 AS f1, (o_orderkey * 3 + 1) % 2000 AS f2, (o_orderkey * 7 + 2) % 2000 AS f3, (o_orderkey * 11 + 5) % 2600 AS f4 FROM orders)
SELECT row_id, round((coalesce(a.v, 0) + coalesce(b.v, 0)) / nullif((a.v IS NOT NULL)::INT + (b.v IS NOT NULL)::INT, 0), 6) AS infield,
 round((coalesce(c.v, 0) + coalesce(e.v, 0)) / nullif((c.v IS NOT NULL)::INT + (e.v IS NOT NULL)::INT, 0), 6) AS outfield
FROM r LEFT JOIN v a ON f1 = a.p_partkey LEFT JOIN v b ON f2 = b.p_partkey LEFT JOIN v c ON f3 = c.p_partkey LEFT JOIN v e ON f4 = e.p_partkey""")
def multi_slot_lookup(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("row_id"), (k % 2000).alias("f1"), ((k * 3 + 1) % 2000).alias("f2"),
                                            ((k * 7 + 2) % 2000).alias("f3"), ((k * 11 + 5) % 2600).alias("f4"))
    dim = table(spark, d, "part").filter("p_size > 5").select("p_partkey", F.col("p_retailprice").alias("v"))
    r = J.slot_means(rows, "row_id", {"infield": ["f1", "f2"], "outfield": ["f3", "f4"]}, dim, "p_partkey", "v")
    return r.select("row_id", F.round("infield", 6).alias("infield"), F.round("outfield", 6).alias("outfield"))


@query("J9 D3", """
SELECT 'in_both' AS part, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'todo', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'stored', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def work_list(spark, d):
    """Complete only when in both files; still to do when in neither."""
    o, li = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem")
    key = lambda df: df.select(F.col("l_orderkey").alias("o_orderkey"))
    r, a = key(li.filter("l_returnflag = 'R'")), key(li.filter("l_returnflag = 'A'"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return (n(o.join(r, "o_orderkey", "left_semi").join(a, "o_orderkey", "left_semi"), "in_both")
            .unionByName(n(o.join(key(li), "o_orderkey", "left_anti"), "todo"))
            .unionByName(n(o.join(key(li), "o_orderkey", "left_semi"), "stored")))


@query("J10", """
WITH sl AS (SELECT l_orderkey AS game, l_linenumber AS slot, min(l_suppkey) AS pitcher, min(l_partkey) AS batter FROM lineitem GROUP BY 1, 2),
t AS (SELECT unnest([1, 2, 3]) AS tto)
SELECT p.game, p.slot AS p_slot, b.slot AS b_slot, CAST(t.tto AS INT) AS tto, p.pitcher, b.batter FROM sl p JOIN sl b ON p.game = b.game CROSS JOIN t WHERE p.slot <= 2""")
def matchup_grid(spark, d):
    """Pitcher slot x batter slot x times through, per game. A game has one row per slot, so the
    grid of a game is bounded by the slot vocabulary (two pitcher slots, seven batter slots)."""
    li = table(spark, d, "lineitem")
    slots = li.groupBy(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("slot")).agg(
        F.min("l_suppkey").alias("pitcher"), F.min("l_partkey").alias("batter"))
    p = slots.filter("slot <= 2").select("game", F.col("slot").alias("p_slot"), "pitcher")
    b = slots.select("game", F.col("slot").alias("b_slot"), "batter")
    return p.join(b, "game").select("game", "p_slot", "b_slot", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("tto"), "pitcher", "batter")


NAMES = """idx AS (SELECT c_custkey AS entity, c_nationkey AS team, 'José Núñez x' || chr(CAST(97 + c_custkey % 26 AS INT)) || chr(CAST(97 + c_custkey // 26 % 26 AS INT)) || ' Jr.' AS name FROM customer)"""


def _name_index(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("entity"), F.col("c_nationkey").alias("team"),
        F.concat(F.lit("José Núñez x"), F.chr(97 + k % 26), F.chr(97 + F.floor(k / 26) % 26), F.lit(" Jr.")).alias("name"))


CLUB_TIERS = [(lab, c, k) for c in ("home", "away") for lab, k in (("exact", "n"), ("team_collapsed", "c"), ("initial", "l"))]


def _clubs_sql() -> str:
    one = "HAVING count(DISTINCT entity) = 1"
    joins = " ".join(f"LEFT JOIN {t} AS x{i} ON x{i}.team = qk.{c} AND x{i}.{k} = qk.{k}" + (f" AND x{i}.i = qk.i" if k == "l" else "") for i, (t, c, k) in enumerate((lab, c, k) for lab, c, k in CLUB_TIERS))
    ids = ", ".join([f"x{i}.e" for i in range(6)] + ["g1.e", "g2.e"])
    club = " ".join(f"WHEN x{i}.e IS NOT NULL THEN qk.{c}" for i, (_, c, _) in enumerate(CLUB_TIERS))
    tier = " ".join(f"WHEN x{i}.e IS NOT NULL THEN '{lab}'" for i, (lab, _, _) in enumerate(CLUB_TIERS))
    return f"""
WITH {NAMES}, nidx AS (SELECT entity, team, 'jose nunez x' || chr(CAST(97 + entity % 26 AS INT)) || chr(CAST(97 + entity // 26 % 26 AS INT)) AS n FROM idx),
k AS (SELECT *, replace(n, ' ', '') AS c, split_part(n, ' ', 3) AS l, 'j' AS i FROM nidx),
q AS (SELECT entity AS ask_id, (team + entity % 3) % 25 AS home, (team + 1) % 25 AS away, CASE WHEN entity % 3 = 0 THEN n WHEN entity % 3 = 1 THEN 'josenunez ' || split_part(n, ' ', 3) ELSE 'j ' || split_part(n, ' ', 3) END AS n FROM k),
qk AS (SELECT *, replace(n, ' ', '') AS c, split_part(n, ' ', -1) AS l, substr(n, 1, 1) AS i FROM q),
exact AS (SELECT team, n, max(entity) AS e FROM k GROUP BY 1, 2), team_collapsed AS (SELECT team, c, min(entity) AS e FROM k GROUP BY 1, 2 {one}), initial AS (SELECT team, l, i, min(entity) AS e FROM k GROUP BY 1, 2, 3 {one}),
gn AS (SELECT n, min(entity) AS e FROM k GROUP BY 1 {one}), gc AS (SELECT c, min(entity) AS e FROM k GROUP BY 1 {one})
SELECT ask_id, coalesce({ids}) AS entity, CASE {club} END AS club, CASE {tier} WHEN g1.e IS NOT NULL THEN 'name' WHEN g2.e IS NOT NULL THEN 'collapsed' END AS tier
FROM qk {joins} LEFT JOIN gn AS g1 ON g1.n = qk.n LEFT JOIN gc AS g2 ON g2.c = qk.c"""


@query("J12", _clubs_sql())
def two_club_resolution(spark, d):
    """A name on one of two clubs: the club's own tiers first, then names unique anywhere, without a club."""
    idx = _name_index(spark, d)
    tail, k = F.element_at(F.split("name", " "), 3), F.col("entity")
    asks = idx.select(k.alias("ask_id"), ((F.col("team") + k % 3) % 25).alias("home"), ((F.col("team") + 1) % 25).alias("away"),
                      F.when(k % 3 == 0, F.col("name")).when(k % 3 == 1, F.concat(F.lit("JoseNunez "), tail)).otherwise(F.concat(F.lit("J. "), tail)).alias("name"))
    return J.resolve_for_clubs(asks, idx, "ask_id", ["home", "away"], "team", "name", "entity").select("ask_id", "entity", "club", "tier")


@query("J12 X1 X2", f"""
WITH {NAMES}, nidx AS (SELECT entity, team, 'jose nunez x' || chr(CAST(97 + entity % 26 AS INT)) || chr(CAST(97 + entity // 26 % 26 AS INT)) AS n FROM idx),
k AS (SELECT *, replace(n, ' ', '') AS c, split_part(n, ' ', 3) AS l, 'j' AS i FROM nidx),
q AS (SELECT entity AS ask_id, CASE WHEN entity % 5 = 4 THEN -1 ELSE team END AS team, CASE WHEN entity % 3 = 0 THEN 'jose nunez ' || split_part(n, ' ', 3)
   WHEN entity % 3 = 1 THEN 'josenunez ' || split_part(n, ' ', 3) ELSE 'j ' || split_part(n, ' ', 3) END AS n FROM k),
qk AS (SELECT *, replace(n, ' ', '') AS c, split_part(n, ' ', -1) AS l, substr(n, 1, 1) AS i FROM q),
u1 AS (SELECT team, n, max(entity) AS e FROM k GROUP BY 1, 2), u2 AS (SELECT team, c, min(entity) AS e FROM k GROUP BY 1, 2 HAVING count(DISTINCT entity) = 1),
u3 AS (SELECT n, min(entity) AS e FROM k GROUP BY 1 HAVING count(DISTINCT entity) = 1), u4 AS (SELECT c, min(entity) AS e FROM k GROUP BY 1 HAVING count(DISTINCT entity) = 1),
u5 AS (SELECT team, l, i, min(entity) AS e FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT entity) = 1)
SELECT ask_id, coalesce(u1.e, u2.e, u3.e, u4.e, u5.e) AS entity,
 CASE WHEN u1.e IS NOT NULL THEN 'exact' WHEN u2.e IS NOT NULL THEN 'team_collapsed' WHEN u3.e IS NOT NULL THEN 'name' WHEN u4.e IS NOT NULL THEN 'collapsed' WHEN u5.e IS NOT NULL THEN 'initial' END AS tier
FROM qk LEFT JOIN u1 ON qk.team = u1.team AND qk.n = u1.n LEFT JOIN u2 ON qk.team = u2.team AND qk.c = u2.c LEFT JOIN u3 ON qk.n = u3.n
LEFT JOIN u4 ON qk.c = u4.c LEFT JOIN u5 ON qk.team = u5.team AND qk.l = u5.l AND qk.i = u5.i""")
def entity_resolution(spark, d):
    """Noisy names (accents, suffix, position token, collapsed, initial only) against the customer index."""
    idx = _name_index(spark, d)
    tail = F.element_at(F.split("name", " "), 3)
    k = F.col("entity")
    asks = idx.select(k.alias("ask_id"), F.when(k % 5 == 4, -1).otherwise(F.col("team")).alias("team"),
                      F.when(k % 3 == 0, F.concat(F.lit("jose-núñez-"), tail, F.lit("-3b")))
                      .when(k % 3 == 1, F.concat(F.lit("JoseNunez "), tail, F.lit(" sr")))
                      .otherwise(F.concat(F.lit("J. "), tail)).alias("name"))
    return J.resolve_entities(asks, idx, "ask_id", "team", "name", "entity").select("ask_id", "entity", "tier")


@query("J13", f"""
WITH {EV}, l AS (SELECT event_id, user_id, ts FROM ev WHERE event_type = 'click'), r AS (SELECT event_id AS rid, user_id, ts AS rts FROM ev WHERE event_type = 'view'),
n AS (SELECT user_id, count(*) AS n FROM r GROUP BY 1),
g AS (SELECT l.event_id, r.rid, abs(epoch_us(r.rts) - epoch_us(l.ts)) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(r.rts) - epoch_us(l.ts)), r.rid) AS rn
  FROM l JOIN r ON l.user_id = r.user_id),
b AS (SELECT a.event_id, a.rid, a.gap, c.gap AS gap2 FROM g a LEFT JOIN g c ON a.event_id = c.event_id AND c.rn = 2 WHERE a.rn = 1)
SELECT l.event_id, CASE WHEN n.n = 1 THEN (CASE WHEN gap <= 21600000000 THEN rid END) WHEN gap + 300000000 < gap2 THEN rid END AS rid_match
FROM l LEFT JOIN b ON l.event_id = b.event_id LEFT JOIN n ON l.user_id = n.user_id""")
def nearest_event_match(spark, d):
    ev = events(spark, d)
    left = ev.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    right = ev.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("rid"), F.col("ts").alias("rts"))
    return J.nearest_guarded(left, right, ["user_id"], "event_id", "ts", "rts", "rid").select("event_id", "rid_match")


@query("J14 D9", f"""
WITH {EV}, {CAP}, c AS (SELECT entity, market, game, count(*) AS v FROM cap GROUP BY 1, 2, 3),
l AS (SELECT DISTINCT entity, market, coalesce(game, 0 * entity + 700 + entity % 7) AS game FROM cap WHERE seq % 3 = 0 UNION SELECT DISTINCT entity, market, 999 FROM cap WHERE seq % 50 = 0),
ex AS (SELECT * FROM c WHERE game IS NOT NULL), se AS (SELECT * FROM c WHERE game IS NULL),
ids AS (SELECT entity, market, count(DISTINCT game) AS ids FROM l GROUP BY 1, 2), has AS (SELECT DISTINCT entity, market FROM ex)
SELECT l.entity, l.market, l.game, coalesce(ex.v, CASE WHEN has.entity IS NULL AND ids.ids <= 1 THEN se.v END) AS v,
 CASE WHEN ex.v IS NOT NULL THEN 'exact' WHEN has.entity IS NULL AND ids.ids <= 1 AND se.v IS NOT NULL THEN 'sentinel' END AS v_via
FROM l LEFT JOIN ex ON l.entity = ex.entity AND l.market = ex.market AND l.game = ex.game LEFT JOIN se ON l.entity = se.entity AND l.market = se.market
LEFT JOIN ids ON l.entity = ids.entity AND l.market = ids.market LEFT JOIN has ON l.entity = has.entity AND l.market = has.market""")
def fallback_key_lookup(spark, d):
    cap = captures(spark, d)
    dim = cap.groupBy("entity", "market", "game").agg(F.count(F.lit(1)).alias("v"))
    left = cap.filter("seq % 3 = 0").select("entity", "market", F.coalesce("game", 700 + F.col("entity") % 7).alias("game")).unionByName(
        cap.filter("seq % 50 = 0").select("entity", "market", F.lit(999).cast("long").alias("game"))).distinct()
    return J.fallback_lookup(left, dim, ["entity", "market"], "game", "v")


@query("D9 J14", f"""
WITH {EV}, {CAP}, k AS (SELECT DISTINCT entity, market, book FROM cap WHERE game IS NOT NULL)
SELECT seq, entity, market, book, game FROM cap WHERE game IS NOT NULL OR (entity, market, book) NOT IN (SELECT (entity, market, book) FROM k)""")
def stale_sentinel_suppression(spark, d):
    r = J.drop_stale_sentinels(captures(spark, d), ["entity", "market", "book"], "game")
    return r.select("seq", "entity", "market", "book", "game")


@query("J15 W18", f"""
WITH {GAMES}, l AS (SELECT home, d, game, row_number() OVER w AS ord, count(*) OVER (PARTITION BY home, d) AS nl FROM games WINDOW w AS (PARTITION BY home, d ORDER BY game)),
r AS (SELECT home, d, game AS final, home_score, row_number() OVER w AS ord, count(*) OVER (PARTITION BY home, d) AS nr FROM games WHERE home_score IS NOT NULL WINDOW w AS (PARTITION BY home, d ORDER BY game)),
c AS (SELECT DISTINCT home, d, nr FROM r)
SELECT l.game, l.ord, CASE WHEN c.nr IS NULL THEN 'no_right' WHEN l.nl = c.nr THEN 'paired' ELSE 'unequal' END AS status, CASE WHEN l.nl = c.nr THEN r.final END AS final
FROM l LEFT JOIN c ON l.home = c.home AND l.d = c.d LEFT JOIN r ON l.home = r.home AND l.d = r.d AND l.ord = r.ord""")
def ordinal_pairing(spark, d):
    """k-th listed game of a day with the k-th final of it; refused when the counts differ."""
    g = games(spark, d)
    fin = g.filter("home_score IS NOT NULL").select("home", "d", F.col("game").alias("final"))
    slot = lambda c: F.floor(F.col(c) / 1000)
    r = J.ordinal_pair(g.select("home", "d", "game"), fin, ["home", "d"], [F.col("game")], [F.col("final")], slot("game"), slot("final"), ["final"])
    return r.select("game", "ord", "status", "final")


@query("J17", f"""
WITH {EV}, iv AS (SELECT user_id, d AS place, CASE WHEN event_id % 3 <> 0 THEN d + CAST(k % 10 AS INT) END AS act FROM ev WHERE event_type = 'signup'),
app AS (SELECT user_id, d, max(d) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_app FROM (SELECT DISTINCT user_id, d FROM ev WHERE event_type = 'view'))
SELECT e.event_id, max(iv.place) AS active_since, CAST(max(iv.place) IS NOT NULL AND NOT coalesce(max(a.d) > max(iv.place), FALSE) AS BOOLEAN) AS unavailable
FROM ev e LEFT JOIN iv ON e.user_id = iv.user_id AND iv.place <= e.d AND (iv.act IS NULL OR iv.act > e.d)
LEFT JOIN (SELECT DISTINCT user_id, d FROM ev WHERE event_type = 'view') a ON a.user_id = e.user_id AND a.d < e.d GROUP BY 1""")
def unavailable_on_date(spark, d):
    """Inside an interval on the day, unless a later appearance overrides it."""
    from asofkit.operators.asof import asof_join

    ev = events(spark, d)
    iv = ev.filter("event_type = 'signup'").select(
        "user_id", F.col("d").alias("place"), F.when(F.col("event_id") % 3 != 0, F.date_add("d", F.col("k") % 10)).alias("act"))
    seen = ev.filter("event_type = 'view'").select("user_id", "d").distinct().withColumn("app", F.col("d"))
    j = J.interval_active(ev, iv, ["user_id"], "d", "place", "act")
    j = asof_join(j, seen, ["user_id"], ["app"])
    off = F.col("active_since").isNotNull() & ~F.coalesce(F.col("app") > F.col("active_since"), F.lit(False))
    return j.select("event_id", "active_since", off.alias("unavailable"))


@query("J19", f"""
WITH {GAMES} SELECT game, is_home, CASE WHEN is_home = 1 THEN home_score ELSE away_score END AS own_score, CASE WHEN is_home = 1 THEN away_score ELSE home_score END AS opp_score
FROM games, (SELECT unnest([0, 1]) AS is_home)""")
def own_opponent_columns(spark, d):
    g = games(spark, d).withColumn("is_home", F.explode(F.array(F.lit(0), F.lit(1))))
    return g.select("game", "is_home", *J.perspective(g, F.col("is_home") == 1, ["score"]))


@query("J20", f"""
WITH {EV}, dd AS (SELECT user_id, d, count(*) AS np FROM ev GROUP BY 1, 2)
SELECT a.user_id, a.d, a.np, coalesce(b.np, 0) AS np_lag1, coalesce(c.np, 0) AS np_lag2 FROM dd a LEFT JOIN dd b ON a.user_id = b.user_id AND b.d + 1 = a.d
LEFT JOIN dd c ON a.user_id = c.user_id AND c.d + 2 = a.d""")
def exact_lag_lookup(spark, d):
    daily = events(spark, d).groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("np"))
    return J.exact_lag(daily, daily, ["user_id"], "d", "np", [1, 2])


@query("J16 Q6", """
SELECT count(*) FILTER (WHERE a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL) AS shared, count(*) FILTER (WHERE b.o_orderkey IS NULL) AS only_a, count(*) FILTER (WHERE a.o_orderkey IS NULL) AS only_b
FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0) b ON a.o_orderkey = b.o_orderkey""")
def join_coverage(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    a = o.filter("o_orderkey % 3 <> 0").withColumn("a", F.lit(1))
    b = o.filter("o_orderkey % 4 <> 0").withColumn("b", F.lit(1))
    return a.join(b, "o_orderkey", "full_outer").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_a"),
        F.count_if(F.col("a").isNull()).alias("only_b"))


@query("J21 P5", """
WITH cur AS (SELECT n_nationkey AS k, 'now' AS src, CAST(n_nationkey * 2.5 - 30 AS DOUBLE) AS lat FROM nation WHERE n_nationkey % 3 = 0),
al AS (SELECT n_nationkey AS k, CAST(n_nationkey // 3 * 3 AS INT) AS canon FROM nation WHERE n_nationkey % 3 = 1),
hist AS (SELECT n_nationkey AS k, CAST(n_nationkey * 1.5 AS DOUBLE) AS lat FROM nation WHERE n_nationkey % 6 = 2)
SELECT c.c_custkey, coalesce(a.lat, b.lat, h.lat) AS lat, CASE WHEN a.lat IS NOT NULL THEN 'current' WHEN b.lat IS NOT NULL THEN 'alias' WHEN h.lat IS NOT NULL THEN 'historical' END AS tier
FROM customer c LEFT JOIN cur a ON c.c_nationkey = a.k LEFT JOIN al ON c.c_nationkey = al.k LEFT JOIN cur b ON al.canon = b.k LEFT JOIN hist h ON c.c_nationkey = h.k""")
def venue_coordinates(spark, d):
    """Current table, then alias, then historical sites."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    cur = n.filter(k % 3 == 0).select(k.alias("k"), (k * 2.5 - 30).alias("lat"))
    alias = n.filter(k % 3 == 1).select(k.alias("k0"), (F.floor(k / 3) * 3).cast("int").alias("canon"))
    hist = n.filter(k % 6 == 2).select(k.alias("k"), (k * 1.5).alias("lat"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = (c.join(cur.withColumnRenamed("lat", "l1"), F.col("c_nationkey") == F.col("k"), "left").drop("k")
         .join(alias, F.col("c_nationkey") == F.col("k0"), "left")
         .join(cur.withColumnRenamed("lat", "l2"), F.col("canon") == F.col("k"), "left").drop("k")
         .join(hist.withColumnRenamed("lat", "l3"), F.col("c_nationkey") == F.col("k"), "left"))
    tier = F.when(F.col("l1").isNotNull(), "current").when(F.col("l2").isNotNull(), "alias").when(F.col("l3").isNotNull(), "historical")
    return j.select("c_custkey", F.coalesce("l1", "l2", "l3").alias("lat"), tier.alias("tier"))


@query("J22 A24", f"""
WITH {EV}, fc AS (SELECT user_id, d, max_by(value, ts) AS fc FROM ev WHERE event_type = 'view' GROUP BY 1, 2), ac AS (SELECT user_id, d, avg(value) AS ac FROM ev WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(fc - ac), 6) AS bias, round(stddev_samp(fc - ac), 6) AS sd, count(*) >= 50 AS enough FROM fc JOIN ac USING (user_id, d)""")
def forecast_error(spark, d):
    """Last forecast of each entity-day against the actual; dispersion with a sufficiency flag."""
    ev = events(spark, d)
    fc = ev.filter("event_type = 'view'").groupBy("user_id", "d").agg(F.max_by("value", F.struct("ts", "event_id")).alias("fc"))
    ac = ev.filter("event_type <> 'view'").groupBy("user_id", "d").agg(F.avg("value").alias("ac"))
    e = F.col("fc") - F.col("ac")
    return fc.join(ac, ["user_id", "d"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(e), 6).alias("bias"),
                                             F.round(F.stddev_samp(e), 6).alias("sd"), (F.count(F.lit(1)) >= 50).alias("enough"))


@query("J23", f"""
WITH {PA}, m AS (SELECT game, max(seq) AS last_seq FROM pa GROUP BY 1), t AS (SELECT pa.game, count(*) AS n_rows, CAST(count(*) FILTER (WHERE label = 'cR') AS BIGINT) AS n_out FROM pa JOIN m ON pa.game = m.game AND pa.seq = m.last_seq GROUP BY 1)
SELECT o_orderkey, n_rows, n_out FROM orders JOIN t ON o_orderkey = game""")
def terminal_event_join(spark, d):
    """Rows of the last play of each game, joined to the game spine."""
    pa = appearances(spark, d)
    last = pa.groupBy("game").agg(F.max("seq").alias("seq"))
    t = pa.join(last, ["game", "seq"]).groupBy("game").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == "cR").alias("n_out"))
    return table(spark, d, "orders").select("o_orderkey").join(t, F.col("o_orderkey") == F.col("game")).select("o_orderkey", "n_rows", "n_out")


@query("J24 D6", f"""
WITH {EV}, {CAP}, priced AS (SELECT entity, d, market, count(*) AS books FROM cap WHERE over IS NOT NULL AND under IS NOT NULL GROUP BY 1, 2, 3),
one AS (SELECT entity, d FROM priced GROUP BY 1, 2 HAVING count(*) = 1), u AS (SELECT p.entity, p.d, p.market, p.books FROM priced p JOIN one USING (entity, d))
SELECT entity, d, market, books FROM u WHERE d IN (SELECT d FROM u GROUP BY 1 HAVING count(*) >= 20)""")
def market_universe(spark, d):
    """Two-sided only; ids that appear more than once on a day drop out whole; small days drop out."""
    from asofkit.operators.scan import group_totals

    p = captures(spark, d).filter("over IS NOT NULL AND under IS NOT NULL").groupBy("entity", "d", "market").agg(F.count(F.lit(1)).alias("books"))
    p = group_totals(p, ["entity", "d"], __m=F.count(F.lit(1))).filter("__m = 1").drop("__m")
    return group_totals(p, ["d"], __u=F.count(F.lit(1))).filter("__u >= 20").drop("__u")


@query("J25 J2 W6", f"""
WITH {PA}, a AS (SELECT pitcher, d, count(*) AS np FROM pa GROUP BY 1, 2), up AS (SELECT DISTINCT pitcher, DATE '2001-06-01' AS d FROM pa),
last AS (SELECT up.pitcher, max(a.d) AS prev, coalesce(sum(a.np) FILTER (WHERE a.d >= up.d - 3), 0) AS pen3 FROM up LEFT JOIN a ON a.pitcher = up.pitcher AND a.d < up.d GROUP BY 1),
s AS (SELECT pitcher, season, avg(disc) AS eff FROM pa GROUP BY 1, 2)
SELECT up.pitcher, CAST(least(date_diff('day', prev, up.d), 30) AS INT) AS rest, CAST(pen3 AS BIGINT) AS pen3, round(coalesce(s.eff, 1.0), 6) AS eff
FROM up LEFT JOIN last ON up.pitcher = last.pitcher LEFT JOIN s ON s.pitcher = up.pitcher AND s.season = 2000""")
def upcoming_state(spark, d):
    """State of an upcoming date from the same operators on a one-date left side."""
    from asofkit.operators.asof import asof_join
    from asofkit.operators.shrink import prior_season
    from asofkit.operators.windows import trailing_sums

    pa = appearances(spark, d)
    day = pa.groupBy("pitcher", "d").agg(F.count(F.lit(1)).alias("np")).withColumn("prev", F.col("d"))
    up = pa.select("pitcher").distinct().withColumn("d", F.lit("2001-06-01").cast("date")).withColumn("season", F.year("d"))
    j = asof_join(up, day, ["pitcher"], ["prev"])
    j = trailing_sums(j, day, ["pitcher"], "d", ["np"], {"pen3": 3})
    eff = pa.groupBy("pitcher", "season").agg(F.avg("disc").alias("eff"))
    j = prior_season(j, eff, ["pitcher"], "season", "season", ["eff"], {"eff": 1.0})
    return j.select("pitcher", F.least(F.datediff("d", "prev"), F.lit(30)).alias("rest"), F.col("np_pen3").cast("long").alias("pen3"), F.round("eff", 6).alias("eff"))


@query("J26 Q1", """
WITH f AS (SELECT n_nationkey AS label, n_nationkey % 9 AS stable FROM nation WHERE n_nationkey <> 7),
s AS (SELECT n_nationkey % 9 AS stable, 1995 + n_nationkey % 6 AS season, max(n_name) AS nm FROM nation GROUP BY 1, 2)
SELECT o_orderkey, s.nm AS code, s.nm IS NULL AS unmapped FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN f ON c_nationkey = f.label
LEFT JOIN s ON f.stable = s.stable AND year(o_orderdate) = s.season""")
def two_hop_mapping(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    first = n.filter(k != 7).select(k.alias("label"), (k % 9).alias("stable"))
    second = n.groupBy((k % 9).alias("stable"), (1995 + k % 6).alias("season")).agg(F.max("n_name").alias("label"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("label"), F.year("o_orderdate").alias("season"))
    return J.two_hop(rows, first, second, "label", "stable", "season", "code").select("o_orderkey", "code", "unmapped")


@query("J27 J18", """
SELECT coalesce(a.k, b.k) AS k, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y FROM
(SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS x, c_mktsegment AS y FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN
(SELECT c_custkey AS k, -c_acctbal AS x, lower(c_mktsegment) AS y FROM customer WHERE c_custkey % 5 <> 0) b ON a.k = b.k""")
def primary_fallback_merge(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    a = c.filter(k % 3 != 0).select(k.alias("k"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("x"), F.col("c_mktsegment").alias("y"))
    b = c.filter(k % 5 != 0).select(k.alias("k"), (-F.col("c_acctbal")).alias("x"), F.lower("c_mktsegment").alias("y"))
    return J.merge_sources(a, b, ["k"], ["x", "y"])


@query("J28", f"""
WITH {PA}, r AS (SELECT game, status, batter, row_number() OVER (PARTITION BY game, status ORDER BY seq, d, batter, pitcher, qty, price) AS rn FROM pa)
SELECT game, max(batter) FILTER (WHERE status = 'F') AS "F", max(batter) FILTER (WHERE status = 'O') AS "O" FROM r WHERE rn = 1 GROUP BY 1""")
def first_claimant(spark, d):
    order = [F.col(c) for c in ("seq", "d", "batter", "pitcher", "qty", "price")]
    return J.first_claimant(appearances(spark, d), ["game"], "status", order, "batter", ["F", "O"])


@query("W25 L2", f"""
WITH {PA}, r AS (SELECT pitcher, d, batter, seq, row_number() OVER (PARTITION BY pitcher ORDER BY d DESC, seq, batter, game) AS rn, dense_rank() OVER (PARTITION BY pitcher ORDER BY d DESC) AS dr FROM pa)
SELECT pitcher, d, batter, CAST(rn AS INT) AS slot FROM r WHERE dr = 1 AND rn <= 9""")
def last_lineup(spark, d):
    """Members of the entity's most recent date, in slot order."""
    pa = appearances(spark, d)
    last = pa.groupBy("pitcher").agg(F.max("d").alias("d"))
    from asofkit.operators.scan import top_k
    r = top_k(pa.join(last, ["pitcher", "d"]), ["pitcher"], [F.col(c) for c in ("seq", "batter", "game")], 9, "slot")
    return r.select("pitcher", "d", "batter", "slot")


@query("W19", f"""
WITH {EV} SELECT user_id, max_by(event_type, ts) AS last_type FROM ev WHERE d < DATE '2024-01-25' AND d >= DATE '2024-01-25' - 10 GROUP BY 1""")
def latest_attribute_in_window(spark, d):
    ev = events(spark, d).filter("d < DATE'2024-01-25' AND d >= date_sub(DATE'2024-01-25', 10)")
    return ev.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


