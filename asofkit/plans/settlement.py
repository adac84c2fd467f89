"""Settlement of forecast sheets over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asofkit.functions.labels import BATTER_EVENTS
from asofkit.operators.ledger import BATTER_FAMILY, PITCHER_FAMILY, graded_totals
from asofkit.operators.settlement import BATTER_STATS, PITCHER_STATS, settle_sheet
from asofkit.plans._roles import GAMES, PA, appearances, games
from asofkit.registry import query
from asofkit.session import cut_lineage

PROPS = ("HR o{}", "hits o{}", "total bases o{}", "RBIs o{}", "runs o{}", "singles o{}", "doubles o{}", "walks o{}", "stolen bases o{}", "H+R+RBI o{}",
         "pitcher strikeouts o{}", "pitcher outs o{}", "pitcher hits allowed o{}", "pitcher walks o{}", "pitcher earned runs o{}", "moneyline", "total runs", "team total runs", "pitcher quality starts o{}")
BAT = {"h": "qty > 10", "b2": "qty > 25 AND qty <= 35", "b3": "qty > 35 AND qty <= 40", "hr": "qty > 40", "r": "disc >= 0.05", "rbi": "price > 40000", "bb": "label = 'cN'", "sb": "tax >= 0.06", "so": "status = 'O'", "pa": "qty > 2"}
PIT = {"so": "status = 'O'", "outs": "qty > 20", "h": "qty > 30", "bb": "label = 'cN'", "er": "disc >= 0.08"}
SLATE = """sl AS (SELECT game, d, 'T' || CAST(away % 5 + 5 AS VARCHAR) || '@T' || CAST(home % 5 AS VARCHAR) AS matchup, 'T' || CAST(home % 5 AS VARCHAR) AS home, 'T' || CAST(away % 5 + 5 AS VARCHAR) AS away, home_score, away_score FROM games),
ord AS (SELECT *, CAST(row_number() OVER (PARTITION BY d, matchup ORDER BY game) AS INT) AS g FROM sl)"""


def slate(spark, d):
    """Games of ten clubs, so that some matchups play twice a day."""
    team = lambda c, add: F.concat(F.lit("T"), (F.col(c) % 5 + add).cast("string"))
    return games(spark, d).select("game", "d", F.concat(team("away", 5), F.lit("@"), team("home", 0)).alias("matchup"), team("home", 0).alias("home"), team("away", 5).alias("away"), "home_score", "away_score", F.col("game").alias("start"))


def ordered_slate(spark, d):
    """``slate`` with ``g``, a game's ordinal among those of its matchup and day."""
    return slate(spark, d).withColumn("g", F.row_number().over(Window.partitionBy("d", "matchup").orderBy("game")))


def sheet(spark, d, pa=None):
    """One priced row per appearance: every label in turn, with a game id, an ordinal or neither."""
    pa = appearances(spark, d).select("game", "seq", "batter", "pitcher").join(ordered_slate(spark, d), "game") if pa is None else pa
    at = (F.col("batter") * 7 + F.col("pitcher") * 3 + F.col("seq")) % len(PROPS)
    half = F.when(at < 10, (F.col("batter") + F.col("seq")) % 4).when((at < 15) | (at == 18), (F.col("pitcher") + F.col("seq")) % 4).when(at == 16, 12 + F.col("pitcher") % 16).otherwise(4 + F.col("batter") % 12)
    line = half * F.lit(0.5)
    label = F.get(F.array(*[F.lit(p) for p in PROPS]), at.cast("int"))
    side = F.when(at == 15, F.when(F.col("batter") % 2 == 0, F.col("home")).otherwise(F.col("away"))).when((F.col("batter") + F.col("seq")) % 2 == 0, "Over").otherwise("Under")
    who = F.when(F.col("batter") % 11 == 0, F.col("batter") + 1).otherwise(F.col("batter"))
    return pa.select("game", "seq", "d", "matchup", F.when(F.col("batter") % 4 != 0, F.col("game")).alias("gamepk"), F.when(F.col("batter") % 8 == 0, F.col("g")).alias("gnum"), F.replace(label, F.lit("{}"), line.cast("string")).alias("prop"), side.alias("side"),
                     line.alias("line"), F.when(F.col("seq") % 2 == 0, F.col("home")).otherwise(F.col("away")).alias("team"), F.when((at >= 10) & (at != 15), F.col("pitcher")).otherwise(who).alias("entity"))


def boxes(spark, d):
    pa = appearances(spark, d).drop("d").join(slate(spark, d).filter("game % 17 <> 0").select("game", "d"), "game")
    one = lambda stats: [F.sum(F.expr(c).cast("long")).alias(s) for s, c in stats.items()]
    bat = pa.groupBy("game", "d", F.col("batter").alias("entity")).agg(*one(BAT)).withColumn("tb", F.col("h") + F.col("b2") + 2 * F.col("b3") + 3 * F.col("hr"))
    pit = pa.groupBy("game", "d", F.col("pitcher").alias("entity")).agg((F.min("seq") <= 3).cast("int").alias("started"), *one(PIT))
    return bat, pit


def boxed_appearances(spark, d, games):
    """Appearances with their game, placed by it once: the first of a batter, or a pitcher, in a game has that one's line of ``boxes`` (bat, pit)."""
    pa = appearances(spark, d).drop("d").repartition("game").join(games, "game")
    for name, who, stats in (("bat", "batter", BAT), ("pit", "pitcher", PIT)):
        w = Window.partitionBy("game", who)
        line = {s: F.sum(F.expr(c).cast("long")).over(w) for s, c in stats.items() if s in (BATTER_STATS if name == "bat" else PITCHER_STATS)}
        line |= {"tb": line["h"] + line["b2"] + 2 * line["b3"] + 3 * line["hr"]} if name == "bat" else {"started": (F.min("seq").over(w) <= 3).cast("int")}
        first = F.row_number().over(w.orderBy("seq")) == 1
        pa = pa.withColumn(name, F.when(first & (F.col("game") % 17 != 0), F.struct(*[c.alias(s) for s, c in line.items()])))
    return pa.select("game", "seq", "batter", "pitcher", "d", "matchup", "home", "away", "g", "bat", "pit")


def settled_sheet(spark, d, **more):
    """The sheet with ``more`` columns, settled; games, and appearances with their lines, are written once for their several uses."""
    s = cut_lineage(ordered_slate(spark, d))
    pa = cut_lineage(boxed_appearances(spark, d, s))
    of = lambda name, who: pa.filter(F.col(name).isNotNull()).select("game", "d", F.col(who).alias("entity"), f"{name}.*")
    return settle_sheet(sheet(spark, d, pa).withColumns(more), of("bat", "batter"), of("pit", "pitcher"), s.filter("home_score IS NOT NULL").drop("g"))


def _sums(stats: dict[str, str]) -> str:
    return ", ".join(f"CAST(sum(({c})::INT) AS BIGINT) AS {s}" for s, c in stats.items())


_AT = f"(batter * 7 + pitcher * 3 + seq) % {len(PROPS)}"
SHEET = f"""{GAMES}, {PA}, {SLATE}, sh0 AS (SELECT p.game, p.seq, o.d, matchup, home, away, batter, pitcher, g, {_AT} AS lbl FROM (SELECT game, seq, batter, pitcher FROM pa) p JOIN ord o USING (game)),
sh AS (SELECT *, CASE WHEN batter % 4 <> 0 THEN game END AS gamepk, CASE WHEN batter % 8 = 0 THEN g END AS gnum,
  0.5::DOUBLE * CASE WHEN lbl < 10 THEN (batter + seq) % 4 WHEN lbl < 15 OR lbl = 18 THEN (pitcher + seq) % 4 WHEN lbl = 16 THEN 12 + pitcher % 16 ELSE 4 + batter % 12 END AS line,
  CASE WHEN lbl = 15 THEN CASE WHEN batter % 2 = 0 THEN home ELSE away END WHEN (batter + seq) % 2 = 0 THEN 'Over' ELSE 'Under' END AS side, CASE WHEN seq % 2 = 0 THEN home ELSE away END AS team,
  CASE WHEN lbl >= 10 AND lbl <> 15 THEN pitcher WHEN batter % 11 = 0 THEN batter + 1 ELSE batter END AS entity FROM sh0),
bpa AS (SELECT pa.* EXCLUDE (d), sl.d FROM pa JOIN sl USING (game) WHERE game % 17 <> 0),
bat AS (SELECT *, h + b2 + 2 * b3 + 3 * hr AS tb FROM (SELECT game, d, batter AS entity, {_sums(BAT)} FROM bpa GROUP BY 1, 2, 3)),
pit AS (SELECT game, d, pitcher AS entity, (min(seq) <= 3)::INT AS started, {_sums(PIT)} FROM bpa GROUP BY 1, 2, 3),
fin AS (SELECT *, row_number() OVER (PARTITION BY d, matchup ORDER BY game) AS k, count(*) OVER (PARTITION BY d, matchup) AS nf FROM sl WHERE home_score IS NOT NULL),
nd AS (SELECT s.d, s.matchup, coalesce(any_value(f.nf), 0) AS nf, greatest(coalesce(max(s.gnum), 0), coalesce(any_value(f.nf), 0)) AS n FROM sh s LEFT JOIN (SELECT DISTINCT d, matchup, nf FROM fin) f ON s.d = f.d AND s.matchup = f.matchup GROUP BY 1, 2),
fr AS (SELECT s.*, nd.nf = 1 AND nd.n = 1 AS day_ok, CASE WHEN gamepk IS NOT NULL THEN a.game WHEN gnum IS NOT NULL THEN CASE WHEN nd.nf = nd.n THEN b.game END WHEN nd.nf = 1 AND nd.n = 1 THEN c.game END AS fg FROM sh s JOIN nd ON nd.d = s.d AND nd.matchup = s.matchup
  LEFT JOIN fin a ON a.game = s.gamepk LEFT JOIN fin b ON b.d = s.d AND b.matchup = s.matchup AND b.k = s.gnum LEFT JOIN fin c ON c.d = s.d AND c.matchup = s.matchup AND c.k = 1),
x AS (SELECT fr.*, f.home_score AS hs, f.away_score AS aw, f.home AS fh, f.away AS fa, EXISTS (SELECT 1 FROM bat WHERE bat.game = fr.fg) AS boxed FROM fr LEFT JOIN fin f ON f.game = fr.fg),
st AS (SELECT * FROM pit WHERE started = 1),
bd AS (SELECT d, entity, {', '.join(f'sum({s}) AS {s}' for s in ('h', 'b2', 'b3', 'hr', 'tb', 'r', 'rbi', 'bb', 'sb'))} FROM bat GROUP BY 1, 2), pd AS (SELECT d, entity, {', '.join(f'sum({s}) AS {s}' for s in PIT)} FROM st GROUP BY 1, 2),
y AS (SELECT x.*, {', '.join(f'CASE WHEN b.game IS NOT NULL THEN b.{s} WHEN day_ok THEN bd.{s} END AS b_{s}' for s in ('h', 'b2', 'b3', 'hr', 'tb', 'r', 'rbi', 'bb', 'sb'))}, {', '.join(f'CASE WHEN p.game IS NOT NULL THEN p.{s} WHEN day_ok THEN pd.{s} END AS p_{s}' for s in PIT)}
  FROM x LEFT JOIN bat b ON b.game = fg AND b.entity = x.entity LEFT JOIN bd ON bd.d = x.d AND bd.entity = x.entity LEFT JOIN st p ON p.game = fg AND p.entity = x.entity LEFT JOIN pd ON pd.d = x.d AND pd.entity = x.entity),
z AS (SELECT *, CASE WHEN fg IS NULL THEN NULL WHEN lbl = 16 THEN hs + aw WHEN lbl = 17 THEN CASE WHEN team = fh THEN hs ELSE aw END ELSE CASE lbl WHEN 0 THEN b_hr WHEN 1 THEN b_h WHEN 2 THEN b_tb WHEN 3 THEN b_rbi WHEN 4 THEN b_r WHEN 5 THEN b_h - b_b2 - b_b3 - b_hr WHEN 6 THEN b_b2 WHEN 7 THEN b_bb WHEN 8 THEN b_sb WHEN 9 THEN b_h + b_r + b_rbi
  WHEN 10 THEN p_so WHEN 11 THEN p_outs WHEN 12 THEN p_h WHEN 13 THEN p_bb WHEN 14 THEN p_er END END AS actual FROM y),
res AS (SELECT game, seq, entity, lbl, line, side, CAST(actual AS DOUBLE) AS actual, CASE WHEN fg IS NULL OR lbl = 18 THEN 'open' WHEN lbl = 15 THEN CASE WHEN (CASE WHEN hs > aw THEN fh ELSE fa END) = side THEN 'win' ELSE 'lose' END
  WHEN actual IS NULL THEN CASE WHEN boxed THEN 'void' ELSE 'open' END WHEN actual = line THEN 'push' WHEN (actual > line) = (side = 'Over') THEN 'win' ELSE 'lose' END AS result FROM z)"""


@query("G12 P7 J15", f"WITH {SHEET} SELECT game, seq, entity, side, line, actual, result FROM res")
def forecast_sheet_settlement(spark, d):
    """Every row of the sheet: moneyline, totals, team totals, five pitcher and ten batter labels; push, void and open."""
    return settled_sheet(spark, d).select("game", "seq", "entity", "side", "line", "actual", "result")


@query("G12 A46", f"WITH {SHEET} SELECT CAST(lbl AS INT) AS label, result, count(*) AS n FROM res GROUP BY 1, 2")
def settlement_by_label(spark, d):
    """How the rows of each label ended."""
    # the label without its line, by its place in the list; a number, as rows keep it through their shuffles
    stem = F.regexp_replace("prop", r" o[0-9.]+$", "")
    place = F.create_map(*[F.lit(x) for i, p in enumerate(PROPS) for x in (p.replace(" o{}", ""), i)])
    return settled_sheet(spark, d, label=F.element_at(place, stem)).groupBy("label", "result").agg(F.count(F.lit(1)).alias("n"))


LINES = {"pk": (0.5, 1.5), "pout": (0.5, 1.5), "pha": (0.5, 1.5), "pbb": (0.5,), "per": (0.5,), "tot": (6.5, 8.5, 10.5), "tt": (2.5, 4.5)}


def _graded_sql() -> str:
    bat = ", ".join(f"{{'family': '{BATTER_FAMILY[m]}', 'market': '{m}', 'y': ({e})::INT, 'who': CAST(entity AS VARCHAR)}}" for m, e in BATTER_EVENTS.items())
    pit = ", ".join(f"{{'family': '{f}', 'market': '{lab} > {x}', 'y': ({st} > {x})::INT, 'who': CAST(entity AS VARCHAR)}}" for f, (lab, st) in PITCHER_FAMILY.items() for x in LINES[f])
    game = ["{'family': 'ml', 'market': 'home ML', 'y': (home_score > away_score)::INT, 'who': home}"]
    game += [f"{{'family': 'tot', 'market': 'Runs > {x}', 'y': (home_score + away_score > {x})::INT, 'who': home}}" for x in LINES["tot"]]
    game += [f"{{'family': 'tt', 'market': '{s} Runs > {x}', 'y': ({s.lower()}_score > {x})::INT, 'who': {s.lower()}}}" for s in ("Away", "Home") for x in LINES["tt"]]
    return f"""{SHEET}, g0 AS (SELECT game, d, unnest([{bat}]) AS r FROM bat WHERE pa > 0 UNION ALL SELECT game, d, unnest([{pit}]) FROM pit WHERE started = 1 UNION ALL SELECT game, d, unnest([{', '.join(game)}]) FROM sl WHERE home_score IS NOT NULL AND away_score IS NOT NULL),
gl AS (SELECT game, d, r.family AS family, r.market AS market, r.who AS who, r.y AS y FROM g0),
dy AS (SELECT market, who, d, count(*) AS n, sum(y) AS s FROM gl GROUP BY 1, 2, 3), ow AS (SELECT *, coalesce(sum(n) OVER w, 0) AS no, coalesce(sum(s) OVER w, 0) AS so FROM dy WINDOW w AS (PARTITION BY market, who ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
le AS (SELECT *, coalesce(sum(n) OVER w, 0) AS na, coalesce(sum(s) OVER w, 0) AS sa FROM (SELECT market, d, sum(n) AS n, sum(s) AS s FROM dy GROUP BY 1, 2) WINDOW w AS (PARTITION BY market ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lp AS (SELECT gl.*, (ow.so + 20.0 * ((le.sa + 1.0) / (le.na + 2.0))) / (ow.no + 20.0) AS p FROM gl JOIN ow USING (market, who, d) JOIN le USING (market, d))"""


def ledger_totals(spark, d):
    bat, pit = boxes(spark, d)
    return graded_totals(bat, pit, slate(spark, d), LINES)


@query("M15 P6 J1", f"WITH {_graded_sql()} SELECT family, market, who, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, round(sum(p), 6) AS expected FROM lp GROUP BY 1, 2, 3")
def graded_ledger(spark, d):
    """Every market of every box line graded against a price as of its day; void lines give no row."""
    return ledger_totals(spark, d).select("family", "market", "who", "n", "hits", F.round("expected", 6).alias("expected"))


@query("M15 P6 A27", f"WITH {_graded_sql()} SELECT family, market, count(*) AS n, round(avg(y), 6) AS base, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS ll FROM lp GROUP BY 1, 2")
def graded_ledger_loss(spark, d):
    """Loss of the as-of prices by market, over the whole ledger."""
    r = ledger_totals(spark, d).groupBy("family", "market").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("hits").alias("hits"), F.sum("loss").alias("loss"))
    return r.select("family", "market", "n", F.round(F.try_divide("hits", "known"), 6).alias("base"), F.round(F.try_divide("loss", "known"), 6).alias("ll"))
