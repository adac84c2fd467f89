"""Nested JSON payloads to flat tables. Each document is one row; pairing inside a document
is done with array functions, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions.text import bet_side, weather_condition, weather_temp, wind_direction, wind_speed

PLAYS = """allPlays array<struct<atBatIndex: int, result: struct<event: string, eventType: string>, about: struct<inning: int, halfInning: string>,
 matchup: struct<batter: struct<id: bigint>, pitcher: struct<id: bigint>>,
 runners: array<struct<movement: struct<start: string, `end`: string, outBase: string, isOut: boolean, outNumber: int>,
  details: struct<playIndex: int, runner: struct<id: bigint>, rbi: boolean, earned: boolean, teamUnearned: boolean, responsiblePitcher: struct<id: bigint>, event: string, eventType: string, movementReason: string>,
  credits: array<struct<credit: string, position: struct<abbreviation: string>, player: struct<id: bigint>>>>>>>"""

ODDS = """bookmakers array<struct<`key`: string, markets: array<struct<`key`: string, outcomes: array<struct<name: string, description: string, point: double, price: int>>>>>>"""

STATS = "map<string, string>"
BOX = f"""info array<struct<label: string, value: string>>, teams struct<away: struct<players: map<string, struct<person: struct<id: bigint, fullName: string>, battingOrder: string, position: struct<abbreviation: string>, stats: struct<batting: {STATS}, pitching: {STATS}>>>>,
 home: struct<players: map<string, struct<person: struct<id: bigint, fullName: string>, battingOrder: string, position: struct<abbreviation: string>, stats: struct<batting: {STATS}, pitching: {STATS}>>>>>"""

INNINGS = "innings array<struct<num: int, away: struct<runs: int>, home: struct<runs: int>>>"
HOURLY = "hourly struct<time: array<string>, relative_humidity_2m: array<double>, surface_pressure: array<double>, precipitation: array<double>>"
TRANSACTIONS = "transactions array<struct<person: struct<id: bigint>, date: string, description: string>>"
SLATE = "scraped_at string, date string, games array<struct<game_pk: bigint, away_team: string, home_team: string, away_lineup: array<array<bigint>>, home_lineup: array<array<bigint>>, away_lineup_src: string, home_lineup_src: string>>"
SCHEDULE = """dates array<struct<games: array<struct<gamePk: bigint, officialDate: string, gameType: string, dayNight: string, gameDate: string, status: struct<codedGameState: string>, venue: struct<name: string>,
 teams: struct<away: struct<score: int, team: struct<id: bigint>>, home: struct<score: int, team: struct<id: bigint>>>>>>>"""


def _parse(docs: DataFrame, body: str, schema: str) -> DataFrame:
    return docs.withColumn("__j", F.from_json(body, schema))


def _base(c: Column) -> Column:
    return F.when(c.isin("score", "4B"), "H").otherwise(F.coalesce(c, F.lit("")))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def runner_movements(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per runner movement from play-by-play documents (GamePk, Season, Date, body)."""
    p = _parse(docs, body, PLAYS).select("GamePk", "Season", "Date", F.explode("__j.allPlays").alias("a"))
    r = p.select("*", F.explode("a.runners").alias("r"))
    credits = F.array_join(F.transform("r.credits", lambda c: F.concat_ws(
        ":", F.regexp_replace(F.coalesce(c["credit"], F.lit("")), "^f_", ""), F.coalesce(c["position"]["abbreviation"], F.lit("")), F.coalesce(c["player"]["id"].cast("string"), F.lit("")))), ";")
    m, d = F.col("r.movement"), F.col("r.details")
    return r.select(
        "GamePk", "Season", "Date", F.col("a.atBatIndex").alias("AtBatIndex"), d["playIndex"].alias("PlayIndex"), F.col("a.about.inning").alias("Inning"), F.col("a.about.halfInning").alias("Half"),
        F.col("a.result.event").alias("PlayEvent"), F.col("a.result.eventType").alias("PlayEventType"), F.col("a.matchup.batter.id").alias("BatterId"), F.col("a.matchup.pitcher.id").alias("PitcherId"),
        d["runner"]["id"].alias("RunnerId"), F.coalesce(m["start"], F.lit("")).alias("StartBase"), _base(m["end"]).alias("EndBase"), _flag(m["isOut"]).alias("IsOut"), _base(m["outBase"]).alias("OutBase"), m["outNumber"].alias("OutNumber"),
        _flag(d["rbi"]).alias("RBI"), _flag(d["earned"]).alias("Earned"), _flag(d["teamUnearned"]).alias("TeamUnearned"), d["responsiblePitcher"]["id"].alias("RespPitcherId"),
        d["event"].alias("Event"), d["eventType"].alias("EventType"), F.coalesce(d["movementReason"], F.lit("")).alias("MovementReason"), F.coalesce(credits, F.lit("")).alias("Credits"))


def boxscore_records(docs: DataFrame, batting: list[str], pitching: list[str], body: str = "body") -> DataFrame:
    """All records of boxscore documents keyed by player (GamePk, Season, Date, away, home, body) from one parse of each.

    ``kind`` says which columns a record fills: game (teams and weather), bat or pit (player, team, ``bat_`` or ``pit_`` statistics).
    """
    note = lambda label: F.get(F.filter("__j.info", lambda i: i["label"] == label), F.lit(0))["value"]
    side = lambda s, t, o, h: F.transform(F.map_values(f"__j.teams.{s}.players"), lambda x: F.struct(x.alias("p"), F.col(t).alias("team"), F.col(o).alias("opp"), F.lit(h).alias("home")))
    players = F.coalesce(F.concat(side("away", "away", "home", 0), side("home", "home", "away", 1)), F.array())
    d = _parse(docs, body, BOX).select("GamePk", "Season", "Date", "away", "home", note("Weather").alias("__weather"), note("Wind").alias("__wind"), players.alias("__players"))
    # a record without a player is the game's
    d = d.select("GamePk", "Season", "Date", "away", "home", "__weather", "__wind", F.explode(F.concat(F.array(F.lit(None)), "__players")).alias("r"))
    played = lambda k: F.coalesce(F.try_element_at(f"r.p.stats.{k}", F.lit("gamesPlayed")).try_cast("int") > 0, F.lit(False))
    order = F.coalesce(F.col("r.p.battingOrder"), F.lit(""))
    kinds = F.when(F.col("r").isNull(), F.array(F.lit("game"))).otherwise(
        F.array_compact(F.array(F.when(played("batting") | (order != ""), "bat"), F.when(played("pitching"), "pit"))))
    d = d.select("*", F.explode(kinds).alias("kind"))
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    player = lambda c: F.when(F.col("kind") != "game", F.col(c))
    stat = lambda kind, k, c: of(kind, F.coalesce(F.try_element_at(f"r.p.stats.{k}", F.lit(c)), F.lit("0"))).alias(f"{kind}_{c}")
    return d.select(
        "GamePk", "Season", "Date", "kind", of("game", F.col("away")).alias("AwayTeam"), of("game", F.col("home")).alias("HomeTeam"), of("game", weather_temp("__weather")).alias("Temp"),
        of("game", weather_condition("__weather")).alias("Condition"), of("game", wind_speed("__wind")).alias("WindSpeed"), of("game", wind_direction("__wind")).alias("WindDir"),
        player("r.p.person.id").alias("PlayerId"), player("r.p.person.fullName").alias("Name"), player("r.team").alias("Team"), player("r.opp").alias("Opponent"), player("r.home").alias("Home"),
        of("bat", order).alias("BattingOrder"), of("bat", F.coalesce("r.p.position.abbreviation", F.lit(""))).alias("Position"),
        *[stat("bat", "batting", c) for c in batting], *[stat("pit", "pitching", c) for c in pitching])


def boxscore(docs: DataFrame, batting: list[str], pitching: list[str], body: str = "body") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Game, batting and pitching rows of ``boxscore_records``; each frame parses the documents again."""
    r = boxscore_records(docs, batting, pitching, body)
    common = ["GamePk", "Season", "Date", "PlayerId", "Name", "Team", "Opponent", "Home"]
    game = r.filter("kind = 'game'").select("GamePk", "Season", "Date", "AwayTeam", "HomeTeam", "Temp", "Condition", "WindSpeed", "WindDir")
    bat = r.filter("kind = 'bat'").select(*common, "BattingOrder", "Position", *[F.col(f"bat_{c}").alias(c) for c in batting])
    pit = r.filter("kind = 'pit'").select(*common, *[F.col(f"pit_{c}").alias(c) for c in pitching])
    return game, bat, pit


def _sides(outcomes: Column, player: bool, default_line: float | None) -> Column:
    """Outcomes with a side and a line, as (side, who, line, price)."""
    o = F.transform(outcomes, lambda x: F.struct(bet_side(x["name"]).alias("side"), x["description"].alias("who"),
                                                 (F.coalesce(x["point"], F.lit(default_line)) if default_line is not None else x["point"]).alias("line"), x["price"].alias("price")))
    return F.filter(o, lambda x: x["side"].isNotNull() & x["line"].isNotNull() & ((F.coalesce(x["who"], F.lit("")) != "") if player else F.lit(True)))


def _paired(m: DataFrame, player: bool, default_line: float | None) -> DataFrame:
    """Rows of ``m`` (column ``outs``) per distinct (who, line) of their outcomes, with the last price of each side as ``p``.

    The sides are an exploded column of one element, so that every pair reads them and none computes them again.
    """
    m = m.withColumn("__o", F.explode(F.array(_sides(F.col("outs"), player, default_line))))

    def price(k: Column, s: str) -> Column:
        hit = F.filter("__o", lambda x: x["who"].eqNullSafe(k["who"]) & (x["line"] == k["line"]) & (x["side"] == s))
        return F.try_element_at(hit, F.lit(-1))["price"]

    keys = F.array_distinct(F.transform("__o", lambda x: F.struct(x["who"], x["line"])))
    pairs = F.transform(keys, lambda k: F.struct(k["who"], k["line"], price(k, "over").alias("over"), price(k, "under").alias("under")))
    return m.withColumn("p", F.explode(pairs)).drop("__o", "outs")


def _markets(docs: DataFrame, body: str) -> DataFrame:
    keep = [c for c in docs.columns if c != body]
    b = _parse(docs, body, ODDS).select(*keep, F.explode("__j.bookmakers").alias("b"))
    return b.select(*keep, F.col("b.key").alias("Book"), F.explode("b.markets").alias("m")).select(*keep, "Book", F.col("m.key").alias("api"), F.col("m.outcomes").alias("outs"))


def prop_prices(docs: DataFrame, base_market: dict[str, str], default_line: float = 0.5, body: str = "body") -> DataFrame:
    """Player prop rows with over and under paired per (player, line); alternate markets take their base name."""
    m = _markets(docs, body).filter(F.col("api").isin(*base_market))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in base_market.items() for x in kv]), F.col("api"))
    keep = [c for c in docs.columns if c != body]
    return _paired(m.select(*keep, "Book", name.alias("Market"), "outs"), True, default_line).select(
        *keep, "Book", "Market", F.col("p.who").alias("PlayerName"), F.col("p.line").alias("Line"), F.col("p.over").alias("OverPrice"), F.col("p.under").alias("UnderPrice"))


def game_prices(docs: DataFrame, body: str = "body") -> DataFrame:
    """Totals, team totals (both sides required) and moneylines (home over, away under); docs carry home and away names."""
    keep = [c for c in docs.columns if c != body]
    m = _markets(docs, body)
    two = lambda df: df.filter(F.col("p.over").isNotNull() & F.col("p.under").isNotNull())
    tot = two(_paired(m.filter(F.col("api").isin("totals", "alternate_totals")).withColumn("outs", F.transform("outs", lambda o: o.withField("description", F.lit(None).cast("string")))), False, None)).select(*keep, "Book", F.lit("totals").alias("Market"), F.col("home").alias("Team"), "p.line", "p.over", "p.under")
    tt = two(_paired(m.filter(F.col("api").isin("team_totals", "alternate_team_totals")), True, None)).select(
        *keep, "Book", F.lit("team_totals").alias("Market"), F.col("p.who").alias("Team"), "p.line", "p.over", "p.under")
    of = lambda who: F.get(F.filter("outs", lambda o: o["name"] == F.col(who)), F.lit(0))["price"]
    h2h = m.filter("api = 'h2h'").select(*keep, "Book", F.lit("h2h").alias("Market"), F.col("home").alias("Team"), F.lit(None).cast("double").alias("line"), of("home").alias("over"), of("away").alias("under"))
    return tot.unionByName(tt).unionByName(h2h)


def linescores(docs: DataFrame, body: str = "body") -> DataFrame:
    keep = [c for c in docs.columns if c != body]
    return _parse(docs, body, INNINGS).select(*keep, F.explode("__j.innings").alias("i")).select(*keep, F.col("i.num").alias("Inning"), F.col("i.away.runs").alias("AwayRuns"), F.col("i.home.runs").alias("HomeRuns"))


def hourly_weather(docs: DataFrame, body: str = "body") -> DataFrame:
    """Parallel hourly arrays to rows (venue, hour, ...)."""
    keep = [c for c in docs.columns if c != body]
    h = "__j.hourly"
    z = F.arrays_zip(F.col(f"{h}.time").alias("t"), F.col(f"{h}.relative_humidity_2m").alias("h"), F.col(f"{h}.surface_pressure").alias("p"), F.col(f"{h}.precipitation").alias("r"))
    return _parse(docs, body, HOURLY).select(*keep, F.explode(z).alias("z")).select(*keep, F.to_timestamp_ntz("z.t", F.lit("yyyy-MM-dd'T'HH:mm")).alias("hour"), F.col("z.h").alias("humidity"), F.col("z.p").alias("pressure"), F.col("z.r").alias("precip"))


def game_weather(games: DataFrame, hours: DataFrame, key: str, start: str, place: str) -> DataFrame:
    """Weather at the start hour and rain over three hours; a game without its start hour keeps NULLs."""
    asks = games.select(key, place, F.col(start).alias("__s"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("__k"))
    asks = asks.withColumn("hour", F.col("__s") + F.make_dt_interval(hours=F.col("__k")))
    j = asks.join(hours, [place, "hour"], "left")
    at = lambda c: F.max(F.when(F.col("__k") == 0, F.col(c)))
    a = j.groupBy(key).agg(at("humidity").alias("humidity"), at("pressure").alias("pressure"), F.sum("precip").alias("__r"), F.max(F.when((F.col("__k") == 0) & F.col("humidity").isNotNull(), 1)).alias("__hit"))
    return games.join(a.select(key, "humidity", "pressure", F.when(F.col("__hit") == 1, F.coalesce("__r", F.lit(0.0))).alias("precip")), key, "left")


def classify_transaction(text: Column) -> Column:
    """struct(kind, days) of a roster move; kind is NULL for anything else."""
    d = F.lower(F.coalesce(text, F.lit("")))
    lst = d.contains("injured list") | d.contains("disabled list")
    kind = (F.when(d.contains("rehab assignment"), "rehab").when(~lst, None).when(d.contains("transferred"), "transfer").when(d.contains("placed"), "place")
            .when(d.contains("activated") | d.contains("reinstated") | d.contains("returned"), "activate"))
    days = F.regexp_extract(d, r"(\d+)-day (?:injured|disabled) list", 1).try_cast("int")
    return F.struct(kind.alias("kind"), F.when(kind != "rehab", days).alias("days"))


def transactions(docs: DataFrame, body: str = "body") -> DataFrame:
    t = _parse(docs, body, TRANSACTIONS).select(F.explode("__j.transactions").alias("t")).select(
        F.col("t.person.id").alias("PlayerId"), F.col("t.date").cast("date").alias("Date"), classify_transaction(F.col("t.description")).alias("c"))
    return t.filter("PlayerId IS NOT NULL AND c.kind IS NOT NULL").select("PlayerId", "Date", F.col("c.kind").alias("Kind"), F.col("c.days").alias("ILDays")).distinct()


def slate_lineups(docs: DataFrame, body: str = "body", trusted: str = "mlb") -> DataFrame:
    """Lineup slots of games whose two sides both come from the trusted source."""
    g = _parse(docs, body, SLATE).select(F.col("__j.scraped_at").alias("scraped_at"), F.col("__j.date").alias("date"), F.explode("__j.games").alias("g"))
    ok = F.forall(F.array("g.away_lineup_src", "g.home_lineup_src"), lambda s: F.coalesce(s == trusted, F.lit(False)))
    side = lambda s: F.transform(f"g.{s}_lineup", lambda x: F.struct(F.lit(s).alias("side"), x[0].alias("player"), x[1].cast("int").alias("slot")))
    return g.filter(ok).select("scraped_at", "date", F.col("g.game_pk").alias("game_pk"), F.explode(F.concat(side("away"), side("home"))).alias("s")).select("scraped_at", "date", "game_pk", "s.*")


def schedule_games(docs: DataFrame, codes: DataFrame, body: str = "body", final_only: bool = True) -> DataFrame:
    """Final games of schedule documents, each id once, with season codes and first-pitch order (docs carry season)."""
    g = _parse(docs, body, SCHEDULE).select("season", F.posexplode("__j.dates").alias("dp", "dt")).select("season", "dp", F.posexplode("dt.games").alias("gp", "g"))
    if final_only:
        g = g.filter("g.status.codedGameState = 'F'")
    one = g.groupBy(F.col("g.gamePk").alias("GamePk")).agg(F.min_by(F.struct("season", "g"), F.struct("season", "dp", "gp")).alias("v"))
    one = one.select("GamePk", "v.season", F.col("v.g.officialDate").cast("date").alias("Date"), F.coalesce("v.g.gameType", F.lit("R")).alias("GameType"), F.coalesce("v.g.dayNight", F.lit("")).alias("DayNight"),
                     F.col("v.g.gameDate").alias("start"), F.col("v.g.venue.name").alias("Venue"), F.col("v.g.teams.away.score").alias("AwayScore"), F.col("v.g.teams.home.score").alias("HomeScore"),
                     F.col("v.g.teams.away.team.id").alias("away_id"), F.col("v.g.teams.home.team.id").alias("home_id"))
    for s in ("away", "home"):
        one = one.join(codes.select("season", F.col("id").alias(f"{s}_id"), F.col("code").alias(f"{s}_code")), ["season", f"{s}_id"], "left")
        one = one.withColumn(f"{s}_code", F.coalesce(f"{s}_code", F.col(f"{s}_id").cast("string")))
    from asofkit.operators.scan import Index, ordered_scan
    return ordered_scan(one, ["Date", "home_code"], [F.col("start"), F.col("GamePk")], F.substring("start", 1, 13), [Index("game_order")])
