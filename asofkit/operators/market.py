"""Price captures, consensus prices, value screen and the bet ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions import odds as O
from asofkit.functions import prob as P
from asofkit.functions.text import key_text
from asofkit.operators.scan import RunningMin, ordered_scan, pick_one, top_k

# Preferred books, one-sided haircut, screen and stake rules.
PREFERRED_BOOKS = ("pinnacle",)
ONE_SIDED = 0.9336
MIN_EV = 0.05
SHRINK_W = 0.5
EDGE_FLOOR = 0.03
MIN_IMPLIED = 0.20
MIN_BOOKS = 2
KELLY_FRACTION = 0.25
PER_BET_CAP = 0.01
START_BANKROLL = 100.0
SETTLED = ("win", "lose", "push", "void")


def compact_captures(
    rows: DataFrame, keys: Sequence[str], ts: str, over: str, under: str, arrival: str, chunk: Column | None = None,
    keep: Sequence[str] = (), in_order: bool = False,
) -> DataFrame:
    """Open and close of every key from an append-only capture log, in arrival order.

    The open is the earliest capture, blanks included. The close is the newest capture,
    but a one-sided one never replaces a two-sided one, equal times only upgrade one side
    to two, and a two-sided capture older than the one-sided close does not replace it.
    Stored rows may carry open_ts, open_over and open_under; they arrive first.

    ``in_order`` promises that captures arrive by time: one partially combined aggregation
    then does everything. Otherwise a scan in arrival order (in chunks) finds the two-sided
    captures that were newer than what they met.
    """
    keys = list(keys)
    two = F.col(over).isNotNull() & F.col(under).isNotNull()
    base = rows
    if "open_ts" not in rows.columns:
        base = base.withColumn("open_ts", F.lit(None).cast("timestamp_ntz")).withColumn("open_over", F.lit(None)).withColumn("open_under", F.lit(None))
    stored = F.col("open_ts").isNotNull()
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    base = base.withColumn("__two", two).withColumn("__t", t).withColumn(
        "__open", F.when(stored, F.struct(F.col("open_ts").alias("ts"), F.col("open_over").alias("o"), F.col("open_under").alias("u")))
        .otherwise(F.struct(F.col(ts).alias("ts"), F.col(over).alias("o"), F.col(under).alias("u"))))
    pay = F.struct(F.col(ts).alias("close_ts"), F.col(over).alias("close_over"), F.col(under).alias("close_under"), *keep)
    opened = F.min_by("__open", F.struct(F.col("__open.ts"), F.col(arrival))).alias("__op")
    n = F.count(F.lit(1)).alias("n_captures")

    def shape(agg: DataFrame, c: Column) -> DataFrame:
        return agg.select(*keys, F.col("__op.ts").alias("open_ts"), F.col("__op.o").alias("open_over"), F.col("__op.u").alias("open_under"),
                          c["close_ts"].alias("close_ts"), c["close_over"].alias("close_over"), c["close_under"].alias("close_under"),
                          *[c[k].alias(k) for k in keep], "n_captures")

    if in_order:
        best = F.max_by(pay, F.struct("__two", "__t", -F.col(arrival))).alias("__c")
        return shape(base.groupBy(*keys).agg(opened, best, n), F.col("__c"))
    # newest one-sided capture seen so far, as a running minimum of the negated time
    seen = ordered_scan(base, keys, [F.col(arrival)], chunk, [RunningMin("__m", F.when(~F.col("__two"), -F.col("__t")))])
    ok = F.col("__two") & (F.col("__m").isNull() | (F.col("__t") >= -F.col("__m")))
    first = seen.groupBy(*keys).agg(F.min(F.when(ok, F.col(arrival))).alias("__i0"))
    rank = F.struct("__t", -F.col(arrival))
    counted = F.col("__two") & (F.col(arrival) >= F.col("__i0"))
    agg = seen.join(first, keys).groupBy(*keys).agg(
        opened, F.max_by(pay, F.when(counted, rank)).alias("__c2"), F.max_by(pay, F.when(~F.col("__two"), rank)).alias("__c1"), n)
    return shape(agg, F.coalesce("__c2", "__c1"))


def fold_legacy(store: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Merge a blank-id row into its only sibling when all its history is strictly older."""
    keys = list(keys)
    named, blank = store.filter(F.col(ident).isNotNull()), store.filter(F.col(ident).isNull())
    sib = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("open_ts").alias("__so"))
    j = blank.join(sib, keys, "left")
    folds = (F.col("__n") == 1) & (F.col("close_ts") < F.col("__so"))
    j = j.withColumn("__fold", F.coalesce(folds, F.lit(False)))
    older = j.filter("__fold").select(*keys, F.struct("open_ts", "open_over", "open_under").alias("__o"))
    merged = named.join(older, keys, "left")
    take = F.col("__o").isNotNull() & (F.col("__o.open_ts") < F.col("open_ts"))
    cols = [F.when(take, F.col(f"__o.{c}")).otherwise(F.col(c)).alias(c) if c in ("open_ts", "open_over", "open_under") else F.col(c) for c in store.columns]
    return merged.select(*cols).unionByName(j.filter("NOT __fold").select(*store.columns))


def n_books(book: Column) -> Column:
    """Distinct books of a group; the set is as small as the list of books, so it needs no second shuffle."""
    return F.size(F.collect_set(book)).cast("long")


def consensus_fair(quotes: DataFrame, keys: Sequence[str], over: str, under: str, book: str, method: str = "proportional",
                   out: str = "fair") -> DataFrame:
    """Preferred book's mean fair price, else the median over two-sided books; keys without one drop out.

    ``quotes`` is a compacted store (one row per key and book), so the median of a key
    looks at no more rows than there are books.
    """
    r = consensus_many(quotes, keys, book, {out: (over, under, method)})
    return r.filter(F.col(out).isNotNull()).withColumnRenamed(f"{out}_books", "two_sided_books")


def consensus_many(quotes: DataFrame, keys: Sequence[str], book: str, prices: dict[str, tuple[str, str, str]],
                   extra: Sequence[Column] = ()) -> DataFrame:
    """Several consensus prices (close, open, another margin model) of one store in one aggregation;
    ``extra`` aggregates ride along."""
    q = quotes.withColumn("__pref", F.lower(book).isin(*PREFERRED_BOOKS))
    for out, (over, under, method) in prices.items():
        q = q.withColumn(f"__f_{out}", O.no_vig(over, under) if method == "proportional" else O.shin_no_vig(over, under))
    aggs = []
    for out in prices:
        f = F.col(f"__f_{out}")
        aggs += [F.coalesce(F.avg(F.when(F.col("__pref"), f)), F.percentile(f, F.lit(0.5))).alias(out),
                 n_books(F.when(f.isNotNull(), F.col(book))).alias(f"{out}_books")]
    return q.groupBy(*keys).agg(*aggs, *extra)


def soft_fair(quotes: DataFrame, keys: Sequence[str], over: str, under: str, book: str) -> DataFrame:
    """Two-sided consensus, else the median one-sided price after a haircut."""
    two = consensus_fair(quotes, keys, over, under, book)
    one = quotes.groupBy(*keys).agg(F.percentile(O.american_to_prob(over), F.lit(0.5)).alias("__o"), F.percentile(O.american_to_prob(under), F.lit(0.5)).alias("__u"))
    est = F.coalesce(P.clip(F.col("__o") * ONE_SIDED, 1e-6, 1 - 1e-6), P.clip(1 - F.col("__u") * ONE_SIDED, 1e-6, 1 - 1e-6))
    return one.join(two, list(keys), "left").select(*keys, F.coalesce("fair", est).alias("fair"),
                                                    F.when(F.col("fair").isNotNull(), "two_sided").when(est.isNotNull(), "one_sided").alias("fair_via"))


def best_price(quotes: DataFrame, keys: Sequence[str], price: str, book: str) -> DataFrame:
    """Most generous price of one side with its book (ties by book name) and the number of books."""
    d = O.decimal_odds(price)
    q = quotes.withColumn("__d", d).filter(F.col("__d").isNotNull())
    b = F.min_by(F.struct(F.col(price).alias("p"), F.col(book).alias("b"), F.col("__d").alias("d")), F.struct(-F.col("__d"), F.col(book)))
    return q.groupBy(*keys).agg(b.alias("__b"), n_books(F.col(book)).alias("books")).select(
        *keys, F.col("__b.p").alias("best_price"), F.col("__b.b").alias("best_book"), F.col("__b.d").alias("best_decimal"), "books")


def capture_span() -> Column:
    """Minutes from open to close."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return F.greatest(F.lit(0.0), (micros("close_ts") - micros("open_ts")) / 6e7)


def close_quality(store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open to close span in minutes of the longest-watched quote of each key."""
    return store.groupBy(*keys).agg(F.max(capture_span()).alias("gap_min")).withColumn("one_cap", (F.col("gap_min") <= 0).cast("int"))


def value_screen(model: DataFrame, store: DataFrame, keys: Sequence[str], p: str, min_ev: float = MIN_EV) -> DataFrame:
    """Both sides of every priced key with their value; only two-sided markets and EV >= min_ev stay."""
    keys = list(keys)
    fair = consensus_fair(store, keys, "close_over", "close_under", "book")
    over = best_price(store, keys, "close_over", "book").select(*keys, F.struct("best_price", "best_book", "best_decimal").alias("__o"))
    under = best_price(store, keys, "close_under", "book").select(*keys, F.struct("best_price", "best_book", "best_decimal").alias("__u"))
    books = store.groupBy(*keys).agg(n_books(F.col("book")).alias("books"))
    j = model.join(fair.select(*keys, "fair"), keys).join(over, keys, "left").join(under, keys, "left").join(books, keys)
    side = F.explode(F.array(
        F.struct(F.lit("Over").alias("side"), F.col(p).alias("p_side"), F.col("fair").alias("fair_side"), F.col("__o").alias("q")),
        F.struct(F.lit("Under").alias("side"), (1 - F.col(p)).alias("p_side"), (1 - F.col("fair")).alias("fair_side"), F.col("__u").alias("q"))))
    r = j.withColumn("s", side).select(*model.columns, "books", "s.side", "s.p_side", "s.fair_side", F.col("s.q.best_price").alias("price"),
                                       F.col("s.q.best_book").alias("book"), F.col("s.q.best_decimal").alias("dec"))
    r = r.withColumn("ev", F.col("p_side") * F.col("dec") - 1).filter(F.col("ev") >= min_ev)
    notes = F.array_compact(F.array(F.when(F.col("books") == 1, "1 book"), F.when(F.col("dec") > 5.0, "longshot")))
    return r.withColumn("note", F.when(F.size(notes) > 0, F.array_join(notes, "; ")))


def with_bet_key(df: DataFrame, date: str = "d", game: str = "game", entity: str = "entity", team: str = "team", market: str = "market",
                 line: str = "line", label: str = "label", gnum: str = "gnum", out: str = "bet_key") -> DataFrame:
    """Add the identity that ignores the side: the team counts only outside the moneyline, the game label only
    without an id. Typed columns are spelled directly; only text columns need normalising."""
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        plain = types[c] in ("tinyint", "smallint", "int", "bigint", "date")
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if plain else key_text(c)

    blank = F.lit("")
    d = df.withColumn("__mkt", text(market)).withColumn("__pk", text(game))
    mkt, pk = F.col("__mkt"), F.col("__pk")
    parts = [text(date), pk, text(entity), F.when(mkt == "h2h", blank).otherwise(text(team)), mkt, text(line),
             F.when(pk == "", text(label)).otherwise(blank), F.when(pk == "", text(gnum)).otherwise(blank)]
    return d.withColumn(out, F.concat_ws("|", *parts)).drop("__mkt", "__pk")


def enrich(bets: DataFrame, passing: DataFrame, family: str, bankroll: Column | float, order: Sequence[Column]) -> DataFrame:
    """Stake fields and the first rule that stops a bet; only the better side of an identity stays."""
    b = bets.join(passing.select(family).distinct().withColumn("__pass", F.lit(True)), family, "left")
    implied, dec = O.american_to_prob("price"), O.decimal_odds("price")
    pb = SHRINK_W * F.col("p_model") + (1 - SHRINK_W) * F.col("p_close")
    b = b.withColumn("implied", implied).withColumn("p_bet", pb).filter("implied IS NOT NULL AND p_bet IS NOT NULL")
    b = b.withColumn("edge", F.col("p_bet") - F.col("implied")).withColumn("ev", F.col("p_bet") * dec - 1).withColumn(
        "f_kelly", O.kelly("p_bet", "price", KELLY_FRACTION))
    why = (F.when(F.col("__pass").isNull(), "family-not-PASS").when(F.col("edge") < EDGE_FLOOR, f"edge<{EDGE_FLOOR}").when(F.col("ev") <= 0, "EV<=0")
           .when(F.col("implied") < MIN_IMPLIED, "longshot-band").when(F.coalesce("books", F.lit(0)) < MIN_BOOKS, "single-book")
           .when(F.col("f_kelly") > PER_BET_CAP, "per-bet-1%").otherwise(""))
    bank = bankroll if isinstance(bankroll, Column) else F.lit(float(bankroll))
    b = b.withColumn("stake_capped_by", why)
    paper = F.col("stake_capped_by").isin("per-bet-1%", "")
    b = b.withColumn("status", F.when(paper, "paper").otherwise("track")).withColumn(
        "stake", F.when(paper, F.least("f_kelly", F.lit(PER_BET_CAP)) * bank).otherwise(0.0)).drop("__pass")
    return pick_one(b, ["bet_key"], [F.desc("ev"), *order])


def append_superseding(led: DataFrame, new: DataFrame) -> DataFrame:
    """New rows of settled identities drop out; live rows that are served again retire with a void marker."""
    done = led.filter(F.col("outcome").isin(*SETTLED)).select("bet_key").distinct()
    fresh = new.join(done, "bet_key", "left_anti")
    served = fresh.select("bet_key").distinct().withColumn("__new", F.lit(True))
    j = led.join(served, "bet_key", "left")
    live = F.col("status").isin("paper", "track") & (F.col("outcome") == "") & F.col("__new").isNotNull()
    old = j.withColumn("__retire", live)
    kept = old.withColumn("outcome", F.when(F.col("__retire"), "superseded").otherwise(F.col("outcome"))).select(*led.columns)
    marks = old.filter("__retire").withColumn("status", F.lit("void")).withColumn("stake", F.lit(0.0)).withColumn(
        "stake_capped_by", F.lit("superseded-by-re-serve")).select(*led.columns)
    return kept.unionByName(marks).unionByName(fresh.select(*led.columns))


def market_outcomes(bets: DataFrame, box: DataFrame, finals: DataFrame, config: DataFrame) -> DataFrame:
    """Realised stat, y and push per bet, set-based.

    ``config``: market, scope (player, starter, total, team, side) and stat name. ``box``:
    game, entity, stat, value, started, exposure (long form). ``finals``: game, home, away,
    home_score, away_score. NULL y means unresolved or a push.
    """
    b = bets.join(config, "market", "left")
    lines = box.select("game", "entity", "stat", F.struct("value", "started", "exposure").alias("__box"))
    b = b.join(lines, ["game", "entity", "stat"], "left").join(
        finals.select("game", F.struct("home", "home_score", "away_score").alias("__f")), "game", "left")
    f, x = F.col("__f"), F.col("__box")
    ok = F.when(F.col("scope") == "starter", x["started"] == 1).otherwise(x["exposure"] > 0)
    actual = (F.when(F.col("scope") == "total", f["home_score"] + f["away_score"])
              .when(F.col("scope") == "team", F.when(F.col("team") == f["home"], f["home_score"]).otherwise(f["away_score"]))
              .when(F.col("scope").isin("player", "starter"), F.when(ok, x["value"])))
    b = b.withColumn("actual", actual.cast("double")).withColumn("final", f.isNotNull())
    home_won = f["home_score"] > f["away_score"]
    y = F.when(F.col("scope") == "side", home_won.cast("int")).when(F.col("actual") != F.col("line"), (F.col("actual") > F.col("line")).cast("int"))
    return b.withColumn("y", y).withColumn("push", F.coalesce((F.col("scope") != "side") & (F.col("actual") == F.col("line")), F.lit(False))).withColumn(
        "home_team", f["home"]).drop("__box", "__f", "stat")


def settle(led: DataFrame, box: DataFrame, finals: DataFrame, config: DataFrame, upto: Column, seq: str = "seq") -> DataFrame:
    """Grade every open row dated up to ``upto`` at once; older live duplicates retire first. Running it again changes nothing."""
    live = F.col("status").isin("paper", "track") & (F.col("outcome") == "")
    # one partially combined pass tells both whether an identity settled and which live row is newest
    ident = led.groupBy("bet_key").agg(F.max(F.col("outcome").isin(*SETTLED)).alias("__done"), F.max(F.when(live, F.col(seq))).alias("__top"))
    j = led.join(ident, "bet_key")
    dup = live & (F.col("__done") | (F.col(seq) < F.col("__top")))
    j = j.withColumn("outcome", F.when(dup, "superseded").otherwise(F.col("outcome"))).drop("__done", "__top")
    g = market_outcomes(j, box, finals, config)
    open_ = F.col("status").isin("paper", "track") & (F.col("outcome") == "") & (F.col("d") <= upto)
    picked = F.when(F.col("scope") == "side", (F.col("team") == F.col("home_team")) == (F.col("y") == 1)).otherwise(
        (F.col("side") == "Over") == (F.col("y") == 1))
    res = F.when(F.col("y").isNotNull() & F.col("final"), F.when(picked, "win").otherwise("lose")).when(F.col("push") & F.col("final"), "push")
    out = F.when(open_ & res.isNotNull(), res).otherwise(F.col("outcome"))
    g = g.withColumn("__o", out).withColumn("__new", open_ & res.isNotNull())
    pnl = F.when(F.col("__new"), O.profit("__o", "stake", "price")).otherwise(F.col("pnl"))
    return g.withColumn("pnl", pnl).withColumn("outcome", F.col("__o")).select(*led.columns)


def void_unplayed(led: DataFrame, box: DataFrame, finals: DataFrame, config: DataFrame, before: Column) -> DataFrame:
    """Void open player rows of earlier dates whose game is final and boxed but holds no gradeable line."""
    player = config.filter(F.col("scope").isin("player", "starter")).select("market", F.col("scope").alias("__scope"))
    boxed = box.select("game").distinct().withColumn("__boxed", F.lit(True))
    fin = finals.select("game").distinct().withColumn("__final", F.lit(True))
    who = box.groupBy("game", "entity").agg(F.max("started").alias("__st"), F.max("exposure").alias("__ex"))
    j = led.join(player, "market", "left").join(boxed, "game", "left").join(fin, "game", "left").join(who, ["game", "entity"], "left")
    grade = F.coalesce(F.when(F.col("__scope") == "starter", F.col("__st") == 1).otherwise(F.col("__ex") > 0), F.lit(False))
    open_ = F.col("status").isin("paper", "track") & (F.col("outcome") == "") & (F.col("d") < before)
    void = open_ & F.col("__scope").isNotNull() & F.col("__boxed").isNotNull() & F.col("__final").isNotNull() & ~grade
    return (j.withColumn("__v", void).withColumn("status", F.when(F.col("__v"), "void").otherwise(F.col("status")))
            .withColumn("outcome", F.when(F.col("__v"), "void").otherwise(F.col("outcome")))
            .withColumn("pnl", F.when(F.col("__v"), 0.0).otherwise(F.col("pnl"))).select(*led.columns))


def fill_clv(led: DataFrame, store: DataFrame, matchup_games: DataFrame, keys: Sequence[str], game: str = "game") -> DataFrame:
    """Closing value by exact game; rows of a store without game ids answer only for one-game matchups."""
    keys = list(keys)
    ex = consensus_fair(store.filter(F.col(game).isNotNull()), [*keys, game], "close_over", "close_under", "book").select(*keys, game, F.col("fair").alias("__x"))
    has = store.filter(F.col(game).isNotNull()).select(*keys, game).distinct().withColumn("__has", F.lit(True))
    bl = consensus_fair(store.filter(F.col(game).isNull()), keys, "close_over", "close_under", "book").select(*keys, F.col("fair").alias("__b"))
    j = led.join(ex, [*keys, game], "left").join(has, [*keys, game], "left").join(bl, keys, "left").join(matchup_games, game, "left")
    single = F.coalesce(F.col("n_games"), F.lit(1)) == 1
    fair = F.coalesce("__x", F.when(F.col("__has").isNull() & single, F.col("__b")))
    side = F.when(F.col("side") == "Over", fair).otherwise(1 - fair)
    return j.withColumn("p_close_final", side).withColumn("clv", O.closing_value(side, O.american_to_prob("price"))).select(*led.columns, "p_close_final", "clv")


def ledger_report(led: DataFrame) -> DataFrame:
    s = led.filter(F.col("outcome").isin("win", "lose", "push"))
    return s.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "win").alias("won"),
                                   F.count_if(F.col("outcome") == "push").alias("push"), F.sum("pnl").alias("pnl"), F.avg("clv").alias("mean_clv"))


def bankroll(led: DataFrame, start: float = START_BANKROLL) -> Column:
    """Start plus settled profit, as a one-value column."""
    return led.agg(F.lit(start) + F.coalesce(F.sum("pnl"), F.lit(0.0))).scalar()


def available_pool(
    roster: DataFrame, use: DataFrame, out_intervals: DataFrame, group: str, entity: str, date: str, size: int = 8, heavy: int = 25
) -> DataFrame:
    """Eligible members per (group, date): not used on both previous days, not ``heavy`` yesterday, not
    inside an interval unless seen since, last seen with the group; the most used first."""
    from asofkit.operators.asof import asof_join
    from asofkit.operators.joins import exact_lag, interval_active
    from asofkit.operators.windows import trailing_sums

    day = use.groupBy(entity, date).agg(F.sum("np").alias("np"), F.max(group).alias("__grp")).withColumn("__seen", F.col(date)).withColumn("__one", F.lit(1))
    r = exact_lag(roster, day, [entity], date, "np", [1, 2])
    r = trailing_sums(r, day, [entity], date, ["__one"], {"30": 30}).withColumnRenamed("__one_30", "uses")
    r = interval_active(r, out_intervals, [entity], date, "place", "act")
    r = asof_join(r, day, [entity], ["__grp", "__seen"], date=date)
    inside = F.col("active_since").isNotNull() & ~F.coalesce(F.col("__seen") >= F.col("active_since"), F.lit(False))
    ok = ~((F.col("np_lag1") > 0) & (F.col("np_lag2") > 0)) & (F.col("np_lag1") < heavy) & ~inside & (F.col("__grp").isNull() | (F.col("__grp") == F.col(group)))
    return top_k(r.filter(ok), [group, date], [F.desc("uses"), F.asc(entity)], size, "pos").select(group, date, entity, "uses", "pos")
