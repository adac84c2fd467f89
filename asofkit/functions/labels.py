"""Market labels, outcome classes and side labels, with their fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofkit.functions.prob import _c

# Outcome class of each terminal event, batted-ball types.
OUTCOME_CLASSES = ["K", "BB", "HBP", "1B", "2B", "3B", "HR", "IPO"]
EVENT_CLASS = {
    "strikeout": "K", "strikeout_double_play": "K", "walk": "BB", "intent_walk": "BB", "hit_by_pitch": "HBP",
    "catcher_interf": "HBP", "single": "1B", "double": "2B", "triple": "3B", "home_run": "HR", "field_out": "IPO",
    "force_out": "IPO", "grounded_into_double_play": "IPO", "double_play": "IPO", "triple_play": "IPO",
    "fielders_choice": "IPO", "fielders_choice_out": "IPO", "field_error": "IPO", "sac_fly": "IPO", "sac_bunt": "IPO",
    "sac_fly_double_play": "IPO", "sac_bunt_double_play": "IPO", "batter_interference": "IPO", "other_out": "IPO",
}
BALL_TYPES = ["ground_ball", "fly_ball", "line_drive", "popup"]

# Pitch classes.
PITCH_CLASS = {
    "FF": "fast", "SI": "fast", "FC": "fast", "SL": "brk", "ST": "brk", "CU": "brk", "KC": "brk", "SV": "brk",
    "KN": "brk", "CS": "brk", "SC": "brk", "CH": "off", "FS": "off", "FO": "off", "EP": "off",
}

# Binary batter events as predicates over a stat line (columns pa h b2 b3 hr tb r rbi bb sb so).
BATTER_EVENTS = {
    "HR": "hr >= 1", "Hit": "h >= 1", "2+ Hits": "h >= 2", "Single": "h - b2 - b3 - hr >= 1", "Double": "b2 >= 1",
    "Triple": "b3 >= 1", "2+ TB": "tb >= 2", "3+ TB": "tb >= 3", "4+ TB": "tb >= 4", "Run": "r >= 1", "2+ Runs": "r >= 2",
    "RBI": "rbi >= 1", "2+ RBI": "rbi >= 2", "H+R+RBI 2+": "h + r + rbi >= 2", "H+R+RBI 3+": "h + r + rbi >= 3",
    "H+R+RBI 4+": "h + r + rbi >= 4", "BB": "bb >= 1", "SB": "sb >= 1", "K": "so >= 1", "2+ K": "so >= 2", "3+ K": "so >= 3",
}

# Stat behind each pitcher line label; batter label keywords in the order they are tried.
LINE_STAT = {"K": "so", "Outs": "outs", "Hits": "h", "BB": "bb", "ER": "er"}
LABEL_STAT = (
    ("H+R+RBI", "h + r + rbi"), ("total bases", "tb"), ("HR", "hr"), ("RBI", "rbi"), ("single", "h - b2 - b3 - hr"),
    ("double", "b2"), ("hit", "h"), ("run", "r"), ("walk", "bb"), ("stolen base", "sb"),
)


# Shown names of priced markets, at one and at more.
NAME_OF_ONE = {
    "batter_hits": "1+ hit", "batter_home_runs": "1+ HR", "batter_runs_scored": "run scored", "batter_walks": "1+ walk",
    "batter_stolen_bases": "stolen base", "batter_singles": "1+ single", "batter_doubles": "1+ double",
}
NAME_OF_MORE = {
    "batter_hits": "hits", "batter_home_runs": "HR", "batter_total_bases": "total bases", "batter_runs_scored": "runs scored",
    "batter_rbis": "RBI", "batter_hits_runs_rbis": "H+R+RBI", "batter_singles": "singles",
}
NAME_OF_PITCHER = {
    "pitcher_strikeouts": "strikeouts", "pitcher_outs": "outs", "pitcher_hits_allowed": "hits allowed", "pitcher_walks": "walks",
    "pitcher_earned_runs": "earned runs",
}
# Stems of the ladder columns that have a map per line.
LINE_STEM = {"pitcher_outs": "Outs"}


def _lookup(pairs: dict, key: Column) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.element_at(F.create_map(*flat), key)


def outcome_class(event) -> Column:
    """Class of a terminal event; NULL for anything that is not one."""
    return _lookup(EVENT_CLASS, _c(event))


def ball_type(event, kind) -> Column:
    """Batted-ball type only when the ball was in play and the type is known."""
    return F.when(~outcome_class(event).isin("K", "BB", "HBP") & _c(kind).isin(*BALL_TYPES), _c(kind))


def pitch_class(code) -> Column:
    return _lookup(PITCH_CLASS, _c(code))


def base_mask(first, second, third) -> Column:
    """1, 2 and 4 for an occupied first, second and third base."""
    bit = lambda c, v: F.when(_c(c).isNotNull(), v).otherwise(0)
    return bit(first, 1) + bit(second, 2) + bit(third, 4)


def line_of(market) -> Column:
    """Number after the last '>' of a label, NULL without one."""
    return F.trim(F.element_at(F.split(_c(market), ">"), -1)).try_cast("double")


def line_label(stem, line) -> Column:
    return F.concat(_c(stem), F.lit(" > "), _c(line).cast("string"))


def market_label(market, line) -> Column:
    """Ladder column of a market whose lines have maps of their own, else NULL."""
    return line_label(_lookup(LINE_STEM, _c(market)), _c(line))


def shown_name(market, line) -> Column:
    """Name a priced market is shown under; an unknown market keeps its own."""
    m, x = _c(market), _c(line)
    one, more, pit = (_lookup(t, m) for t in (NAME_OF_ONE, NAME_OF_MORE, NAME_OF_PITCHER))
    n = (x + 0.5).cast("int")
    batter = F.when(one.isNotNull() & (more.isNull() | (n == 1)), one).otherwise(F.concat(n.cast("string"), F.lit("+ "), more))
    return F.coalesce(batter, F.concat(F.lit("pitcher "), pit, F.lit(" o"), x.cast("string")), m)


def line_stat(market) -> Column:
    """Stat a pitcher line label grades, NULL when it is not a line label."""
    stem = F.regexp_extract(_c(market), r"^(K|Outs|Hits|BB|ER) > \d+(?:\.\d+)?$", 1)
    return F.when(stem != "", _lookup(LINE_STAT, stem))


def label_actual(label) -> Column:
    """Count a batter label prices, the first keyword found in the fixed order (needs the stat columns)."""
    out = None
    for word, stat in LABEL_STAT:
        hit = F.contains(_c(label), F.lit(word))
        out = F.when(hit, F.expr(stat)) if out is None else out.when(hit, F.expr(stat))
    return out


def batter_events(stats_prefix: str = "") -> Column:
    """Array of (market, y) structs for a stat line."""
    return F.array(*[F.struct(F.lit(m).alias("market"), F.expr(e).cast("int").alias("y")) for m, e in BATTER_EVENTS.items()])


def nickname_code(full, names: dict[str, str]) -> Column:
    """Code of the longest nickname the full name ends with."""
    out = F.lit(None).cast("string")
    for nick in sorted(names, key=len):  # later branches wrap earlier ones, so the longest match wins
        out = F.when(_c(full).endswith(nick), names[nick]).otherwise(out)
    return out
