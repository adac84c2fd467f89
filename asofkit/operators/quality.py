"""Table contracts, publishing, freshness, provenance and fit-window guards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """What a table must look like to be published."""

    columns: Sequence[str]
    key: Sequence[str] = ()
    min_rows: int = 1
    max_dup_frac: float = 0.0
    numeric: dict[str, float] = field(default_factory=dict)  # column -> largest share of unreadable values
    date: str | None = None
    max_age_days: int | None = None
    armed_months: tuple[int, int] = (1, 12)  # freshness is judged only in these months
    shrink_ratio: float = 0.98
    shrink_rows: int = 0
    season: str | None = None

    def derived(self, **changes) -> "Contract":
        return replace(self, **changes)


def contract_metrics(df: DataFrame, c: Contract) -> DataFrame:
    """Every number the contract needs, one pass over the rows plus one partial aggregation for the key."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for col in c.numeric:
        aggs.append(F.avg(F.when(F.col(col).try_cast("double").isNull(), 1.0).otherwise(0.0)).alias(f"bad_{col}"))
    if c.date:
        dt = F.col(c.date).try_cast("date")
        aggs += [F.avg(F.when(dt.isNotNull(), 1.0).otherwise(0.0)).alias("date_ok"), F.max(dt).alias("max_date")]
    one = df.agg(*aggs)
    if c.key:
        # duplicates come from key counts, so a hot key is a counter and not a group of rows
        dup = df.groupBy(*c.key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("dups"))
        one = one.withColumn("dups", dup.scalar())
    return one


def validate(
    df: DataFrame, c: Contract, prev: DataFrame | None = None, today: str | None = None, reference: Column | None = None
) -> DataFrame:
    """Problems as rows (check, detail); no rows means the table is fine.

    Freshness counts from ``today``, or from ``reference`` (the newest date of a table that
    leads this one) when that is earlier, so a season's end raises no false alarm.
    """
    spark = df.sparkSession
    missing = [x for x in c.columns if x not in df.columns]
    if missing:
        return spark.createDataFrame([("columns", f"missing {', '.join(missing)}")], "check string, detail string")
    m = contract_metrics(df, c)
    checks: list[tuple[str, Column, Column]] = [("rows", F.col("rows") < c.min_rows, F.concat(F.lit("rows "), F.col("rows").cast("string")))]
    for col, lim in c.numeric.items():
        checks.append((f"numeric:{col}", F.col(f"bad_{col}") > lim, F.concat(F.lit("unreadable "), F.round(f"bad_{col}", 4).cast("string"))))
    if c.key:
        share = F.col("dups") / F.greatest(F.col("rows"), F.lit(1))
        checks.append(("key", share > c.max_dup_frac, F.concat(F.lit("duplicates "), F.col("dups").cast("string"))))
    if c.date:
        checks.append(("date_parse", F.col("date_ok") < 0.99, F.round("date_ok", 4).cast("string")))
        if today:
            t = F.lit(today).cast("date")
            checks.append(("date_future", F.col("max_date") > t, F.col("max_date").cast("string")))
            if c.max_age_days is not None:
                armed = F.month(t).between(*c.armed_months)
                ref = t if reference is None else F.least(t, reference)
                checks.append(("stale", armed & (F.datediff(ref, "max_date") > c.max_age_days), F.col("max_date").cast("string")))
    if prev is not None:
        before = prev.agg(F.count(F.lit(1))).scalar()
        m = m.withColumn("__prev", before)
        small = (F.col("rows") < F.col("__prev") * c.shrink_ratio) & (F.col("__prev") - F.col("rows") > c.shrink_rows)
        checks.append(("shrink", small, F.concat(F.col("__prev").cast("string"), F.lit(" -> "), F.col("rows").cast("string"))))
    rows = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("check"), detail.alias("detail"))) for n, bad, detail in checks])
    out = m.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("p")).select("p.check", "p.detail")
    if prev is not None and c.season:
        gone = prev.select(c.season).distinct().join(df.select(c.season).distinct(), c.season, "left_anti")
        out = out.unionByName(gone.select(F.lit("season").alias("check"), F.concat(F.lit("vanished "), F.col(c.season).cast("string")).alias("detail")))
    return out


def publish(candidate: DataFrame, previous: DataFrame, c: Contract, today: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The candidate if it meets its contract, else the previous version; and the report."""
    problems = validate(candidate, c, previous, today)
    return (previous if problems.limit(1).count() else candidate), problems


def freshness(df: DataFrame, date: str, today: str, max_age: int, group: Sequence[str] = ()) -> DataFrame:
    m = df.groupBy(*group).agg(F.max(date).alias("newest"))
    age = F.datediff(F.lit(today).cast("date"), "newest")
    return m.select(*group, "newest", age.alias("age_days"), (age > max_age).alias("stale"))


def provenance(df: DataFrame, name: str, date: str, unit: str, written: str | None = None) -> DataFrame:
    return df.agg(F.lit(name).alias("source"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
                  F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct(unit).alias("n_units") if written == "approx" else F.countDistinct(unit).alias("n_units"))


def fit_overlap(windows: DataFrame) -> DataFrame:
    """Does an evaluation range touch the fit range, and where may an honest one start?"""
    hit = ~((F.col("eval_end") < F.col("fit_start")) | (F.col("eval_start") > F.col("fit_end")))
    return windows.withColumn("overlaps", hit).withColumn("auto_start", F.date_add("fit_end", 1))


def contracts_from_table(specs: DataFrame) -> dict[str, Contract]:
    """Contract registry from a table of specs: one short row per table (name, columns, key, min_rows, ...)."""
    out = {}
    for r in specs.toLocalIterator():
        s = r.asDict(recursive=True)
        name = s.pop("name")
        out[name] = Contract(**{k: v for k, v in s.items() if v is not None})
    return out


def registry(specs: DataFrame) -> tuple[dict[str, Contract], dict[str, str]]:
    """Contracts by file name and the reasons why a spec gives none.

    ``specs`` is one short row per table (name, parent, fields of ``Contract``). A null field comes
    from the parent, at any depth; a missing parent or a circle leaves the name without a contract.
    """
    raw = {s.pop("name"): s for s in (r.asDict(recursive=True) for r in specs.toLocalIterator())}
    good, broken = {}, {}
    for name in raw:
        line, at = [], name
        while at is not None and at in raw and at not in line:
            line.append(at)
            at = raw[at].get("parent")
        if at is not None:
            broken[name] = f"parent {at} is " + ("its own ancestor" if at in raw else "not registered")
            continue
        fields = {}
        for ancestor in reversed(line):
            fields |= {k: v for k, v in raw[ancestor].items() if v is not None and k != "parent"}
        good[name] = Contract(**{"columns": (), **fields})
    return good, broken


def validate_files(spark: SparkSession, paths: Sequence[str], specs: DataFrame, today: str | None = None) -> DataFrame:
    """Problems as rows (file, check, detail); a file whose name has no contract is itself a problem."""
    good, broken = registry(specs)
    out = spark.createDataFrame([], "file string, check string, detail string")
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
        if name in good:
            found = validate(spark.read.parquet(path), good[name], today=today)
        else:
            found = spark.createDataFrame([("contract", broken.get(name, "not registered"))], "check string, detail string")
        out = out.unionByName(found.select(F.lit(name).alias("file"), "check", "detail"))
    return out


# Contracts of the tables the flatteners and the ledger write.
CONTRACTS: dict[str, Contract] = {
    "games": Contract(
        columns=("GamePk", "Season", "Date", "DayNight", "AwayTeam", "HomeTeam", "AwayScore", "HomeScore", "Venue", "GameType"),
        key=("GamePk",), date="Date", max_age_days=6, armed_months=(4, 10), numeric={"GamePk": 0.0, "AwayScore": 0.02, "HomeScore": 0.02},
        min_rows=13000, shrink_ratio=0.999, season="Season"),
    "game_batting": Contract(
        columns=("GamePk", "Season", "Date", "PlayerId", "Team", "PA", "H", "HR"), key=("GamePk", "PlayerId"), max_dup_frac=0.001, date="Date",
        numeric={"PlayerId": 0.0, "PA": 0.001, "HR": 0.001}, min_rows=280000, shrink_ratio=0.999, season="Season"),
    "movements": Contract(
        columns=("GamePk", "Season", "Date", "AtBatIndex", "PlayIndex", "RunnerId", "StartBase", "EndBase", "IsOut", "RBI", "Earned"),
        key=("GamePk", "AtBatIndex", "PlayIndex", "RunnerId", "StartBase"), max_dup_frac=0.002, date="Date", max_age_days=6, armed_months=(4, 11),
        numeric={"GamePk": 0.0, "RunnerId": 0.001}, min_rows=1800000, shrink_ratio=0.999, season="Season"),
    "weather": Contract(
        columns=("GamePk", "Date", "Venue", "Humidity", "Pressure", "Precip"), key=("GamePk",), date="Date", max_age_days=6, armed_months=(4, 11),
        numeric={"GamePk": 0.0, "Humidity": 0.02, "Pressure": 0.02}, min_rows=20000, shrink_ratio=0.999),
    "linescores": Contract(
        columns=("GamePk", "Date", "Season", "Inning", "AwayRuns", "HomeRuns"), key=("GamePk", "Inning"), date="Date", max_age_days=6,
        armed_months=(4, 11), numeric={"GamePk": 0.0, "Inning": 0.0, "AwayRuns": 0.02}, min_rows=1000, shrink_ratio=0.999, season="Season"),
    "il_events": Contract(
        columns=("PlayerId", "Date", "Kind", "ILDays"), key=("PlayerId", "Date", "Kind"), max_dup_frac=0.02, date="Date", max_age_days=10,
        armed_months=(5, 9), numeric={"PlayerId": 0.0}, min_rows=20000, shrink_ratio=0.999),
    "odds": Contract(
        columns=("Date", "GamePk", "PlayerId", "Market", "Line", "OverPrice", "UnderPrice", "Book", "CapturedAt"), date="Date",
        numeric={"Line": 0.05, "OverPrice": 0.20}, min_rows=1, shrink_ratio=0.999),
    "sprint_speed": Contract(
        columns=("Year", "PlayerId", "SprintSpeed"), key=("Year", "PlayerId"), numeric={"PlayerId": 0.0, "SprintSpeed": 0.01}, min_rows=3500,
        shrink_ratio=0.999, shrink_rows=20, season="Year"),
}
CONTRACTS["minor_game_batting"] = CONTRACTS["game_batting"].derived(
    columns=(*CONTRACTS["game_batting"].columns, "Level"), min_rows=400000, max_age_days=10, armed_months=(5, 9))
