"""Keyed state: stints per player."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


STINT_SCHEMA = "user_id long, place_date date, act_date date, il60 int, rehab int"


def islands(events: pd.DataFrame) -> pd.DataFrame:
    """Stints of one player's events in order: what lies between two activations is one island.

    An island counts if something opened it; a rehab counts after the first opening. The same rule as
    the batch form (``operators.windows.stints``).
    """
    e = events.reset_index(drop=True)
    closes, opens = e["kind"] == "activate", e["kind"].isin(["place", "transfer"])
    e["island"] = closes.cumsum() - closes
    e["at"] = e.index
    first = e[opens].groupby("island").agg(place_date=("d", "first"), start=("at", "first"), il60=("k", lambda k: int((k.fillna(0) >= 60).any())))
    out = first.join(e[closes].groupby("island").agg(act_date=("d", "first"))).join(e[e["kind"] == "rehab"].groupby("island").agg(last=("at", "last")))
    out["rehab"] = (out["last"] > out["start"]).astype(int)
    return out


def walk(held: tuple | None, events: Iterable[tuple]) -> tuple[list[tuple], tuple | None]:
    """The rule of ``islands``, one event (d, kind, k) at a time: stints closed by ``events`` and the open one (place, il60, rehab)."""
    place, il60, rehab = held or (None, 0, 0)
    opened, done = held is not None, []
    for d, kind, k in events:
        if kind == "activate":
            if opened:
                done.append((place, d, il60, rehab))
            opened, place, il60, rehab = False, None, 0, 0
        elif kind in ("place", "transfer"):
            if not opened:
                opened, place = True, d
            il60 = int(il60 or (k or 0) >= 60)
        elif kind == "rehab" and opened:
            rehab = 1
    return done, (place, il60, rehab) if opened else None


class StintProcessor(StatefulProcessor):
    """The open island of a player is the state. Rows are walked as they are: a frame per player costs more than its events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "place date, il60 int, rehab int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a micro-batch of one key is bounded by the trigger's file limit; missing days and ids come last
        batch = sorted(rows, key=lambda r: (r["d"] is None, r["d"], r["event_id"] is None, r["event_id"]))
        got = self.open.get()
        held = None if got is None else tuple(got)
        done, left = walk(held, [(r["d"], r["kind"], r["k"]) for r in batch])
        if left is None and held is not None:
            self.open.clear()
        elif left is not None and left != held:
            self.open.update(left)
        for place, act, il60, rehab in done + ([(left[0], None, *left[1:])] if left else []):
            yield Row(user_id=key[0], place_date=place, act_date=act, il60=il60, rehab=rehab)

    def close(self) -> None:
        pass


def stint_stream(events: DataFrame) -> DataFrame:
    """Stream of (user_id, d, event_id, kind, k) to stint versions."""
    use_rocksdb(events.sparkSession)
    return events.groupBy("user_id").transformWithState(StintProcessor(), STINT_SCHEMA, "Update", "None")
