"""The gap of every call to the call before it of its source, by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators import events as ev
from tidewire.streaming.runs import LATENESS, write_batches

_OUT = "id long, source_id string, at long, gap_seconds double, too_soon boolean"
_MICROS = 1_000_000


class GapProcessor(StatefulProcessor):
    """State of a source: the calls that a late one may still come before (``open``), and the last call before those (``last``).

    New calls are set among the open ones, and gaps that are new or have changed go out: a late call restates its successor's. When the watermark has passed, an event-time timer
    closes calls: only the last of them stays. A source that has had no call for ``horizon_days`` is forgotten by a second timer; a call after so long a time counts as the first. Without a horizon no
    source is forgotten: the state is one row for each.
    """

    def __init__(self, min_gap: float, horizon_days: int | None):
        self.min_gap, self.horizon_ms = min_gap, None if horizon_days is None else horizon_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at long, id long")
        self.last = handle.getValueState("last", "at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["at", "id"]] for r in rows], ignore_index=True).drop_duplicates("id")
        known = pd.DataFrame(list(self.open.get()), columns=["at", "id"])
        new = new[~new["id"].isin(known["id"])]
        if new.empty:
            return
        both = pd.concat([known.assign(new=False), new.assign(new=True)], ignore_index=True).astype({"at": "int64", "id": "int64", "new": "bool"})
        both = both.sort_values(["at", "id"], ignore_index=True)
        before = both["at"].shift(1).astype("float64")
        last = self.last.get() if self.last.exists() else None
        if last:
            before.iloc[0] = last[0]
        out = both[both["new"] | both["new"].shift(1, fill_value=False)]  # and those that a new call now precedes
        gap = (out["at"] - before[out.index]) / _MICROS
        if self.horizon_ms is not None:
            gap = gap.where(gap * 1000 <= self.horizon_ms)  # whether the state is gone by then or not
        yield pd.DataFrame({"id": out["id"], "source_id": key[0], "at": out["at"], "gap_seconds": gap, "too_soon": (gap < self.min_gap).where(gap.notna(), None)})
        self._close(both[["at", "id"]], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        calls = pd.DataFrame(list(self.open.get()), columns=["at", "id"])
        self._close(calls, mark)
        last = self.last.get() if self.last.exists() else None
        if self.horizon_ms is not None and calls.empty and last and last[0] // 1000 + self.horizon_ms <= mark:
            self.last.clear()
        return iter(())

    def _close(self, calls: pd.DataFrame, mark: int) -> None:
        """Calls up to the watermark leave the list, the last of them for ``last``; timers for the rest."""
        over = calls["at"] // 1000 < mark
        if over.any():
            at, id_ = calls[over].iloc[-1]
            self.last.update((int(at), int(id_)))
            if self.horizon_ms is not None:
                self.handle.registerTimer(int(at) // 1000 + self.horizon_ms)
        left = calls[~over]
        if left.empty:
            self.open.clear()
        else:
            self.open.put([(int(a), int(i)) for a, i in left.itertuples(index=False)])
            self.handle.registerTimer(int(left["at"].iloc[-1]) // 1000 + 1)

    def close(self) -> None:
        pass


def gaps(events: DataFrame, lateness: str = LATENESS, horizon_days: int | None = 7, min_gap: float = ev.MIN_GAP_SECONDS) -> DataFrame:
    """(id, source_id, created_at, gap_seconds, too_soon) of calls as they come, and again where a late one changes a gap.

    However micro-batches cut and order the calls, the last row of an id is its gap in event time, if no call is later than ``lateness`` (such ones are dropped, as by every watermark).
    Equal times are ordered by id, repeated ids count once, calls without a time are no calls, those without a source are one source. A source's calls of a micro-batch meet in one task:
    they are as many as its rate allows in that time. Needs a session with the RocksDB state store (``state_session``).
    """
    calls = events.where(ev.event_class().isin(list(ev.REQUEST_CLASSES)) & F.col("created_at").isNotNull())
    timed = calls.select("id", F.col("source_id").cast("string").alias("source_id"), F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", lateness)
    rows = timed.withColumn("at", F.unix_micros("created_at"))
    found = rows.groupBy("source_id").transformWithStateInPandas(GapProcessor(min_gap, horizon_days), _OUT, "Update", "EventTime")
    kind = events.schema["source_id"].dataType
    return found.select("id", F.col("source_id").cast(kind).alias("source_id"), F.timestamp_micros("at").cast("timestamp_ntz").alias("created_at"), "gap_seconds", "too_soon")


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for streams with keyed state, so that the caller's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        value = spark.conf.get(key, None)
        if value is not None and own.conf.get(key, None) != value:
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def write_gaps(events: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS, horizon_days: int | None = 7, **trigger) -> StreamingQuery:
    """The gaps in batch folders; ``read_latest`` by id gives each call's last one. Nothing that has been written is read."""
    return write_batches(gaps(events, lateness, horizon_days), path, checkpoint, "update", **trigger)
