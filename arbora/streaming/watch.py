"""Watcher events as a stream: the same classes, batches and coalescing as the batch functions, with state for each key.

State is one open batch for each key: its first and last time and its paths.  It closes when a later event of the key comes
after its deadline, or when the watermark passes it.  The rule itself has no event time; the watermark is there to keep state
bounded: rows later than it are dropped by Spark.  Rows of one trigger are taken in order of time.

With a `control` column (events.control) some rows speak of the whole folder: dropped ones count for nothing, while a restart,
rescan or reload clears the open batch, which then asks for a full scan and names what called for it, as events.directed does."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import GAP_US, MAX_PATHS, MAX_US, scope

EVENT = "event_id long, key string, at timestamp, path string, kind string"
OUT = "key string, batch_start long, path string, scope string, events long"
_STATE = "first long, last long, full boolean, dropped long, paths array<string>, scopes array<string>, counts array<long>, calls array<long>"
#: What speaks of a whole folder, in the order of `calls`.
CALLS = ("restart", "rescan", "reload")


def read(spark: SparkSession, folder: str, schema: str = EVENT, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


class _Batch:
    """One open batch: the paths that are held, a Tree instead of all below it; past MAX_PATHS, or after a call, only a full scan is
    left."""

    def __init__(self, first: int, last: int, full: bool = False, dropped: int = 0, found: dict[str, list] | None = None, calls: list[int] | None = None):
        self.first, self.last, self.full, self.dropped, self.found, self.calls = first, last, full, dropped, found or {}, calls or [0] * len(CALLS)

    def call(self, us: int, what: str) -> None:
        self.last = max(self.last, us)
        self.calls[CALLS.index(what)] += 1
        self.full, self.found = True, {}

    def add(self, us: int, path: str, what: str | None) -> None:
        self.last = max(self.last, us)
        if what is None:
            return
        if self.full:
            self.dropped += 1
            return
        if path not in self.found and any(self.found.get(path[:k], ("",))[0] == "Tree" for k, c in enumerate(path) if c == "/"):
            return
        was = self.found.setdefault(path, [what, 0])
        if what == "Tree" and (was[0] != "Tree" or not was[1]):
            for below in [p for p in self.found if p.startswith(path + "/")]:
                del self.found[below]
        was[0] = max(was[0], what)  # Tree before Entry
        was[1] += 1
        if len(self.found) > MAX_PATHS:
            self.full, self.dropped, self.found = True, sum(n for _, n in self.found.values()), {}

    def rows(self, key: str) -> list[tuple]:
        """What a closed batch leaves to scan."""
        if any(self.calls):
            return [(key, self.first, "", "Full", sum(self.calls)), *((key, self.first, "", c.capitalize(), n) for c, n in zip(CALLS, self.calls) if n)]
        if self.full:
            return [(key, self.first, "", "Full", self.dropped)]
        return [(key, self.first, path, s, n) for path, (s, n) in self.found.items()]

    def state(self) -> tuple:
        return (self.first, self.last, self.full, self.dropped, list(self.found), [s for s, _ in self.found.values()], [int(n) for _, n in self.found.values()])


def coalesce(events: DataFrame, gap: int = GAP_US, most: int = MAX_US, late: str = "10 seconds") -> DataFrame:
    """events (event_id, key, at, path, kind) -> one row for each path that a closed batch leaves to scan."""

    def advance(key: tuple[Any, ...], pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch: _Batch | None = None
        if state.exists:
            first, last, full, dropped, names, scopes, counts, calls = state.get
            batch = _Batch(first, last, full, dropped, {p: [s, n] for p, s, n in zip(names, scopes, counts)}, list(calls))
        out: list[tuple] = []
        if state.hasTimedOut:
            out += batch.rows(key[0])
            state.remove()
        else:
            rows = pd.concat(list(pages)).sort_values(["us", "event_id"])
            for us, path, what, called in zip(rows["us"].tolist(), rows["path"], rows["scope"], rows["control"]):
                if batch is not None and us > min(batch.first + most, batch.last + gap):
                    out += batch.rows(key[0])
                    batch = None
                batch = batch or _Batch(us, us)
                if called is not None:
                    batch.call(us, called)
                else:
                    batch.add(us, path, what)
            state.update((*batch.state(), batch.calls))
            state.setTimeoutTimestamp(max(min(batch.first + most, batch.last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "batch_start", "path", "scope", "events"])

    called = F.col("control") if "control" in events.columns else F.lit(None).cast("string")
    told = events.withWatermark("at", late).withColumns({"us": F.unix_micros("at"), "scope": scope(F.col("kind")), "control": called})
    told = told.filter(~F.col("control").eqNullSafe(F.lit("drop")))
    out = told.groupBy("key").applyInPandasWithState(advance, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    # Rows as Spark's own operators (a join with entries, say) take them: the state's operator gives views of Arrow batches.
    return out.withColumn("events", F.coalesce("events", F.lit(0).cast("long")))


def drain(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Run over all that is there now, writing Parquet; a second call goes on where the first one ended."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
