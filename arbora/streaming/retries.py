"""Retries and back-offs as timers of a stream.

Outcomes of a folder's work come in, and what is due comes out when its time comes.  A row has key, event_id, at, and `what`:

scan     a pass over `paths` (an array of path and scope; `full`: over all of it) ended, `ok` or not.  A pass over paths that
         failed is tried again after 2, 4 and 8 s; it takes the place of a retry that is pending.  A pass that succeeds, full or
         not, ends the row of failures and the pending retry; a full one that failed waits for the next full one.
watch    watches were set up: `ok` (all of them: the back-off begins anew), or not, then again after events.watch_backoff, with
         `quota` and the folder's `rescan_s`.
restart  the watcher was lost: again after the present back-off, which doubles.
rescan   events were lost: again at once, while the back-off stays.

Rows come out as key, due, what (scan, watch), attempt, delay_s, path, scope: a scan's retry has a row for each of its paths (one
row without a path where it has none).

Times are event times and the watermark is the clock, so that the same outcomes give the same rows however they are cut into
triggers: outcomes of a trigger are taken in order of (at, event_id), and a timer that is due by then goes first.  A timer that no
later outcome of its folder changes fires when the watermark passes it.  State is two timers a folder and the paths of one retry."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "event_id long, key string, at timestamp, what string, ok boolean, full boolean, quota boolean, rescan_s long, paths array<struct<path string, scope string>>"
OUT = "key string, due timestamp, what string, attempt int, delay_s long, path string, scope string"
#: How often a pass is tried again; the first and the longest back-off, and the shortest rescan, in seconds.
RETRIES, FIRST_S, LONGEST_S, RESCAN_S = 3, 30, 300, 5
_SECOND = 1_000_000


class Timers(StatefulProcessor):
    """What a folder waits for.  `scan` and `watch` are open timers (due in microseconds, attempt, delay), `paths` those of the scan,
    and `rule` holds how many passes in a row failed, how often the back-off doubled, and the attempts at watching since it began."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rule = handle.getValueState("rule", "failed int, doubled int, tries int")
        self.open = {what: handle.getValueState(what, "due long, attempt int, delay long") for what in ("scan", "watch")}
        self.paths = handle.getMapState("paths", "path string", "scope string")

    def close(self) -> None:
        pass

    def _set(self, what: str, due: int, attempt: int, delay: int) -> None:
        self._cancel(what)
        self.open[what].update((due, attempt, delay))
        self.handle.registerTimer(-(-due // 1000))

    def _cancel(self, what: str) -> None:
        """Forget a timer; its alarm may still ring, and then finds nothing that is due."""
        if self.open[what].exists():
            self.open[what].clear()

    def _due(self, key: str, now: int) -> list[tuple]:
        """What is due by `now`, in order; it isn't open any more."""
        found = sorted((*self.open[w].get(), w) for w in self.open if self.open[w].exists())
        rows: list[tuple] = []
        for due, attempt, delay, what in found:
            if due > now:
                continue
            paths = [(p[0], s[0]) for p, s in self.paths.iterator()] if what == "scan" else []
            rows += [(key, due, what, attempt, delay, p, s) for p, s in sorted(paths) or [(None, None)]]
            self._cancel(what)
            if what == "scan":
                self.paths.clear()
        return rows

    def _take(self, at: int, row: Any) -> None:
        failed, doubled, tries = self.rule.get() if self.rule.exists() else (0, 0, 0)
        backoff = min(LONGEST_S, FIRST_S << min(doubled, 8))
        if row.what == "scan" and row.ok:
            failed = 0
            self._cancel("scan")
            self.paths.clear()
        elif row.what == "scan" and not row.full and failed < RETRIES:
            failed += 1
            self.paths.clear()
            for path, scope in self._merged(row.paths).items():
                self.paths.updateValue((path,), (scope,))
            self._set("scan", at + (1 << failed) * _SECOND, failed, 1 << failed)
        elif row.what == "watch" and row.ok:
            doubled = tries = 0
            self._cancel("watch")
        elif row.what in ("watch", "restart"):
            delay = max(backoff, int(row.rescan_s), RESCAN_S) if row.what == "watch" and row.quota else backoff
            doubled, tries = min(doubled + 1, 8), tries + 1
            self._set("watch", at + delay * _SECOND, tries, delay)
        elif row.what == "rescan":
            tries += 1
            self._set("watch", at, tries, 0)
        self.rule.update((failed, doubled, tries))

    @staticmethod
    def _merged(paths: Any) -> dict[str, str]:
        """The scope of each path; a Tree wins."""
        told: dict[str, str] = {}
        for p in paths if paths is not None else []:
            if p["path"] is not None:
                told[p["path"]] = max(told.get(p["path"], ""), p["scope"] or "Entry")
        return told

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        told = pd.concat(list(rows)).sort_values(["us", "event_id"])
        for row in told.itertuples(index=False):
            out += self._due(key[0], int(row.us))
            self._take(int(row.us), row)
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield _frame(self._due(key[0], expiredTimerInfo.getExpiryTimeInMs() * 1000))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "due", "what", "attempt", "delay_s", "path", "scope"])
    out["due"] = pd.to_datetime(out["due"].astype("int64"), unit="us", utc=True)
    return out.astype({"attempt": "int32", "delay_s": "int64"})


def timed(outcomes: DataFrame, late: str = "10 seconds") -> DataFrame:
    """outcomes (OUTCOME) -> what is due, and when.  Nulls: no key or time, no row; ok, full and quota count as false, rescan_s as 0.
    The session's state store must be RocksDB (as `enable` sets it)."""
    plain = {c: F.coalesce(c, F.lit(False)) for c in ("ok", "full", "quota")}
    told = outcomes.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).withColumns({**plain, "rescan_s": F.coalesce("rescan_s", F.lit(0).cast("long"))})
    told = told.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    return told.groupBy("key").transformWithStateInPandas(Timers(), OUT, "Append", "EventTime")


def enable(spark) -> None:
    """Choose the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
