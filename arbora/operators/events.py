"""Watcher events: classes, batches, coalescing, and the schedules around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from . import automata, subtrees

#: A batch's times and size, and the quantum of watch limits.
GAP_US, MAX_US = 100_000, 1_000_000
MAX_PATHS = 4096
QUANTUM = 65_536


def scope(kind: Column) -> Column:
    """Entry (one path), Tree (all below), or null for what doesn't matter."""
    return F.when(kind == "Access(Close(Write))", "Entry").when(kind.startswith("Access"), None).when(kind.rlike(r"^Modify\((Data|Metadata)"), "Entry").otherwise("Tree")


def control(path: Column, error: Column, rescan: Column, outside: Column, patterns: Sequence[str] = (), marker: Column | None = None) -> Column:
    """What an event means for the whole folder: restart, rescan, reload, drop, or null (a normal event)."""
    changed = path.endswith("ignore") & F.lower(F.element_at(F.split(path, "/"), -1)).isin(*paths.RESERVED)
    if marker is not None:
        changed = changed | marker
    return F.when(error, "restart").when(rescan, "rescan").when(outside, "drop").when(changed, "reload").when(paths.excluded(path, patterns), "drop")


def batches(events: DataFrame, by: str, at_us: str = "us", gap: int = GAP_US, most: int = MAX_US, order: str = "event_id") -> DataFrame:
    """events with batch (number) and batch_start: a batch closes `gap` after its last or `most` after its first event,
    whichever comes first; an event just at that time still belongs to it.

    The only thing to remember is when the last batch began; a gap forgets it."""
    told = automata.renewed(events.withColumn("__us", F.col(at_us).cast("long")), [by], ["__us", order], "__us", most + 1, gap=gap)
    return told.select(*events.columns, F.col("began").alias("batch_start"), F.col("turn").alias("batch"))


def coalesced(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """What a batch (by) leaves to scan: one row for each path with its scope, Tree before Entry, nothing below a Tree.

    One sweep over the paths of each batch finds what a Tree is above of."""
    one = events.filter(F.col("scope").isNotNull()).groupBy(*by, "path").agg(F.max("scope").alias("scope"), F.count("*").alias("events"))
    marked = one.withColumn("__tree", F.when(F.col("scope") == "Tree", 0).cast("long"))
    return subtrees.above(marked, by, "path", "__tree").filter("above is null").drop("__tree", "above")


def overflowing(events: DataFrame, by: Sequence[str], most: int = MAX_PATHS) -> DataFrame:
    """Batches that held more paths at a time than a batch may; they become one full scan.  A path is held from its first event
    (by event_id) on, unless a Tree above it was there before, until a Tree above it comes.  Without an event_id all events
    come at once."""
    known = events.filter(F.col("scope").isNotNull())
    known = known if "event_id" in events.columns else known.withColumn("event_id", F.lit(0))
    tree = F.min(F.when(F.col("scope") == "Tree", F.col("event_id")))
    one = known.groupBy(*by, "path").agg(F.min("event_id").alias("first"), tree.cast("long").alias("tree"))
    held = subtrees.above(one, by, "path", "tree", name="gone").filter("gone is null or first < gone")
    # What a Tree absorbs goes before it comes itself.
    steps = held.select(*by, F.explode(F.array_compact(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("step")), F.when(F.col("gone").isNotNull(), F.struct(F.col("gone").alias("at"), F.lit(-1).alias("step")))))).alias("s")).select(*by, "s.*")
    each = steps.groupBy(*by, "at", "step").agg(F.sum("step").alias("change"))
    live = F.sum("change").over(Window.partitionBy(*by).orderBy("at", "step"))
    return each.withColumn("paths", live).groupBy(*by).agg(F.max("paths").alias("paths")).filter(F.col("paths") > most)


def counters(events: DataFrame, by: Sequence[str], most: int = MAX_PATHS) -> DataFrame:
    """Events, ignored, surviving paths, coalesced events and overflows (0 or 1) by batch; one that overflows keeps no paths."""
    seen = events.groupBy(*by).agg(F.count("*").alias("events"), F.count(F.when(F.col("scope").isNull(), 1)).alias("ignored"))
    left = coalesced(events, by).groupBy(*by).agg(F.count("*").alias("paths"))
    full = overflowing(events, by, most).select(*by, F.lit(1).cast("long").alias("overflows"))
    out = seen.join(left, list(by), "left").join(full, list(by), "left").withColumn("overflows", F.coalesce("overflows", F.lit(0)))
    out = out.withColumn("paths", F.when(F.col("overflows") > 0, 0).otherwise(F.coalesce("paths", F.lit(0))))
    return out.withColumn("coalesced", F.col("events") - F.col("ignored") - F.col("paths"))


def directed(events: DataFrame, by: str, at_us: str = "us", gap: int = GAP_US, most: int = MAX_US, order: str = "event_id", paths_most: int = MAX_PATHS) -> DataFrame:
    """What each batch of events (with `scope` and `control`) asks for: by, batch, batch_start, path, scope, events.

    Dropped events open no batch and keep none open.  A batch with a restart, rescan or reload is one full scan (scope Full, an
    empty path, as many events as there were such ones), and a row for each kind of them (scope Restart, Rescan, Reload); one that
    overflows is a full scan with its events; any other leaves its coalesced paths."""
    told = batches(events.filter(~F.col("control").eqNullSafe(F.lit("drop"))), by, at_us, gap, most, order)
    key = [by, "batch", "batch_start"]
    row = lambda t, scope_, n: t.select(*key, F.lit("").alias("path"), scope_.alias("scope"), n.cast("long").alias("events"))
    kinds = told.filter("control is not null").groupBy(*key, "control").agg(F.count("*").alias("n"))
    called = kinds.groupBy(*key).agg(F.sum("n").alias("n"))
    plain = told.filter("control is null").join(called.select(*key), key, "left_anti")
    full = overflowing(plain.withColumnRenamed(order, "event_id"), key, paths_most).select(*key)
    over = plain.filter("scope is not null").join(full, key, "left_semi").groupBy(*key).agg(F.count("*").alias("n"))
    left = coalesced(plain.join(full, key, "left_anti"), key).select(*key, "path", "scope", "events")
    return left.unionByName(row(kinds, F.initcap("control"), F.col("n"))).unionByName(row(called, F.lit("Full"), F.col("n"))).unionByName(row(over, F.lit("Full"), F.col("n")))


def routes(pending: DataFrame, entries: DataFrame) -> DataFrame:
    """Where each coalesced path is scanned: as a tree, or as an entry; an entry that isn't there any more becomes a tree."""
    known = entries.filter("kind <> 'Deleted'").select("path", F.lit(True).alias("known")).distinct()
    return pending.join(known, "path", "left").withColumn("route", F.when((F.col("scope") == "Tree") | F.col("known").isNull(), "tree").otherwise("entry")).drop("known")


def retried(pending: DataFrame, most: int = 3) -> DataFrame:
    """pending (path, scope, attempt) merged by path (Tree wins), with the delay of the next attempt, while there is one."""
    merged = pending.groupBy("path").agg(F.max("scope").alias("scope"), F.max("attempt").alias("attempt"))
    return merged.filter(F.col("attempt") < most).withColumn("delay_s", F.pow(F.lit(2.0), F.col("attempt")).cast("long"))


def watch_backoff(failures: Column, quota: Column, rescan_s: Column) -> Column:
    """Seconds to the next try: 30 doubling to 300; when a quota is the reason, at least the rescan interval (5 or more)."""
    wait = F.least(F.lit(300), 30 * F.pow(F.lit(2.0), failures)).cast("long")
    return F.when(quota, F.greatest(wait, rescan_s, F.lit(5))).otherwise(wait)


def open_gaps(gaps: DataFrame, generation: int) -> DataFrame:
    """Coverage gaps (path, generation) that still stand: of this generation or later, and not below another one."""
    return subtrees.outermost(gaps.filter(F.col("generation") >= generation).select("path").distinct(), [], "path")


def watch_demand(entries: DataFrame, folders: DataFrame, excluded: Column | None = None) -> DataFrame:
    """Watches that each folder (folder, paused) needs: its directories and two."""
    dirs = entries.filter("kind = 'Directory'")
    dirs = dirs if excluded is None else dirs.filter(~excluded)
    n = dirs.groupBy("folder").agg(F.count("*").alias("directories"))
    return folders.join(n, "folder", "left").withColumn("directories", F.coalesce("directories", F.lit(0))).withColumn("watches", F.col("directories") + 2)


def suggested_limit(needed: Column, current: Column) -> Column:
    """A limit with a quarter more (or one quantum), in whole quanta, and never below what there is."""
    want = needed + F.greatest(F.floor(needed / 4), F.lit(QUANTUM))
    return F.greatest(F.ceil(want / QUANTUM) * QUANTUM, current)


def thermal(readings: DataFrame, by: str, limit: float, at: str = "at", value: str = "celsius") -> DataFrame:
    """readings with `hot`: on from the limit up, off from five below it down, in between as it was; a reading that isn't valid
    counts as hot."""
    v = F.col(value)
    valid = F.coalesce(~F.isnan(v) & (v >= 0) & (v <= 150), F.lit(False))
    said = F.when(~valid, F.lit(True)).when(v >= limit, F.lit(True)).when(v <= limit - 5, F.lit(False))
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return readings.withColumn("said", said).withColumn("hot", F.coalesce(F.last("said", True).over(w), F.lit(False))).drop("said")


def hottest(readings: DataFrame, drivers: Sequence[str]) -> DataFrame:
    v = F.col("celsius")
    return readings.filter(F.col("driver").isin(*drivers) & ~F.isnan(v) & (v >= 0) & (v <= 150)).groupBy("at").agg(F.max("celsius").alias("celsius"))
