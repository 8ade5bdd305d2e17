"""What a retention policy may remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clocks
from . import eviction
from .ranges import running

DAY = 86400
MAX_ARTIFACTS = 100_000


def expired(saved: Column, days: int | None, at: int) -> Column:
    """Old enough; what is dated in the future never is."""
    return F.lit(False) if days is None else (saved <= at) & (at - saved >= days * DAY)


def versions(archives: DataFrame, at: int, days: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Archived versions (folder, id, saved_at, bytes) to remove, with the reason: by age, else oldest first until what is left
    fits the space.  What goes is always a prefix in order of age, so a running sum finds it."""
    old = expired(F.col("saved_at"), days, at)
    if max_bytes is None:
        marked = archives.withColumns({"old": old, "over": F.lit(False)})
    else:
        total = archives.groupBy(F.col("folder").alias("__f")).agg(F.sum("bytes").alias("__total"))
        summed = running(archives, ["folder"], [F.col("saved_at"), F.col("id")], {"__before": "bytes"}).join(total, F.col("folder").eqNullSafe(F.col("__f")))
        marked = summed.withColumns({"old": old, "over": F.col("__total") - F.col("__before") > max_bytes}).drop("n", "__before", "__total", "__f")
    return marked.filter("old or over").withColumn("reason", F.when(F.col("old"), "version age").otherwise("version space limit")).drop("old", "over")


def lru(rows: DataFrame, limit: int, most: int = 1024, by: str = "cache") -> DataFrame:
    """What stays of a cache (used, id, bytes): the newest rows while their sum and number fit.

    Only the newest `most` of each cache, which partitions find for themselves, are summed."""
    w = Window.partitionBy(by).orderBy(F.desc("used"), F.desc("id"))
    few = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return few.withColumn("sum", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("sum") <= limit).drop("sum", "n")


def newest(rows: DataFrame, most: int = 1024, by: str = "cache") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("used"), F.desc("id")))
    return rows.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def scan_cache(puts: DataFrame, budget: int, items: int = 16_384, item_bytes: int = 8 << 20, by: str = "cache") -> DataFrame:
    """What a cache that evicts in order of insertion holds after puts (position, key, bytes): empty items and those over the
    size never enter; a key put again moves to its new place; the newest stay while they fit.  Reading doesn't refresh.

    Exact for any sizes: an item that has once gone stays out, though later puts may be smaller."""
    fits = puts.filter((F.col("bytes") > 0) & (F.col("bytes") <= item_bytes) & (F.col("bytes") <= budget))
    return eviction.kept(fits, by, "position", budget, items)


def partials(files: DataFrame, at: int, days: int | None) -> DataFrame:
    """Abandoned transfers: files (folder, name, modified, bytes) with a transfer's name that are old enough."""
    named = F.col("name").rlike(r"^(resume-[0-9a-f]{64}\.part|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$")
    return files.filter(named & expired(F.col("modified"), days, at)).withColumn("reason", F.lit("abandoned transfer"))


def resolved(archived: DataFrame, pending: DataFrame, entries: DataFrame, at: int, days: int | None, device: str | None = None) -> DataFrame:
    """Archived conflicts (folder, id, path, local, incoming, modified, bytes) that are settled and old: no pending record, and
    the index knows both sides.  device: of a receive-only folder, whose own counter doesn't count."""
    now = entries.select("folder", "path", F.col("clock").alias("now"))
    local = F.col("local.clock") if device is None else clocks.drop_device(F.col("local.clock"), device)
    left = archived.join(pending.select("folder", "id"), ["folder", "id"], "left_anti").filter(expired(F.col("modified"), days, at))
    return left.join(now, ["folder", "path"]).filter(clocks.includes(local, F.col("now")) & clocks.includes(F.col("incoming.clock"), F.col("now"))).drop("now").withColumn("reason", F.lit("resolved conflict age"))


def reclaimable(bytes_: Column, links: Column) -> Column:
    """A file with other hard links frees nothing."""
    return F.when(links > 1, 0).otherwise(bytes_)


def report(candidates: DataFrame, removed: DataFrame | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """One row: candidates, eligible_bytes, removed, skipped, protected_conflicts (unresolved ones)."""
    pending = (candidates.limit(0) if conflicts is None else conflicts).agg(F.count("*").alias("protected_conflicts"))
    found = candidates.agg(F.count("*").alias("candidates"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("eligible_bytes"))
    gone = (candidates.limit(0) if removed is None else removed).agg(F.count("*").alias("removed"))
    one = found.join(gone, F.lit(True)).join(pending, F.lit(True))  # one row each
    return one.select("candidates", "eligible_bytes", "removed", (F.col("candidates") - F.col("removed")).alias("skipped"), "protected_conflicts")


def unchanged_since(candidates: DataFrame, now: DataFrame) -> DataFrame:
    """Candidates that are still what they were in the preview (by stamp)."""
    return candidates.join(now.select("folder", "id", F.col("stamp").alias("found")), ["folder", "id"]).filter("stamp = found").drop("found")


def enabled(policy: dict[str, int | None]) -> list[str]:
    """The categories to scan: those with a limit."""
    limits = {"versions": ("versions_days", "versions_max_bytes"), "partials": ("partial_days",), "conflicts": ("resolved_conflicts_days",)}
    return [c for c, keys in limits.items() if any(policy.get(k) is not None for k in keys)]


def enabled_columns(policy: dict[str, Column]) -> Column:
    """enabled() for policies in rows."""
    has = lambda *keys: F.coalesce(*[policy[k] for k in keys]).isNotNull()
    named = [("versions", has("versions_days", "versions_max_bytes")), ("partials", has("partial_days")), ("conflicts", has("resolved_conflicts_days"))]
    return F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in named]))


def too_many(artifacts: DataFrame, most: int = MAX_ARTIFACTS) -> DataFrame:
    """Categories with more artifacts than a pass may handle."""
    return artifacts.groupBy("folder", "category").agg(F.count("*").alias("artifacts")).filter(F.col("artifacts") > most)
