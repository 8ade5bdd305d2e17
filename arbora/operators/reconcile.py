"""Reconciliation of two indexes: what to apply, what to transfer, and pairing plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clocks, paths
from ..functions.entries import same_bytes, same_content
from ..storage import cut
from .diff import KEY, packed, tombstone
from .ranges import running


def _both(local: DataFrame, remote: DataFrame, how: str) -> DataFrame:
    return packed(remote, "remote").join(packed(local, "local"), KEY, how)


def _out(excluded: Column | None) -> Column:
    return F.lit(False) if excluded is None else F.coalesce(excluded, F.lit(False))


def outcomes(local: DataFrame, remote: DataFrame, excluded: Column | None = None) -> DataFrame:
    """What applying each remote version does: skip, place or conflict, with the clock to record when placed."""
    both = _both(local, remote, "left")
    a, b = F.col("local"), F.col("remote")
    rel, same = clocks.relation(a["clock"], b["clock"]), same_content(a, b)
    outcome = (
        F.when(_out(excluded), "skip").when(a.isNull(), "place").when(rel == "After", "skip").when((rel == "Equal") & same, "skip")
        .when(rel == "Equal", "conflict").when((rel == "Concurrent") & ~same, "conflict").otherwise("place")
    )
    out = both.withColumns({"relation": F.coalesce(rel, F.lit("Absent")), "outcome": outcome})
    return out.withColumn("clock", F.when(F.col("outcome") == "place", clocks.merge(a["clock"], b["clock"])).otherwise(a["clock"]))


def wanted(local: DataFrame, remote: DataFrame, live: DataFrame | None = None, excluded: Column | None = None) -> DataFrame:
    """Remote files whose content must be fetched: newer or unknown here, and not what is on disk (live; default: the index)."""
    both = _both(local, remote, "left").join(packed(local if live is None else live, "live"), KEY, "left")
    a, b = F.col("local"), F.col("remote")
    rel = clocks.relation(a["clock"], b["clock"])
    known = F.coalesce((rel == "After") | ((rel == "Equal") & same_content(a, b)), F.lit(False))
    there = F.coalesce((F.col("live")["kind"] != "Deleted") & same_bytes(F.col("live"), b), F.lit(False))
    return both.filter((b["kind"] == "File") & ~_out(excluded) & ~known & ~there).select(*KEY, "remote.*")


def publication_rank(kind: Column, path: Column) -> list[Column]:
    """Order of publication: live entries shortest path first, then deletions longest first."""
    gone = F.coalesce(kind == "Deleted", F.lit(True))
    return [gone, F.when(gone, -F.length(path)).otherwise(F.length(path)), path]


def publication_order(entries: DataFrame) -> DataFrame:
    """entries with their `position` in the order of publication of their folder, counted by ranges of it."""
    return running(entries, ["folder"], publication_rank(F.col("kind"), F.col("path")), name="position")


def pairing_plan(local: DataFrame, remote: DataFrame, mode: str = "merge", excluded: Column | None = None, key: Column | None = None) -> DataFrame:
    """The plan of an offline pairing, seen from the side whose snapshot is `local`: one row for each path with its action.

    mode merge: history (same content), conflict, send, receive; mode seed-local: history, delete, replace.  Remote rows that
    are excluded have action ignored; local live paths that the other side doesn't know (by key) are send-new."""
    both = _both(local, remote, "left")
    a, b = F.col("local"), F.col("remote")
    rel, same = clocks.relation(a["clock"], b["clock"]), F.coalesce(same_content(a, b), F.lit(False))
    skip = _out(excluded)
    if mode == "merge":
        action = F.when(skip, "ignored").when(a.isNull() & (b["kind"] == "Deleted"), None).when(same, "history").when(rel.isin("Concurrent", "Equal"), "conflict").when(rel == "After", "send").otherwise("receive")
    else:
        action = F.when(skip, "ignored").when(same, "history").when(a.isNull() | (a["kind"] == "Deleted"), "delete").otherwise("replace")
    met = both.withColumn("action", action).filter("action is not null")
    fold = paths.path_key("path") if key is None else key
    mine = packed(local.filter("kind <> 'Deleted'"), "local").withColumn("k", fold)
    theirs = remote.select("folder", fold.alias("k")).distinct()
    new = mine.join(theirs, ["folder", "k"], "left_anti").filter(~skip)
    return met.select(*KEY, "action", "local", "remote").unionByName(new.select(*KEY, F.lit("send-new").alias("action"), "local", F.lit(None).cast(met.schema["remote"].dataType).alias("remote")))


def plan_summary(plan: DataFrame) -> DataFrame:
    """Paths and bytes (the other side's, or the local ones of send-new) by folder and action."""
    return plan.groupBy("folder", "action").agg(F.count("*").alias("paths"), F.coalesce(F.sum(F.coalesce("remote.size", "local.size")), F.lit(0)).alias("bytes"))


def kind_clashes(plan: DataFrame) -> DataFrame:
    """Replacements of a file by a directory or the reverse, which seeding refuses."""
    live = lambda c: F.coalesce(F.col(c) != "Deleted", F.lit(False))
    differ = (F.col("local.kind") == "Directory") != (F.col("remote.kind") == "Directory")
    return plan.filter(live("local.kind") & live("remote.kind") & differ)


def seed_result(plan: DataFrame, device: str) -> DataFrame:
    """What a seeded path becomes: the local version or a tombstone, after both sides' clocks and one event more."""
    rows = plan.filter("action in ('history', 'delete', 'replace')")
    base = F.when(F.col("local").isNotNull(), F.struct(*[F.col(f"local.{c}").alias(c) for c in ("kind", "size", "hash", "target", "mode", "stamp")])).otherwise(tombstone(F.col("remote")))
    clock = clocks.bump(clocks.merge(F.col("local.clock"), F.col("remote.clock")), device)
    return rows.select(*KEY, "action", base.alias("base"), clock.alias("clock")).select(*KEY, "action", "base.*", "clock")


def stale(plan: DataFrame, local: DataFrame) -> DataFrame:
    """Planned paths whose index entry is no longer the one that was planned with."""
    now = plan.select(*KEY, F.col("local").alias("planned")).join(packed(local, "now"), KEY, "left")
    a, b = F.col("planned"), F.col("now")
    same = (a.isNull() & b.isNull()) | F.coalesce(same_content(a, b) & (clocks.text(a["clock"]) == clocks.text(b["clock"])) & (a["size"] == b["size"]) & (a["stamp"] == b["stamp"]), F.lit(False))
    return now.filter(~same)


#: Fixed value: the format of plans.
FORMAT = 1


def header(plan: DataFrame, device: str, folder: str, counter: int) -> DataFrame:
    """The one row that describes a plan: format, device, folder, counter (the folder's sequence number when it was made), items."""
    items = plan.filter(F.col("folder") == folder).agg(F.count("*").alias("items"))
    return items.select(F.lit(FORMAT).alias("format"), F.lit(device).alias("device"), F.lit(folder).alias("folder"), F.lit(counter).cast("long").alias("counter"), "items")


def header_faults(headers: DataFrame, heads: DataFrame) -> DataFrame:
    """What is wrong with plans' headers: several for a folder, another format, or a folder that has moved on since."""
    many = headers.groupBy("folder").agg(F.count("*").alias("n"), F.min("format").alias("low"), F.max("format").alias("high"), F.max("counter").alias("counter"))
    told = many.join(heads, "folder", "left")
    faults = F.array_compact(F.array(
        F.when(F.col("n") != 1, F.lit("several headers")),
        F.when((F.col("low") != FORMAT) | (F.col("high") != FORMAT), F.lit("another format")),
        F.when(F.coalesce("head", F.lit(0)) != F.col("counter"), F.lit("stale")),
    ))
    return told.select("folder", faults.alias("faults")).filter(F.size("faults") > 0)


def audit(plan: DataFrame, key: Column | None = None) -> DataFrame:
    """A plan as it is kept for the record: path, path_key, both sides and the stamp as JSON, and the action, by folder and path."""
    fold = paths.path_key("path") if key is None else key
    told = plan.select(*KEY, fold.alias("path_key"), F.to_json("remote").alias("remote"), F.to_json("local").alias("local"), F.col("local.stamp").alias("stamp"), "action")
    return told.repartitionByRange(*KEY).sortWithinPartitions(*KEY)


def page(plan: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of a plan in order of folder and path; 1 to 1000 rows."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be from 1 to 1000, offset not negative")
    return plan.orderBy(*KEY).offset(offset).limit(limit)


def changed_since(expected: DataFrame, live: DataFrame) -> DataFrame:
    """Destinations whose stamp isn't the expected one any more."""
    return expected.select(*KEY, F.col("stamp").alias("expected")).join(live.select(*KEY, F.col("stamp").alias("found")), KEY, "left").filter(~F.col("expected").eqNullSafe(F.col("found")))


def required_parents(entries: DataFrame, bulk: Column, directory: Column | None = None) -> DataFrame:
    """For each entry that travels in bulk: the highest sequence number among its ancestors, which must have been applied, and
    how many ancestors are missing or no directories (directory: what those are, by default by `kind`).

    The entries are both sides of a join, and are written first so that what they come from runs once."""
    directory = F.col("kind") == "Directory" if directory is None else directory
    entries = cut(entries.select(*KEY, "seq", bulk.alias("__bulk"), directory.alias("__directory")), "parents")
    # A number first, so that the join sorts by numbers.
    number = F.xxhash64("folder", "parent").alias("__number")
    up = entries.filter("__bulk").select(*KEY, F.explode_outer(paths.ancestors(F.col("path"))).alias("parent")).select("*", number)
    known = entries.select("folder", F.col("path").alias("parent"), F.col("seq").alias("parent_seq"), "__directory").select("*", number)
    met = up.join(known, ["__number", "folder", "parent"], "left")
    bad = F.col("parent").isNotNull() & ~F.coalesce("__directory", F.lit(False))
    return met.groupBy(*KEY).agg(F.coalesce(F.max("parent_seq"), F.lit(0)).alias("required_seq"), F.count(F.when(bad, 1)).alias("violations"))


def can_send(mode: Column) -> Column:
    return mode != "receive-only"


def can_receive(mode: Column) -> Column:
    return mode != "send-only"


def directions(pairs: DataFrame) -> DataFrame:
    """pairs (local_mode, remote_mode, ...) with sends, receives and mismatch."""
    sends = can_send(F.col("local_mode")) & can_receive(F.col("remote_mode"))
    receives = can_receive(F.col("local_mode")) & can_send(F.col("remote_mode"))
    return pairs.withColumns({"sends": sends, "receives": receives, "mismatch": ~sends & ~receives})


def common_folders(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Folders of both sides that are approved, ready and not paused here."""
    mine = local.filter("approved and ready and not paused").select("folder", F.col("mode").alias("local_mode"))
    return directions(mine.join(remote.select("folder", F.col("mode").alias("remote_mode")), "folder"))
