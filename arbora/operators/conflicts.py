"""Conflict records: folder, id, path, local and incoming (structs of entries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clocks
from ..functions.entries import same_content
from ..storage import cut
from . import dominance
from .diff import KEY, packed


def conflict_id(path: Column, entry: Column) -> Column:
    """The hash of an incoming version in one canonical spelling, without its sequence number and stamp."""
    return F.sha2(F.concat_ws("\n", path, entry["kind"], entry["size"].cast("string"), entry["hash"], F.coalesce(entry["target"], F.lit("")), entry["mode"].cast("string"), clocks.text(entry["clock"])), 256)


def records(outcomes: DataFrame) -> DataFrame:
    """Conflict records of the conflicts among outcomes()."""
    return outcomes.filter("outcome = 'conflict'").select("folder", conflict_id(F.col("path"), F.col("remote")).alias("id"), "path", "local", F.col("remote").alias("incoming"))


def save(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both, where a record that exists stays as it is."""
    return existing.unionByName(new.join(existing.select("folder", "id"), ["folder", "id"], "left_anti").dropDuplicates(["folder", "id"]))


def listed(conflicts: DataFrame) -> DataFrame:
    return conflicts.orderBy("folder", "path", "id")


def at_paths(conflicts: DataFrame, paths: DataFrame) -> DataFrame:
    """The records of some paths (folder, path)."""
    return conflicts.join(paths.select(*KEY).distinct(), KEY, "left_semi")


def by_id(conflicts: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of some ids (folder, id)."""
    return conflicts.join(ids.select("folder", "id").distinct(), ["folder", "id"], "left_semi")


def counts(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("folder").agg(F.count("*").alias("conflicts"))


def page(conflicts: DataFrame, query: str = "", folder: str | None = None, offset: int = 0, size: int = 50) -> DataFrame:
    """A page of search results (paths and folders in any case, ids as spelled), each with whether more follow."""
    q = F.lit(query)
    hit = F.contains(F.lower("path"), F.lower(q)) | F.contains(F.lower("folder"), F.lower(q)) | F.contains(F.col("id"), q)
    found = conflicts.filter(hit if folder is None else hit & (F.col("folder") == folder))
    rows = found.orderBy("folder", "path", "id").offset(offset).limit(size + 1)
    numbered = rows.withColumn("n", F.row_number().over(Window.orderBy("folder", "path", "id")))
    return numbered.withColumn("more", F.count("*").over(Window.partitionBy()) > size).filter(F.col("n") <= size).drop("n")


def clear_resolved(conflicts: DataFrame, applied: DataFrame) -> DataFrame:
    """Records that the applied versions (folder, path, clock) don't settle yet: both sides' clocks must be included."""
    clock = applied.select(*KEY, F.col("clock").alias("now"))
    both = conflicts.join(clock, KEY, "left")
    settled = clocks.includes(F.col("local.clock"), F.col("now")) & clocks.includes(F.col("incoming.clock"), F.col("now"))
    return both.filter(~F.coalesce(settled, F.lit(False))).drop("now")


def keep_local(conflicts: DataFrame, entries: DataFrame, device: str) -> DataFrame:
    """For each record the entry that keeping the local version makes: its clock knows the incoming one and one event more."""
    both = conflicts.join(packed(entries, "now"), KEY)
    return both.select("folder", "id", "path", "now", clocks.bump(clocks.merge(F.col("now.clock"), F.col("incoming.clock")), device).alias("clock"))


def take_incoming(conflicts: DataFrame, entries: DataFrame, device: str, receive_only: bool = False) -> DataFrame:
    """For each record: whether taking it is refused (a strictly newer one for the path is pending), the resulting clock, and
    the ids of the records that it clears.

    A path's distinct clocks are compared (dominance), not its records with each other."""
    both = conflicts.join(packed(entries, "now"), KEY, "left")
    empty = F.create_map().cast("map<string,bigint>")
    base = F.coalesce("now.clock", empty)
    base = clocks.drop_device(base, device) if receive_only else base
    clock = clocks.merge(base, F.col("incoming.clock"))
    clock = clock if receive_only else clocks.bump(clock, device)
    settled = F.coalesce(clocks.includes(F.col("local.clock"), F.col("now.clock")), F.lit(False))
    mine = cut(both.select("folder", "id", "path", dominance.steps(F.col("incoming.clock")).alias("steps"), settled.alias("settled"), clock.alias("clock")), "incoming")
    mine = mine.withColumn("upper", dominance.steps(F.col("clock")))
    pending = mine.filter("steps is not null")
    refused = dominance.dominated(pending.select(*KEY, "steps").distinct(), KEY).withColumn("refused", F.lit(True))
    points = pending.filter("settled").groupBy(*KEY, "steps").agg(F.collect_set("id").alias("ids"))
    pairs = dominance.known(points.select(*KEY, "steps"), mine.select(*KEY, F.col("upper").alias("steps")).distinct(), KEY)
    cleared = pairs.join(points.withColumnRenamed("steps", "lower"), [*KEY, "lower"]).groupBy(*KEY, "upper").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    told = mine.join(refused, [*KEY, "steps"], "left").join(cleared, [*KEY, "upper"], "left")
    own = F.array("id")
    return told.select("folder", "id", "path", F.coalesce("refused", F.lit(False)).alias("refused"), F.array_sort(F.coalesce(F.array_union("ids", own), own)).alias("clears"), "clock")


def reviewed(current: Column, seen: Column) -> Column:
    """Whether what was reviewed is still what is there."""
    same = same_content(current, seen) & (current["size"] == seen["size"]) & (clocks.text(current["clock"]) == clocks.text(seen["clock"])) & (current["stamp"] == seen["stamp"])
    return (current.isNull() & seen.isNull()) | F.coalesce(same, F.lit(False))


def preview(kind: Column, size: Column, hash_: Column, body: Column) -> Column:
    """The text to show of a version (body: binary), or why there is none."""
    text = F.try_validate_utf8(body)
    said = lambda why: F.lit("Preview unavailable: " + why)
    # The sentences and sizes are fixed values.
    return (
        F.when(kind != "File", F.concat(F.lit("("), F.lower(kind), F.lit(")")))
        .when(size > 64 * 1024, said("preview omitted: file exceeds 64 KiB; compare it externally"))
        .when((F.octet_length(body) != size) | (F.sha2(body, 256) != hash_), said("preview differs from indexed version; refresh after a scan"))
        .when(text.isNull() | F.contains(text, F.lit("\x00")), said("binary content; compare externally"))
        .when(text == "", "(empty file)")
        .otherwise(text)
    )


def review_refused(size: Column, stamp: Column, indexed_stamp: Column) -> Column:
    """A changed file over 16 MiB isn't hashed for a review."""
    return (size > 16 * 1024 * 1024) & ~stamp.eqNullSafe(indexed_stamp)
