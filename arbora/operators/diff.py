"""Snapshot diff: from an index and a scan to new versions, deletions and sequence numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clocks, paths
from ..functions.entries import ENTRY, same_content
from .ranges import running
from .subtrees import above

KEY = ["folder", "path"]
OBSERVED = ("kind", "size", "hash", "target", "mode", "stamp")


def packed(df: DataFrame, name: str, fields: Sequence[str] = ENTRY) -> DataFrame:
    """folder, path and one struct of the other columns."""
    return df.select(*KEY, F.struct(*[c for c in fields if c in df.columns]).alias(name))


def unchanged(old: Column, seen: Column) -> Column:
    """Whether content needn't be hashed again."""
    return (old["kind"] != "Deleted") & (old["stamp"] == seen["stamp"]) & (old["mode"] == seen["mode"])


def needs_hash(entries: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The rows of a scan whose content must be read: all but the unchanged ones."""
    both = packed(snapshot, "seen", OBSERVED).join(packed(entries, "old"), KEY, "left")
    return both.filter(~F.coalesce(unchanged(F.col("old"), F.col("seen")), F.lit(False))).select(*KEY, "seen.*")


def tombstone(old: Column) -> Column:
    """What a missing path looks like: no content, the mode and clock as they were."""
    return F.struct(F.lit("Deleted").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit("").alias("hash"), F.lit(None).cast("string").alias("target"), old["mode"].alias("mode"), F.lit("").alias("stamp"))


def adopts(received: Column, fresh: Column) -> Column:
    """Whether an observation is the version that was being delivered."""
    return F.when(received["kind"] == "Deleted", fresh["kind"] == "Deleted").otherwise(same_content(received, fresh))


def predicted(entries: DataFrame, snapshot: DataFrame, device: str, of: DataFrame) -> DataFrame:
    """The clocks that paths (of: folder, path) would get if what is seen now were recorded; nothing is."""
    these = of.select(*KEY).distinct()
    near = lambda df: df.join(these, KEY, "left_semi")
    return decide(near(entries), near(snapshot), device).select(*KEY, "action", "clock")


def decide(entries: DataFrame, snapshot: DataFrame, device: str, receiving: DataFrame | None = None, errors: int = 0, keep: Column | None = None) -> DataFrame:
    """One row for each path of either side: folder, path, action, old (index), fresh (observation) and the clock to record.

    action: none, restamp (only the stamp is new), adopt (a delivered version), change, delete.  With scan errors nothing is
    deleted; paths for which `keep` holds (excluded ones) never are."""
    both = packed(entries, "old").join(packed(snapshot, "seen", OBSERVED), KEY, "full_outer")
    if receiving is None:
        both = both.withColumn("got", F.lit(None).cast(both.schema["old"].dataType))
    else:
        both = both.join(packed(receiving, "got"), KEY, "left")
    old, got = F.col("old"), F.col("got")
    both = both.withColumn("fresh", F.when(F.col("seen").isNotNull(), F.struct(*[F.col(f"seen.{c}").alias(c) for c in ("kind", "size", "hash", "target", "mode", "stamp")])).otherwise(tombstone(old)))
    fresh, missing = F.col("fresh"), F.col("seen").isNull()
    stays = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)
    fits = F.coalesce(adopts(got, fresh), F.lit(False)) & (old.isNull() | (clocks.relation(old["clock"], got["clock"]) == "Before"))
    action = (
        F.when(missing & (old.isNull() | (old["kind"] == "Deleted")), "none")
        .when(missing & (F.lit(errors > 0) | stays), "none")
        .when(F.coalesce(same_content(old, fresh), F.lit(False)), "restamp")
        .when(got.isNotNull() & fits, "adopt")
        .when(missing, "delete")
        .otherwise("change")
    )
    clock = F.when(F.col("action") == "adopt", clocks.merge(old["clock"], got["clock"])).when(F.col("action").isin("change", "delete"), clocks.bump(F.coalesce(old["clock"], F.create_map().cast("map<string,bigint>")), device)).otherwise(old["clock"])
    return both.withColumn("action", action).withColumn("clock", clock).select(*KEY, "action", "old", "fresh", "clock")


def numbered(changes: DataFrame, heads: DataFrame) -> DataFrame:
    """changes (folder, path, kind, ...) with seq after each folder's head: parents before children, deletions deepest first."""
    gone = F.col("kind") == "Deleted"
    ranked = running(changes, ["folder"], [gone, F.when(gone, -F.length("path")).otherwise(F.length("path")), F.col("path")])
    return ranked.join(heads, "folder", "left").withColumn("seq", F.coalesce("head", F.lit(0)) + F.col("n")).drop("head", "n")


def applied(entries: DataFrame, decided: DataFrame, heads: DataFrame) -> DataFrame:
    """The new versions that decide() calls for, with sequence numbers."""
    new = decided.filter("action in ('change', 'delete', 'adopt')").select(*KEY, "fresh.*", "clock")
    return numbered(new, heads)


def latest(*versions: DataFrame) -> DataFrame:
    """Of all versions of a path the one with the highest sequence number (an upsert)."""
    union = versions[0]
    for v in versions[1:]:
        union = union.unionByName(v, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in KEY]
    if all(isinstance(union.schema[c].dataType, (T.NumericType, T.BooleanType)) and not isinstance(union.schema[c].dataType, T.DecimalType) for c in rest):
        # Such values are updated in place, so they are hashed and never sorted.
        return union.groupBy(*KEY).agg(*[(F.max(c) if c == "seq" else F.max_by(c, "seq")).alias(c) for c in rest])
    return union.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("v")).select(*KEY, "v.*")


def unseen(entries: DataFrame, snapshot: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Live entries that a scan didn't meet; with scopes (folder, scope) only those at or below one of them.

    Entries and scopes are swept together in the order of the tree, so that no pair is compared and no path repeated."""
    live = entries.filter("kind <> 'Deleted'").join(snapshot.select(*KEY), KEY, "left_anti")
    if scopes is None:
        return live
    roots = scopes.select("folder", F.col("scope").alias("path"), F.lit(0).cast("long").alias("__scope")).distinct()
    both = live.unionByName(roots, allowMissingColumns=True)
    return above(both, ["folder"], "path", "__scope", proper=False).filter("__scope is null and above is not null").select(*live.columns)


def totals(entries: DataFrame) -> DataFrame:
    """Live files and their bytes by folder."""
    file = F.col("kind") == "File"
    return entries.groupBy("folder").agg(F.count(F.when(file, 1)).alias("files"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("bytes"))


def collisions(entries: DataFrame, key: Column | None = None) -> DataFrame:
    """Keys under which several paths of a folder collide."""
    keyed = entries.withColumn("path_key", paths.path_key("path") if key is None else key)
    found = keyed.groupBy("folder", "path_key").agg(F.countDistinct("path").alias("paths"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
    return found.filter("paths > 1")


def aliases(incoming: DataFrame, entries: DataFrame) -> DataFrame:
    """incoming (folder, path) with the local spelling of its longest prefix that is known under another spelling, whether that
    differs in case and not only in Unicode form (an error), and whether another incoming path has the same one (one too)."""
    known = entries.select("folder", F.col("path").alias("local"), paths.path_key("path").alias("k"))
    asked = incoming.select(*KEY, F.explode(paths.prefixes(F.col("path"))).alias("prefix")).withColumn("k", paths.path_key("prefix"))
    hits = asked.join(known, ["folder", "k"]).filter("prefix <> local")
    best = hits.groupBy(*KEY).agg(F.max_by(F.struct("prefix", "local"), F.struct(F.length("prefix"), "local")).alias("b"))
    out = incoming.select(*KEY).join(best, KEY, "left")
    resolved = F.when(F.col("b").isNotNull(), F.concat("b.local", F.expr("substring(path, length(b.prefix) + 1)"))).otherwise(F.col("path"))
    told = out.select(*KEY, resolved.alias("local_path"), F.coalesce(F.lower("b.prefix") == F.lower("b.local"), F.lit(False)).alias("case_only"))
    several = told.distinct().groupBy("folder", "local_path").agg(F.count("*").alias("k"))
    return told.join(several, ["folder", "local_path"]).withColumn("duplicate", F.col("k") > 1).select(*KEY, "local_path", "case_only", "duplicate")


def scan_errors(errors: DataFrame, most: int = 32) -> DataFrame:
    """The first errors of each scan, by order; the scan's total besides."""
    rank = F.row_number().over(Window.partitionBy("scan").orderBy("at", "message"))
    kept = errors.withColumn("rank", rank).filter(F.col("rank") <= most)
    return kept.join(errors.groupBy("scan").agg(F.count("*").alias("total")), "scan")
