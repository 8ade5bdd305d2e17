"""Change feeds by lane, cursors, and what peers still have to receive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .ranges import running

#: From which size a file travels in bulk, and the rows of a page.
BULK_BYTES = 1 << 20
PAGE = 128
#: Backlogs sum up stretches of 2 to the power of this many sequence numbers.
STRETCH = 14


def bulk(kind: Column, size: Column) -> Column:
    return (kind == "File") & (size >= BULK_BYTES)


def lane(path: Column, kind: Column, size: Column, lanes: int | Column) -> Column:
    """Lane 0 for all but large files; those are spread over the others by the hash of their path."""
    n = F.lit(lanes) if isinstance(lanes, int) else lanes
    spread = F.conv(F.substring(F.sha2(path, 256), 1, 15), 16, 10).cast("long")
    return F.when((n <= 1) | ~bulk(kind, size), 0).otherwise(1 + F.pmod(spread, F.greatest(n - 1, F.lit(1)))).cast("int")


def valid_lane(index: Column, count: Column) -> Column:
    return count.between(1, 8) & (index >= 0) & (index < count)


def change_feed(entries: DataFrame, folder: str, after: int, limit: int) -> DataFrame:
    return entries.filter((F.col("folder") == folder) & (F.col("seq") > after)).orderBy("seq").limit(limit)


def heads(entries: DataFrame) -> DataFrame:
    return entries.groupBy("folder").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))


def lane_page(entries: DataFrame, folder: str, after: int, lanes: int, index: int, size: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """One lane's next entries, and one row with `upto`, the cursor that they lead to.

    The page looks at `size` rows of the lane's class (small or bulk).  Lane 0 takes all of them; a bulk lane takes its first
    one.  If fewer rows than a page were left and nothing stopped it, the cursor goes to the folder's head."""
    if not (1 <= lanes <= 8 and 0 <= index < lanes):
        raise ValueError("no such lane")
    mine = entries.filter((F.col("folder") == folder) & (F.col("seq") > after))
    if lanes == 1:
        page = mine.orderBy("seq").limit(size)
        return page, page.agg(F.coalesce(F.max("seq"), F.lit(after)).alias("upto"))
    large = bulk(F.col("kind"), F.col("size"))
    looked = mine.filter(large if index else ~large).orderBy("seq").limit(size)
    hits = looked.filter(lane(F.col("path"), F.col("kind"), F.col("size"), lanes) == index)
    page = hits.orderBy("seq").limit(1) if index else hits
    seen = looked.agg(F.count("*").alias("seen"), F.max("seq").alias("last"))
    found = page.agg(F.max("seq").alias("hit"))
    head = entries.filter(F.col("folder") == folder).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    full = (F.col("seen") < size) & (F.lit(index == 0) | F.col("hit").isNull())
    stop = F.when(F.col("hit").isNotNull() & F.lit(index > 0), F.col("hit")).otherwise(F.col("last"))
    one = seen.join(found, F.lit(True)).join(head, F.lit(True))  # one row each
    return page, one.select(F.when(full, F.greatest("head", F.lit(after))).otherwise(F.coalesce(stop, F.lit(after))).alias("upto"))


def effective_cursors(cursors: DataFrame, lane_cursors: DataFrame, lanes: int) -> DataFrame:
    """peer, folder, lane, cursor: a lane's own cursor, or the folder's where it has none."""
    # Both kinds side by side: a folder's cursor counts as lane -1, and other numbers of lanes only make their peers known.
    mine = F.when(F.col("lanes") == lanes, F.col("lane"))
    told = cursors.select("peer", "folder", F.lit(-1).alias("lane"), "value").unionAll(lane_cursors.select("peer", "folder", mine.alias("lane"), "value"))
    here = F.col("peer").isNotNull() & F.col("folder").isNotNull()
    found = [F.max(F.when(here & (F.col("lane") == i), F.col("value"))).alias(f"__{i + 1}") for i in range(-1, lanes)]
    each = F.array(*[F.coalesce(f"__{i + 1}", "__0", F.lit(0)) for i in range(lanes)])
    return told.groupBy("peer", "folder").agg(*found).select("peer", "folder", F.posexplode(each).alias("lane", "cursor"))


def advanced(cursors: DataFrame, lane_cursors: DataFrame, updates: DataFrame, lanes: int) -> tuple[DataFrame, DataFrame]:
    """Cursors after updates (peer, folder, lane, value): lanes only move on, and a folder's cursor is the least of its lanes."""
    moved = lane_cursors.unionByName(updates.withColumn("lanes", F.lit(lanes)).select(lane_cursors.columns)).groupBy("peer", "folder", "lanes", "lane").agg(F.max("value").alias("value"))
    floor = effective_cursors(cursors, moved, lanes).join(updates.select("peer", "folder").distinct(), ["peer", "folder"], "left_semi").groupBy("peer", "folder").agg(F.min("cursor").alias("value"))
    return cursors.unionByName(floor).groupBy("peer", "folder").agg(F.max("value").alias("value")), moved


def backlog(entries: DataFrame, cursors: DataFrame, lane_cursors: DataFrame, lanes: int, excluded: Column | None = None) -> DataFrame:
    """peer, folder: entries, files and bytes that lie after the cursor of their lane.

    A lane is cut into stretches of STRETCH sequence numbers.  The entries of a stretch and the cursors in it (each place once,
    whoever stands there) are sorted together, and running sums tell what lies before each cursor in its stretch; sums of whole
    stretches tell the rest.  So entries are never repeated for peers, nor compared with cursors one by one, and are shuffled once."""
    at = cut(effective_cursors(cursors, lane_cursors, lanes).withColumn("cursor", F.col("cursor").cast("long")), "cursors")
    zero = F.lit(0).cast("long")
    file = (F.col("kind") == "File").cast("long")
    mine = entries if excluded is None else entries.filter(~excluded)
    rows = mine.select("folder", lane(F.col("path"), F.col("kind"), F.col("size"), lanes).alias("lane"), F.col("seq").cast("long").alias("seq"), F.lit(1).cast("long").alias("entries"), file.alias("files"), F.when(file == 1, F.col("size").cast("long")).otherwise(zero).alias("bytes"))
    counts = ("entries", "files", "bytes")
    stretch = F.shiftright("seq", STRETCH)
    rows = cut(rows.withColumn("__stretch", stretch), "lanes")
    places = at.select("folder", "lane", F.col("cursor").alias("seq"), *[F.lit(None).cast("long").alias(c) for c in counts]).distinct().withColumn("__stretch", stretch)
    key = ["__stretch", "folder", "lane"]
    # A cursor comes after the entry where it stands.
    upto = Window.partitionBy(*key).orderBy("seq", F.col("entries").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    passed = rows.unionByName(places).withColumns({f"__{c}": F.sum(c).over(upto) for c in counts}).filter("entries is null").select(*key, F.col("seq").alias("cursor"), *[f"__{c}" for c in counts])
    # What the cursors' stretches and those after them hold; a stretch that only cursors are in holds nothing.
    held = rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in counts]).unionByName(places.select(*key, *[zero.alias(c) for c in counts]).distinct()).groupBy(*key).agg(*[F.sum(c).alias(c) for c in counts])
    later = cut(running(held, ["folder", "lane"], [-F.col("__stretch")], {f"__later_{c}": c for c in counts}), "stretches")
    left = passed.join(later, key).select("folder", "lane", "cursor", *[(F.col(f"__later_{c}") + F.col(c) - F.coalesce(f"__{c}", zero)).alias(c) for c in counts])
    return at.join(left, ["folder", "lane", "cursor"]).groupBy("peer", "folder").agg(*[F.sum(c).alias(c) for c in counts])


def still_valid(acknowledged: Column, observed: Column) -> Column:
    """Whether a backlog sample holds: as many lanes as now, and none behind what the sample had."""
    pairs = F.arrays_zip(acknowledged.alias("prior"), observed.alias("now"))
    return F.coalesce((F.size(acknowledged) == F.size(observed)) & F.forall(pairs, lambda p: F.coalesce(p["now"] >= p["prior"], F.lit(False))), F.lit(False))


def illegal_batches(batches: DataFrame, lanes: int) -> DataFrame:
    """batches: batch, prior, upto, lane and rows seq, path, kind, size.  One row for each broken batch with its reasons."""
    order = Window.partitionBy("batch").orderBy("position")
    row = batches.withColumn("before", F.lag("seq").over(order))
    bad = F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(
        F.when(F.col("upto") < F.col("prior"), F.lit("cursor moves back")),
        F.when(F.col("before") >= F.col("seq"), F.lit("sequence not increasing")),
        F.when((F.col("seq") <= F.col("prior")) | (F.col("seq") > F.col("upto")), F.lit("sequence outside the batch")),
        F.when(lane(F.col("path"), F.col("kind"), F.col("size"), lanes) != F.col("lane"), F.lit("wrong lane")),
    )))))
    told = row.groupBy("batch").agg(bad.alias("reasons"), F.count("*").alias("rows"))
    told = told.withColumn("reasons", F.array_sort(F.when(F.col("rows") > PAGE, F.array_append("reasons", F.lit("too many rows"))).otherwise(F.col("reasons"))))
    return told.filter(F.size("reasons") > 0)


def send_disabled(local_mode: Column, remote_mode: Column) -> Column:
    return F.when(local_mode == "receive-only", "local folder is receive-only").when(remote_mode == "send-only", "peer folder is send-only (last handshake)")


def delivery_label(d: dict[str, Column]) -> Column:
    """What to say about a delivery.  The columns: approved, mode, connected, sampled_at (null: no sample), send_disabled,
    error, now, pending_entries (null: unknown), pending_files, pending_bytes, complete, active_lanes, acknowledged, local_head,
    conflicts, phase, queued_paths, folder_error, watch_error, unwatched, cooling."""
    from .report import bytes_text, count_text

    prefix = F.when(d["complete"], "").otherwise("≥ ")
    queued = F.concat(
        prefix, count_text(d["pending_files"]), F.lit(" files · "), prefix, bytes_text(d["pending_bytes"].cast("double")), F.lit(" queued · "), prefix,
        count_text(F.greatest(d["pending_entries"] - d["pending_files"], F.lit(0))), F.lit(" metadata"),
    )
    behind = (F.size(d["acknowledged"]) == 0) | F.exists(d["acknowledged"], lambda n: F.coalesce(n < d["local_head"], F.lit(True)))
    busy = (d["phase"] != "watching") | (d["queued_paths"] > 0) | d["folder_error"].isNotNull() | d["watch_error"].isNotNull() | (d["unwatched"] > 0) | d["cooling"]
    # The labels are fixed values, and the first that holds counts.
    return (
        F.when(~d["approved"], "approval needed")
        .when(d["mode"] == "receive-only", "sending disabled · receive-only")
        .when(~d["connected"], "offline · delivery unconfirmed")
        .when(d["sampled_at"].isNull(), "awaiting delivery status")
        .when(d["send_disabled"].isNotNull(), F.concat(F.lit("sending disabled · "), d["send_disabled"]))
        .when(d["error"].isNotNull(), "queue unavailable · d for details")
        .when(d["now"] - d["sampled_at"] > 15, "queue sample stale")
        .when(d["pending_entries"].isNull(), "checking delivery")
        .when((d["pending_entries"] > 0) | ~d["complete"], queued)
        .when(d["active_lanes"] < F.size(d["acknowledged"]), "waiting for transfer lanes")
        .when(behind, "reconciling index")
        .when(d["conflicts"] > 0, "index delivered · conflicts remain")
        .when(busy, "index delivered · scan pending")
        .otherwise("indexed changes delivered")
    )
