"""Suffix-array deduplication: a depth-limited radix sort.

Suffixes are ordered only through their first `length` bytes (their window), most significant digit first; a bucket of one is
done and leaves.  Suffixes that are still together after the last pass have equal windows: they are exactly the repeated ones.

The digits of a window are read from its anchor on: the piece of PIECE bytes with the least hash in the window, leftmost first;
then the bytes right of it, then those left of it, from the anchor outwards.  Anchors depend on a window's own bytes alone, so
equal windows have equal anchors at equal places, and any order of digits gives the same groups.  Neighbouring suffixes mostly
share their anchor, which makes a run of them one row, and only one suffix in some forty is sorted:

  1. the first digit, the anchor's piece, deals runs to buckets (by its hash): buckets with one run are done;
  2. runs with the same bytes are one (by a cryptographic digest of 128 bits); all but the earliest are repeated.  The earliest ones go on if
     their bucket has different runs, since those can still share single windows;
  3. inside a bucket the runs' bytes are sorted by digits of eight bytes, first to the right and then to the left of the anchor,
     each pass only over runs that are still together.  Common prefixes of neighbours in that order tell for each place of the
     anchor which windows are equal, byte by byte: all but the earliest are repeated.

A bucket of more than BUCKET runs (a line that a third of all documents hold) goes on by further digits before that: its runs
are cut into pieces whose windows share STEPS[0] places of the anchor, and dealt by the bytes that all windows of a piece share
(all but STEPS[0] - 1); what is still too large by STEPS[1], and at last by whole windows, which are grouped by their bytes.
Buckets are made by hashes, but what shares one is told apart by bytes: only the equal runs of step 2 rest on a digest.
Grouped minima have partial sums before the shuffle, joins on hot keys are split, and no task holds more than a few buckets.

Cases: null texts are empty; texts under `length` bytes keep everything; a null id is the smallest; rows that share id and text
count as one place (neither is earlier than the other) and are cut alike; rows that share an id alone are documents of their
own, in order of their texts' hashes; an empty table gives no rows; columns named like those added are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, slices, texts_of, written

LENGTH, PIECE = 100, 24
#: Runs of one bucket that are sorted together; places of the anchor that pieces of larger buckets share; runs sorted at once.
BUCKET, STEPS, BLOCK_ROWS = 4096, (20, 5, 1), 16_384
#: Hot buckets up to this many are broadcast (8 bytes each); more are joined.
BROADCAST_BUCKETS = 100_000
#: Windows hashed at once; the bits of a place among them; bytes of text handled at once.
PART, PLACE, BLOCK_BYTES = 1 << 17, 18, 8 << 20
NO_ID = -(2**63)

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_ODD = [np.uint64(int(x) | 1) for x in _random.integers(0, 2**64, 5, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def _pieces(flat: np.ndarray) -> np.ndarray:
    """The hash of the 24 bytes from each place on: eight by doubling, then sixteen, then both."""
    h = _BYTE[flat]
    for step, odd in ((1, _ODD[0]), (2, _ODD[1]), (4, _ODD[2])):
        h = h[:-step] * odd + h[step:]
        h ^= h >> np.uint64(32)
    wide = h[:-8] * _ODD[3] + h[8:]
    return _mix(wide[:-8] * _ODD[4] + h[16:])


def _digest(body: bytes) -> bytes:
    """16 bytes that stand for a run's bytes (their number and the anchor's place follow from them)."""
    return hashlib.blake2b(body, digest_size=16).digest()


def _key(body: bytes, bits: int) -> int:
    """The bucket of bytes that windows share."""
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True) >> (64 - bits)


def _runs(flat: np.ndarray, offsets: np.ndarray, length: int, lean: bool, bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: row, start in it, number of windows and the anchor's place (in one number), anchor's
    hash, digest of the run's bytes (two longs)."""
    width = length - PIECE + 1
    for first in range(0, len(flat) - length + 1, PART):
        part = flat[first : first + PART + length - 1]
        n = len(part) - length + 1
        h = _pieces(part) >> np.uint64(64 - bits) << np.uint64(64 - bits)
        key = (h >> np.uint64(PLACE)) << np.uint64(PLACE) | np.arange(len(h), dtype=np.uint64)
        low, have = key, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        anchor = (low & np.uint64((1 << PLACE) - 1)).astype(np.int32)
        # Windows that reach beyond their text don't count.
        i, j = np.searchsorted(offsets, first, "right") - 1, np.searchsorted(offsets, first + n + length, "left")
        edge = np.zeros(n + 1, np.int32)
        ends = offsets[max(i, 0) + 1 : j + 1]
        np.add.at(edge, np.clip(ends - length + 1 - first, 0, n), 1)
        np.add.at(edge, np.clip(ends - first, 0, n), -1)
        valid = np.cumsum(edge[:n]) == 0
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
        new[1:] |= valid[1:] != valid[:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, n))
        keep = valid[start]
        start, count = start[keep], count[keep]
        if not len(start):
            continue
        at = anchor[start]
        row = np.searchsorted(offsets, start + first, "right") - 1
        if lean:
            yield row, None, None, h[at], None
            continue
        body, end = part.tobytes(), start + count - 1 + length
        whole = np.frombuffer(b"".join(_digest(body[x:y]) for x, y in zip(start.tolist(), end.tolist())), np.int64).reshape(-1, 2)
        yield row, start + first - offsets[row], count << 16 | at - start, h[at], whole


def _run_rows(docs: DataFrame, length: int, lean: bool, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = texts_of(batch, "text")
            ids = np.asarray(batch.column("d").to_numpy(zero_copy_only=False), np.int64)
            for a, b in slices(offsets, BLOCK_BYTES):
                mine = offsets[a : b + 1] - offsets[a]
                for row, start, count, h, whole in _runs(flat[offsets[a] : offsets[b]], mine, length, lean, bits):
                    cols = [h.view(np.int64)] if lean else [h.view(np.int64), whole[:, 0], whole[:, 1], ids[a + row], start.astype(np.int32), count.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["b", "c", "e", "d", "s", "n"][: len(cols)])

    return docs.mapInArrow(run, "b long" if lean else "b long, c long, e long, d long, s int, n int")


def _packed(docs: DataFrame, least: int) -> DataFrame:
    """d and the text's bytes, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            flat, offsets = texts_of(batch, "text")
            out = [press(flat[offsets[i] : offsets[i + 1]]) if offsets[i + 1] - offsets[i] >= least else None for i in range(len(batch))]
            for i in range(0, len(batch), 512):
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(i, 512), pa.array(out[i : i + 512], pa.binary())], names=["d", "z"])

    return docs.select("d", "text").mapInArrow(run, "d long, z binary").filter("z is not null")


def _piece_rows(packed: DataFrame, length: int) -> DataFrame:
    """From d, z and runs (b, s, n): key (the bucket), d, s, n (windows), at (the anchor's place in the piece) and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, z in enumerate(batch.column("z")):
                body = unpress(z.as_py())
                runs = batch.column("runs").slice(i, 1).flatten()
                key, s, n = (runs.field(c).to_numpy() for c in ("b", "s", "n"))
                n, at = n >> 16, n & 0xFFFF
                pieces = [body[a : a + c - 1 + length] for a, c in zip(s.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(s), batch.column("d")[i].as_py(), np.int64)), pa.array(s), pa.array(n), pa.array(at), pa.array(pieces, pa.binary())], names=_PIECE)

    return packed.mapInArrow(run, _PIECE_DDL)


_PIECE, _PIECE_DDL = ["key", "d", "s", "n", "at", "bytes"], "key long, d long, s int, n int, at int, bytes binary"


def _cut_rows(pieces: DataFrame, length: int, step: int, bits: int) -> DataFrame:
    """Pieces cut so that the windows of each have their anchor at `step` neighbouring places, dealt by what those share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, d, s, n, at, body in zip(*(batch.column(c).to_pylist() for c in _PIECE)):
                for near in range((at - n + 1) // step * step, at + 1, step):
                    far = min(near + step - 1, length - PIECE)
                    lo, hi = max(0, at - far), min(n - 1, at - near)
                    if lo <= hi:
                        shared = _key(b"%d %d " % (key, near) + body[at - near if at >= near else 0 : at - far + length], bits)
                        out.append((shared, d, s + lo, hi - lo + 1, at - lo, body[lo : hi + length]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], names=_PIECE)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pieces.mapInArrow(run, _PIECE_DDL)


def _digits(flat: np.ndarray, first: np.ndarray, size: np.ndarray, step: int, width: int) -> np.ndarray:
    """The `size` bytes from `first` on (step 1) or back (step -1), filled up with zeros, as numbers of eight bytes."""
    place = np.arange(-(-width // 8) * 8)
    inside = place < size[:, None]
    at = np.where(inside, first[:, None] + step * place, 0)
    return np.where(inside, flat[at], 0).astype(np.uint8).view(">u8").astype(np.uint64)


def _radix_sorted(digits: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (in order of their buckets) sorted inside buckets, most significant digit first: each row's place in that order, and
    for each place how many bytes it shares with the one before (-1: another bucket)."""
    m = len(bucket)
    order, shared = np.arange(m), np.full(m, 8 * digits.shape[1])
    edge = np.append(True, bucket[1:] != bucket[:-1])
    shared[edge] = -1
    for k in range(digits.shape[1]):
        alone = edge & np.append(edge[1:], True)
        live = np.flatnonzero(~alone)  # a bucket of one is done
        if not len(live):
            break
        group = np.cumsum(edge)[live]
        value = digits[order[live], k]
        by = np.lexsort((value, group))
        order[live], value = order[live[by]], value[by]
        new = np.flatnonzero((group[1:] == group[:-1]) & (value[1:] != value[:-1])) + 1
        apart = value[new] ^ value[new - 1]
        same = sum((apart < np.uint64(1 << (64 - 8 * b))).astype(np.int64) for b in range(1, 8))
        edge[live[new]], shared[live[new]] = True, 8 * k + same
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    return place, shared


def repeated_windows(bucket: np.ndarray, d: np.ndarray, s: np.ndarray, n: np.ndarray, at: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces in order of their buckets: the windows that an earlier place has too, as rows of (piece, first window, number)."""
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    size = n - 1 + length
    anchor = np.cumsum(size) - size + at
    right, shared_right = _radix_sorted(_digits(flat, anchor, size - at, 1, length), bucket)
    left, shared_left = _radix_sorted(_digits(flat, anchor - 1, at, -1, length - PIECE), bucket)
    earlier, order = np.empty(len(d), np.int64), np.lexsort((s + at, d))
    # Rows that share id and text have the same places.
    earlier[order] = np.cumsum(np.append(True, (np.diff(d[order]) != 0) | (np.diff((s + at)[order]) != 0)))
    hits = []
    for o in range(int((at - n + 1).min()), int(at.max()) + 1):  # windows that begin o bytes before their anchor
        have = np.flatnonzero((at >= o) & (at - o < n))
        if len(have) > 1:
            same = np.cumsum(shared_right < length - o)[right[have]] * (len(d) + 1) + np.cumsum(shared_left < o)[left[have]]
            by = np.lexsort((earlier[have], same))
            new = np.append(True, same[by][1:] != same[by][:-1])
            place = earlier[have[by]]
            found = have[by[place != place[new][np.cumsum(new) - 1]]]
            hits.append(found << 8 | (at[found] - o))
    hit = np.sort(np.concatenate([np.zeros(0, np.int64), *hits]))
    if not len(hit):
        return hit, hit, hit
    start = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1))
    return hit[start] >> 8, hit[start] & 255, np.diff(np.append(start, len(hit)))


def _sorted_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """Each bucket in one task: its repeated windows as d, s and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(t: pa.Table) -> pa.RecordBatch:
            key, d, s, n, at = (t.column(c).to_numpy().astype(np.int64) for c in _PIECE[:-1])
            row, first, many = repeated_windows(key, d, s, n, at, t.column("bytes").to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(d[row]), pa.array((s[row] + first).astype(np.int32)), pa.array(many.astype(np.int32))], names=["d", "s", "n"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) >= BLOCK_ROWS:
                key = held.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1], "left"))  # the last bucket may go on
                if whole:
                    yield solve(held.slice(0, whole).combine_chunks())
                    held = held.slice(whole)
        if held is not None and len(held):
            yield solve(held.combine_chunks())

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "d long, s int, n int")


def _bucket_windows(pieces: DataFrame, length: int, bucket: int, bits: int) -> list[DataFrame]:
    """Tables of d, s and n: the repeated windows of all pieces.  Deletes `pieces`."""
    out = []
    for step in (*STEPS, None):
        hot = written(pieces.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") > bucket).select("key"), "radix-hot")
        many = hot.count()
        if many == 0 or step is None:
            break
        these = F.broadcast(hot) if many <= BROADCAST_BUCKETS else hot
        out.append(written(_sorted_pieces(pieces.join(these, "key", "left_anti").select(*_PIECE), length), "radix-sorted"))
        finer = written(_cut_rows(pieces.join(these, "key", "left_semi").select(*_PIECE), length, step, bits), "radix-pieces")
        discard(pieces, hot)
        pieces = finer
    if many == 0:
        out.append(written(_sorted_pieces(pieces, length), "radix-sorted"))
    else:  # pieces of one window: those with the same bytes are equal
        first = pieces.groupBy("key", "bytes").agg(F.min(F.struct("d", "s")).alias("f"))
        out.append(written(pieces.join(first, ["key", "bytes"]).filter((F.col("d") != F.col("f.d")) | (F.col("s") != F.col("f.s"))).select("d", "s", F.lit(1).alias("n")), "radix-sorted"))
    discard(pieces, hot)
    return out


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and d: the id, or where rows of one id have different texts a number in order of id and text's hash."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("d"))
    hashed = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    pairs = hashed.select("d", "h")
    if pairs.groupBy("d").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x != y").isEmpty():
        return rows
    within = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))  # the number inside a partition
    ranked = written(pairs.distinct().repartitionByRange("d", "h").sortWithinPartitions("d", "h").select("d", "h", F.spark_partition_id().alias("p"), within.alias("k")), "radix-ids")
    at, parts = 0, []
    for r in ranked.groupBy("p").count().orderBy("p").collect():  # as many rows as partitions
        parts.append((r["p"], at))
        at += r["count"]
    begin = F.broadcast(docs.sparkSession.createDataFrame(parts, "p int, begin long"))
    number = ranked.join(begin, "p").select("d", "h", (F.col("begin") + F.col("k")).alias("number"))
    out = written(hashed.join(number, ["d", "h"]).select("doc_id", "text", F.col("number").alias("d")), "radix-rows")
    discard(ranked)
    return out


def _spans(rows: DataFrame, length: int, bucket: int, bits: int) -> DataFrame:
    """d and spans: places s and numbers n of windows that also start earlier, in no order."""
    rows = rows.select("d", "text")
    low, high, longest = rows.agg(F.min("d"), F.max("d"), F.max(F.octet_length("text"))).first()
    # Id and place in one number, in the order of "earlier": a long where both fit.
    room = int(longest or 1).bit_length()
    if low is None or (low >= 0 and high < 1 << (63 - room)):
        place, d, at = f"d * {1 << room}L + s", f"w div {1 << room}L", f"cast(w % {1 << room}L as int)"
    else:
        unit, zero = f"cast({1 << room} as decimal(20,0))", f"cast({2**63} as decimal(20,0))"
        place = f"cast((cast(d as decimal(20,0)) + {zero}) * {unit} + s as decimal(38,0))"
        d, at = f"cast(floor(w / {unit}) - {zero} as bigint)", f"cast(w % {unit} as int)"
    packed, unpacked = F.expr(place).alias("w"), (F.expr(d).alias("d"), F.expr(at).alias("s"))
    # A table of its own, so that the join with a hot bucket's runs can be split.
    more = written(_run_rows(rows, length, True, bits).groupBy("b").agg(F.count("*").alias("k")).filter("k > 1").select("b"), "radix-more")
    runs = written(_run_rows(rows, length, False, bits).join(more, "b", "left_semi").select("b", "c", "e", packed, "n"), "radix-runs")
    discard(more)
    classes = written(runs.groupBy("b", "c", "e").agg(F.min("w").alias("w"), F.min("n").alias("n"), F.count("*").alias("k")), "radix-classes")
    first = classes.filter("k > 1").select("b", "c", "e", F.col("w").alias("w0"))
    second = written(runs.join(first, ["b", "c", "e"]).filter("w != w0").select(*unpacked, F.expr("shiftright(n, 16)").alias("n")), "radix-equal")
    discard(runs)
    mixed = written(classes.groupBy("b").agg(F.count("*").alias("m")).filter("m > 1").select("b"), "radix-mixed")
    open_runs = classes.join(mixed, "b", "left_semi").select("b", *unpacked, "n").groupBy("d").agg(F.collect_list(F.struct("b", "s", "n")).alias("runs"))
    pieces = written(_piece_rows(_packed(rows, length).join(open_runs, "d"), length), "radix-pieces")
    discard(classes, mixed)
    found = [second, *_bucket_windows(pieces, length, bucket, bits)]
    union = found[0]
    for other in found[1:]:
        union = union.unionByName(other)
    spans = written(union.groupBy("d").agg(F.collect_list(F.struct("s", "n")).alias("spans")), "radix-spans")
    discard(*found)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, removed (spans as start and end, bytes) and kept (binary: the remaining bytes).  bits: of the hashes that
    make buckets; any number gives the same result."""
    rows = _numbered(docs, doc_id, text)
    spans = _spans(rows, length, bucket, bits)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            flat, offsets = texts_of(batch, "text")
            for a, b in slices(offsets, BLOCK_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("d"), pa.array([pack(flat[offsets[i] : offsets[i + 1]]) for i in range(a, b)], pa.binary())], names=["doc_id", "d", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            lists, zs = batch.column("spans"), batch.column("z").to_pylist()
            bounds, inner = lists.offsets.to_numpy(), lists.flatten()
            s_all, n_all, base = inner.field("s").to_numpy(), inner.field("n").to_numpy(), bounds[0]
            held, size, done = [], 0, 0
            for i in range(len(batch)):
                body = np.frombuffer(unpack(zs[i]), np.uint8)
                s = s_all[bounds[i] - base : bounds[i + 1] - base].astype(np.int64)
                e = np.minimum(s + n_all[bounds[i] - base : bounds[i + 1] - base] - 1 + length, len(body))
                removed, kept = [], body
                if len(s):
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.append(True, s[1:] > e[:-1])
                    start, end = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
                    edge = np.zeros(len(body) + 1, np.int8)
                    edge[start] += 1
                    edge[end] -= 1
                    kept = body[np.cumsum(edge[:-1]) == 0]
                    removed = [{"start": int(x), "end": int(y)} for x, y in zip(start, end)]
                held.append((len(body), removed, kept.tobytes()))
                size += len(body)
                if size >= BLOCK_BYTES or i + 1 == len(batch):
                    part = batch.slice(done, i + 1 - done)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], spans_type), pa.array([x[2] for x in held], pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"]
                    )
                    held, size, done = [], 0, i + 1

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    id_field = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    small = T.StructType([id_field, T.StructField("d", T.LongType()), T.StructField("z", T.BinaryType())])
    joined = rows.mapInArrow(press, small).join(spans, "d", "left").select("doc_id", "z", F.coalesce("spans", F.expr("cast(array() as array<struct<s:int,n:int>>)")).alias("spans"))
    schema = T.StructType([id_field, *T.StructType.fromDDL("n_bytes long, removed array<struct<start:long,end:long>>, kept binary").fields])
    return joined.mapInArrow(cut, schema)


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove_repeats(docs, length).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
