"""Content-defined chunking and delta plans.

A signature is one row for each chunk: key columns, offset, len, hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import automata

#: Bounds of signatures and plans.
MAX_BLOCKS = 8192
MIN_FLOOR = 16 * 1024
ELIGIBLE = 1 << 20
LEAST_GAIN = 256 * 1024


def gear_table() -> np.ndarray:
    """Fixed values by rule: the finaliser of splitmix64 at each byte plus the golden ratio."""
    n = np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    n = (n ^ (n >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    n = (n ^ (n >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return n ^ (n >> np.uint64(31))


class Parameters(NamedTuple):
    min: int
    max: int
    mask: int


def parameters(source: int, basis: int, min_floor: int = MIN_FLOOR) -> Parameters:
    """Chunk bounds for two sizes: at most about MAX_BLOCKS chunks, powers of two."""
    least = max(-(-max(source, basis) // MAX_BLOCKS), min_floor)
    low = 1 << (least - 1).bit_length()
    return Parameters(low, 16 * low, 4 * low - 1)


def parameter_columns(source: Column, basis: Column, min_floor: int = MIN_FLOOR) -> list[Column]:
    least = F.greatest(F.ceil(F.greatest(source, basis) / MAX_BLOCKS), F.lit(min_floor))
    low = F.pow(F.lit(2.0), F.ceil(F.log2(least.cast("double")))).cast("long")
    return [low.alias("min_len"), (low * 16).alias("max_len"), (low * 4 - 1).alias("mask")]


def boundaries(body: bytes, p: Parameters) -> list[int]:
    """The ends of the chunks.  A rolling hash's low bits depend on the last few bytes alone, so it is a sum of shifted tables
    over all places at once; the walk then only visits candidates."""
    n, bits = len(body), (p.mask + 1).bit_length() - 1
    gear = gear_table()[np.frombuffer(body, np.uint8)]
    h = gear.copy()
    for j in range(1, min(bits, n)):
        h[j:] += gear[:-j] << np.uint64(j)
    cuts = np.flatnonzero((h & np.uint64(p.mask)) == 0) + 1
    out, start = [], 0
    while start < n:
        at = int(np.searchsorted(cuts, start + p.min))
        end = min(int(cuts[at]) if at < len(cuts) else n, start + p.max, n)
        out.append(end)
        start = end
    return out


def signature(files: DataFrame, body: str = "body", keep: tuple[str, ...] = ("folder", "path"), min_floor: int = MIN_FLOOR, basis: str | None = None) -> DataFrame:
    """keep, offset, len and hash of the chunks of each file (string or binary).  Custom logic that SQL lacks: a rolling hash
    inside each value, by NumPy over Arrow batches; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, offsets, lens, hashes = [], [], [], []
            other = batch.column("__basis").to_pylist() if basis else [0] * len(batch)
            for i, value in enumerate(batch.column("__body")):
                data = value.as_py() or b""
                start = 0
                for end in boundaries(data, parameters(len(data), other[i] or 0, min_floor)) if data else []:
                    rows.append(i)
                    offsets.append(start)
                    lens.append(end - start)
                    hashes.append(hashlib.sha256(data[start:end]).hexdigest())
                    start = end
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(offsets, pa.int64()), pa.array(lens, pa.int64()), pa.array(hashes, pa.string())], names=[*keep, "offset", "len", "hash"])

    extra = [F.col(basis).cast("long").alias("__basis")] if basis else []
    schema = T.StructType([*files.select(*keep).schema.fields, *T.StructType.fromDDL("offset long, len long, hash string").fields])
    return files.select(*keep, F.col(body).cast("binary").alias("__body"), *extra).mapInArrow(run, schema)


def fixed_blocks(files: DataFrame, size: int, body: str = "body", keep: tuple[str, ...] = ("folder", "path")) -> DataFrame:
    """The chunks of a fixed size."""
    data = F.col(body).cast("binary")
    n = F.octet_length(data)

    def block(k: Column) -> Column:
        piece = F.substring(data, k * size + 1, F.lit(size))
        return F.struct((k * size).cast("long").alias("offset"), F.octet_length(piece).cast("long").alias("len"), F.sha2(piece, 256).alias("hash"))

    # Blocks are cut inside the row, and only their hashes leave it: a file is never repeated for its blocks.
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), block)
    return files.filter(n > 0).select(*keep, F.explode(blocks).alias("x")).select(*keep, "x.*")


def broken_signatures(chunks: DataFrame, sizes: DataFrame, by: list[str], max_len: Column | int) -> DataFrame:
    """Files whose chunks aren't contiguous from 0 to their size (sizes: by, size), or have bad lengths or hashes."""
    w = Window.partitionBy(*by).orderBy("offset")
    gap = F.col("offset") != F.coalesce(F.lag("offset").over(w) + F.lag("len").over(w), F.lit(0))
    bad = (F.col("len") < 1) | (F.col("len") > max_len) | ~F.col("hash").rlike("^[0-9a-f]{64}$")
    told = chunks.withColumns({"gap": gap, "bad": bad}).groupBy(*by).agg(F.max("gap").alias("gap"), F.max("bad").alias("bad"), F.sum("len").alias("total"), F.count("*").alias("blocks"))
    whole = sizes.join(told, by, "left")
    return whole.filter(F.coalesce("gap", "bad", F.lit(False)) | F.coalesce("bad", F.lit(False)) | (F.coalesce("total", F.lit(0)) != F.col("size")) | (F.col("blocks") > MAX_BLOCKS))


def plan(source: DataFrame, basis: DataFrame, by: list[str]) -> DataFrame:
    """source's chunks, each with basis_offset: where the basis first has the same chunk, or null for literal bytes."""
    first = basis.groupBy(*by, "hash", "len").agg(F.min("offset").alias("basis_offset"))
    return source.join(first, [*by, "hash", "len"], "left").select(*by, "offset", "len", "hash", "basis_offset")


def reuse(planned: DataFrame, by: list[str]) -> DataFrame:
    """Bytes to copy and to send for each file."""
    copied = F.coalesce(F.sum(F.when(F.col("basis_offset").isNotNull(), F.col("len"))), F.lit(0))
    told = planned.groupBy(*by).agg(F.sum("len").alias("size"), copied.alias("reused"), F.count("*").alias("operations"))
    return told.withColumn("literal", F.col("size") - F.col("reused")).withColumn("reused_percent", F.round(100 * F.col("reused") / F.col("size"), 2))


def worthwhile(reused: Column, metadata: Column, size: Column) -> Column:
    """Whether what is saved pays for the metadata and a twentieth of the size (256 KiB at least)."""
    return reused >= metadata + F.greatest(F.floor(size / 20), F.lit(LEAST_GAIN))


def plan_metadata(planned: DataFrame, by: list[str]) -> DataFrame:
    """The bytes that a plan's operations take as JSON."""
    line = F.to_json(F.struct("len", "hash", "basis_offset"))
    return planned.groupBy(*by).agg((F.sum(F.octet_length(line)) + F.count("*") + 1).alias("metadata"))


def broken_plans(planned: DataFrame, sizes: DataFrame, by: list[str], max_len: Column | int) -> DataFrame:
    """Plans with bad operations, copies outside of the basis, or of another length than what remains (sizes: by, remaining,
    basis_size)."""
    rows = planned.join(sizes, by)
    bad = (F.col("len") <= 0) | (F.col("len") > max_len) | ~F.col("hash").rlike("^[0-9a-f]{64}$")
    outside = F.coalesce(F.col("basis_offset") + F.col("len") > F.col("basis_size"), F.lit(False))
    told = rows.groupBy(*by, "remaining").agg(F.max(bad).alias("bad"), F.max(outside).alias("outside"), F.sum("len").alias("total"), F.count("*").alias("n"))
    return told.filter(F.col("bad") | F.col("outside") | (F.col("total") != F.col("remaining")) | (F.col("n") > MAX_BLOCKS))


def eligible(basis_size: Column, remaining: Column) -> Column:
    return (basis_size >= ELIGIBLE) & (remaining >= ELIGIBLE)


def skips(attempts: DataFrame, by: list[str], order: str, useful: str = "useful") -> DataFrame:
    """attempts with `skipped`: after an attempt that didn't pay, the next three are skipped, then one tries again.

    Which attempts run depends on those that ran before: an automaton whose state is how many are still to skip."""
    rows = attempts.select(*by, order, F.coalesce(F.col(useful), F.lit(False)).alias("__good"))
    told = automata.stepped(rows, by, [order], "__good", [[3, 0, 1, 2], [0, 0, 1, 2]], name="__left")
    return told.select(*by, order, (F.col("__left") > 0).alias("skipped"))


def resume_offset(body: Column, offered: Column, prefix_hash: Column) -> Column:
    """Where a transfer goes on: after the offered bytes if they are a prefix of the source, else at the beginning."""
    data = body.cast("binary")
    return F.when((offered <= F.octet_length(data)) & (F.sha2(F.substring(data, F.lit(1), offered), 256) == prefix_hash), offered).otherwise(F.lit(0))


def resume_key(peer: Column, path: Column, hash_: Column, size: Column) -> Column:
    return F.sha2(F.to_json(F.array(peer, path, hash_, size.cast("string"))), 256)


def bad_copies(planned: DataFrame, bodies: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """Copies whose range of the basis hasn't the hash that was planned.

    A file's copies (MAX_BLOCKS at most in a legal plan) come to its body as one list."""
    rest = [c for c in planned.columns if c not in by]
    lists = planned.filter("basis_offset is not null").groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("__copies"))
    data = F.col("__b")
    wrong = F.filter("__copies", lambda x: F.sha2(F.substring(data, (x["basis_offset"] + 1).cast("int"), x["len"].cast("int")), 256) != x["hash"])
    return lists.join(bodies.select(*by, F.col(body).cast("binary").alias("__b")), by).select(*by, F.explode(wrong).alias("x")).select(*by, "x.*")


def reassembled(planned: DataFrame, sources: DataFrame, bases: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """by and `body`: each file put together from copies of its basis and literal pieces of its source, which both come to its
    list of operations once."""
    lists = planned.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("offset", "len", "basis_offset"))).alias("__plan"))
    rows = lists.join(sources.select(*by, F.col(body).cast("binary").alias("__s")), by).join(bases.select(*by, F.col(body).cast("binary").alias("__b")), by, "left")
    cut = lambda data, at, n: F.hex(F.substring(data, (at + 1).cast("int"), n.cast("int")))
    pieces = F.transform("__plan", lambda x: F.when(x["basis_offset"].isNotNull(), cut(F.col("__b"), x["basis_offset"], x["len"])).otherwise(cut(F.col("__s"), x["offset"], x["len"])))
    return rows.select(*by, F.unhex(F.array_join(pieces, "")).alias(body))
