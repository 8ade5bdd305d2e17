"""Which version vectors of a group are below which, without pairing a large group with itself.

Vectors are `steps`: arrays of (device, counter), sorted and without zeros, so that equal clocks are equal values.  Groups of up to
SMALL vectors are compared in a join.  Larger ones are sorted by ranges and cut into blocks of BLOCK; a block knows for each device
the least counter of its vectors (0 where one lacks it) and the greatest, and only blocks whose bounds allow it are compared, a pair
of blocks a row.  Whether a vector is below another at all is decided in two steps: inside blocks first, where all but the
incomparable ones fall out, and then among what is left.  Blocks of one group are compared by their bounds each with each, which
is a row for a thousand vectors squared."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clocks
from ..storage import cut
from .ranges import running

#: Vectors of a group that a join compares; vectors of a block; rows that a task gives at a time.
SMALL, BLOCK, ROWS = 64, 1024, 1024
STEPS = "array<struct<key:string,value:bigint>>"


def steps(clock: Column) -> Column:
    return F.array_sort(F.map_entries(F.map_filter(clock, lambda _, v: v > 0))).cast(STEPS)


def _below(lower: Column, upper: Column) -> Column:
    return clocks.includes(F.map_from_entries(lower), F.map_from_entries(upper))


def _blocks(vectors: DataFrame, by: Sequence[str], block: int, side: str) -> DataFrame:
    """by, and a block's number, vectors, and least and greatest counters as maps; their names begin with `side`."""
    at = [*by, "block"]
    rows = running(vectors.select(*by, "steps"), by, [F.col("steps")]).withColumn("block", F.floor((F.col("n") - 1) / block)).drop("n")
    held = rows.groupBy(*at).agg(F.collect_list("steps").alias("rows"), F.count("*").alias("n"))
    each = rows.select(*at, F.explode("steps").alias("e")).groupBy(*at, F.col("e.key").alias("key")).agg(F.min("e.value").alias("least"), F.max("e.value").alias("most"), F.count("*").alias("with"))
    per = each.join(held.select(*at, "n"), at).groupBy(*at).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("with") == F.col("n"), F.struct("key", "least")))).alias("low"),
        F.map_from_entries(F.collect_list(F.struct("key", "most"))).alias("high"),
    )
    none = F.create_map().cast("map<string,bigint>")
    told = held.join(per, at, "left")
    return told.select(*by, F.col("block").alias(f"{side}_block"), F.col("rows").alias(f"{side}_rows"), F.coalesce("low", none).alias(f"{side}_low"), F.coalesce("high", none).alias(f"{side}_high"))


def _matrix(uppers: list) -> dict[str, np.ndarray]:
    """For each device the counters of a block's vectors."""
    out: dict[str, np.ndarray] = {}
    for i, u in enumerate(uppers):
        for e in u:
            if e["key"] not in out:
                out[e["key"]] = np.zeros(len(uppers), np.int64)
            out[e["key"]][i] = e["value"]
    return out


def _above(lower, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Which of a block's vectors know all that `lower` does."""
    told = np.ones(n, bool)
    for e in lower:
        if e["key"] not in columns:
            return np.zeros(n, bool)
        told &= columns[e["key"]] >= e["value"]
    return told


def _pairs(by: Sequence[str], marks: bool):
    """Over rows of two blocks: the lower vectors that are strictly below some upper one, or all pairs (lower, upper)."""
    vector = pa.list_(pa.struct([("key", pa.string()), ("value", pa.int64())]))
    names = ["lower"] if marks else ["lower", "upper"]

    def made(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([*[schema.field(c) for c in by], *[pa.field(n, vector) for n in names]]))

    def compare(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            for i in range(page.num_rows):
                row = page.slice(i, 1).to_pylist()[0]
                uppers, group = row["u_rows"], {c: row[c] for c in by}
                columns, out = _matrix(uppers), []
                sums = np.sum(list(columns.values()), axis=0) if columns else np.zeros(len(uppers), np.int64)
                for lower in row["l_rows"]:
                    told = _above(lower, columns, len(uppers))
                    if marks:
                        # One above that isn't equal has a greater sum.
                        if (told & (sums > sum(e["value"] for e in lower))).any():
                            out.append({**group, "lower": lower})
                    else:
                        out += [{**group, "lower": lower, "upper": uppers[i]} for i in np.flatnonzero(told)]
                        if len(out) >= ROWS:
                            yield made(out, page.schema)
                            out = []
                yield made(out, page.schema)

    return compare


def _compared(pairs: DataFrame, by: Sequence[str], marks: bool) -> DataFrame:
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)
    return pairs.select(*by, "l_rows", "u_rows").mapInArrow(_pairs(by, marks), f"{kinds}, lower {STEPS}" + ("" if marks else f", upper {STEPS}"))


def _near(lower: DataFrame, upper: DataFrame, by: Sequence[str]) -> DataFrame:
    """The pairs of blocks in which a lower vector may be below an upper one, dealt to all tasks."""
    return lower.join(upper, [*by]).filter(clocks.includes(F.col("l_low"), F.col("u_high"))).repartition(*by, "l_block", "u_block")


def dominated(vectors: DataFrame, by: Sequence[str], small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Of distinct vectors (by, steps) those that are strictly below another one of their group."""
    size = vectors.groupBy(*by).agg(F.count("*").alias("__n")).filter("__n > 1")
    few = vectors.join(size.filter(F.col("__n") <= small).select(*by), [*by], "left_semi")
    other = few.select(*by, F.col("steps").alias("other"))
    out = few.join(other, [*by]).filter((F.col("steps") != F.col("other")) & _below(F.col("steps"), F.col("other"))).select(*by, "steps").distinct()
    many = size.filter(F.col("__n") > small).select(*by)
    if many.isEmpty():
        return out
    large = vectors.join(many, [*by], "left_semi")
    first = _blocks(large, by, block, "l")
    alone = cut(_compared(first.withColumn("u_rows", F.col("l_rows")).repartition(*by, "l_block"), by, True), "dominated")
    fallen = alone.withColumnRenamed("lower", "steps")
    left = cut(large.join(fallen, [*by, "steps"], "left_anti"), "undominated")
    lower = cut(_blocks(left, by, block, "l"), "dominance-blocks")
    upper = lower.select(*by, *[F.col(f"l_{c}").alias(f"u_{c}") for c in ("block", "rows", "low", "high")])
    rest = _compared(_near(lower, upper, by), by, True).withColumnRenamed("lower", "steps").distinct()
    return out.unionByName(fallen).unionByName(rest)


def known(points: DataFrame, askers: DataFrame, by: Sequence[str], small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """by, lower, upper: for each distinct vector of `askers` (by, steps) the distinct ones of `points` that it includes."""
    count = lambda df: df.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > small).select(*by)
    many = count(points).unionByName(count(askers)).distinct()
    named = lambda df, name: df.select(*by, F.col("steps").alias(name))
    few = named(points.join(many, [*by], "left_anti"), "lower").join(named(askers.join(many, [*by], "left_anti"), "upper"), [*by])
    out = few.filter(_below(F.col("lower"), F.col("upper"))).select(*by, "lower", "upper")
    if many.isEmpty():
        return out
    large = lambda df, side: _blocks(df.join(many, [*by], "left_semi"), by, block, side)
    return out.unionByName(_compared(_near(large(points, "l"), large(askers, "u"), by), by, False))
