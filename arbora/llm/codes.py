"""Embedding near-dedup: randomised-rotation binary codes with stored correction factors.

Every distinct vector o (at unit length) is turned by one random rotation and kept as the signs of its D components, the code s
(a unit vector after division by the root of D), with the factor f = s.o.  For another unit vector q

    (s.q) / f   is an unbiased estimate of o.q over rotations, and with confidence
    |(s.q) / f - o.q|  <=  SURE * sqrt((1 - f^2) / f^2) / sqrt(D - 1);
    at any rotation  o.q <= cos(max(0, angle(s, q) - angle(s, o))), since angles are a metric.

The tighter of these upper bounds decides: it comes down to a least value of s.q for each code, so a block of codes and vectors is
one product and one comparison.  Pairs that pass are held against the bound of the other one's code too, and what is left is
recomputed exactly, in double precision.  At SURE = 6 a link is lost to the confidence with a chance of some 10^-9.

Which pairs meet: PIVOTS vectors (more of them the more vectors there are, no two nearer than the threshold's angle t, chosen out
of a bounded sample by hash) make cells, and a vector goes to the `spread` cells whose pivots are nearest, so a cell holds
hundreds of vectors whatever the input's size, and the number of pairs grows with the input and not with its square.  A
linked pair at the threshold shares a cell with a chance of 0.99 and more, a nearer one almost surely (measured in
tests/llm/test_codes.py); a pair that shares several cells is judged in the first.  Every vector is indexed.

Hot cells: the core of a cell are the vectors within t / 2 of its pivot.  Any two of them are linked, by the triangle inequality, so
they are counted by one sum and joined by one edge each, and no pair of them is ever looked at; a vector belongs to one core at
most.  Vectors beyond 3 t / 2 can't be linked with a core.  What remains in a large cell is dealt in parts of PART vectors, a task
for each two parts; a task gives back a row for each of its vectors that has links (how many) and a spanning forest of its links
(at most an edge for each vector), never its pairs.

Copies are folded first, by value.  Cost: each distinct vector is shuffled `spread` times (5 to 12 for 10^4 to 10^10 vectors).

Cases: vectors that are null, all zeros, or hold a null or non-finite component link with nothing, and so do rows without an id
(component_id is their id, kept is null without one); shorter vectors count as filled up with zeros; rows that share an id are
vectors of their own (both are kept where the id is the component's); without rows there are none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import discard, written
from .graph import components

THRESHOLD = 0.9
#: Confidence of an estimate, in standard deviations (about); margin for rounding, in radians.
SURE, MARGIN = 6.0, 1e-6
#: Vectors for each pivot; pivots, least and most; sampled vectors for each pivot wanted; bytes of pivots at most.
EACH, PIVOTS, SAMPLED, BYTES = 64, (16, 65_536), 4, 64 << 20
#: Vectors in a part of a cell; rows of a block.
PART, BLOCK = 4096, 512


def spread(pivots: int) -> int:
    """To how many cells a vector goes."""
    return max(1, min(pivots, math.ceil(0.7 * math.log2(max(2, pivots)) + 1)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in doubles; scaled by a power of two first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows x[i] and y[i], in double precision."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None]) for v in (x.astype(np.float64), y.astype(np.float64)))
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def rotation(size: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]


def encoded(u: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the turned unit vectors, and the factors s.o."""
    t = u @ turn
    return np.packbits(t >= 0, axis=1), np.abs(t).sum(1) / math.sqrt(u.shape[1])


def signs(packed: np.ndarray, size: int) -> np.ndarray:
    """Codes as unit vectors."""
    return (np.unpackbits(packed, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(size))


def least(factor: np.ndarray, size: int, threshold: float, sure: float = SURE) -> np.ndarray:
    """For each code the least s.q at which o.q can reach the threshold, by the tighter bound."""
    f = np.clip(factor, 1e-9, 1.0)
    certain = np.cos(np.minimum(np.arccos(f) + math.acos(threshold), math.pi))
    width = sure * np.sqrt((1 - f * f) / (f * f)) / math.sqrt(max(1, size - 1))
    return np.maximum(certain, f * (threshold - width)) - 1e-5 if size > 2 else certain - 1e-5


def pivots_of(nodes: DataFrame, n: int, size: int, threshold: float) -> np.ndarray:
    """Unit vectors out of a sample by hash, no two nearer than the threshold's angle (less a little)."""
    most = max(PIVOTS[0], min(PIVOTS[1], n // EACH, BYTES // (8 * size)))
    found = nodes.orderBy(F.xxhash64("x"), "node").limit(SAMPLED * most).select("x").collect()
    sample, kept = unit(np.array([r["x"] for r in found], np.float64).reshape(len(found), size)), np.zeros((most, size))
    k, near = 0, math.cos(math.acos(threshold) + 1e-3)
    for v in sample:
        if k < most and (not k or (kept[:k] @ v).max() <= near):
            kept[k] = v
            k += 1
    return kept[:k]


def _coded(nodes: DataFrame, pivots: np.ndarray, turn: np.ndarray, element: str, threshold: float) -> DataFrame:
    """The index: node, x, code, factor, cells (ascending), roles in them (0 core, 1 near it, 2 neither), core (-1: of none)."""
    shared = nodes.sparkSession.sparkContext.broadcast((pivots, turn))
    m, angle = spread(len(pivots)), math.acos(threshold)
    core_at, near_at = math.cos(angle / 2 - MARGIN), math.cos(min(math.pi, 1.5 * angle + MARGIN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, r = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            u = unit(vectors.matrix(b, "x"))
            code, factor = encoded(u, r)
            dot = u @ p.T
            at = np.sort(np.argpartition(-dot, m - 1, axis=1)[:, :m], axis=1)
            there = np.take_along_axis(dot, at, 1)
            role = np.where(there >= core_at, 0, np.where(there >= near_at, 1, 2)).astype(np.int8)
            # No two pivots are within the threshold's angle, so no vector is within half of it of two.
            core = np.where((role == 0).any(1), np.take_along_axis(at, there.argmax(1)[:, None], 1)[:, 0], -1)
            fixed = lambda a, kind: pa.array(a.tolist(), pa.list_(kind))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), b.column("x"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), fixed(at, pa.int32()), fixed(role, pa.int8()), pa.array(core.astype(np.int32))], ["node", "copies", "x", "code", "factor", "cells", "roles", "core"])

    return nodes.select("node", "copies", "x").mapInArrow(run, f"node long, copies long, x array<{element}>, code binary, factor double, cells array<int>, roles array<tinyint>, core int")


def _forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> list[int]:
    """Which edges a[i]-b[i] join two trees (parent is kept up to date)."""
    used = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(i)
    return used


def _solver(turn, threshold: float, stats_wanted: bool):
    """The links among the rows of one task."""

    def solve(key, page):
        cell, left, right = key[0], key[2], key[3]
        x = np.stack(page["x"].to_numpy())
        size, n = x.shape[1], len(page)
        u = unit(x)
        q = (u @ turn.value).astype(np.float32)
        s = signs(np.stack([np.frombuffer(c, np.uint8) for c in page["code"]]), size)
        low = least(page["factor"].to_numpy(), size, threshold).astype(np.float32)
        node, copies, core, role, side = (page[c].to_numpy() for c in ("node", "copies", "core", "role", "side"))
        cells = np.stack(page["cells"].to_numpy())
        links, parent = np.zeros(n, np.int64), np.arange(n)
        edges: list[tuple[int, int]] = []
        looked = exact = 0
        # Rows of the left part against those of the right one; within one part each pair once.
        mine, theirs = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if left != right else (np.arange(n), np.arange(n))
        for at in range(0, len(mine), BLOCK):
            a, b = mine[at : at + BLOCK], theirs if left != right else theirs[at:]
            i, j = np.nonzero(s[a] @ q[b].T >= low[a][:, None])
            looked += len(a) * len(b)
            i, j = a[i], b[j]
            ok = (role[i] + role[j] != 2) | (role[i] == role[j])  # a core and what is beyond its reach
            if left == right:
                ok &= i < j
            ok &= (core[i] < 0) | (core[i] != core[j])
            i, j = i[ok], j[ok]
            ok = np.einsum("ij,ij->i", s[j], q[i]) >= low[j]
            i, j = i[ok], j[ok]
            for c in range(0, len(i), 1 << 16):  # a bounded number of pairs at once
                p, r = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                same = cells[p][:, :, None] == cells[r][:, None, :]
                first = np.where(same.any(2), cells[p], np.iinfo(np.int32).max).min(1)
                p, r = p[first == cell], r[first == cell]
                exact += len(p)
                linked = cosines(x[p], x[r]) >= threshold
                p, r = p[linked], r[linked]
                np.add.at(links, p, copies[r])
                np.add.at(links, r, copies[p])
                edges += [(p[e], r[e]) for e in _forest(n, p, r, parent)]
        some = np.flatnonzero(links)
        e = np.array(edges, np.int64).reshape(-1, 2)
        out = pd.DataFrame({"node": np.concatenate([node[some], node[e[:, 0]]]), "links": np.concatenate([links[some], np.zeros(len(e), np.int64)]), "other": pd.array([None] * len(some) + node[e[:, 1]].tolist(), dtype="Int64")})
        if stats_wanted:
            out = pd.concat([out, pd.DataFrame({"node": [-1, -2], "links": [looked, exact], "other": pd.array([None, None], dtype="Int64")})])
        return out

    return solve


def _dealt(index: DataFrame, pivots: int) -> DataFrame:
    """The index's rows for each task: cell, kind (0: a core against what is near it, 1: the others among themselves), left and
    right part, side, and the row."""
    rows = index.withColumn("e", F.explode(F.arrays_zip("cells", "roles"))).select("*", F.col("e.cells").alias("cell"), F.col("e.roles").cast("int").alias("role")).drop("e", "roles")
    sizes = index.select(F.explode(F.arrays_zip("cells", "roles")).alias("e")).groupBy(F.col("e.cells").alias("cell")).agg(*[F.count_if(F.col("e.roles") == r).alias(f"n{r}") for r in range(3)])
    parts = lambda n: F.ceil(n / PART).cast("int")
    # A row for each pivot.
    cut = F.broadcast(sizes.select(F.col("cell").alias("c"), parts(F.col("n0")).alias("of_core"), parts(F.col("n1")).alias("of_near"), parts(F.col("n1") + F.col("n2")).alias("of_rest")))
    rows = rows.join(cut, F.col("cell") == F.col("c")).withColumn("h", F.pmod(F.xxhash64("node"), F.lit(2**31 - 1)))
    part = lambda n: F.pmod("h", F.greatest(F.col(n), F.lit(1))).cast("int")
    own = rows.withColumns({"core_part": part("of_core"), "near_part": part("of_near"), "rest_part": part("of_rest")})
    task = lambda kind, left, right, side: F.struct(F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"), F.lit(side).alias("side"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    rest = F.col("rest_part")
    # Core and near parts have numbers that differ: -1, -2, ... and 0, 1, ...
    core_to = F.transform(upto("of_near"), lambda i: task(0, -1 - F.col("core_part"), i, 0))
    near_to = F.transform(upto("of_core"), lambda i: task(0, -1 - i, F.col("near_part"), 1))
    rest_to = F.transform(upto("of_rest"), lambda i: F.when(i < rest, task(1, i, rest, 1)).otherwise(task(1, rest, i, 0)))
    return own.withColumn("t", F.explode(F.when(F.col("role") == 0, core_to).when(F.col("role") == 1, F.concat(near_to, rest_to)).otherwise(rest_to))).select("cell", "t.*", "node", "copies", "x", "code", "factor", "cells", "core", "role")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, stats: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.  Into `stats`: pairs of distinct vectors, pairs estimated, and pairs
    recomputed."""
    spark = embeddings.sparkSession
    element = "float" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("x"))
    takes = F.col("vec_id").isNotNull() & vectors.finite("x") & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    alone = rows.filter(~takes).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.when(F.col("vec_id").isNotNull(), F.lit(True)).alias("kept"))
    rows = vectors.aligned(rows.filter(takes), "x", F.lit(0).cast(element))
    folded = rows.groupBy("x").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = written(folded.withColumn("node", F.monotonically_increasing_id()), "codes-nodes")
    shape = nodes.agg(F.count("*"), F.max(F.size("x"))).first()
    if not shape[0]:
        discard(nodes)
        return alone
    size = shape[1]
    pivots = pivots_of(nodes, shape[0], size, threshold)
    turn = rotation(size)
    index = written(_coded(nodes, pivots, turn, element, threshold), "codes-index")
    solve = _solver(spark.sparkContext.broadcast(turn), threshold, stats is not None)
    found = written(_dealt(index, len(pivots)).groupBy("cell", "kind", "left", "right").applyInPandas(solve, "node long, links long, other long"), "codes-links")
    if stats is not None:
        told = {r["node"]: r["n"] for r in found.filter("node < 0").groupBy("node").agg(F.sum("links").alias("n")).collect()}
        stats |= {"pairs": shape[0] * (shape[0] - 1) // 2, "estimated": told.get(-1, 0), "recomputed": told.get(-2, 0), "pivots": len(pivots)}
    cores = index.filter("core >= 0").select("node", "copies", "core")
    heads = cores.groupBy("core").agg(F.min("node").alias("head"), F.sum("copies").alias("weight"))  # a row for each pivot
    inside = cores.join(F.broadcast(heads), "core").select("node", (F.col("weight") - F.col("copies")).alias("links"), F.col("head").alias("other"))
    all_ = found.filter("node >= 0").unionByName(inside)
    links = all_.groupBy("node").agg(F.sum("links").alias("links"))
    edges = components(all_.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = nodes.select("node", "x", "copies", "first").join(links, "node", "left").join(edges, "node", "left").select("x", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component"))
    least_of = named.groupBy("component").agg(F.min("first").alias("component_id"))
    told = written(named.join(least_of, "component").select("x", "n_links", "component_id"), "codes-told")
    discard(nodes, index, found)
    out = rows.join(told, "x").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)


CODES_SQL = f"""
with recursive u as (
  select row_number() over () as row, vec_id, embedding::double[] as x from embeddings),
t as (
  select row, vec_id, x from u where vec_id is not null and x is not null
    and len(list_filter(x, lambda c: c is null or isnan(c) or isinf(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
v as materialized (
  select row, vec_id, list_resize(x, (select max(len(x)) from t), 0::double) as x from t),
p as materialized (
  select a.row as a, b.row as b, b.vec_id as id from v a join v b on a.row <> b.row
  where list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= {THRESHOLD}),
r as (
  select a, b, id from p
  union
  select r.a, p.b, p.id from r join p on p.a = r.b),
c as (select a, min(id) as id from r group by a),
n as (select a, count(*) as n from p group by a),
o as (
  select u.vec_id, coalesce(n.n, 0)::bigint as n_links, least(u.vec_id, coalesce(c.id, u.vec_id)) as component_id
  from u left join c on c.a = u.row left join n on n.a = u.row)
select *, vec_id = component_id as kept from o
"""
