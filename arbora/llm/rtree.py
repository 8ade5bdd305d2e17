"""N-gram Jaccard join with a count-vector R-tree.

A document's set of distinct word shingles is hashed into groups; its group counts are a point.  For two documents the overlap
is at most the sum of the coordinate minima of their points, and for a document and a box the sum of the minima with the box's
upper corner: an R-tree over the points (packed by sort-tile-recursion) finds all documents that can reach the overlap needed,
and surviving pairs are verified on the sets themselves.  Points have FINEST groups and are kept sparse, as the sorted groups of
all shingles.  A tree counts its points in as many groups as its sets have shingles (with fewer, counts of long documents look
alike and bound nothing) and its boxes in COARSE ones; what it finds passes the bound on all groups before it is a pair.

One tree over a corpus would still not prune (boxes around unlike documents reach everything), so documents are first dealt to
small trees by the same counting argument: sets that are similar enough differ in at most d shingles; cut into more than d
blocks of the hash range they agree in a whole block.  Each block that isn't empty is a key, so similar sets meet under one;
blocks outnumber d by a margin, and a set that has more empty blocks than that margin adds its empty ones as keys.  A key's
lead is the member that shares most keys (an original has more in common than its edited copies); all members of a lead's keys
(of one class of sizes) make one neighbourhood, with one tree, in parts of bounded size.

Trees are searched twice.  First by the lead: as many searches as neighbourhoods.  Components of the links found tell which
pairs are settled.  Then, in neighbourhoods that still hold several components, by the members outside of the largest one;
only pairs between different components are taken.  Only components are wanted, so a pair that is already connected need not
be verified; no link between different components is ever left out.  Equal sets are one node, named by the least 64-bit hash
of their texts; ids come in only when the components are known.

Cases: null, empty and blank texts have no shingles and are linked with nothing; texts with fewer words than a shingle are one
shingle as a whole; rows that share an id are one document in the components (each of its texts links) but keep a row each;
rows without an id link like others and take the smallest id of their component, null if it has none; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, released, slices, texts_of, written
from .graph import components

#: Groups of the boxes, of a tree's points at most, and of the points themselves (as powers of two).
COARSE_BITS, TREE_BITS, FINEST_BITS = 6, 12, 16
COARSE = 1 << COARSE_BITS
#: Entries of a node; points of a tree; pairs with one text in one task.
LEAF, CHUNK, SALT = 16, 1024, 1000
BLOCK_BYTES = 1 << 20
#: Keys in one row; neighbourhoods (some 40 bytes each) that are broadcast, more are joined.
KEYS_ROW, BROADCAST_ROWS = 4096, 100_000

_random = np.random.Generator(np.random.PCG64(77))
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_ODD = [np.uint64(int(x) | 1) for x in _random.integers(0, 2**64, 12, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, size: int = 4) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    n = len(offsets) - 1
    word = ~_SPACE[flat]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(flat)]
    first[inner] = word[inner]
    start = np.flatnonzero(first)
    if not len(start):
        return [np.zeros(0, np.uint64)] * n
    # Each byte counts by its value and its place in its word; spaces don't.
    begun = np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(flat)]])))
    place = (np.arange(len(flat)) - begun).astype(np.uint64)
    value = _mix(_BYTE[_LOWER[flat]] + place * _ODD[0])
    value[~word] = 0
    words = _mix(np.add.reduceat(value, start))
    bounds = np.searchsorted(start, offsets)
    out = []
    grams = np.zeros(0, np.uint64)
    if len(words) >= size:
        grams = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            grams = grams * _ODD[k] + words[k : len(words) - size + 1 + k]
        grams = _mix(grams)
    for i in range(n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64) * _ODD[9]
            for k in range(a, b):
                h = _mix(h + words[k : k + 1] * _ODD[4 + (k - a) % 4])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Layout:
    """Classes of set sizes (of the smaller of a pair), and into how many blocks each cuts the hash range."""

    RATIO = 1.6

    def __init__(self, percent: int = 85):
        self.percent = percent
        self.edges = [1]
        while self.edges[-1] < 2**40:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * self.RATIO)))
        self.differ = [self.most_apart(e - 1) for e in self.edges[1:]]
        self.blocks = [math.ceil(1.1 * (d + 1)) + (2 if d else 0) for d in self.differ]

    def largest(self, smaller: int) -> int:
        return smaller * 100 // self.percent

    def most_apart(self, smaller: int) -> int:
        """Shingles in which a set of that size and a larger one can differ and still be linked."""
        total = smaller + self.largest(smaller)
        return total * (100 - self.percent) // (100 + self.percent)

    def needed(self, total):
        """The overlap that links two sets with `total` shingles together."""
        return -(-self.percent * total // (100 + self.percent))

    def keys(self, u: np.ndarray) -> np.ndarray:
        """The keys of a sorted set of hashes; the low six bits are the class."""
        n, out = len(u), []
        if n == 0 or (self.largest(n) == n and self.largest(n - 1) < n):
            return np.zeros(0, np.int64)  # it can only be linked with its equals
        top = int(np.searchsorted(self.edges, n, "right")) - 1
        low = int(np.searchsorted(self.edges, -(-self.percent * n // 100), "right")) - 1
        mixed = _mix(u)
        for c in range(low, top + 1):
            m = self.blocks[c]
            block = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            have = block[start]
            key = np.add.reduceat(mixed, start) + have * _ODD[7]
            if m - len(start) > m - min(self.differ[c], self.most_apart(n)) - 1:
                empty = np.ones(m, bool)
                empty[have.astype(np.int64)] = False
                key = np.append(key, np.flatnonzero(empty).astype(np.uint64) * _ODD[7])
            key = _mix(key + np.array([c], np.uint64) * _ODD[8])
            out.append((key << np.uint64(6) | np.uint64(c)).view(np.int64))
        return np.concatenate(out)


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    """Points of fewer groups: neighbouring ones are counted together."""
    while points.shape[1] > groups:
        points = points[:, 0::2] + points[:, 1::2]
    return points


class RTree:
    """Points packed by sort-tile-recursion; nodes have an upper corner (on COARSE groups) and a least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        coarse = fold(points, COARSE)
        self.order = self._tiles(coarse, np.arange(len(points)), sizes)
        self.points, self.coarse, self.sizes = points[self.order], coarse[self.order], sizes[self.order]
        self.levels = []
        corner, least = self.coarse, self.sizes
        while len(corner) > LEAF:
            cut = np.arange(0, len(corner), LEAF)
            corner, least = np.maximum.reduceat(corner, cut), np.minimum.reduceat(least, cut)
            self.levels.append((corner, least))

    @staticmethod
    def _tiles(points: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """By size first; then, inside slabs, by the coordinates that vary most."""
        at = at[np.argsort(sizes[at], kind="stable")]
        if len(at) <= LEAF:
            return at
        slab = max(LEAF, int(math.sqrt(len(at) / LEAF) + 1) * LEAF)
        out = []
        for a in range(0, len(at), slab):
            part = at[a : a + slab]
            axis = int(points[part].var(0).argmax())
            out.append(part[np.argsort(points[part, axis], kind="stable")])
        return np.concatenate(out)

    def search(self, q: np.ndarray, size: int, layout: Layout) -> np.ndarray:
        """Indices of the points whose overlap with q can be enough."""
        rough = fold(q[None], COARSE)[0]
        live = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            ok = np.minimum(corner[live], rough).sum(1) >= layout.needed(size + least[live])
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            live = (live[ok][:, None] * LEAF + np.arange(LEAF)).ravel()
            live = live[live < below]
        need = layout.needed(size + self.sizes[live])
        ok = np.minimum(self.coarse[live], rough).sum(1) >= need
        live, need = live[ok], need[ok]
        ok = np.minimum(self.points[live], q).sum(1) >= need
        return self.order[live[ok]]


def pack_point(u: np.ndarray) -> bytes:
    """A set's point: the groups of its shingles, in order, each as often as it is hit."""
    return (u >> np.uint64(64 - FINEST_BITS)).astype("<u2").tobytes()


def unpack_points(packed: list[bytes], bits: int) -> np.ndarray:
    """Points as rows of counts in 2**bits groups."""
    sizes = [len(p) // 2 for p in packed]
    row = np.repeat(np.arange(len(packed)), sizes) << bits
    at = np.frombuffer(b"".join(packed), "<u2").astype(np.int64) >> (FINEST_BITS - bits)
    return np.bincount(row + at, minlength=len(packed) << bits).astype(np.int32).reshape(len(packed), 1 << bits)


def spelled(packed: bytes) -> np.ndarray:
    """A point's hits as distinct sorted numbers (group, how often before), so that common ones make the sum of minima."""
    at = np.frombuffer(packed, "<u2").astype(np.int64)
    return at << 32 | np.arange(len(at)) - np.searchsorted(at, at)


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted arrays of distinct numbers share."""
    if not len(a):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    flat, offsets = texts_of(batch, "text")
    for a, b in slices(offsets, BLOCK_BYTES):
        yield a, shingle_sets(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)


def _nodes(rows: DataFrame, size: int, layout: Layout) -> DataFrame:
    """id, hash of the text, number of shingles, two hashes of the set, and its keys; further rows (n = -1) for sets with more than
    KEYS_ROW keys.  A set that a task meets again comes without keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            ids, hashes = batch.column("id").to_pylist(), batch.column("hash").to_pylist()
            for a, sets in _blocks(batch, size):
                out = []
                for i, u in enumerate(sets):
                    if not len(u):
                        out.append((ids[a + i], hashes[a + i], 0, 0, 0, None))
                        continue
                    h1 = int(_mix(u).sum(dtype=np.uint64).view(np.int64))
                    h2 = int(_mix(u ^ _ODD[10]).sum(dtype=np.uint64).view(np.int64))
                    keys = layout.keys(u) if h1 not in met else np.zeros(0, np.int64)
                    if len(met) < 1 << 18:
                        met.add(h1)
                    out.append((ids[a + i], hashes[a + i], len(u), h1, h2, keys[:KEYS_ROW]))
                    out += [(None, None, -1, h1, h2, keys[k : k + KEYS_ROW]) for k in range(KEYS_ROW, len(keys), KEYS_ROW)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["id", "hash", "n", "h1", "h2", "keys"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return rows.mapInArrow(released(run), "id long, hash long, n long, h1 long, h2 long, keys array<long>")


def _packed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            flat, offsets = texts_of(batch, "text")
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                z = [press(flat[offsets[j] : offsets[j + 1]]) for j in range(i, i + len(part))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), pa.array(z, pa.binary())], names=["row", "id", "z"])

    return rows.mapInArrow(released(run), "row long, id long, z binary")


def _points(texts: DataFrame, size: int) -> DataFrame:
    """id, n and point of each packed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, len(batch), 256):
                part, n, points = batch.slice(i, 256), [], []
                for z in part.column("z"):
                    flat = np.frombuffer(unpack(z.as_py()), np.uint8)
                    u = shingle_sets(flat, np.array([0, len(flat)]), size)[0]
                    n.append(len(u))
                    points.append(pack_point(u))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(points, pa.binary())], names=["id", "n", "point"])

    return texts.mapInArrow(released(run), "id long, n long, point binary")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, layout: Layout) -> DataFrame:
    """The pairs (u, v) of nodes that are linked; a u with very many pairs is dealt to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def set_of(z: bytes) -> np.ndarray:
            flat = np.frombuffer(unpack(z), np.uint8)
            return shingle_sets(flat, np.array([0, len(flat)]), size)[0]

        last, mine = None, None
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            zu, zv, good = batch.column("zu"), batch.column("zv"), []
            for i in range(len(batch)):
                if u[i] != last:
                    last, mine = u[i], set_of(zu[i].as_py())
                other = set_of(zv[i].as_py())
                common = common_count(mine, other)
                good.append(100 * common >= layout.percent * (len(mine) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good))

    salts = pairs.groupBy("u").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    # u's text once for each of its salts; then its pairs come to it, dealt by v.
    left = texts.select(F.col("id").alias("u"), F.col("z").alias("zu")).join(salts, "u").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    with_v = pairs.join(texts.select(F.col("id").alias("v"), F.col("z").alias("zv")), "v").join(salts, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))
    both = with_v.select("u", "salt", "v", "zv").join(left.select("u", "salt", "zu"), ["u", "salt"])
    return both.select("u", "v", "zu", "zv").mapInArrow(released(run), "u long, v long")


def _searched(dealt: DataFrame, layout: Layout) -> DataFrame:
    """dealt: lead, class, part, block, id, n, point, component, data, asks.  The pairs (u, v) of different components that each
    part's R-tree leaves for the rows that ask."""

    def group(ids, n, packed, component, data, asks) -> Iterator[np.ndarray]:
        own = np.flatnonzero(data)
        if not len(own):
            return
        points = unpack_points(packed, min(TREE_BITS, max(COARSE_BITS, int(n.max()).bit_length())))
        tree, spelt = RTree(points[own], n[own]), {}
        for i in np.flatnonzero(asks):
            hit = own[tree.search(points[i], int(n[i]), layout)]
            hit = hit[component[hit] != component[i]]
            mine = spelled(packed[i])
            for j in hit.tolist():
                if j not in spelt:
                    spelt[j] = spelled(packed[j])
            hit = hit[np.array([common_count(mine, spelt[j]) >= layout.needed(n[i] + n[j]) for j in hit.tolist()], bool)]
            if len(hit):
                yield np.stack([np.minimum(ids[i], ids[hit]), np.maximum(ids[i], ids[hit])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(t: pa.Table, all_: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            t = t.combine_chunks()
            by = np.stack([t.column(c).to_numpy() for c in ("lead", "class", "part", "block")])
            start = np.flatnonzero(np.append(True, (by[:, 1:] != by[:, :-1]).any(0))) if len(t) else np.zeros(0, int)
            last = len(start) if all_ else len(start) - 1
            if last <= 0:
                return None, t
            ends = np.append(start[1:], len(t))
            cols = [t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "component", "data", "asks")]
            packed = t.slice(0, int(ends[last - 1])).column("point").to_pylist()
            found = []
            for a, b in zip(start[:last].tolist(), ends[:last].tolist()):
                found += group(cols[0][a:b], cols[1][a:b], packed[a:b], cols[2][a:b], cols[3][a:b].astype(bool), cols[4][a:b].astype(bool))
            rest = t.slice(int(ends[last - 1]))
            if not found:
                return None, rest
            pair = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["u", "v"]), rest

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            found, held = solve(held, False)
            if found is not None:
                yield found
        if held is not None and len(held):
            found, _ = solve(held, True)
            if found is not None:
                yield found

    by = ["lead", "class", "part", "block"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(released(run), "u long, v long")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast what is known to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_hash(text: str) -> F.Column:
    """What groups() calls a row's hash."""
    return F.xxhash64(F.col(text))


def groups(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, hash of the text, n (shingles), component (of linked texts, whatever their ids; null without shingles) and least (the
    component's smallest id) of every row of docs."""
    layout = Layout(percent)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_hash(text).alias("hash"), F.col(text).alias("text"))
    all_nodes = written(_nodes(rows, size, layout), "ngram-nodes")
    nodes, alike = written(all_nodes.filter("n >= 0").drop("keys"), "ngram-slim"), ["n", "h1", "h2"]
    # A set's id is its node; `row` with it names rows that have its text (equal ones), `least` is the smallest id.
    one = F.min(F.struct("hash", "id"))
    sets = written(nodes.filter("n > 0").groupBy(*alike).agg(one["hash"].alias("id"), one["id"].alias("row"), F.min("id").alias("least")), "ngram-sets")
    keys = all_nodes.select(F.explode("keys").alias("key"), "h1")
    shared = written(keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a != b").select("key"), "ngram-shared")
    members = written(keys.join(shared, "key", "left_semi").distinct(), "ngram-members")
    discard(shared)
    # A key's lead is the member that shares most keys.
    support = members.groupBy("h1").agg(F.count("*").alias("k")).withColumn("lead", F.col("k") * F.lit(2**40) + F.pmod("h1", F.lit(2**40)))
    graded = members.join(support.select("h1", "lead"), "h1")
    leads = graded.groupBy("key").agg(F.max("lead").alias("lead"))
    middle = graded.join(leads, ["key", "lead"]).groupBy("key").agg(F.min("h1").alias("lead"))
    around = written(members.join(middle, "key").select("lead", F.pmod("key", F.lit(64)).cast("int").alias("class"), "h1").distinct(), "ngram-around")
    discard(members, all_nodes)
    # Texts and points of all sets that lie in a neighbourhood.
    need = around.select("h1").distinct().join(sets.select("h1", "id", "row"), "h1").select("id", "row")
    packed = _packed(rows)
    texts = written(packed.join(need, (packed["id"] == need["id"]) & packed["row"].eqNullSafe(need["row"]), "left_semi").groupBy("id").agg(F.first("z").alias("z")), "ngram-texts")
    points = written(_points(texts, size), "ngram-points")
    told = sets.select("h1", "id").join(points, "id")
    count = written(around.groupBy("lead", "class").agg(F.count("*").alias("members")), "ngram-count")
    parts = F.ceil(F.col("members") / CHUNK).cast("int")

    # The leads' searches.
    everyone = around.join(_small(count), ["lead", "class"]).join(told, "h1").withColumn("component", F.col("id"))
    spread = {"block": F.lit(0), "data": F.col("h1") != F.col("lead"), "asks": F.col("h1") == F.col("lead")}
    everyone = everyone.withColumns(spread).withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), parts).cast("int")))))
    columns = ["lead", "class", "part", "block", "id", "n", "point", "component", "data", "asks"]
    star = written(_searched(everyone.select(*columns), layout).distinct(), "ngram-star")
    links = written(_verified(star, texts, size, layout), "ngram-links")
    found = written(components(links), "ngram-components")

    # What is left: neighbourhoods with three sets or more that still lie in several components.
    placed = told.join(found, told["id"] == found["node"], "left").select("h1", "id", "n", "point", F.coalesce("component", "id").alias("component"))
    at = around.join(placed.select("h1", "id", "component"), "h1")
    most = at.groupBy("lead", "class", "component").agg(F.count("*").alias("k"))
    state = most.groupBy("lead", "class").agg(F.sum("k").alias("members"), F.count("*").alias("several"), F.max(F.struct("k", "component")).alias("m"))
    state = written(state.filter("members > 2 and several > 1").select("lead", "class", "members", F.col("m.component").alias("main"), (F.col("members") - F.col("m.k")).alias("asking")), "ngram-state")
    left = written(at.join(_small(state), ["lead", "class"]).select("lead", "class", "members", "asking", "main", "h1", "id", "component"), "ngram-left")
    # Its lead has asked already; data and asking rows are both dealt in parts of bounded size.
    blocks = F.ceil(F.col("asking") / CHUNK).cast("int")
    left = left.filter("h1 != lead").withColumn("asks", F.col("component") != F.col("main"))
    part, block = F.pmod(F.xxhash64("id"), parts).cast("int"), F.pmod(F.xxhash64(F.lit(1), "id"), blocks).cast("int")
    data = left.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    data = data.withColumn("asks", F.col("asks") & (F.col("block") == block)).withColumn("data", F.lit(True))
    asks = left.filter("asks").withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).filter(F.col("part") != part).withColumn("data", F.lit(False))
    both = data.select("lead", "class", "part", "block", "id", "component", "data", "asks").unionByName(asks.select("lead", "class", "part", "block", "id", "component", "data", "asks"))
    more = written(_searched(both.join(placed.select("id", "n", "point"), "id").select(*columns), layout).distinct(), "ngram-more")
    more_links = written(_verified(more, texts, size, layout), "ngram-more-links")
    if not more_links.isEmpty():
        discard(found)
        found = written(components(links.unionByName(more_links)), "ngram-components")
    ids = sets.join(found, sets["id"] == found["node"], "left").select(*alike, "least", F.coalesce("component", "id").alias("component"))
    least = ids.groupBy("component").agg(F.min("least").alias("least"))
    ids = ids.drop("least").join(least, "component")
    out = written(nodes.select("id", "hash", *alike).join(ids, alike, "left").select("id", "hash", "n", "component", "least"), "ngram-groups")
    discard(nodes, sets, around, count, state, star, texts, points, links, found, left, more, more_links)
    return out


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links lead to) of every row of docs."""
    found = groups(docs, size, percent, doc_id, text)
    # An id whose texts lie in several components makes them one.
    named = found.filter("id is not null and component is not null")
    split = written(named.groupBy("id").agg(F.min("component").alias("v"), F.max("component").alias("w")).filter("v != w").select("id", "v"), "ngram-split")
    least = F.col("least")
    if not split.isEmpty():
        joined = components(named.join(split, "id").select(F.col("component").alias("u"), "v").filter("u != v"))
        whole = named.select(F.col("component").alias("node"), "least").distinct().join(joined.withColumnRenamed("component", "all"), "node")
        whole = whole.join(whole.groupBy("all").agg(F.min("least").alias("__least")), "all").select("node", "__least")
        found = found.join(whole, found["component"] == whole["node"], "left")
        least = F.coalesce("__least", "least")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(least, "id").alias("component_id"))
