"""Rules that go through the rows of a key in order and remember something: parallel prefixes of small automata.

Rows are sorted by ranges of (by, order) and written once, so a key with a third of all rows is many ranges.  A task goes through
its range in pages of PAGE rows, so what it holds doesn't grow with the range.  Inside a page each key's rows are a block, and one
pass gives every row what it does for any state that the block may be entered with, and the block a map from entry to exit state.
Only the first and the last block of a page can go on in another one: their maps (two a page at most) are composed along each key
in the order of the pages, which tells the states that blocks are entered with, and these few are broadcast to the rows.  Nothing
gathers the rows of a key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import cut

#: Before all times, and after them.
MIN, MAX = -(2**63), 2**63 - 1
#: The rows of a page, and the bytes from which on a page is full with fewer.
PAGE, PAGE_BYTES = 1 << 15, 1 << 25


def _pages(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of batches as tables of `rows` rows, or of fewer that are large."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        while batch.num_rows:
            part, batch = batch.slice(0, rows - n), batch.slice(rows - n)
            held.append(part)
            n, size = n + part.num_rows, size + part.nbytes
            if n == rows or size >= PAGE_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _blocks(rows: DataFrame, by: Sequence[str], order: Sequence[str], reads: Sequence[str], adds: str, exit_type: str, annotate: Callable[[dict, np.ndarray], tuple[list, list]], page: int = PAGE) -> DataFrame:
    """rows with __p (the page, numbered in order), __i (the place in it), the columns `adds`, and on the last row of a page's first
    and last block `__exit`.  annotate(columns `reads`, first rows of blocks and the end) gives the values of `adds`, and an exit for
    each block."""
    more = T.StructType.fromDDL(f"__p long, __i long, {adds}, __exit {exit_type}")
    schema = T.StructType([*rows.schema.fields, *more.fields])
    arrow = to_arrow_schema(more)

    def paged(table: pa.Table, at: int) -> pa.Table:
        n, new = len(table), np.zeros(len(table), bool)
        new[0] = True
        for c in by:
            code = np.asarray(table.column(c).dictionary_encode(null_encoding="encode").combine_chunks().indices)
            new[1:] |= code[1:] != code[:-1]
        edges = np.append(np.flatnonzero(new), n)
        values, exits = annotate({c: table.column(c) for c in reads}, edges)
        last = [None] * n
        for k in {0, len(edges) - 2}:
            last[edges[k + 1] - 1] = exits[k]
        told = [pa.array(np.full(n, at, np.int64)), pa.array(np.arange(n)), *[pa.array(v, f.type) for v, f in zip(values, list(arrow)[2:-1])], pa.array(last, arrow.field("__exit").type)]
        for name, column in zip(arrow.names, told):
            table = table.append_column(name, column)
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 20
        for at, table in enumerate(_pages(batches, page), first):
            yield from paged(table, at).to_batches(max_chunksize=10_000)

    return cut(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(run, schema), "automata")


def _entered(blocks: DataFrame, by: Sequence[str], begin: Column, after: Callable[[Column, Column], Column]) -> DataFrame:
    """For blocks that another page's block of the key may precede: by (as __b0, ...), __q (the page), and __entry, the state at
    its beginning.  after(state, block's exit): the state at its end."""
    ends = blocks.filter("__exit is not null").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__p", "__exit"))).alias("e")).filter(F.size("e") > 1)
    kind = ends.select(begin.alias("s")).schema["s"].dataType.simpleString()
    step = lambda acc, x: F.struct(after(acc["s"], x["__exit"]).alias("s"), F.array_append(acc["out"], F.struct(x["__p"].alias("p"), acc["s"].alias("s"))).alias("out"))
    found = ends.select(*by, F.explode(F.aggregate("e", F.struct(begin.alias("s"), F.expr(f"cast(array() as array<struct<p:bigint,s:{kind}>>)").alias("out")), step, lambda acc: acc["out"])).alias("x"))
    return found.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col("x.p").alias("__q"), F.col("x.s").alias("__entry"))


def _joined(blocks: DataFrame, by: Sequence[str], entries: DataFrame) -> DataFrame:
    same = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    # Two rows a page at most.
    return blocks.join(F.broadcast(entries), same, "left").drop("__q", *[f"__b{i}" for i in range(len(by))])


def stepped(rows: DataFrame, by: Sequence[str], order: Sequence[str], symbol: str, table: Sequence[Sequence[int]], begin: int = 0, name: str = "state") -> DataFrame:
    """rows with the state (0 to 14) that an automaton is in before each: table[symbol][state] is the next one.

    `symbol` is a whole number or a boolean; null counts as 0."""
    steps = np.array(table, np.int64)
    states = steps.shape[1]
    if not 0 < states <= 15 or steps.min() < 0 or steps.max() >= states:
        raise ValueError("between 1 and 15 states")
    shift = 4 * np.arange(states)

    def annotate(columns: dict, edges: np.ndarray) -> tuple[list, list]:
        said = columns[symbol].combine_chunks()
        said = said.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        first = np.repeat(edges[:-1], np.diff(edges))
        # Maps of 1, 2, 4, ... rows up to each row, by doubling; none reaches over the beginning of its block.
        upto, step = steps[said], 1
        while step < len(said):
            ok = np.flatnonzero(np.arange(len(said)) - step >= first)
            if not len(ok):
                break
            upto[ok] = np.take_along_axis(upto[ok], upto[ok - step], 1)
            step *= 2
        before = np.empty_like(upto)
        before[1:] = upto[:-1]
        before[edges[:-1]] = np.arange(states)
        pack = lambda m: (m << shift).sum(1)
        return [pack(before)], pack(upto[edges[1:] - 1]).tolist()

    blocks = _blocks(rows, by, order, [symbol], "__map long", "long", annotate)
    at = lambda packed, state: F.call_function("shiftright", packed, (state * 4).cast("int")).bitwiseAND(F.lit(15).cast("long")).cast("int")
    entries = _entered(blocks, by, F.lit(begin), lambda s, e: at(e, s))
    out = _joined(blocks, by, entries).withColumn(name, at(F.col("__map"), F.coalesce("__entry", F.lit(begin))))
    return out.drop("__p", "__i", "__map", "__exit", "__entry")


def _holds(x: Column, low: Column, high: Column) -> Column:
    """Whether x is in (low, high], where a range whose low is above its high goes round: beyond low, or up to high."""
    return F.when(low < high, (low < x) & (x <= high)).otherwise((low < x) | (x <= high))


def _chains(at: list[int], reset: list[bool], window: int) -> tuple[list[int], list[int], list[dict]]:
    """What a block of renewals does when what began before it leaves it closed until x: row j begins if x is in (low[j], high[j]],
    and the block leaves, for an x in (low, high], `began` as the time of the last row that began.  Ranges can go round.

    The first row to begin is the first at x or later, or the first reset.  That is a row in the first window, or the row after
    it, where the chain of the first row goes on too: so the chains of these candidates, in order of time, are a ring.  Chains
    that meet in a row are neighbours in it, and go on as one."""
    n = len(at)
    low, high = [MAX] * n, [MIN] * n
    chains: deque[tuple[int, int, int]] = deque()  # each: when it can begin again, low, high
    first = True
    end = at[0] + window
    for j in range(n):
        t, met = at[j], []
        while chains and (reset[j] or chains[0][0] <= t):
            met.append(chains.popleft())
        if first and (reset[j] or t >= end):  # whatever x is, something has begun by now
            first = False
            a, b = at[j - 1] if j else MIN, met[-1][2] if met else MAX
        elif first and (j == 0 or t > at[j - 1]):
            a, b = at[j - 1] if j else MIN, t
        elif met:
            a, b = met[0][1], met[-1][2]
        else:
            continue
        if met and not chains:
            a, b = MIN, MAX  # all of them
        low[j], high[j] = a, b
        chains.append((t + window, a, b))
    return low, high, [{"low": a, "high": b, "began": t - window} for t, a, b in chains]


def renewed(rows: DataFrame, by: Sequence[str], order: Sequence[str], at: str, window: int, tag: str | None = None, gap: int | None = None) -> DataFrame:
    """rows with `begins`: whether the time `at` (a long, in order) is `window` or more after that of the last row of the key that
    began; `began`, the time of the last row that began, this one included; and `turn`, how many rows of the key have begun.

    A row also begins if its `tag` isn't that of the row before (a null tag equals none), or if it comes more than `gap` after it;
    a key's first row begins.  Times must not be null."""

    def annotate(columns: dict, edges: np.ndarray) -> tuple[list, list]:
        times = columns[at].to_numpy()
        tags = columns[tag].to_pylist() if tag else [0] * len(times)
        low, high, exits = [], [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            t, s = times[a:b].tolist(), tags[a:b]
            new = [s[j] is None or s[j] != s[j - 1] or (gap is not None and t[j] - t[j - 1] > gap) for j in range(1, b - a)]
            x, y, left = _chains(t, [s[0] is None, *new], window)
            low += x
            high += y
            exits.append({"at": t[0], "tag": None if s[0] is None else str(s[0]), "last_at": t[-1], "last_tag": None if s[-1] is None else str(s[-1]), "chains": left})
        return [low, high], exits

    exit_type = "struct<at: long, tag: string, last_at: long, last_tag: string, chains: array<struct<low: long, high: long, began: long>>>"
    blocks = _blocks(rows, by, order, [at] + ([tag] if tag else []), "__low long, __high long", exit_type, annotate)
    nothing = F.expr("cast(null as bigint)")
    begin = F.struct(nothing.alias("began"), nothing.alias("last_at"), F.expr("cast(null as string)").alias("last_tag"))

    def opens(state: Column, block: Column) -> Column:
        """From when on the block's first row can begin."""
        same = F.coalesce(state["last_tag"] == block["tag"], F.lit(False))
        near = F.lit(True) if gap is None else block["at"] - state["last_at"] <= gap
        return F.coalesce(F.when(same & near, state["began"] + window), F.lit(MIN + 1))

    def after(state: Column, block: Column) -> Column:
        x = opens(state, block)
        hit = F.filter(block["chains"], lambda c: _holds(x, c["low"], c["high"]))
        return F.struct(F.coalesce(F.try_element_at(hit, F.lit(1))["began"], state["began"]).alias("began"), block["last_at"].alias("last_at"), block["last_tag"].alias("last_tag"))

    entries = _entered(blocks, by, begin, after)
    heads = blocks.filter("__exit is not null").select(*[F.col(c).alias(f"__h{i}") for i, c in enumerate(by)], F.col("__p").alias("__r"), F.struct("__exit.at", "__exit.tag").alias("__head"))
    same = F.col("__q") == F.col("__r")
    for i in range(len(by)):
        same = same & F.col(f"__b{i}").eqNullSafe(F.col(f"__h{i}"))
    entries = entries.join(heads, same).withColumn("__entry", F.struct(F.col("__entry.began").alias("began"), opens(F.col("__entry"), F.col("__head")).alias("x"))).drop("__head", "__r", *[f"__h{i}" for i in range(len(by))])
    told = _joined(blocks, by, entries)
    begins = _holds(F.coalesce("__entry.x", F.lit(MIN + 1)), F.col("__low"), F.col("__high"))
    told = told.withColumn("begins", begins)
    # Inside a block: the last row that began, and how many; before it: those of the key's blocks in other pages.
    here = Window.partitionBy("__p", *by).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumns({"began": F.coalesce(F.last(F.when(F.col("begins"), F.col(at)), True).over(here), F.col("__entry.began")), "turn": F.sum(F.col("begins").cast("long")).over(here)})
    open_ = F.broadcast(entries.select("__q", *[f"__b{i}" for i in range(len(by))]))
    match = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    each = _joined(blocks.join(open_, match, "left_semi"), by, entries).filter(begins).groupBy("__p", *by).agg(F.count("*").alias("__k"))
    whole = entries.select(F.col("__q").alias("__p"), *[F.col(f"__b{i}").alias(c) for i, c in enumerate(by)])
    counts = _null_safe(whole, each, ["__p", *by])
    before = F.sum(F.coalesce("__k", F.lit(0))).over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    moved = counts.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.coalesce(before, F.lit(0)).alias("__more"))
    out = _joined(told, by, moved).withColumn("turn", F.col("turn") + F.coalesce("__more", F.lit(0)))
    return out.drop("__p", "__i", "__low", "__high", "__exit", "__entry", "__more")


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join by columns that may be null."""
    named = right.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__r{i}"))
    return left.join(named, same, "left").drop(*[f"__r{i}" for i in range(len(on))])
