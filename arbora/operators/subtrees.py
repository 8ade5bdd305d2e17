"""What lies below what: one sweep over paths in the order of their trees.

Paths are sorted so that all below a path follow it at once ("/" comes before every other character).  Then the paths that cover
a row are a stack: going on, what doesn't cover the next row is closed for good.  The sweep goes through pages of the sorted
rows; a page starts with the stack that the pages before leave open, which takes one row a page.  So each path is shuffled
once, however deep it is, and a folder is as many tasks as it has ranges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automata import _blocks, _entered, _joined

_STACK = "array<struct<root: string, value: long>>"


def _covers(root: Column, key: Column, proper: bool) -> Column:
    below = F.startswith(key, F.concat(root, F.lit("\x00")))
    return below if proper else below | (key == root)


def above(rows: DataFrame, by: Sequence[str], path: str, value: str, proper: bool = True, name: str = "above") -> DataFrame:
    """rows with the least `value` of the rows of the same key (by) whose path is above theirs (proper: not equal to it), or null.

    Rows with a null value cover nothing.  `value` is a long.  Null paths neither cover nor are covered."""
    ordered = rows.withColumns({"__path": F.replace(F.coalesce(path, F.lit("")), F.lit("/"), F.lit("\x00")), "__last": F.col(value).isNull()})

    def annotate(columns: dict, edges: np.ndarray) -> tuple[list, list]:
        keys, values = columns["__path"].to_pylist(), columns[value].to_pylist()
        found: list[int | None] = [None] * len(keys)
        exits = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            stack: list[tuple[str, int, int]] = []  # path, value, and the least value from the bottom to here
            for i in range(a, b):
                k = keys[i]
                while stack and not (k.startswith(stack[-1][0] + "\x00") or (not proper and k == stack[-1][0])):
                    stack.pop()
                if not k:
                    continue
                if stack:
                    found[i] = stack[-1][2]
                if values[i] is not None:
                    stack.append((k, values[i], min(values[i], stack[-1][2]) if stack else values[i]))
            exits.append({"last": keys[b - 1], "stack": [{"root": k, "value": v} for k, v, _ in stack]})
        return [found], exits

    blocks = _blocks(ordered, by, ["__path", "__last"], ["__path", value], "__own long", f"struct<last: string, stack: {_STACK}>", annotate)
    after = lambda state, block: F.concat(F.filter(state, lambda r: _covers(r["root"], block["last"], proper)), block["stack"])
    entries = _entered(blocks, by, F.expr(f"cast(array() as {_STACK})"), after)
    open_ = F.filter("__entry", lambda r: _covers(r["root"], F.col("__path"), proper))
    least = F.least("__own", F.array_min(F.transform(open_, lambda r: r["value"])))
    return _joined(blocks, by, entries).withColumn(name, least).drop("__p", "__i", "__path", "__last", "__own", "__exit", "__entry")


def outermost(rows: DataFrame, by: Sequence[str], path: str) -> DataFrame:
    """Rows that have no other row of their key above them."""
    return above(rows.withColumn("__one", F.lit(0).cast("long")), by, path, "__one").filter("above is null").drop("__one", "above")
