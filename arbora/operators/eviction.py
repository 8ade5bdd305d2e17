"""Caches that evict in order of insertion, exactly, by low-water marks.

What such a cache holds after its puts is decided by one number: everything put before the mark has gone at some time, and what
was put after it never did.  A put moves the mark to the first place from which the items that are live then (each key's newest
put so far) fit; what earlier puts have pushed out stays out, so the mark never goes back and the end's mark is the greatest of
all.  Each put's own mark depends on the newest live items alone, not on earlier marks, so puts are looked at in blocks: a page of
the sorted puts of a cache, and what is live when it begins.  That is composed along the pages from each block's newest items,
as many as can fit, so a cache with most of the puts is many tasks."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automata import PAGE, _blocks, _entered

_TAIL = "array<struct<place: long, key: string, bytes: long>>"


def marks(puts: Iterable[tuple[int, str, int]], held: OrderedDict[str, tuple[int, int]], budget: int, items: int) -> list[int]:
    """The mark after each put (place, key, bytes), into a cache that holds `held` (key -> place, bytes; oldest first): one past
    the place of the last item that was pushed out.  `held` is left as it is then."""
    total, mark, out = sum(n for _, n in held.values()), -1, []
    for place, key, n in puts:
        old = held.pop(key, None)
        if old is not None:
            total -= old[1]
        while held and (total + n > budget or len(held) >= items):
            _, (p, m) = held.popitem(last=False)
            total -= m
            mark = p + 1
        held[key] = (place, n)
        total += n
        out.append(mark)
    return out


def kept(puts: DataFrame, by: str, order: str, budget: int, items: int) -> DataFrame:
    """The puts (by, key, bytes, in the order of `order`) whose items a cache of `budget` bytes and `items` items holds at the end.

    Every put must fit alone.  A put of a key replaces what the key has, and makes room from the oldest item on."""
    rows = puts.withColumn("__key", F.col("key").cast("string"))

    def annotate(columns: dict, edges: np.ndarray) -> tuple[list, list]:
        keys, sizes = columns["__key"].to_pylist(), columns["bytes"].to_pylist()
        low, exits = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            held: OrderedDict[str, tuple[int, int]] = OrderedDict()
            low += marks(zip(range(a, b), keys[a:b], sizes[a:b]), held, budget, items)
            exits.append({"full": low[-1] >= 0, "size": sum(n for _, n in held.values()), "tail": [{"place": p, "key": k, "bytes": n} for k, (p, n) in held.items()]})
        return [low], exits

    blocks = _blocks(rows, [by], [order], ["__key", "bytes"], "__low long", f"struct<full: boolean, size: long, tail: {_TAIL}>", annotate, min(max(PAGE, items), 1 << 24))
    # Places inside a page become places of all.
    wide = F.shiftleft("__p", 24)
    blocks = blocks.withColumn("__place", wide + F.col("__i")).withColumn("__low", F.when(F.col("__low") >= 0, wide + F.col("__low")).otherwise(F.lit(-1)))
    tail = F.transform("__exit.tail", lambda x: F.struct((wide + x["place"]).alias("place"), x["key"].alias("key"), x["bytes"].alias("bytes")))
    blocks = blocks.withColumn("__exit", F.when(F.col("__exit").isNotNull(), F.struct(F.col("__exit.full").alias("full"), F.col("__exit.size").alias("size"), tail.alias("tail"))))

    def after(state: Column, block: Column) -> Column:
        """Live items after a block: its own, and before them what it left untouched; too many do no harm."""
        names = F.transform(block["tail"], lambda x: x["key"])
        older = F.filter(state, lambda x: ~F.array_contains(names, x["key"]))
        return F.when(block["full"], block["tail"]).otherwise(F.slice(F.concat(older, block["tail"]), -F.least(F.size(older) + F.size(block["tail"]), F.lit(items)), F.lit(items)))

    entries = _entered(blocks, [by], F.expr(f"cast(array() as {_TAIL})"), after).filter(F.size("__entry") > 0)
    entries = entries.select(F.col("__b0").alias("__c"), F.col("__q"), F.col("__entry").alias("__tail"))

    def replay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"__mark": np.zeros(0, np.int64)})
        left = left.sort_values("__i")
        held: OrderedDict[str, tuple[int, int]] = OrderedDict()
        before = marks(((x["place"], x["key"], x["bytes"]) for x in right["__tail"].iloc[0]), held, budget, items)
        own = marks(zip(left["__place"].tolist(), left["__key"], left["bytes"].tolist()), held, budget, items)
        return pd.DataFrame({"__mark": [max(before[-1], own[-1])]})

    # Only blocks that others of their cache precede are gone through again.
    again = blocks.join(F.broadcast(entries.select("__c", "__q")), F.col(by).eqNullSafe(F.col("__c")) & (F.col("__p") == F.col("__q")), "left_semi")
    cache = again.select(by).schema[0].dataType.simpleString()

    def solve(key, left, right):
        out = replay(left, right)
        out.insert(0, "__c", [key[0]] * len(out))
        return out

    seen = again.select(F.col(by).alias("__c"), F.col("__p").alias("__q"), "__i", "__place", "__key", "bytes").groupBy("__c", "__q").cogroup(entries.groupBy("__c", "__q")).applyInPandas(solve, f"__c {cache}, __mark long")
    low = blocks.select(F.col(by).alias("__c"), F.col("__low").alias("__mark")).unionByName(seen).groupBy("__c").agg(F.max("__mark").alias("__mark"))
    last = blocks.groupBy(by, "__key").agg(F.max_by(F.struct(*puts.columns, "__place"), "__place").alias("v")).select("v.*")
    return last.join(low, F.col(by).eqNullSafe(F.col("__c"))).filter("__place >= __mark").select(*puts.columns)
