"""Version vectors: maps from device to counter, where a missing device counts 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _either(a: Column, b: Column, test) -> Column:
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    return F.exists(pairs, lambda p: test(p["x"], p["y"]))


def relation(a: Column, b: Column) -> Column:
    """Equal, Before (a is older), After or Concurrent; null if either is null."""
    above, below = _either(a, b, lambda x, y: x > y), _either(a, b, lambda x, y: x < y)
    return F.when(above & below, "Concurrent").when(above, "After").when(below, "Before").when(a.isNotNull() & b.isNotNull(), "Equal")


def merge(a: Column, b: Column) -> Column:
    """The larger counter of each device; null counts as no devices."""
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.greatest(x, y))


def includes(older: Column, newer: Column) -> Column:
    """Whether newer knows all that older does."""
    return relation(older, newer).isin("Before", "Equal")


def bump(clock: Column, device: str) -> Column:
    """One more event of a device."""
    return F.map_concat(drop_device(clock, device), F.create_map(F.lit(device), F.coalesce(clock[device], F.lit(0)) + 1))


def drop_device(clock: Column, device: str) -> Column:
    return F.map_filter(clock, lambda k, _: k != device)


def text(clock: Column) -> Column:
    """The clock in one canonical spelling: device:counter in order of devices, without zeros."""
    entries = F.array_sort(F.map_entries(F.map_filter(clock, lambda _, v: v > 0)))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
