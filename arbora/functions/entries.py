"""One version of one path: content comparisons and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

KINDS = ("File", "Directory", "Symlink", "Deleted")
ENTRY = ("kind", "size", "hash", "target", "mode", "clock", "seq", "stamp")


def same_bytes(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["hash"] == b["hash"]) & a["target"].eqNullSafe(b["target"])


def same_content(a: Column, b: Column) -> Column:
    """Equal bytes and, but for links, equal mode; the size is not compared."""
    return same_bytes(a, b) & ((a["kind"] == "Symlink") | (a["mode"] == b["mode"]))


def stamp(*fields: Column) -> Column:
    """A fingerprint of a file's metadata."""
    return F.concat_ws(":", *[f.cast("string") for f in fields])


#: Fixed value: the fields of a fingerprint, in order.
STAMP_FIELDS = ("dev", "ino", "size", "mtime", "mtime_nsec", "ctime", "ctime_nsec")


def fingerprint(row: dict[str, Column]) -> Column:
    """The stamp of a file from all its STAMP_FIELDS."""
    return stamp(*[row[f] for f in STAMP_FIELDS])


def content_hash(body: Column) -> Column:
    """SHA-256 in hex: the same contract of 64 digits as any other hash of content here."""
    return F.sha2(body, 256)


def violations(path: Column, kind: Column, size: Column, hash_: Column, target: Column, mode: Column, clock: Column) -> Column:
    """What is wrong with an entry, as an array of names."""
    devices = F.map_keys(clock)
    checks = {
        "path": F.size(paths.violations(path)) > 0,
        "clock size": (F.size(clock) < 1) | (F.size(clock) > 32),
        "clock counter": F.exists(F.map_values(clock), lambda v: v <= 0),
        "device": F.exists(devices, lambda d: ~d.rlike("^[0-9a-f]{64}$")),
        "file hash": (kind == "File") & ~hash_.rlike("^[0-9a-f]{64}$"),
        "mode": (mode < 0) | (mode > 0o777),
        "size": size < 0,
        "target": (kind == "Symlink") & (target.isNull() | F.contains(target, F.lit("\x00")) | (F.octet_length(target) > 4096) | (hash_ != F.sha2(target, 256))),
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())
