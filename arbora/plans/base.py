"""The register of named queries, and pieces of SQL that oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under a name, with its SQL twin."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rel(a: str, b: str) -> str:
    above, below = f"({a}.ca > {b}.ca or {a}.cb > {b}.cb)", f"({a}.ca < {b}.ca or {a}.cb < {b}.cb)"
    return f"(case when {above} and {below} then 'Concurrent' when {above} then 'After' when {below} then 'Before' else 'Equal' end)"


def bytes_eq(a: str, b: str) -> str:
    return f"({a}.kind = {b}.kind and {a}.hash = {b}.hash and {a}.target is not distinct from {b}.target)"


def content_eq(a: str, b: str) -> str:
    return f"({bytes_eq(a, b)} and ({a}.kind = 'Symlink' or {a}.mode = {b}.mode))"


def clock_text(ca: str, cb: str) -> str:
    return f"concat_ws(',', case when {ca} > 0 then concat('A:', {ca}) end, case when {cb} > 0 then concat('B:', {cb}) end)"
