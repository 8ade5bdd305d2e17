"""Intermediate tables in the folder that spark.checkpoint.dir names: written, read back, and deleted."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

#: What this process has written and not deleted, by path.
_made: dict[str, SparkSession] = {}
#: Tables of the catalog whose files lie at some of these paths.
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one, on a single machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="arbora-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes at the end of a scratch() block or of the process."""
    path = f"{shared_dir(spark)}/arbora/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.unregister(_discard_all)
        atexit.register(_discard_all)
    _made[path] = spark
    return path


def temporary_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new name for a table of the catalog, and the path for its files; both go as those of temporary() do."""
    path = temporary(spark, name)
    _tables[path] = f"arbora_{name}_{path.rpartition('-')[2]}"
    return _tables[path], path


def mounted(spark: SparkSession, path: str) -> str:
    """A path of the shared folder as plain file functions know it; an error where it isn't a mounted folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    if uri.getScheme() != "file":
        raise ValueError(f"{path} isn't in a mounted folder")
    return uri.getPath()


def cut(df: DataFrame, name: str, conf: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Cut the lineage of df: write it as Parquet in the shared folder and read it back.  conf: settings while it is written, each
    with the value that it has where it is unset, and the one to write with.

    The table is there until discard(), the end of a scratch() block around this call, or the end of the process."""
    spark = df.sparkSession
    path = temporary(spark, name)  # known before it is written: a write that fails leaves files too
    was = {key: spark.conf.get(key, default) for key, (default, _) in (conf or {}).items()}
    try:
        for key, (_, now) in (conf or {}).items():
            spark.conf.set(key, now)
        df.write.parquet(path)
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._arbora_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"drop table if exists {_tables.pop(path)}")
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def discard(*made: DataFrame) -> None:
    """Delete the files behind tables made by cut()."""
    for df in made:
        path = getattr(df, "_arbora_path", None)
        if path:
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that are cut inside go at the end of the block: results must be written or collected before."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            _delete(_made[path], path)


def _discard_all() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)
