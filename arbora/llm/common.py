"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, discard, shared_dir  # noqa: F401  discard and shared_dir are used from here

#: Words of the contracts: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: While a step is written: shuffle files go with it, so that steps don't add up on disk; a join's partition is split among
#: tasks from a few MB on where it is much larger than the others (one hot key).
_STEP = {
    CLEANUP: ("false", "true"),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": ("256MB", "4MB"),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": ("5.0", "3.0"),
}


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it as Parquet in the shared folder and read it back."""
    return cut(df, name, _STEP)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000: with texts of some KB (and files made of them) a task holds some MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets into them; nulls are empty."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.large_binary()
    col = col.cast(pa.large_string()).cast(kind) if not pa.types.is_large_binary(col.type) and not pa.types.is_binary(col.type) else col.cast(kind)
    if col.null_count:
        col = pa.compute.fill_null(col, pa.scalar(b"", kind))
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]] if len(offsets) else flat[:0], offsets - offsets[0]


def released(run):
    """run, and then what it no longer needs goes back to the system: Python workers live on for the next stage."""

    def lean(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return lean


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer text is a range of its own."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, min(end, n)))
        at = out[-1][1]
    return out


def hash60(*columns) -> F.Column:
    """A number from 0 to 2**60 - 1 out of MD5: the same on every engine and in every run."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
