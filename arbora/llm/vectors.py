"""Embedding columns: which vectors count, equal lengths, whole numbers, and matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers beyond this count as this, so that differences of two fit a long.
MOST = 2**61


def finite(column: str) -> Column:
    """Whether a vector is there and holds no null, NaN or infinity; never null."""
    odd = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(odd, F.lit(False))


def whole(column: str, scale: int, plus: int = 0) -> Column:
    """floor(scale * x) + plus of each component x, x as double."""
    bound = lambda x: F.greatest(F.lit(-MOST).cast("long"), F.least(F.lit(MOST).cast("long"), x))
    return F.transform(F.col(column), lambda x: bound(F.floor(x.cast("double") * scale).cast("long")) + F.lit(plus).cast("long"))


def aligned(rows: DataFrame, column: str, fill: Column) -> DataFrame:
    """Rows whose vectors are all as long as the longest, shorter ones filled up."""
    least, most = rows.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if least == most:
        return rows
    return rows.withColumn(column, F.concat(column, F.array_repeat(fill, F.lit(most) - F.size(column))))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of equally long vectors without nulls, a row each."""
    col = batch.column(column)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))
