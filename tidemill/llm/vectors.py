"""Vectors as whole numbers, for operators whose results must be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole components below this are squared and summed exactly by doubles.
EXACT_IN_DOUBLE = 1 << 21
#: Whole components beyond this have squared distances that no long holds.
LARGEST = 1 << 27


def sound(vector: Column) -> Column:
    """Not null, no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def whole_vectors(vectors: DataFrame, embedding: str, *columns: Column) -> DataFrame:
    """``columns`` and ``v``: each component times 256, rounded down, of sound vectors.
    A vector with a component of LARGEST or beyond is left out: what is asked of it
    would not fit a long."""
    v = F.col(embedding)
    scaled = vectors.filter(sound(v)).select(*columns, F.transform(v, lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return scaled.filter(~F.exists("v", lambda x: (x >= LARGEST) | (x <= -LARGEST))).withColumn("v", F.col("v").cast("array<int>"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``size`` components, as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)
