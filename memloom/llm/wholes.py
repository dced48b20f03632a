"""Vectors as whole numbers, for operators whose sums must be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(v: Column) -> Column:
    """True for arrays without a null or a component that is not finite; false for null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_vectors(vectors: DataFrame, scale: int, limit: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the components floor(scale * x), of the rows whose vector is finite.

    A scaled component of `limit` or more in absolute value is an error.
    """

    def number(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < limit, F.floor(y)).otherwise(F.raise_error(F.lit(f"a scaled component is {limit:.4g} or more")).cast("long"))

    v = F.col(vector_col)
    return vectors.filter(is_finite(v)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, number).alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The rows of an Arrow list column whose lists all have `width` whole numbers."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)
