"""Vectors of a table as fixed-width binary columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that can take part.

    Rows whose id or vector is null, or whose vector is empty or holds a null,
    infinite or not-a-number component, are left out. Rows of one id count as
    one: that with the smallest vector.
    """
    inside = df.schema[vector_col].dataType
    if not isinstance(inside, St.ArrayType):
        raise TypeError(f"{vector_col} must be an array column")
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .filter((F.size("v") > 0) & finite)
            .groupBy("vec_id").agg(F.min("v").alias("v")))
