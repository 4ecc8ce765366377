"""Vector means per group, combined before the shuffle."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_vectors(
    df: DataFrame, keys: list[str], vec: str, name: str, weight: Column | None = None, *aggs: Column
) -> DataFrame:
    """Mean of an array column per group as one dense buffer per map task."""
    v = array_to_vector(F.col(vec))
    mean = Summarizer.mean(v) if weight is None else Summarizer.mean(v, weight)
    out = df.groupBy(*keys).agg(mean.alias(name), *aggs)
    return out.withColumn(name, vector_to_array(name))
