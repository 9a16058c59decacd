"""Aggregates with an order: mode by first seen, samples with a count of the rest, distinct in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_by


def first_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, n): the most frequent value of each key; ties go to the one seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("__quire_first"))
    return first_by(counts, keys, F.desc("n"), "__quire_first", value).drop("__quire_first")


def sample_of_groups(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """The first ``rows`` rows of each key, with the number that is left out (``overflow``)."""
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("__quire_rank", F.row_number().over(w.orderBy(*order))).withColumn("__quire_all", F.count("*").over(w))
    return numbered.filter(F.col("__quire_rank") <= rows).withColumn("overflow", F.greatest(F.col("__quire_all") - rows, F.lit(0))).withColumnRenamed("__quire_rank", "rank").drop("__quire_all")


def distinct_in_order(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, order): each value once, where it is first seen."""
    return df.groupBy(*keys, value).agg(F.min(order).alias(order))
