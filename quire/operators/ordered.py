"""Ordered analytics over records of a document: one shuffle on the key, one sort, windows that share both."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], *order: str | Column) -> Window:
    """The window of a document's records in order; ``order`` must be total, or two windows may differ on ties."""
    return Window.partitionBy(*keys).orderBy(*order)


def up_to_here(w) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(value: Column, w) -> Column:
    """The last value that isn't null, this record's included."""
    return F.last(value, ignorenulls=True).over(up_to_here(w))


def latched(flag: Column, w) -> Column:
    """True from the first record on where ``flag`` holds."""
    return F.max(F.coalesce(flag, F.lit(False))).over(up_to_here(w))


def running_count(flag: Column, w) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).over(up_to_here(w))


def island(starts: Column, w) -> Column:
    """Number of the run that a record belongs to; a run begins where ``starts`` holds (or is null, as at the first record)."""
    return F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(up_to_here(w))


def merge_cite_runs(df: DataFrame, keys: list[str], order: str, part: str) -> DataFrame:
    """(keys, order, part): consecutive parts that are one numbered citation each, as one part at the place of the first.

    Numbers of one digit each are the digits of one number that was split; others are a list. All else stays as it is.
    """
    number = F.regexp_extract(part, r"^\\citep\{([0-9]+)\}$", 1)
    own = df.select(*keys, F.col(order).alias("__quire_at"), F.col(part).alias("__quire_part"), F.nullif(number, F.lit("")).alias("__quire_n"))
    wo = ordered(keys, "__quire_at")
    alone = F.col("__quire_n").isNull() | F.lag("__quire_n").over(wo).isNull()
    runs = own.withColumn("__quire_run", island(alone, wo)).groupBy(*keys, "__quire_run").agg(
        F.min("__quire_at").alias(order), F.min("__quire_part").alias("__quire_part"), F.array_sort(F.collect_list(F.when(F.col("__quire_n").isNotNull(), F.struct("__quire_at", "__quire_n")))).alias("__quire_ns")
    )
    numbers = F.transform("__quire_ns", lambda x: x["__quire_n"])
    digits = F.forall(numbers, lambda n: F.length(n) == 1)
    merged = F.concat(F.lit("\\citep{"), F.when(digits, F.array_join(numbers, "")).otherwise(F.array_join(numbers, ",")), F.lit("}"))
    return runs.select(*keys, order, F.when(F.size("__quire_ns") > 1, merged).otherwise(F.col("__quire_part")).alias(part))


def gap_clusters(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, cluster, lo, hi, mean, n): values whose distance to the one before is under the tolerance cluster together."""
    w = ordered(keys, value)
    numbered = df.withColumn("__quire_start", F.col(value) - F.lag(value).over(w) >= tolerance)
    numbered = numbered.withColumn("cluster", island(F.col("__quire_start"), w))
    return numbered.groupBy(*keys, "cluster").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def coalesce_intervals(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """(keys, lo, hi): overlapping and touching intervals merged. Repeated intervals count once."""
    w = ordered(keys, lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = df.select(*keys, lo, hi).distinct().withColumn("__quire_start", F.col(lo) > before)
    numbered = numbered.withColumn("__quire_island", island(F.col("__quire_start"), w))
    return numbered.groupBy(*keys, "__quire_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__quire_island")


def anchored_clusters(df: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """(key, value, cluster): a value joins the cluster whose *first* value it is within the tolerance of.

    Unlike gap clusters this looks back to where the cluster began, so it goes through a group's rows in order.
    """
    kinds = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(value, kind="stable")
        number, anchor, out = 0, None, []
        for v in group[value]:
            if anchor is None or not v - anchor < tolerance:
                number, anchor = number + 1, v
            out.append(number)
        return group.assign(cluster=out)

    return df.select(key, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {value} {kinds[value]}, cluster int")


def midpoints(value: Column, w) -> tuple[Column, Column]:
    """Boundaries halfway to the neighbours; null at the edges."""
    return (F.lag(value).over(w) + value) / 2, (value + F.lead(value).over(w)) / 2


def look_ahead(df: DataFrame, keys: list[str], order: str, value: Column, blocked: Column, rows: int, name: str) -> DataFrame:
    """``df`` with the first value among the next ``rows`` records, null if a blocking record comes before it."""
    w = ordered(keys, order)
    ahead = w.rowsBetween(1, rows)
    numbered = df.withColumn("__quire_n", F.row_number().over(w)).withColumn("__quire_v", value).withColumn("__quire_b", blocked)
    hit = F.first(F.when(F.col("__quire_v").isNotNull(), F.struct("__quire_n", "__quire_v")), ignorenulls=True).over(ahead)
    stop = F.min(F.when(F.col("__quire_b"), F.col("__quire_n"))).over(ahead)
    out = numbered.withColumn("__quire_hit", hit).withColumn("__quire_stop", stop)
    clear = F.col("__quire_stop").isNull() | (F.col("__quire_stop") > F.col("__quire_hit.__quire_n"))
    return out.withColumn(name, F.when(clear, F.col("__quire_hit.__quire_v"))).drop("__quire_n", "__quire_v", "__quire_b", "__quire_hit", "__quire_stop")


def bracket_pairs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, open, close, inside): the outermost pairs of round brackets in a text, by places from 0.

    An opening bracket pairs with the next closing one at its depth, so one window gives the depths and one over
    (keys, depth) the pairs, in linear work. Brackets without a partner contain nothing.
    """
    chars = df.select(*keys, F.col(text).alias("__quire_text"), F.posexplode(F.split(text, "")).alias("__quire_at", "__quire_c")).filter(F.col("__quire_c").isin("(", ")"))
    opens = F.col("__quire_c") == "("
    running = F.sum(F.when(opens, 1).otherwise(-1)).over(ordered(keys, "__quire_at").rowsBetween(Window.unboundedPreceding, 0))
    level = chars.withColumn("__quire_depth", running + F.when(opens, 0).otherwise(1))
    paired = level.withColumn("__quire_close", F.lead("__quire_at").over(ordered([*keys, "__quire_depth"], "__quire_at"))).filter(opens & F.col("__quire_close").isNotNull())
    before = F.max("__quire_close").over(ordered(keys, "__quire_at").rowsBetween(Window.unboundedPreceding, -1))
    outer = paired.withColumn("__quire_before", before).filter(F.col("__quire_before").isNull() | (F.col("__quire_before") < F.col("__quire_at")))
    a, b = F.col("__quire_at"), F.col("__quire_close")
    return outer.select(*keys, a.alias("open"), b.alias("close"), F.substring("__quire_text", a + 2, b - a - 1).alias("inside"))
