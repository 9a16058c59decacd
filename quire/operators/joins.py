"""Joins that SQL has no word for: as-of, containment, greedy one-to-one, prefix search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], strict: bool = True, tie: str | None = None) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the last row of ``right`` before it (or at it, if not ``strict``).

    A union and a forward fill: one shuffle on the keys and one sort, whatever the number of matches, where a range
    join would make every pair. ``tie`` orders rows of ``right`` at one place.
    """
    side = 1 if strict else -1  # at one place, left rows come before right rows if strict
    payload = F.struct(*values)
    a = left.withColumn("__quire_at", F.col(left_at)).withColumn("__quire_side", F.lit(0)).withColumn("__quire_right", F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType))
    a = a.withColumn("__quire_tie", F.lit(None).cast(dict(right.dtypes)[tie] if tie else "int"))
    b = right.select(*keys, F.col(right_at).alias("__quire_at"), F.lit(side).alias("__quire_side"), payload.alias("__quire_right"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("__quire_tie"))
    w = Window.partitionBy(*keys).orderBy("__quire_at", "__quire_side", "__quire_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__quire_found", F.last("__quire_right", ignorenulls=True).over(w)).filter(F.col("__quire_side") == 0)
    return both.select(*left.columns, *[F.col(f"__quire_found.{v}").alias(v) for v in values])


def contained_anti(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Rows of ``left`` whose span no span of ``right`` with the same keys contains.

    The span containing [lo, hi] exists if the largest end among spans that begin at or before lo reaches hi: a
    running maximum over one sort, not a join of all pairs.
    """
    w = Window.partitionBy(*keys).orderBy(lo, "__quire_side").rowsBetween(Window.unboundedPreceding, 0)
    a = left.withColumn("__quire_side", F.lit(1)).withColumn("__quire_reach", F.lit(None).cast(dict(right.dtypes)[hi]))
    b = right.select(*keys, lo, F.lit(0).alias("__quire_side"), F.col(hi).alias("__quire_reach"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__quire_most", F.max("__quire_reach").over(w)).filter("__quire_side = 1")
    return both.filter(F.col("__quire_most").isNull() | (F.col("__quire_most") < F.col(hi))).select(*left.columns)


def first_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in an order, which must be total."""
    return df.withColumn("__quire_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__quire_rank = 1").drop("__quire_rank")


def first_unused(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Each row of ``left``, in order, with the first row of ``right`` that agrees on the keys and that none before it took.

    Agreement on keys is an equivalence, so the n-th row of a key on one side gets the n-th on the other: two ranks and an
    equality join, no loop. Rows without a partner left go. Orders must be total.
    """
    ranked = lambda df, order: df.withColumn("__quire_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked(left, left_order).join(ranked(right, right_order), [*keys, "__quire_rank"]).drop("__quire_rank")


def greedy_pairs(scored: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """(group, left, right, score): pairs in order of score (ties by left, then right), each side used once.

    What is taken depends on what was taken before, so a group goes through Python; groups are independent.
    """
    kinds = dict(scored.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, left, right], ascending=[False, True, True], kind="stable")
        used_left, used_right, keep = set(), set(), []
        for k, (a, b) in enumerate(zip(rows[left], rows[right])):
            if a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                keep.append(k)
        return rows.iloc[keep]

    columns = [group, left, right, score]
    return scored.select(*columns).groupBy(group).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def prefix_search(needles: DataFrame, hay: DataFrame, needle: str, text: str, lengths: tuple[int, ...], needle_id: str, hay_id: str) -> DataFrame:
    """(needle_id, hay_id, length): the text that begins with the longest of the needle's prefixes; ties to the smaller id.

    Prefixes of both sides are exploded and joined on equality, so there is no loop over all pairs.
    """
    cut = lambda c: F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("length"), F.substring(c, 1, n).alias("prefix")) for n in lengths]), lambda x: F.length(x["prefix"]) == x["length"]))
    a = needles.select(needle_id, cut(needle).alias("p")).select(needle_id, "p.length", "p.prefix")
    b = hay.select(hay_id, cut(text).alias("p")).select(hay_id, "p.length", "p.prefix").groupBy("length", "prefix").agg(F.min(hay_id).alias(hay_id))
    return first_by(a.join(b, ["length", "prefix"]), [needle_id], F.desc("length"), hay_id).select(needle_id, hay_id, "length")


def nearest_in_group(df: DataFrame, group: str, row_id: str, vector: str, tile: int = 4096, digits: int = 6) -> DataFrame:
    """(row_id, best): the other row of its group with the largest inner product, rounded, ties to the smaller id.

    A group is cut into tiles by a hash of the id, and each pair of tiles is one matrix product in one task that gives a row
    for each of its rows; no pair of rows is ever a row, and a task holds two tiles, whatever the group's size. Rows without
    a vector or without another row in their group have no best.
    """
    kinds = dict(df.dtypes)
    known = df.select(F.col(group).alias("g"), F.col(row_id).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("g is not null and k is not null and v is not null")
    tiles = known.groupBy("g").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    cut = known.join(tiles, "g").withColumn("own", F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    asks = cut.select("g", F.col("own").alias("a"), every.alias("b"), F.lit(True).alias("asks"), "k", "v")
    offers = cut.select("g", every.alias("a"), F.col("own").alias("b"), F.lit(False).alias("asks"), "k", "v")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["asks"]], rows[~rows["asks"]].sort_values("k")
        if left.empty or right.empty:
            return pd.DataFrame({"k": left["k"][:0], "best": left["k"][:0], "score": []})
        score = np.round(np.stack(left["v"].to_list()) @ np.stack(right["v"].to_list()).T, digits)
        score[left["k"].to_numpy()[:, None] == right["k"].to_numpy()[None, :]] = -np.inf
        best = score.argmax(axis=1)  # the first of equals, so the smallest id
        out = pd.DataFrame({"k": left["k"].to_numpy(), "best": right["k"].to_numpy()[best], "score": score[np.arange(len(left)), best]})
        return out[np.isfinite(out["score"])]

    found = asks.unionByName(offers).groupBy("g", "a", "b").applyInPandas(run, f"k {kinds[row_id]}, best {kinds[row_id]}, score double")
    top = found.groupBy("k").agg(F.min_by("best", F.struct(-F.col("score"), F.col("best"))).alias("best"))
    return top.withColumnRenamed("k", row_id)
