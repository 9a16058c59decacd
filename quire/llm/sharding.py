"""Longest-processing-time sharding.

Rows of a group (equal texts) stay together. Groups, largest first, go to the least-loaded shard. The driver
needs only the classes of groups of one size, (size, number of groups), of which there can be no more than the root of
twice all bytes; a heap over the shards takes the classes in turn, and the many equal groups of a class are dealt in one
step, to the shards that the heap would give them to one by one. So it is the exact schedule, whatever the number of groups.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, table, text_or_empty, written

SHARDS = 8
#: Rows that are numbered by one task at about, at least; and such cells of rows at most at about.
CELL, CELLS = 1024, 65_536


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard gets, when each in turn goes to the least-loaded shard (ties to the smaller).

    The heap would pop the ``count`` least of all (load + k * size, shard). A few steps of it are taken; of many, all
    below a level found by bisection at once.
    """
    got = [0] * len(loads)
    if count > 4 * len(loads):
        taken = lambda level: sum(max(0, -(-(level - load) // size)) for load in loads)  # noqa: E731  keys below the level
        low, high = min(loads), max(loads) + size * (count + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if taken(middle) <= count else (low, middle)
        got = [max(0, -(-(low - load) // size)) for load in loads]
    heap = [(load + n * size, shard) for shard, (load, n) in enumerate(zip(loads, got))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, shard = heap[0]
        got[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return got


def schedule(classes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """size -> how many groups each shard gets, for classes of (size, number of groups), largest size first."""
    loads, out = [0] * shards, {}
    for size, count in sorted(classes, reverse=True):
        out[size] = deal(loads, size, count)
        loads = [load + n * size for load, n in zip(loads, out[size])]
    return out


def _ranked(rows: DataFrame, by: list[str], cell, order: list, name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within each ``by``: numbered within cells, and cells one after the other."""
    rows = rows.withColumn("__cell", cell)
    counts = rows.groupBy(*by, "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*by, "__cell").orderBy(*order)))
    return numbered.join(offsets, [*by, "__cell"]).withColumn(name, F.col("__before") + F.col("__at") - 1).drop("__cell", "__n", "__at", "__before")


def shard(docs: DataFrame, shards: int = SHARDS, cell: int = CELL) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    size: UTF-8 bytes of the text plus 1; null counts as empty and is of its group. slot: gapless from 0
    in each shard; where rows tie on (doc_id, text) any order among them gives the same rows. Groups of one size are
    equal to the schedule; they are told apart by the hash of the text. The loads are those of the exact schedule.
    """
    spark = docs.sparkSession
    own = F.unhex(F.md5(text_or_empty()))
    sized = written(docs.select("doc_id", (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"), F.crc32(text_or_empty()).alias("text_crc32"), own.alias("group")), "shard-sizes")
    groups = written(sized.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    classes = [(r.bytes, r.k) for r in groups.groupBy("bytes").agg(F.count("*").alias("k")).collect()]  # a row for each size
    plan = schedule(classes, shards)
    many = dict(classes)
    ends = [[sum(got[: k + 1]) for k in range(shards)] for got in plan.values()]
    placed = spark.createDataFrame(pa.table({"bytes": pa.array(list(plan), pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64())), "k": pa.array([many[s] for s in plan], pa.int64())}))

    rows = groups.agg(F.sum("n")).first()[0] or 0
    cell = max(cell, rows // CELLS)
    hashed = lambda column, count: F.pmod(F.xxhash64(column), F.greatest(F.ceil(count / F.lit(cell)), F.lit(1)).cast("long"))
    ranked = _ranked(groups.join(placed, "bytes"), ["bytes"], hashed("group", F.col("k")), ["group"], "rank")
    to = written(ranked.select("group", "n", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")), "shard-places")

    # Groups of more than a cell, of which there are CELLS at most at about, are sent to their rows; the others' rows go to them.
    large = F.broadcast(to.filter(F.col("n") > cell))
    of_large = sized.join(large, "group").withColumn("cell", F.concat(F.col("group"), F.encode(hashed("doc_id", F.col("n")).cast("string"), "UTF-8")))
    few = F.pmod(F.xxhash64("group"), F.lit(max(1, rows // cell // shards))).cast("string")
    of_small = sized.join(large, "group", "left_anti").join(to.filter(F.col("n") <= cell), "group").withColumn("cell", F.encode(few, "UTF-8"))
    out = _ranked(of_large.unionByName(of_small), ["shard"], F.col("cell"), [F.col("doc_id").asc_nulls_last(), "group"], "slot")
    out = written(out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")), "shard-slots")
    discard(sized, groups, to)
    return out


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot; the law is ``bytes``."""
    out = shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
