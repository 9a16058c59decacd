"""Paragraphs of finished code that floats cut apart, and long tables cut into pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered as O

#: A float environment, and what ends a sentence.
FLOAT = r"(?s)\\begin\{((?:table|figure)\*?)\}.*?\\end\{\1\}"
SENTENCE_ENDS = (".", "!", "?", "。", "！", "？")


def merged_around_floats(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text) with the blank lines about floats taken out where the text before them goes on behind them.

    It goes on if what comes before doesn't end a sentence and what comes behind begins neither with a capital, nor a digit, nor a
    command. Floats with nothing but blank lines between them are carried past together: the last text before them and the first
    behind them decide, found by filling forwards and backwards over one order of pieces.
    """
    pieces = F.arrays_zip(F.split(text, FLOAT, -1).alias("piece"), F.regexp_extract_all(text, F.lit(FLOAT), F.lit(0)).alias("float"))
    rows = docs.select(*keys, F.posexplode(pieces).alias("__quire_at", "p")).select(*keys, "__quire_at", "p.piece", "p.float")
    core = F.nullif(F.regexp_replace("piece", r"^[\n\r]+|[\n\r]+$", ""), F.lit(""))
    w = O.ordered(keys, "__quire_at")
    before = O.forward_fill(F.right(core, F.lit(1)), w)
    after = F.first(F.left(core, F.lit(1)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    starts_anew = (F.lower("__quire_after") != F.col("__quire_after")) | F.col("__quire_after").rlike(r"^[0-9\\]")
    rows = rows.withColumns({"__quire_before": before, "__quire_after": after, "__quire_core": F.coalesce(core, F.lit(""))})
    rows = rows.withColumn("__quire_on", F.coalesce(F.col("float").isNotNull() & ~F.col("__quire_before").isin(*SENTENCE_ENDS) & ~starts_anew, F.lit(False)))
    rows = rows.withColumn("__quire_came", F.coalesce(F.lag("__quire_on").over(w), F.lit(False)))
    head, tail = F.regexp_extract("piece", r"^([\n\r]+)", 1), F.regexp_extract("piece", r"([\n\r]+)$", 1)
    short = lambda on, gap: F.when(on & (F.length(gap) > 1), F.lit("\n")).otherwise(gap)
    blank = F.when(F.col("__quire_on") & F.col("__quire_came"), short(F.lit(True), F.col("piece"))).otherwise(F.col("piece"))
    whole = F.when(F.col("__quire_core") == "", blank).otherwise(F.concat(short(F.col("__quire_came"), head), "__quire_core", short(F.col("__quire_on"), tail)))
    made = rows.select(*keys, F.struct("__quire_at", F.concat(whole, F.coalesce("float", F.lit(""))).alias("s")).alias("x"))
    return made.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias(text))


def page_starts(rows: DataFrame, keys: list[str], order: str, height: str, head: float, room: float) -> DataFrame:
    """(keys, order, page): the rows of long tables on pages. Each page begins with the head, which takes ``head`` of its ``room``,
    and takes rows while they fit; a row that is higher than a page stands alone.

    Where a page ends depends on where it began, so the rows of a table stream in order, narrow and sorted by one shuffle; all that is held is
    the page and how full it is. Tables go side by side. Nothing is joined and no round is written.
    """
    sized = rows.select(*keys, F.col(order).alias("__quire_o"), F.coalesce(F.col(height), F.lit(0.0)).cast("double").alias("__quire_h"))
    streamed = sized.repartition(*keys).sortWithinPartitions(*keys, "__quire_o")
    limit = room - head + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, page, filled = None, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.columns[: len(keys)]
            new = np.zeros(batch.num_rows, bool)
            for c in own:
                same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
                none = c.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= ~(same | (none[1:] & none[:-1]))
            first = [c[0].as_py() for c in own]
            new[0] = last is None or first != last
            pages = []
            for begins, h in zip(new.tolist(), batch.column(batch.num_columns - 1).to_pylist()):
                if begins:
                    page, filled = 0, h
                elif filled + h > limit:
                    page, filled = page + 1, h
                else:
                    filled += h
                pages.append(page)
            last = [c[-1].as_py() for c in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pages, pa.int64())], [*keys, order, "page"])

    kinds = dict(rows.dtypes)
    return streamed.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, order)) + ", page long")
