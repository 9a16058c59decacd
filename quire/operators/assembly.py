"""A document's body from several streams: text, headings, runs of formulas, floats at their anchors, citations by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixes
from ..functions import latex as L
from . import ordered as O

# Classes that a template places itself; what is appended to the line before it if it is shorter.
ELSEWHERE = ("title", "author", "affiliation", "front_matter", "abstract_label", "abstract", "keywords", "figure_caption", "table_caption")
SHORT = 30


def cited(text: Column, keys_by_number: Column) -> Column:
    """``[12]`` as a citation of the entry that has this number; numbers that no entry has stay."""

    def change(t: Column, before: Column, after: Column) -> Column:
        key = F.element_at(keys_by_number, F.regexp_extract(t, r"^\[([0-9]+)\]$", 1))
        return F.when(t.rlike(r"^\[[0-9]+\]$") & key.isNotNull(), F.concat(F.lit("\\citep{"), key, F.lit("}"))).otherwise(t)

    return fixes.pieces(text, r"\[[0-9]+\]|[^\[]+|\[", change)


def emit(blocks: DataFrame, floats: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tex): the body of every document, whole.

    ``blocks`` has (keys, block_ord, text, latex, heading_level, semantic_type), latex being the code of a displayed formula; ``floats``
    (keys, float_ord, anchor, code), placed behind the block that they are anchored to; ``entries`` (keys, number, cite_key). What
    the template places itself, and all from the references on, goes. Formulas that follow each other are gathered; they are numbered within their
    section. A short unclassed block goes to the end of the last line of text before it, whatever headings, formulas or floats
    lie between; the first one of a document without such a line begins one. Documents of which nothing is left give nothing.
    """
    w = O.ordered(keys, "block_ord")
    kept = blocks.withColumn("__quire_end", O.latched(F.col("semantic_type") == "reference", w)).filter(~F.col("__quire_end") & ~F.col("semantic_type").isin(*ELSEWHERE))
    formula, level = F.col("semantic_type") == "display_formula", F.coalesce("heading_level", F.lit(1))
    heading = F.col("semantic_type") == "heading"
    kept = kept.withColumn("__quire_section", O.running_count(heading & (level == 1), w)).withColumns({"__quire_prev": F.coalesce(F.lag(formula).over(w), F.lit(False)), "__quire_next": F.coalesce(F.lead(formula).over(w), F.lit(False))})
    number = O.running_count(formula, O.ordered([*keys, "__quire_section"], "block_ord"))
    numbers = entries.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("number").cast("string").alias("n"), F.col("cite_key").alias("k")))).alias("__quire_keys"))
    known = kept.withColumn("__quire_number", number).join(numbers, keys, "left").withColumn("__quire_keys", F.coalesce("__quire_keys", F.create_map().cast("map<string,string>")))

    body = cited(L.chemistry(L.escape(F.trim("text"))), F.col("__quire_keys"))
    labelled = F.concat(F.coalesce("latex", F.lit("")), F.lit(" \\label{"), L.equation_label(F.col("__quire_section"), F.col("__quire_number")), F.lit("}"))
    many, first, last = F.col("__quire_prev") | F.col("__quire_next"), ~F.col("__quire_prev"), ~F.col("__quire_next")
    around = lambda opening, inside, closing: F.concat(F.lit(opening), inside, F.lit(closing))
    gathered = F.concat(F.when(first, "\\begin{gather}\n").otherwise(""), labelled, F.when(last, "\n\\end{gather}").otherwise(" \\\\"))
    line = (
        F.when(formula, F.when(many, gathered).otherwise(around("\\begin{equation}\n", labelled, "\n\\end{equation}")))
        .when(heading, F.concat(F.lit("\\"), F.when(level == 2, "sub").when(level >= 3, "subsub").otherwise(""), around("section{", body, "}")))
        .when(F.col("semantic_type") == "acknowledgement", around("\\begin{acknowledgements}\n", body, "\n\\end{acknowledgements}")).otherwise(body)
    )
    blank = F.trim("text") == ""
    kind = F.when(formula | heading | (F.col("semantic_type") == "acknowledgement") | blank, "line").when((F.col("semantic_type") == "unknown") & (F.length(F.trim("text")) < SHORT), "short").otherwise("text")
    own = known.select(*keys, F.col("block_ord").cast("long").alias("place"), F.lit(0).alias("sub"), F.lit(0).cast("long").alias("seq"), kind.alias("kind"), line.alias("s"))
    placed = floats.join(blocks.select(*keys).distinct(), keys, "left_semi").select(*keys, F.col("anchor").cast("long").alias("place"), F.lit(1).alias("sub"), F.col("float_ord").cast("long").alias("seq"), F.lit("line").alias("kind"), F.col("code").alias("s"))
    rows = own.unionByName(placed)

    order = O.ordered(keys, "place", "sub", "seq")
    here = F.struct("place", "sub", "seq")
    rows = rows.withColumn("__quire_text", O.forward_fill(F.when(F.col("kind") == "text", F.lit(1)), order)).withColumn("__quire_shorts", O.running_count(F.col("kind") == "short", order))
    begins = (F.col("kind") == "short") & F.col("__quire_text").isNull() & (F.col("__quire_shorts") == 1)
    rows = rows.withColumn("kind", F.when(begins, "text").otherwise(F.col("kind")))
    rows = rows.withColumn("__quire_head", F.when(F.col("kind") == "short", O.forward_fill(F.when(F.col("kind") == "text", here), order)).otherwise(here))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sub", "seq", "s"))), lambda x: x["s"]), "")
    lines = rows.groupBy(*keys, "__quire_head").agg(whole.alias("s"), F.bool_or(F.col("kind") == "text").alias("is_text"))
    lines = lines.select(*keys, F.struct("__quire_head", F.concat("s", F.when(F.col("is_text"), F.lit("\n")).otherwise("")).alias("s")).alias("x"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("tex"))


def anchors(floats: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(columns of floats, anchor): the block behind which each float goes.

    ``floats`` has (keys, place, number); ``blocks`` (keys, block_ord, text, heading_level, semantic_type). A float goes behind the last
    block of text or heading before it. One that stands behind the references, where an earlier conversion left it, is recovered: of
    the blocks that mention its number, the first that a heading precedes sends it to that heading, else the last mention to the block before it,
    or to itself if it is the first. Without any mention it goes to the last block before the references; without any block its anchor is null.
    Mentions meet floats by equality on the number that they name; the blocks before them come from one order, filled forwards.
    """
    w = O.ordered(keys, "block_ord")
    marked = blocks.withColumn("__quire_end", O.latched(F.col("semantic_type") == "reference", w))
    start = marked.groupBy(*keys).agg(F.min(F.when(F.col("__quire_end"), F.col("block_ord"))).alias("__quire_stop"))
    valid = marked.filter(~F.col("__quire_end") & ~F.col("semantic_type").isin("figure_caption", "table_caption", "empty"))
    is_heading = F.col("heading_level").isNotNull() | (F.col("semantic_type") == "heading")
    valid = valid.withColumns({"__quire_before": F.lag("block_ord").over(w), "__quire_headed": F.coalesce(F.lag(is_heading).over(w), F.lit(False))})
    final = valid.groupBy(*keys).agg(F.max("block_ord").alias("__quire_last"))

    said = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)(?:图|Figure|Fig\.?)\s*([0-9]+(?:\.[0-9]+)*)"), F.lit(1))))
    mentions = valid.select(*keys, "block_ord", "__quire_before", "__quire_headed", said.alias("number"))
    told = mentions.groupBy(*keys, "number").agg(
        F.min(F.when(F.col("__quire_headed"), F.struct("block_ord", "__quire_before")))["__quire_before"].alias("__quire_to_heading"), F.max(F.struct("block_ord", F.coalesce("__quire_before", "block_ord").alias("b")))["b"].alias("__quire_to_mention"),
    )
    own = F.struct(*floats.columns)
    at = floats.select(*keys, own.alias("__quire_float"), F.col("place").cast("double").alias("e"), F.lit(1).alias("asks"))
    edges = valid.select(*keys, F.col("block_ord").cast("double").alias("e"), F.lit(0).alias("asks"), F.col("block_ord").cast("long").alias("b"))
    near = at.unionByName(edges, allowMissingColumns=True).withColumn("__quire_near", O.forward_fill(F.col("b"), O.ordered(keys, "e", "asks"))).filter("asks = 1")
    asked = near.select("__quire_float.*", "__quire_near", F.col("__quire_float.number").cast("string").alias("__quire_number"))
    joined = asked.join(start, keys, "left").join(final, keys, "left").join(told.withColumnRenamed("number", "__quire_number"), [*keys, "__quire_number"], "left")
    late = F.coalesce(F.col("place") >= F.col("__quire_stop"), F.lit(False))
    anchor = F.when(late, F.coalesce("__quire_to_heading", "__quire_to_mention", "__quire_last")).otherwise(F.col("__quire_near"))
    return joined.select(*floats.columns, anchor.cast("long").alias("anchor"))


def float_groups(floats: DataFrame, keys: list[str], most: int = 3, near: int = 2) -> DataFrame:
    """(columns of floats, group, nth): floats that are set together, ``most`` of them at a time.

    ``floats`` has (keys, start, end, section, page, major). One goes on with those before it if it begins within ``near`` blocks of the end of the last,
    in the same section, under the same major number (where both have one) and on its page or the next, pages never going back.
    Those conditions on neighbours give runs, and a run's floats are dealt out ``most`` at a time, by two windows over one order.
    """
    w = O.ordered(keys, "start", "end")
    lag = lambda c: F.lag(c).over(w)
    apart = F.col("start") > lag("end") + near
    moved = ~F.col("section").eqNullSafe(lag("section")) | (F.col("major") != lag("major")) | F.col("page").isNull() | (F.col("page") < lag("page")) | (F.col("page") > lag("page") + 1)
    runs = floats.withColumn("__quire_run", O.island(lag("start").isNull() | apart | F.coalesce(moved, lag("page").isNull()), w))
    n = F.row_number().over(O.ordered([*keys, "__quire_run"], "start", "end")) - 1
    runs = runs.withColumns({"__quire_n": n, "__quire_new": n % most == 0})
    return runs.withColumn("group", O.running_count(F.col("__quire_new"), w)).withColumn("nth", F.col("__quire_n") % most).select(*floats.columns, "group", "nth")
