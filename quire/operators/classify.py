"""Semantic classes of the blocks of a paper.

Everything that a block alone decides is a native Column (``candidate``). What depends on the blocks before it (the
abstract's region, the first title, the end of the authors) goes through each document's rows in order, on that
narrow candidate, not on the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import first_mode

# Patterns of the classes, Chinese and English.
FIGURE = r"(?i)^\s*(?:图|Figure|Fig\.?)\s*[0-9.]+"
TABLE = r"(?i)^\s*(?:表|Table|Talbe)\s*[0-9.]+"
ABSTRACT_LABEL, ABSTRACT = r"(?i)^\s*Abstract\s*[:：.]?\s*$", r"(?i)^\s*Abstract\s*[:：.]\s*"
KEYWORDS = r"(?i)^\s*Key\s*words?\s*[:：]|^关键词\s*[:：]"
REFERENCE = r"(?i)^\s*References?\s*$|^参考文献\s*$"
ACKNOWLEDGEMENT = r"(?i)^\s*Acknowledgements?|^致谢"
DECLARATION = r"(?i)^\s*(?:Code\s*availability|Data\s*availability|Competing\s*interests|Author\s*contribution|Sample\s*availability|Copyright)"
AFFILIATION = r"(?i)大学|学院|研究所|研究院|气象局|科学院|中心|University|Institute|Laboratory|Lab\b|Center|Centre|Bureau|Department|Observatory|Agency|Authority|Office|College|School\b"
CORRESPONDENCE = r"(?i)^\s*(?:Correspondence|通讯作者|联系人|Corresponding\s*author)\s*[:：.]?\s*"
EMAIL = r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"
NARRATIVE = r"^(?:中|是|为|说明|展示|可以看到|所示)"
#: Body size if a document tells none, in points.
BODY_PT = 12.0


def body_size(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body_pt): the mode of the sizes of long blocks that are no headings; ties to the first seen."""
    long = blocks.filter(F.col("heading_level").isNull() & (F.length("text") > 30))
    return first_mode(long, keys, "size_pt", "block_ord").select(*keys, F.col("size_pt").alias("body_pt"))


def candidate() -> Column:
    """Class by the block alone; ``open`` where the blocks before it decide."""
    text, small, known = F.trim("text"), F.col("size_pt") < F.col("body_pt"), F.col("size_pt").isNotNull()
    figure, table = text.rlike(FIGURE), text.rlike(TABLE)
    after = F.ltrim(F.regexp_replace(F.regexp_replace(text, FIGURE, ""), TABLE, ""))
    strict = text.rlike(r"(?i)^\s*(?:图|Figure|Fig\.?|表|Table|Talbe)\s*[0-9]+(?:\.[0-9]+)*\s*[:：,，.。、\s]+")
    caption = F.when(figure, "figure_caption").otherwise("table_caption")
    narrative = after.rlike(NARRATIVE) & ~F.coalesce(small, F.lit(False))
    captioned = (
        F.when(narrative, "body").when(strict, F.when(known & ~small, "body").otherwise(caption))
        .when((F.length(text) > 100) & ~text.rlike(r"[a-zA-Z]\s*[),]") & ~F.coalesce(small, F.lit(False)), "body").otherwise(caption)
    )
    return (
        F.when(F.col("heading_level").isNotNull(), "heading").when((text == "") & ~F.col("has_formula"), "empty")
        .when(text.rlike(ABSTRACT_LABEL), "abstract_label").when(text.rlike(KEYWORDS), "keywords").when(figure | table, captioned)
        .when(text.rlike(REFERENCE), "reference").when(text.rlike(ACKNOWLEDGEMENT), "acknowledgement").when(text.rlike(DECLARATION), "declaration")
        .when(text.rlike(ABSTRACT), "abstract").otherwise("open")
    )


def classify(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``blocks`` with semantic_type. Needs block_ord, text, heading_level, alignment, size_pt, indent_pt, has_formula, has_cite."""
    sized = blocks.join(body_size(blocks, keys), keys, "left").withColumn("body_pt", F.coalesce("body_pt", F.lit(BODY_PT)))
    text = F.trim("text")
    marked = sized.withColumn("__quire_n", F.row_number().over(Window.partitionBy(*keys).orderBy("block_ord")) - 1).withColumn("candidate", candidate())
    centred, undecided = F.coalesce(F.col("alignment") == "center", F.lit(False)), F.col("candidate") == "open"  # only these are asked whom they name
    facts = marked.select(
        *keys, "block_ord", F.col("__quire_n").alias("n"), "candidate", centred.alias("centred"), F.length(text).alias("size"), (undecided & text.rlike(AFFILIATION)).alias("affiliated"),
        (undecided & (text.rlike(CORRESPONDENCE) | text.contains("@") & text.rlike(EMAIL))).alias("mailed"), F.coalesce(F.col("size_pt") < F.col("body_pt"), F.lit(False)).alias("small"),
        (F.col("has_formula") & (F.trim(F.regexp_replace(text, r"\([0-9.-]+\)", "")) == "")).alias("alone"), (F.col("has_formula") & (F.length(text) < 100) & text.rlike(r"\([0-9.-]+\)")).alias("numbered"),
        ((F.coalesce(F.col("indent_pt"), F.lit(0.0)) > 0) | (F.length(text) > 50) | F.col("has_cite") | F.col("has_formula")).alias("solid"),
    )
    kinds, width = dict(blocks.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, before = None, None
        inside = title = authors_done = False
        for batch in batches:  # a partition's rows by document and place; a document may go on in the next batch
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != document:
                    document, before = row[:width], None
                    inside = title = authors_done = False
                _, n, kind, centred, size, affiliated, mailed, small, alone, numbered, solid = row[width:]
                if kind in ("heading", "keywords"):
                    inside = False
                elif kind == "abstract":
                    inside = True
                elif kind == "open":
                    if before == "abstract_label" or inside:
                        kind, inside = "abstract", True
                    elif n < 5 and centred and size > 5 and not title:
                        kind, title = "title", True
                    elif title and not authors_done and n < 15 and centred and 1 < size < 100 and not affiliated:
                        kind = "author"
                    elif mailed:
                        kind = "correspondence"
                    elif affiliated and (centred or small and size < 200):
                        kind, authors_done = "affiliation", True
                    else:
                        if title and not centred and n < 15:
                            authors_done = True
                        kind = "display_formula" if alone or numbered else "body" if solid else "unknown"
                out.append(kind)
                before = kind
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], pa.array(out, pa.string())], [*keys, "block_ord", "semantic_type"])

    in_order = facts.repartition(*keys).sortWithinPartitions(*keys, "n")
    types = in_order.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "block_ord"]) + ", semantic_type string")
    return blocks.join(types, [*keys, "block_ord"])


def assemble(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tex): a document's lines in order, from classified blocks; an unclassed short block goes on the line before it."""
    from ..functions import latex as L

    blocks = blocks.withColumn("__quire_escaped", L.escape(F.col("text")))
    body = L.chemistry(F.col("__quire_escaped"))
    level = F.coalesce("heading_level", F.lit(1))
    line = (
        F.when(F.col("semantic_type") == "heading", F.concat(F.lit("\\"), F.when(level == 2, "sub").when(level >= 3, "subsub").otherwise(""), F.lit("section{"), body, F.lit("}")))
        .when(F.col("semantic_type") == "title", F.concat(F.lit("\\title{"), body, F.lit("}"))).when(F.col("semantic_type") == "author", F.concat(F.lit("\\author{"), body, F.lit("}")))
        .when(F.col("semantic_type").isin("figure_caption", "table_caption"), F.concat(F.lit("\\caption{"), body, F.lit("}"))).when(F.col("semantic_type") == "empty", F.lit("")).otherwise(body)
    )
    rows = blocks.select(*keys, F.struct("block_ord", (F.col("semantic_type") == "unknown").alias("goes_on"), line.alias("line")).alias("piece"))
    joined = lambda x, k: F.concat(F.when(x["goes_on"] & (k > 0), F.lit(" ")).otherwise(F.lit("\n")), x["line"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), joined), "")
    return rows.repartition(*keys).groupBy(*keys).agg(F.ltrim(text, F.lit("\n")).alias("tex"))
