"""Document lines: the block scan and everything that is decided line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .registry import query, table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, line): the ordered blocks of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))


@query("s1_lines_by_class", """
    with l as (
      select doc_id, unnest(string_split(text, chr(10))) as line from documents
    ), c as (
      select doc_id, case
        when trim(line) = '' then 'empty'
        when regexp_matches(line, '(?i)^\\s*(figure|fig\\.|table|图|表)\\s*[0-9]+') then 'caption'
        when regexp_matches(line, '^[0-9]+(\\.[0-9]+)*\\s+\\S') and length(line) <= 80 then 'heading'
        when length(line) <= 80 then 'short'
        else 'body' end as line_class, length(line) as n
      from l)
    select doc_id, line_class, count(*) as n_lines, sum(n) as n_chars from c group by doc_id, line_class
""")
def s1_lines_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = lines(spark, sf_dir).select("doc_id", X.line_class(F.col("line")).alias("line_class"), F.length("line").alias("n"))
    return classed.groupBy("doc_id", "line_class").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_chars"))
