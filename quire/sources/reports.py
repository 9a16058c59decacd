"""Reports and logs: aggregates as text, written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.latex import CHEM_NAMES, chemistry
from ..operators.aggregates import sample_of_groups

RUN_LOG = "step string, severity string, message string, at timestamp"


def as_json(df: DataFrame, path: str) -> None:
    """One JSON record a line, read back with ``read_json`` and the same schema."""
    df.write.mode("overwrite").json(path)


def read_json(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def block_report(blocks: DataFrame, keys: list[str], samples: int = 5, preview: int = 40) -> DataFrame:
    """(keys, report): counts by class and the first texts of each, with the number that is left out."""
    few = sample_of_groups(blocks.withColumn("preview", F.substring("text", 1, preview)), [*keys, "semantic_type"], ["block_ord"], samples)
    line = F.concat(F.lit("  ["), F.col("block_ord").cast("string"), F.lit("] "), F.col("preview"))
    classes = few.groupBy(*keys, "semantic_type").agg(
        F.max("overflow").alias("more"), F.count("*").alias("shown"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"),
    )
    text = F.concat(F.col("semantic_type"), F.lit(": "), (F.col("shown") + F.col("more")).cast("string"), F.lit("\n"), F.col("lines"), F.when(F.col("more") > 0, F.concat(F.lit("\n  ... "), F.col("more").cast("string"), F.lit(" more"))).otherwise(""))
    return classes.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("semantic_type", text.alias("text")))), lambda x: x["text"]), "\n").alias("report"))


def section_report(rows: DataFrame, keys: list[str], samples: int = 10) -> DataFrame:
    """(keys, report): sections in order, each with its count, its first lines, and how many more there are.

    ``rows`` has (keys, section, ord, line). Lines are numbered by one window, and only those that are shown are collected.
    """
    w = Window.partitionBy(*keys, "section").orderBy("ord", "line")
    few = rows.withColumns({"__quire_rank": F.row_number().over(w), "__quire_n": F.count("*").over(Window.partitionBy(*keys, "section"))}).filter(F.col("__quire_rank") <= samples)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__quire_rank", "line"))), lambda x: F.concat(F.lit("\n  "), x["line"])), "")
    parts = few.groupBy(*keys, "section").agg(F.first("__quire_n").alias("n"), shown.alias("lines"))
    more = F.when(F.col("n") > samples, F.format_string("\n  ... %d more", F.col("n") - samples)).otherwise("")
    text = F.concat(F.format_string("[%s] %d", "section", "n"), "lines", more)
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", text.alias("t")))), lambda x: x["t"]), "\n").alias("report"))


def chemistry_rows(texts: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, section, ord, line) of every name with a number in a text: ``1 converted`` with its code, ``2 kept`` as it is, and ``3 doubtful``
    if a converted one is in a listed name of a model or satellite, or the other way about."""
    names = F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z_])([A-Z][A-Za-z]*[0-9]{1,2})(?![0-9A-Za-z_])"), F.lit(1))
    found = texts.select(*keys, F.col(order).alias("ord"), F.explode(names).alias("name"))
    made = found.withColumn("code", chemistry(F.col("name")))
    doubtful = F.exists(F.array(*[F.lit(n) for n in CHEM_NAMES]), lambda n: F.lower("name").contains(F.lower(n)))
    converted = F.col("code") != F.col("name")
    row = lambda section, line: F.struct(F.lit(section).alias("section"), line.alias("line"))
    rows = F.concat(F.array(F.when(converted, row("1 converted", F.concat("name", F.lit(" -> "), "code"))).otherwise(row("2 kept", F.col("name")))), F.when(converted & doubtful, F.array(row("3 doubtful", F.col("name")))).otherwise(F.array().cast("array<struct<section:string,line:string>>")))
    return made.select(*keys, "ord", F.explode(rows).alias("r")).select(*keys, "r.section", "ord", "r.line")


def element_counts(scanned: DataFrame, styles: int = 10) -> DataFrame:
    """(path, paragraphs, tables, formulas, media, styles) of packages: counts of top-level elements, and the first styles in order.

    ``scanned`` has a row for each package with arrays of its blocks (kind, style, formulas) and media, as ``docx.gathered`` gives, so nothing is shuffled.
    """
    of = lambda kind: F.size(F.filter("blocks", lambda b: b["kind"] == kind)).cast("long")
    formulas = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.coalesce(b["formulas"], F.lit(0)))
    named = F.transform(F.filter("blocks", lambda b: b["style"].isNotNull()), lambda b: b["style"])
    counts = scanned.filter(F.size("blocks") > 0)
    return counts.select("path", of("p").alias("paragraphs"), of("tbl").alias("tables"), formulas.alias("formulas"), F.size("media").cast("long").alias("media"), F.slice(named, 1, styles).alias("styles"))


def round_trip_report(pairs: DataFrame, level: str) -> DataFrame:
    """(line): a Markdown table of how many formulas came back at each level, with shares."""
    counts = pairs.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("n"))
    rows = counts.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row for each level, four at most
    return rows.select(F.format_string("| %s | %d | %.1f %% |", "level", "n", 100.0 * F.col("n") / F.col("total")).alias("line"))


def log(run: DataFrame, path: str) -> None:
    """Appends (step, severity, message, at) rows to a log table."""
    run.write.mode("append").parquet(path)


def passed(run: DataFrame) -> bool:
    """Whether no step of a run log failed."""
    return run.filter("severity = 'error'").limit(1).count() == 0
