"""Tables: widths that fit the page and the text, heights after wrapping, tabular code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import ordered as O

# Centimetres of a character, of a line, of the least column, and of the widest column that text can ask for.
CHAR_CM, LINE_CM, LEAST_CM, DONOR_CM, WIDEST_CM = 0.42, 0.55, 0.2, 1.15, 4.5
LONG, LONG_CM, TWIPS, LEAST_TWIPS = 16, 0.16, 567.0, 400


def scaled_widths(widths: DataFrame, keys: list[str], limit_cm: float | None) -> DataFrame:
    """(keys, col, width_cm) scaled so that a table is as wide as the limit; as they are without a limit or a total."""
    total = F.sum("width_cm").over(Window.partitionBy(*keys))
    fits = F.greatest(F.col("width_cm") * F.lit(limit_cm) / total, F.lit(LEAST_CM))
    return widths.withColumn("width_cm", F.when((total > 0) & F.lit(limit_cm).isNotNull(), fits).otherwise(F.col("width_cm")))


def rebalanced_widths(widths: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, width_cm): columns of long text grow at the cost of the others, the table's width stays.

    ``cells`` has (keys, col_start, grid_span, text); cells over several columns and numbers ask for nothing. One
    aggregation finds the longest text of each column, one window per table does the rest.
    """
    w = Window.partitionBy(*keys)
    text = F.trim(F.coalesce("text", F.lit("")))
    longest = cells.filter((F.col("grid_span") == 1) & ~X.numeric_looking(text)).groupBy(*keys, F.col("col_start").alias("col")).agg(F.max(F.length(text)).alias("__quire_long"))
    width, wanted = F.col("width_cm"), F.least(F.greatest(F.col("width_cm"), F.col("__quire_long") * LONG_CM), F.lit(WIDEST_CM))
    grown = widths.join(longest, [*keys, "col"], "left").withColumn("__quire_growth", F.when((F.col("__quire_long") >= LONG) & (wanted > width), wanted - width))
    spared = grown.withColumn("__quire_spare", F.when(F.col("__quire_growth").isNull(), F.greatest(width - DONOR_CM, F.lit(0.0))).otherwise(0.0))
    asked, offered = F.sum("__quire_growth").over(w), F.sum("__quire_spare").over(w)
    moved = F.least(asked, offered)
    change = F.when(F.col("__quire_growth").isNotNull(), F.col("__quire_growth") * moved / asked).otherwise(-moved * F.col("__quire_spare") / offered)
    return spared.withColumn("width_cm", F.when((asked > 0) & (offered > 0), width + change).otherwise(width)).select(*widths.columns)


def wrapped_lines(text: Column, width_cm: Column) -> Column:
    """Lines that a text takes in a column; characters beyond 127 count as wide ones."""
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    units = wide + (F.length(text) - wide) * 0.55
    return F.when(width_cm > 0, F.greatest(F.lit(1), F.floor(units * CHAR_CM / width_cm) + 1)).otherwise(1)


def heights(cells: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, height_cm): the sum of row heights after wrapping, without a first row that is one cell over all columns.

    ``cells`` has (keys, row, col_start, grid_span, text, row_height in twips or null). Cells meet their columns by
    equality on exploded places, so a span adds rows, not a range join.
    """
    at = F.explode(F.sequence(F.col("col_start"), F.col("col_start") + F.col("grid_span") - 1)).alias("col")
    spanned = cells.select(*keys, "row", "col_start", at).join(widths.select(*keys, "col", "width_cm"), [*keys, "col"], "left")
    wide = spanned.groupBy(*keys, "row", "col_start").agg(F.sum("width_cm").alias("__quire_w"))
    columns = widths.groupBy(*keys).agg(F.count("*").alias("__quire_columns"))
    text = F.trim(F.coalesce("text", F.lit("")))
    lines = F.when(text != "", wrapped_lines(text, F.coalesce("__quire_w", F.lit(0.0)))).otherwise(1)
    least = F.greatest(F.coalesce("row_height", F.lit(LEAST_TWIPS)), F.lit(LEAST_TWIPS)) / TWIPS
    high = cells.join(wide, [*keys, "row", "col_start"]).join(columns, keys)
    title = (F.col("row") == 0) & (F.col("col_start") == 0) & (F.col("grid_span") == F.col("__quire_columns"))
    tall = F.greatest(least, F.when(lines > 1, lines * LINE_CM).otherwise(0.0))
    rows = high.groupBy(*keys, "row").agg(F.max(F.when(title, 0.0).otherwise(tall)).alias("__quire_h"))
    return rows.groupBy(*keys).agg(F.sum("__quire_h").alias("height_cm"))


def _clines(cells: Column) -> Column:
    """The ranges of columns that cells with a rule below cover, adjoining ones as one."""
    ruled = F.filter(cells, lambda c: c["rule_below"])
    none = F.array().cast("array<struct<a:int,b:int>>")
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, c: Column) -> Column:
        end = c["col_start"] + c["grid_span"]
        joins = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last(acc)["b"]) == c["col_start"])
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.when(F.size(acc) > 0, last(acc)["a"]).alias("a"), end.alias("b"))))
        return F.when(joins, longer).otherwise(F.concat(acc, F.array(F.struct((c["col_start"] + 1).alias("a"), end.alias("b")))))

    return F.aggregate(ruled, none, step)


def tabular_code(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code): a table environment with a tabular, from (keys, row, col_start, grid_span, v_merge, text, rule_below).

    A first row of one cell over all columns is the caption. Merged cells become \\multicolumn and \\multirow; a cell that
    continues a merge is empty. A row with a rule below all of its cells ends in \\hline, below some in \\cline.
    """
    w = O.ordered([*keys, "col_start"], "row")
    goes_on = (F.col("v_merge") == "continue") & (F.col("row") - F.lag("row").over(w) == 1)
    runs = cells.withColumn("__quire_run", O.island(~F.coalesce(goes_on, F.lit(False)), w))
    runs = runs.withColumn("__quire_rows", F.count("*").over(Window.partitionBy(*keys, "col_start", "__quire_run")))
    of_table = Window.partitionBy(*keys)
    runs = runs.withColumn("__quire_columns", F.max(F.col("col_start") + F.col("grid_span")).over(of_table))
    text = F.replace(F.trim(F.coalesce("text", F.lit(""))), F.lit("&"), F.lit("\\&"))
    tall = F.when(F.col("v_merge") == "restart", F.concat(F.lit("\\multirow{"), F.col("__quire_rows"), F.lit("}{*}{"), text, F.lit("}"))).otherwise(text)
    wide = F.when(F.col("grid_span") > 1, F.concat(F.lit("\\multicolumn{"), F.col("grid_span"), F.lit("}{|c|}{"), tall, F.lit("}"))).otherwise(tall)
    shown = F.when(F.col("v_merge") == "continue", F.when(F.col("grid_span") > 1, F.concat(F.lit("\\multicolumn{"), F.col("grid_span"), F.lit("}{|c|}{}"))).otherwise("")).otherwise(wide)
    cell = F.struct("col_start", "grid_span", F.coalesce("rule_below", F.lit(False)).alias("rule_below"), shown.alias("shown"), text.alias("text"))
    rows = runs.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.first("__quire_columns").alias("columns"))
    title = (F.col("row") == 0) & (F.size("cells") == 1) & (F.get("cells", 0)["grid_span"] == F.col("columns"))
    clines = F.array_join(F.transform(_clines(F.col("cells")), lambda r: F.concat(F.lit("\\cline{"), r["a"], F.lit("-"), r["b"], F.lit("}"))), " ")
    rule = F.when(F.forall("cells", lambda c: c["rule_below"]), " \\hline").when(F.exists("cells", lambda c: c["rule_below"]), F.concat(F.lit(" "), clines)).otherwise("")
    line = F.concat(F.lit("    "), F.array_join(F.transform("cells", lambda c: c["shown"]), " & "), F.lit(" \\\\"), rule)
    parts = rows.select(*keys, "row", "columns", F.when(title, F.get("cells", 0)["text"]).alias("caption"), F.when(~title, line).alias("line"))
    tables = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("row", "line")))).alias("lines"), F.coalesce(F.max("caption"), F.lit("")).alias("caption"), F.max("columns").alias("columns"))
    code = F.concat_ws(
        "\n", F.lit("\\begin{table}[htbp]\n  \\centering"), F.concat(F.lit("  \\caption{"), "caption", F.lit("}")), F.concat(F.lit("  \\label{tab:"), X.slug(F.col("caption")), F.lit("}")),
        F.concat(F.lit("  \\begin{tabular}{|"), F.repeat(F.lit("c|"), F.col("columns")), F.lit("}\n    \\hline")), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("    \\hline\n  \\end{tabular}\n\\end{table}"),
    )
    return tables.select(*keys, code.alias("code"))
