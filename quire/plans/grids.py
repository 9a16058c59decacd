"""Cells of tables out of code, whatever their braces, spans and merges: from tabular code, from drawn lines, and piece by piece."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import braces
from ..functions import latex as L
from ..operators import grids as G
from ..operators import ordered as O
from ..sources import tex
from .lines import lines
from .registry import query, table

# --- formats, cells and rows, from the line items of an order

_FORM = "concat(case l_linenumber % 4 when 0 then '|' when 1 then concat('@{', chr(92), 'hspace{', repeat('{', cast(l_linenumber as int)), 'l|r', repeat('}', cast(l_linenumber as int)), '}}') when 2 then '>{p{3cm}|}' else ' ' end, case l_returnflag when 'A' then 'l' when 'N' then 'c' else concat('p{', cast(l_quantity as int), case l_linestatus when 'F' then 'mm' else 'cm' end, '}') end, case when l_partkey % 3 = 0 then '|' else '' end)"


@query("p49_column_format", """with n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) as k from lineitem)
    select l_orderkey, cast(k - 1 as int) as col, case l_returnflag when 'A' then 'left' when 'N' then 'center' else 'left' end as align, case when l_returnflag not in ('A', 'N') then cast(round_even(cast(l_quantity as int) * case l_linestatus when 'F' then 56.7 else 567.0 end, 0) as int) end as width_twips,
      k = 1 and l_linenumber % 4 = 0 as rule_left, l_partkey % 3 = 0 or coalesce(lead(l_linenumber % 4 = 0) over (partition by l_orderkey order by k), false) as rule_right from n""")
def p49(spark, sf):
    """The format of a table with a column for each line of an order, put together and read: alignment, width and rules of every column."""
    part = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", F.expr(_FORM).alias("part"))
    forms = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "").alias("form"))
    return forms.select("l_orderkey", F.posexplode(braces.columns(F.col("form"))).alias("col", "c")).select("l_orderkey", "col", "c.*")


_DEPTH = "cast(doc_id % 10 + 1 as int)"


@query("p50_cell_text", """select doc_id, concat('A ', lang, ' & ', case doc_id % 3 when 0 then '{x}' else '' end, ' H', translate(cast(doc_id as varchar), '0123456789', '₀₁₂₃₄₅₆₇₈₉'), ' ', n_chars, '%') as "text", doc_id % 2 = 0 as bold, doc_id % 3 = 1 as italic,
    case doc_id % 4 when 0 then 8 when 1 then 14 end as size_pt from documents""")
def p50(spark, sf):
    """Text and style of a cell of code with braces up to ten deep and more, escapes and subscripts."""
    code = f"""concat(case doc_id % 4 when 0 then '~scriptsize ' when 1 then '~large ' else '' end, case when doc_id % 2 = 0 then '~textbf{{' else '' end, repeat('{{', {_DEPTH}), 'A ', lang, ' ~& ', case doc_id % 3 when 0 then '~{{x~}}' when 1 then '~emph{{}}' else '' end,
        repeat('}}', {_DEPTH}), case when doc_id % 2 = 0 then '}}' else '' end, ' H$_', case when doc_id % 2 = 0 then concat('{{', doc_id, '}}') else cast(doc_id as string) end, '$ ', n_chars, '~%')"""
    return table(spark, sf, "documents").select("doc_id", F.replace(F.expr(code), F.lit("~"), F.lit("\\")).alias("t")).select("doc_id", braces.cell(F.col("t")).alias("c")).select("doc_id", "c.*")


@query("p51_cell_split", f"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord, unnest(string_split(text, chr(10))) as line from documents),
      s as (select doc_id, ord, list_concat([concat(repeat('{{', {_DEPTH}), ord, ' & ', doc_id, repeat('}}', {_DEPTH})), concat(length(line), ' ', chr(92), '& ', chr(92), '{{')], list_transform(string_split(translate(line, concat('{{}}', chr(92)), ''), '&'), lambda x: trim(x))) as w from l)
    select doc_id, ord, len(w) as n, array_to_string(w, '|') as cells, array_to_string(list_resize(w, doc_id % 6, ''), '|') as padded from s""")
def p51(spark, sf):
    """Cells of a row, for every line: split at depth 0, with braces up to ten deep and escaped separators before it; and the same filled up or cut."""
    t = F.expr(f"concat(repeat('{{', {_DEPTH}), ord, ' & ', doc_id, repeat('}}', {_DEPTH}), '&', length(line), ' ', chr(92), '& ', chr(92), '{{&', translate(line, concat('{{}}', chr(92)), ''))")
    cells = lines(spark, sf).select("doc_id", "ord", braces.split(t).alias("w"))
    return cells.select("doc_id", "ord", F.size("w").cast("long").alias("n"), F.array_join("w", "|").alias("cells"), F.array_join(braces.padded(F.col("w"), (F.col("doc_id") % 6).cast("int")), "|").alias("padded"))


@query("p11_nested_arguments", f"""select doc_id, [concat('in ', lang), concat('a ', repeat('{{', {_DEPTH}), source, repeat('}}', {_DEPTH}), ' ', chr(92), 'emph{{in ', lang, '}} z'), 'open'] as bodies, concat('x a ', repeat('{{', {_DEPTH}), source, repeat('}}', {_DEPTH}), ' in ', lang, ' z y ', chr(92), 'other{{k}} ', doc_id) as bare from documents""")
def p11(spark, sf):
    """Arguments of commands with braces up to ten deep and more, one inside another and one that nothing closes; and the text without these commands."""
    inner = f"concat('x ~textbf [o] {{a ', repeat('{{', {_DEPTH}), source, repeat('}}', {_DEPTH}), ' ~emph{{in ', lang, '}} z}} y ~other{{k}} ', doc_id"
    d = table(spark, sf, "documents").select("doc_id", *[F.replace(F.expr(e), F.lit("~"), F.lit("\\")).alias(n) for n, e in (("t", inner + ")"), ("u", inner + ", '~textbf{open')"))])
    return d.select("doc_id", braces.bodies(F.col("u"), "textbf", "emph").alias("bodies"), braces.unwrapped(F.col("t"), "textbf", "emph").alias("bare"))


# --- whole tables: a row for each line of an order, runs of equal flags and of equal flags and states merged

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
_RUNS = f"""with n as (select *, row_number() over w - 1 as r, case when lag(l_returnflag) over w = l_returnflag then 0 else 1 end as new_a, case when lag(l_returnflag) over w = l_returnflag and lag(l_linestatus) over w = l_linestatus then 0 else 1 end as new_b from lineitem window w as (partition by l_orderkey order by {", ".join(_ORDER)})),
    m as (select *, sum(new_a) over (partition by l_orderkey order by r) as a, sum(new_b) over (partition by l_orderkey order by r) as b from n),
    g as (select *, min(r) over (partition by l_orderkey, a) as a0, count(*) over (partition by l_orderkey, a) as an, min(r) over (partition by l_orderkey, b) as b0, count(*) over (partition by l_orderkey, b) as bn from m),
    cells as (select l_orderkey, r as "row", 0 as col_start, 1 as grid_span, a0 as "first", an as rows, concat(l_returnflag, ' {{', a0, '}}') as "text" from g
      union all select l_orderkey, r, 1, 2, b0, bn, concat(l_linestatus, ' & ', b0) from g where l_linestatus = 'F'
      union all select l_orderkey, r, 1, 1, r, 1, cast(l_partkey as varchar) from g where l_linestatus <> 'F' union all select l_orderkey, r, 2, 1, r, 1, concat('s_', l_suppkey) from g where l_linestatus <> 'F'
      union all select l_orderkey, r, 3, 1, r, 1, concat(cast(l_quantity as int), '%') from g union all select l_orderkey, r, 4, 1, r, 1, case when l_suppkey % 2 = 0 then '' else 'odd' end from g)"""


def _rows(spark, sf):
    """(l_orderkey, row, cells) with the cells (col_start, grid_span, first, rows, text) of a row in order: merged ones in each of their ``rows`` from ``first`` on."""
    w = O.ordered(["l_orderkey"], *_ORDER)
    flag, state = (F.col(c) != F.lag(c).over(w) for c in ("l_returnflag", "l_linestatus"))
    n = table(spark, sf, "lineitem").withColumns({"row": (F.row_number().over(w) - 1), "a": O.island(flag, w), "b": O.island(flag | state, w)})
    for run in "ab":
        of = Window.partitionBy("l_orderkey", run)
        n = n.withColumns({f"{run}0": F.min("row").over(of), f"{run}n": F.count("*").over(of).cast("int")})
    one, f = F.lit(1), F.col("l_linestatus") == "F"
    cell = lambda col, span, first, rows, text: F.struct(F.lit(col).alias("col_start"), F.lit(span).alias("grid_span"), first.alias("first"), rows.alias("rows"), text.alias("text"))
    wide = cell(1, 2, F.col("b0"), F.col("bn"), F.concat("l_linestatus", F.lit(" & "), "b0"))
    rest = [cell(1, 1, F.col("row"), one, F.col("l_partkey").cast("string")), cell(2, 1, F.col("row"), one, F.concat(F.lit("s_"), "l_suppkey"))]
    all_ = F.concat(
        F.array(cell(0, 1, F.col("a0"), F.col("an"), F.concat("l_returnflag", F.lit(" {"), "a0", F.lit("}")))), F.when(f, F.array(wide)).otherwise(F.array(*rest)),
        F.array(cell(3, 1, F.col("row"), one, F.concat(F.col("l_quantity").cast("int"), F.lit("%"))), cell(4, 1, F.col("row"), one, F.when(F.col("l_suppkey") % 2 == 0, "").otherwise("odd"))),
    )
    return n.select("l_orderkey", "row", all_.alias("cells"))


def _cells(spark, sf):
    """The same with a row for each cell: (l_orderkey, row, col_start, grid_span, first, rows, text)."""
    return _rows(spark, sf).select("l_orderkey", "row", F.inline("cells"))


_MERGE = """case when rows = 1 then null when "row" = "first" then 'restart' else 'continue' end as v_merge"""


@query("x7_multirow_cells", _RUNS + f""" select l_orderkey, "row", col_start, grid_span, {_MERGE}, case when "row" = "first" then rows else 1 end as row_span, case when "row" = "first" then translate("text", '{{}}', '') else '' end as "text" from cells""")
def x7(spark, sf):
    """Tabular code in which \\multirow and \\multicolumn cross, back into cells. Odd orders leave out the empty cells below a taller one."""
    row, odd = F.col("row"), F.col("l_orderkey") % 2 == 1

    def shown(c):
        text = F.replace(F.replace(c["text"], F.lit("&"), F.lit("\\&")), F.lit("%"), F.lit("\\%"))
        tall = F.when(c["first"] != row, F.lit("")).when(c["rows"] > 1, F.concat(F.lit("\\multirow{"), c["rows"], F.lit("}{*}{"), text, F.lit("}"))).otherwise(text)
        return F.when(c["grid_span"] > 1, F.concat(F.lit("\\multicolumn{"), c["grid_span"], F.lit("}{@{}c|}{"), tall, F.lit("}"))).otherwise(tall)

    written = F.filter("cells", lambda c: (c["first"] == row) | ~odd)
    rows = _rows(spark, sf).select("l_orderkey", "row", F.array_join(F.transform(written, shown), " & ").alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), " \\\\ \\hline\n")
    code = rows.groupBy("l_orderkey").agg(F.concat(F.lit("\\begin{tabular}{|l|@{}c|*{2}{r|}p{2cm}|}\n\\hline "), lines, F.lit("\\\\\n\\end{tabular}")).alias("text"))
    back = tex.scan(code, tex.tabulars, key="l_orderkey", only=("row", "col_start", "grid_span", "v_merge", "row_span", "text"))
    return back.select("l_orderkey", "row", "col_start", "grid_span", "v_merge", "row_span", F.replace(F.replace("text", F.lit("\\&"), F.lit("&")), F.lit("\\%"), F.lit("%")).alias("text"))


@query("x6_drawn_cells", _RUNS + f""" select l_orderkey, "row", col_start - case when hidden and col_start > 1 then 1 else 0 end as col_start, case when hidden then 1 else grid_span end as grid_span, {_MERGE}, rows as row_span, case when "row" = "first" then "text" else '' end as "text",
    case when "row" = "first" then 0.4 + l_orderkey % 3 * 0.4 end as top_pt, case when "row" = "first" + rows - 1 then 0.4 + l_orderkey % 3 * 0.4 end as bottom_pt, 0.4 + l_orderkey % 3 * 0.4 as left_pt, 0.4 + l_orderkey % 3 * 0.4 as right_pt from cells join (select l_orderkey, bool_and(l_linestatus = 'F') as hidden from lineitem group by 1) using (l_orderkey)""")
def x6_k4(spark, sf):
    """Tables drawn as lines and nodes without any description, back into cells: rows, spans, merges, texts and widths of borders.

    Where no row draws the line between two columns (``hidden`` in the SQL), they are one column to whoever only sees the drawing.
    """
    c = _cells(spark, sf)
    once = c.filter("row = first").withColumn("row_span", F.col("rows")).withColumn("pt", F.lit(0.4) + F.col("l_orderkey") % 3 * F.lit(0.4))
    widths = table(spark, sf, "lineitem").select("l_orderkey").distinct().select("l_orderkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("col")).withColumn("width_cm", F.lit(1.3) + F.col("l_orderkey") % 7 * 0.31 + F.col("col") * 0.17)
    back = G.drawn_cells(G.drawn_code(once, widths, ["l_orderkey"]), ["l_orderkey"])
    pts = [F.round(p, 6).alias(p) for p in ("top_pt", "bottom_pt", "left_pt", "right_pt")]
    return back.select("l_orderkey", "row", "col_start", "grid_span", "v_merge", "row_span", braces.cell_text(F.col("text")).alias("text"), *pts)


_SOURCE = (
    "concat('~begin{table}~begin{tabular}{lc} ~multirow{2}{*}{', lang, '} & ', doc_id, ' ~~ & ', source, ' ~~ ~end{tabular}~end{table} text ~begin{table}~caption{c}~begin{tikzpicture}', chr(10), "
    "'~draw (0,0) -- (4,0);~draw (0,-1) -- (4,-1);~draw[line width=1pt] (0,-2) -- (4,-2);~draw (0,0) -- (0,-2);~draw (4,0) -- (4,-2);~draw (1.5,', case when doc_id % 2 = 0 then '-1' else '0' end, ') -- (1.5,-2);', "
    "'~node at (', case when doc_id % 2 = 0 then 2.0 else 0.75 end, ',-0.5) {', lang, ' {~bfseries x}};', case when doc_id % 2 = 0 then '' else '~node at (2.7,-0.5) {right};' end, '~node at (0.75,-1.5) {', doc_id, '};~end{tikzpicture}~end{table}')"
)


@query("s16_tex_tables", """select doc_id, 'tabular' as kind, 0 as table_ord, r as "row", c as col_start, 1 as grid_span, m as v_merge, replace(replace(replace(t, '[lang]', lang), '[id]', cast(doc_id as varchar)), '[source]', source) as "text" from documents, (values (0, 0, 'restart', '[lang]'), (0, 1, null, '[id]'), (1, 0, 'continue', ''), (1, 1, null, '[source]')) v(r, c, m, t)
    union all select doc_id, 'tikz', 0, 0, 0, case when doc_id % 2 = 0 then 2 else 1 end, null, concat(lang, ' x') from documents union all select doc_id, 'tikz', 0, 0, 1, 1, null, 'right' from documents where doc_id % 2 = 1
    union all select doc_id, 'tikz', 0, 1, 0, 1, null, cast(doc_id as varchar) from documents union all select doc_id, 'tikz', 0, 1, 1, 1, null, '' from documents""")
def s16(spark, sf):
    """Both kinds of tables of a source as one record: a tabular with a taller cell, and a drawn table whose upper cells are one in every second document."""
    t = F.replace(F.expr(_SOURCE), F.lit("~~"), F.lit("\\\\"))
    return G.tables_of_tex(table(spark, sf, "documents").select("doc_id", F.replace(t, F.lit("~"), F.lit("\\")).alias("text")))
