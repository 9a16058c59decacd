"""Scanners, converters, classification, assembly and round trips over markup that is built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cites as C
from ..functions import equations as E
from ..functions import latex as L
from ..functions import omml
from ..operators import classify as K
from ..operators import ordered as O
from ..operators import tables as T
from ..sources import images, reports, tex
from ..streaming import documents as S
from .lines import lines
from .registry import query, table

B = "chr(92)"


def built(spark, sf, text: str, source: str = "documents", key: str = "doc_id"):
    return table(spark, sf, source).select(key, F.expr(text).alias("text"))


_BIB = "concat('@article{k', doc_id, ', author = {Smith, A. and {D}oe}, year = ', doc_id % 30 + 1990, ', title = \"T ', source, '\"} @comment{x, y} @book{b', doc_id % 7, ',title={', lang, '}}')"


@query("s8_bib_entries", "select doc_id, 0 as ord, concat('k', doc_id) as key, 'Smith, A. and {D}oe' as author, cast(doc_id % 30 + 1990 as varchar) as year, concat('T ', source) as title from documents union all select doc_id, 2, concat('b', doc_id % 7), '', '', lang from documents")
def s8(spark, sf):
    return tex.scan(built(spark, sf, _BIB), tex.bib_entries)


@query("s9_bib_keys", "select key, count(*) as n from (select concat('k', doc_id) as key from documents union all select concat('b', doc_id % 7) from documents) group by key")
def s9(spark, sf):
    keys = F.regexp_extract_all("text", F.lit(r"@(?!comment|preamble|string)\w+\s*\{\s*([^,\s]+)\s*,"), F.lit(1))
    return built(spark, sf, _BIB).select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


_BBL = f"concat({B}, 'begin{{thebibliography}}{{9}} ', {B}, 'bibitem[Wang(2020)]{{k', doc_id, '}} Wang: ', {B}, 'emph{{T}} ', {B}, 'doi{{10.1/', doc_id, '}} ', {B}, 'bibitem{{m', doc_id % 5, '}} Ma, http://x.org/', doc_id, ' ', {B}, 'end{{thebibliography}} ', {B}, 'bibitem{{no}} x')"


@query("s10_bbl_items", "select doc_id, 0 as ord, concat('k', doc_id) as item_key, 'Wang(2020)' as label, 'Wang: T' as plain_text, concat('https://doi.org/10.1/', doc_id) as doi_url, null as external_url from documents union all select doc_id, 1, concat('m', doc_id % 5), '2', concat('Ma, http://x.org/', doc_id), null, concat('http://x.org/', doc_id) from documents")
def s10_s11(spark, sf):
    return tex.bbl_items(built(spark, sf, _BBL)).drop("cite")


_LABELS = "concat(case doc_id % 5 when 0 then '[{Wang et~al.(2022{~natexlab{a}})Wang, Ding, and Ma}]' when 1 then concat('[', lang, ' Li(', doc_id % 40 + 1980, 'b)', lang, ' Li and Ng]') when 2 then '[Solo[x](1999)]' when 3 then '[{No {Y}ear}]' else '' end)"


@query("s11_bbl_labels", """select doc_id, k as ord, case k when 0 then concat('k', doc_id) else 'z' end as item_key, case k when 1 then '2' else case doc_id % 5 when 0 then 'Wang et al. (2022)' when 1 then concat(lang, ' Li and Ng (', doc_id % 40 + 1980, ')') when 2 then 'Solo[x] (1999)' when 3 then 'No Year' else '1' end end as cite
    from documents, (values (0), (1)) v(k)""")
def s11(spark, sf):
    """Labels in square brackets with braces and brackets inside, as authors and year; running numbers where there are none."""
    t = F.replace(F.expr(f"concat('~begin{{thebibliography}}{{9}} ~bibitem', {_LABELS}, '{{k', doc_id, '}} Wang: T ~bibitem{{z}} y')"), F.lit("~natexlab"), F.lit("\\natexlab"))
    t = F.replace(F.replace(t, F.lit("~bibitem"), F.lit("\\bibitem")), F.lit("~begin"), F.lit("\\begin"))
    return tex.bbl_items(table(spark, sf, "documents").select("doc_id", t.alias("text"))).select("doc_id", "ord", "item_key", "cite")


_FORM = f"concat('A ', {B}, 'begin{{equation}}a=', doc_id, {B}, 'label{{eq', doc_id % 6, '}}', {B}, 'end{{equation}} b $x_', doc_id % 9, '$ c ', {B}, '[z', {B}, ']')"


@query("s12_tex_formulas", "select doc_id, 0 as ord, 'display' as type, 'equation' as env, concat('a=', doc_id) as latex, concat('eq', doc_id % 6) as label from documents union all select doc_id, 1, 'inline', '$', concat('x_', doc_id % 9), null from documents union all select doc_id, 2, 'display', '[]', 'z', null from documents")
def s12(spark, sf):
    return tex.scan(built(spark, sf, _FORM), tex.formulas).select("doc_id", "ord", "type", "env", "latex", "label")


_FIG = f"concat('t ', {B}, 'begin{{figure}}', {B}, 'includegraphics[width=', doc_id % 9, 'cm]{{fig', doc_id, '.png}}', {B}, 'caption{{A {{b}} ', lang, '}}', chr(10), 'note ', doc_id % 3, chr(10), {B}, 'end{{figure}}')"


@query("s13_tex_figures", "select doc_id, concat('fig', doc_id, '.png') as path, concat('width=', doc_id % 9, 'cm') as width, concat('A {b} ', lang) as caption, concat('note ', doc_id % 3) as legend, false as is_full_width, 2 as start from documents")
def s13(spark, sf):
    return tex.scan(built(spark, sf, _FIG), tex.figures).select("doc_id", "path", "width", "caption", "legend", "is_full_width", "start")


_TAB = f"concat({B}, 'begin{{table}}', {B}, 'caption{{C', doc_id, '}}', {B}, 'begin{{tabular}}{{lcc}}', {B}, 'hline A & b', {B}, '&c & ', doc_id, ' ', {B}, {B}, ' ', {B}, 'multicolumn{{2}}{{c}}{{', {B}, 'textbf{{W}}}} & ', lang, {B}, {B}, {B}, 'end{{tabular}}', {B}, 'end{{table}}')"


@query("s15_tabular_cells", r"""select doc_id, 3 as columns, concat('C', doc_id) as caption, u.* from documents, lateral (values (0, 0, 1, 'A', false), (0, 1, 1, 'b\&c', false), (0, 2, 1, cast(doc_id as varchar), false), (1, 0, 2, 'W', true), (1, 2, 1, lang, false)) u("row", col_start, grid_span, "text", bold)""")
def s15_s16_x7(spark, sf):
    return tex.scan(built(spark, sf, _TAB), tex.tabulars).select("doc_id", "columns", "caption", "row", "col_start", "grid_span", "text", "bold")


@query("s19_probe_log", "select p_partkey, name, round(pt * 25.4 / 72.27, 4) as mm from (select p_partkey, 'textwidth' as name, p_size * 10.5 as pt from part union all select p_partkey, 'columnsep', p_size + 0.25 from part)")
def s19(spark, sf):
    log = built(spark, sf, "concat('noise', chr(10), 'PROBE-textwidth=', p_size * 10.5, 'pt', chr(10), 'PROBE-columnsep=', p_size + 0.25, 'pt')", "part", "p_partkey")
    pairs = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(r"PROBE-(\w+)=([0-9.]+)pt"), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "pt"))])
    return log.select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", "x.name", F.round(F.col("x.pt").try_cast("double") * 25.4 / 72.27, 4).alias("mm"))


_CLS = f"concat({B}, 'if@stage@final ', {B}, 'textwidth', doc_id % 90 + 100, 'mm ', {B}, 'else ', {B}, '@twocolumntrue ', {B}, 'fi ', {B}, 'columnsep 7mm')"


@query("x5_class_conditions", "select doc_id, 'final' as branch, 'textwidth' as param, cast(doc_id % 90 + 100 as double) as value from documents union all select doc_id, 'not final', 'column_count', 2.0 from documents union all select doc_id, 'shared', 'columnsep', 7.0 from documents")
def x5_s17(spark, sf):
    return tex.scan(built(spark, sf, _CLS), tex.conditions)


@query("x4_s7_field_targets", "select doc_id, concat('_Bib_', doc_id) as target from documents where doc_id % 2 = 0")
def x4(spark, sf):
    t = built(spark, sf, "concat('begin HYPERLINK ', chr(92), 'l \"', case when doc_id % 2 = 0 then '_Bib_' else '' end, case when doc_id % 2 = 0 then cast(doc_id as string) else '' end, '\" separate x end')")
    return t.select("doc_id", F.regexp_extract("text", r'HYPERLINK\s+\\l\s+"([^"]+)"', 1).alias("target")).filter("target <> ''")


# --- converters in Arrow batches

@query("p30_equation_width", "select doc_id, round(0.9 + greatest(0.8, 0.45 * 0.9 * length(cast(doc_id as varchar))) + 0.9 + 0.9 + 2 * 0.9, 6) as width from documents")
def p30(spark, sf):
    return built(spark, sf, r"concat('a_{', doc_id, r'}+\alpha xy')").select("doc_id", F.round(E.width_of("text"), 6).alias("width"))


@query("p32_equation_lines", r"select doc_id, concat('y &=a', doc_id, '+b|&\quad +c') as t from documents")
def p32(spark, sf):
    return built(spark, sf, "concat('y = a', doc_id, '+b+c')").select("doc_id", F.array_join(E.lines_of("text", F.lit(40.0)), "|").alias("t"))


@query("p35_formula_cleanup", r"select doc_id, concat('X', doc_id % 9, ' \times y-1') as t from documents")
def p35(spark, sf):
    return built(spark, sf, "concat('Ｘ', doc_id % 9, ' ×  y−１$')").select("doc_id", E.cleaned_of("text").alias("t"))


_OMML = "concat('<m:oMath xmlns:m=\"http://schemas.openxmlformats.org/officeDocument/2006/math\"><m:f><m:num><m:r><m:t>', doc_id, '</m:t></m:r></m:num><m:den><m:sSup><m:e><m:r><m:t>α</m:t></m:r></m:e><m:sup><m:r><m:t>', doc_id % 4, '</m:t></m:r></m:sup></m:sSup></m:den></m:f></m:oMath>')"


@query("p36_math_to_latex", r"select doc_id, concat('\frac{', doc_id, '}{\alpha^{', doc_id % 4, '}}') as t from documents")
def p36_s6(spark, sf):
    return built(spark, sf, _OMML).select("doc_id", omml.latex_of("text").alias("t"))


@query("p37_operands", r"select doc_id, concat('\sum_{i}^{n}{x_{', doc_id, '}}+1') as t from documents")
def p37(spark, sf):
    return built(spark, sf, r"concat(r'\sum_{i}^{n} x_{', doc_id, '}+1')").select("doc_id", E.with_operands_of("text").alias("t"))


_GRID = "select conv_id, cast(turn // 3 as int) as r, cast(turn % 3 as int) as c, case when turn % 3 = 1 and turn % 2 = 1 then '12.5 %' else trim(text) end as t, 1.0 + conv_id % 3 + turn % 3 as w, case when turn % 5 = 0 then 700 end as h from conversations"


def _grid(spark, sf):
    """Cells of a table for each conversation, three to a row, and the widths of their columns."""
    t = table(spark, sf, "conversations").select(
        "conv_id", F.floor(F.col("turn") / 3).cast("int").alias("row"), (F.col("turn") % 3).cast("int").alias("col_start"), F.lit(1).alias("grid_span"),
        F.when((F.col("turn") % 3 == 1) & (F.col("turn") % 2 == 1), "12.5 %").otherwise(F.col("text")).alias("text"), F.when(F.col("turn") % 5 == 0, 700).alias("row_height"), (1.0 + F.col("conv_id") % 3 + F.col("turn") % 3).alias("width_cm"),
    )
    return t.drop("width_cm"), t.groupBy("conv_id", F.col("col_start").alias("col")).agg(F.max("width_cm").alias("width_cm"))


@query("p46_table_height", f"""with g as ({_GRID}), n as (select conv_id, count(distinct c) as cols from g group by 1),
    l as (select g.conv_id, r, c, cols, greatest(coalesce(h, 400), 400) / 567.0 as least, case when t = '' then 1 else greatest(1, floor((0.55 * length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) + length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))) * 0.42 / w) + 1) end as k from g join n using (conv_id)),
    rows_ as (select conv_id, r, max(case when r = 0 and c = 0 and cols = 1 then 0 else greatest(least, case when k > 1 then k * 0.55 else 0 end) end) as high from l group by 1, 2)
    select conv_id, round(sum(high), 6) as cm from rows_ group by 1""")
def p46(spark, sf):
    cells, widths = _grid(spark, sf)
    return T.heights(cells, widths, ["conv_id"]).select("conv_id", F.round("height_cm", 6).alias("cm"))


@query("p47_column_widths", f"""with g as ({_GRID}), c as (select conv_id, c as col, max(w) as w0, max(length(t)) filter (where not regexp_matches(t, '^[-+±0-9.,\\s%/()]*$')) as long from g group by 1, 2),
    s as (select *, greatest(w0 * 12.0 / sum(w0) over (partition by conv_id), 0.2) as w from c),
    d as (select *, case when long >= 16 and least(greatest(w, long * 0.16), 4.5) > w then least(greatest(w, long * 0.16), 4.5) - w end as up from s),
    e as (select *, case when up is null then greatest(w - 1.15, 0) else 0 end as spare, sum(up) over (partition by conv_id) as asked from d), f as (select *, sum(spare) over (partition by conv_id) as offered from e)
    select conv_id, col, round(case when asked > 0 and offered > 0 then case when up is not null then w + up * least(1.0, offered / asked) else w - asked * least(1.0, offered / asked) * spare / offered end else w end, 6) as cm from f""")
def p47(spark, sf):
    """Widths scaled to 12 cm; columns of long text then grow at the cost of the others."""
    cells, widths = _grid(spark, sf)
    return T.rebalanced_widths(T.scaled_widths(widths, ["conv_id"], 12.0), cells, ["conv_id"]).select("conv_id", "col", F.round("width_cm", 6).alias("cm"))


@query("p57_preamble_lines", "with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord, unnest(string_split(text, chr(10))) as line from documents), f as (select *, bool_or(ord % 4 = 1) over (partition by doc_id order by ord) as on_ from l) select doc_id, count(*) as n from f where not on_ or ord % 4 <> 2 group by 1")
def p57(spark, sf):
    on = O.latched(F.col("ord") % 4 == 1, O.ordered(["doc_id"], "ord"))
    return lines(spark, sf).withColumn("on", on).filter(~F.col("on") | (F.col("ord") % 4 != 2)).groupBy("doc_id").agg(F.count("*").alias("n"))


# --- tables there and back, classification, assembly, reports

_CELLS = "select conv_id, cast(turn as int) as \"row\", cast(length(role) % 3 as int) as col_start, 1 as grid_span, text, cast(turn * 100 as int) as width_twips from conversations"


@query("k4_table_round_trip", _CELLS)
def k4_x6_p52(spark, sf):
    """Cells to TikZ code and back: the description in the code makes it lossless."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("int").alias("row"), (F.length("role") % 3).cast("int").alias("col_start"), F.lit(1).alias("grid_span"), "text", (F.col("turn") * 100).cast("int").alias("width_twips"))
    return tex.cells_of_code(tex.table_code(c, ["conv_id"]), ["conv_id"])


_ROWS = (  # row, col_start, grid_span, v_merge, text, rule_below
    (0, 0, 3, None, "Caption [id] of [lang]", False), (1, 0, 2, None, "a & [lang]", True), (1, 2, 1, "restart", "tall [id]", False), (2, 0, 1, None, "x", True), (2, 1, 1, None, None, True), (2, 2, 1, "continue", "", True),
    (3, 0, 1, None, "y", True), (3, 1, 1, None, "z", False), (3, 2, 1, None, " w ", True),
)
_EXPECTED = r"""\begin{table}[htbp]
  \centering
  \caption{Caption [id] of [lang]}
  \label{tab:Caption-[id]-of-[lang]}
  \begin{tabular}{|c|c|c|}
    \hline
    \multicolumn{2}{|c|}{a \& [lang]} & \multirow{2}{*}{tall [id]} \\ \cline{1-2}
    x &  &  \\ \hline
    y & z & w \\ \cline{1-1} \cline{3-3}
    \hline
  \end{tabular}
\end{table}"""


@query("k4_tabular_code", f"select doc_id, replace(replace('{_EXPECTED}', '[id]', cast(doc_id as varchar)), '[lang]', lang) as code from documents")
def k4_tabular(spark, sf):
    cell = lambda r: F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, (("row", "int"), ("col_start", "int"), ("grid_span", "int"), ("v_merge", "string"), ("text", "string"), ("rule_below", "boolean")))])
    cells = table(spark, sf, "documents").select("doc_id", "lang", F.inline(F.array(*[cell(r) for r in _ROWS])))
    return T.tabular_code(cells.withColumn("text", F.replace(F.replace("text", F.lit("[id]"), F.col("doc_id").cast("string")), F.lit("[lang]"), F.col("lang"))), ["doc_id"])


_TIKZ = (
    "concat({B}, 'begin{{table*}}{B2}renewcommand{{{B2}thetable}}{{', doc_id, '}}{B2}caption{{C {{', lang, '}}}}{B2}begin{{tikzpicture}}N', doc_id, '{B2}end{{tikzpicture}}{B2}end{{table*}} ', {B}, 'begin{{table}}{B2}begin{{tabular}}{{l}}x{B2}end{{tabular}}{B2}end{{table}}', "
    "{B}, 'begin{{strip}}{B2}begin{{tikzpicture}}no{B2}end{{tikzpicture}}{B2}end{{strip}}', {B}, 'begin{{strip}}{B2}def{B2}@captype{{table}}{B2}begin{{tikzpicture}}S{B2}end{{tikzpicture}}{B2}end{{strip}}', "
    "chr(10), '% WORD_SUPERTABLE_BEGIN number=S', doc_id, chr(10), '% WORD_SUPERTABLE_TIKZ=', 'JSBtZXRhOmZ1bGxfd2lkdGg9MQpL', chr(10), {B}, 'tablecaption{{L ', lang, '}} x', chr(10), '% WORD_SUPERTABLE_END')"
)


@query("s14_tikz_tables", """select doc_id, 0 as ord, 'table*' as kind, cast(doc_id as varchar) as number, concat('C {', lang, '}') as caption, concat('N', doc_id) as body, true as is_full_width from documents
    union all select doc_id, 1, 'strip', '', '', 'S', true from documents union all select doc_id, 2, 'supertabular', concat('S', doc_id), concat('L ', lang), concat('% meta:full_width=1', chr(10), 'K'), true from documents""")
def s14(spark, sf):
    text = F.replace(F.expr(_TIKZ.format(B=B, B2="~")), F.lit("~"), F.lit("\\"))
    return tex.scan(table(spark, sf, "documents").select("doc_id", text.alias("text")), tex.tikz_tables).select("doc_id", "ord", "kind", "number", "caption", "body", "is_full_width")


def _blocks(spark, sf):
    b = lines(spark, sf).withColumnRenamed("ord", "block_ord")
    text = F.when(F.col("block_ord") % 6 == 3, F.concat(F.lit("Figure 2. "), "line")).when(F.col("block_ord") == 1, "Abstract").otherwise(F.col("line"))
    return b.select(
        "doc_id", "block_ord", text.alias("text"), F.when(F.col("block_ord") % 7 == 5, 1).alias("heading_level"), F.when(F.col("block_ord") < 1, "center").alias("alignment"),
        F.when(F.col("block_ord") % 6 == 3, 9.0).otherwise(12.0).alias("size_pt"), F.lit(None).cast("double").alias("indent_pt"), F.lit(False).alias("has_formula"), F.col("line").contains("(1)").alias("has_cite"),
    )


@query("x1_classified_blocks")
def x1_w1_w2(spark, sf):
    return K.classify(_blocks(spark, sf), ["doc_id"]).select("doc_id", "block_ord", "semantic_type")


@query("x2_k3_assembled_tex")
def x2(spark, sf):
    return K.assemble(K.classify(_blocks(spark, sf), ["doc_id"]), ["doc_id"])


@query("k2_block_report")
def k2(spark, sf):
    return reports.block_report(K.classify(_blocks(spark, sf), ["doc_id"]), ["doc_id"])


@query("k9_round_trip_report", "select concat('| ', level, ' | ', n, ' | ', printf('%.1f', 100.0 * n / sum(n) over ()), ' % |') as line from (select case doc_id % 3 when 0 then 'exact' when 1 then 'semantic' else 'different' end as level, count(*) as n from documents group by 1)")
def k9(spark, sf):
    p = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 1, "x_{2}").otherwise("x_2").alias("a"), F.when(F.col("doc_id") % 3 == 2, "y").otherwise("x_2").alias("b"))
    return reports.round_trip_report(p.select(L.formula_match(F.col("a"), F.col("b")).alias("level")), "level")


@query("x8_image_match")
def x8(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("g"), F.col("vec_id"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("histogram"), (F.col("vec_id") % 7 * 60).cast("int").alias("width"), F.lit(100).alias("height"), (F.col("vec_id") * 2000).alias("file_size"))
    side = lambda odd, name: e.filter(F.col("vec_id") % 2 == odd).select("g", F.concat(F.lit(name), "vec_id", F.lit(".png")).alias("path"), "width", "height", "file_size", "histogram")
    return images.match(side(0, "fig"), side(1, "orig"), "g")


@query("x11_rule_fallback", "select doc_id, case when length(text) < 30 then 'short' when not regexp_matches(text, '[.!?]\\s*$') then 'no_end' else 'ok' end as verdict from documents")
def x11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.length("text") < 30, "short").when(~F.col("text").rlike(r"[.!?]\s*$"), "no_end").otherwise("ok").alias("verdict"))


# --- extensions beyond the reference: windows in time, grouping sets, sketches

@query("e1_tumbling_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def e1(spark, sf):
    return S.tumbling(table(spark, sf, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("e2_session_windows", "with g as (select user_id, ts, sum(case when p is null or ts >= p + interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events)) select user_id, min(ts) as start, count(*) as n from g group by user_id, s")
def e2(spark, sf):
    return S.sessions(table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("e3_grouping_sets", "select lang, source, count(*) as n from documents group by grouping sets ((lang, source), (lang), ())")
def e3(spark, sf):
    return table(spark, sf, "documents").groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.count("*").alias("n"))


@query("e4_sketches")
def e4(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"), F.percentile_approx("l_quantity", [0.5, 0.9]).alias("quantiles"))


# --- a document's way through all of it

@query("q_cited_entries_flow", "with c as (select distinct doc_id, unnest([concat('k', doc_id % 7), concat('k', doc_id % 5), 'zz']) as k from documents), b as (select distinct concat('k', n_nationkey) as k, n_name from nation) select doc_id, count(b.k) as found, count(*) - count(b.k) as missing, max(b.n_name) as last from c left join b using (k) group by doc_id")
def cited_entries_flow(spark, sf):
    """Citation commands of every document, joined to the bibliography: found, missing."""
    t = built(spark, sf, r"concat(r'x (\citep{k', doc_id % 7, ', k', doc_id % 5, r'}) y \citet{zz}')")
    keys = t.select("doc_id", F.explode(C.cited_keys(F.col("text"))).alias("k"))
    bib = table(spark, sf, "nation").select(F.concat(F.lit("k"), "n_nationkey").alias("k"), "n_name")
    return keys.join(bib.withColumn("hit", F.lit(1)), "k", "left").groupBy("doc_id").agg(F.count("hit").alias("found"), (F.count("*") - F.count("hit")).alias("missing"), F.max("n_name").alias("last"))
