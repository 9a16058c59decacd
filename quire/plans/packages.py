"""Word packages that are built from the documents inside the plan, and every scan of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import docx
from .registry import query, table


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _filled(xml: str) -> Column:
    """XML with [id], [lang] and [source] filled in from the document."""
    out = F.lit(xml)
    for name, value in (("[id]", F.col("doc_id").cast("string")), ("[lang]", F.coalesce(_escaped(F.col("lang")), F.lit(""))), ("[source]", F.coalesce(_escaped(F.col("source")), F.lit("")))):
        out = F.replace(out, F.lit(name), value)
    return out


#: What follows the lines of the text: seven blocks.
_TAIL = (
    '<w:p><w:r><w:rPr><w:b/><w:sz w:val="21"/><w:color w:val="EE0000"/></w:rPr><w:t>[lang]</w:t></w:r><w:r><w:rPr><w:b w:val="0"/><w:i/></w:rPr><w:t xml:space="preserve"> [source]</w:t></w:r><w:hyperlink w:anchor="sec"><w:r><w:t>see</w:t></w:r></w:hyperlink></w:p>'
    '<w:tbl><w:tr><w:tc><w:tcPr><w:tcW w:w="900" w:type="dxa"/><w:gridSpan w:val="2"/><w:tcBorders><w:top w:val="single"/></w:tcBorders></w:tcPr><w:p><w:r><w:t>[lang]</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>'
    "<w:tr><w:tc><w:p><w:r><w:t>[id]</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>"
    "<w:p><w:r><w:t>let </w:t></w:r><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath><w:r><w:t> be</w:t></w:r><m:oMathPara><m:oMath><m:sSup><m:e><m:r><m:t>y</m:t></m:r></m:e><m:sup><m:r><m:t>[id]</m:t></m:r></m:sup></m:sSup></m:oMath></m:oMathPara></w:p>"
    '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText xml:space="preserve"> HYPERLINK </w:instrText></w:r><w:r><w:instrText>\\l "_Bib_[id]"</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>[lang], </w:t></w:r><w:r><w:t>2020</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
    '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:drawing><a:blip r:embed="rIm1"/></w:drawing></w:r></w:p>'
    '<w:p><w:r><w:drawing><a:blip r:embed="rIm0"/><a:blip r:embed="none"/></w:drawing></w:r></w:p>'
    "<w:p/>"
)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a package for each document. Its lines are the first paragraphs; every fifth one is a heading."""
    line = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda x, k: F.concat(F.lit("<w:p><w:pPr>"), F.when(k % 5 == 0, '<w:pStyle w:val="Heading1"/>').otherwise('<w:ind w:firstLine="420"/>'), F.when(k == 0, '<w:jc w:val="center"/>').otherwise(""), F.lit("</w:pPr><w:r><w:t>"), _escaped(x), F.lit("</w:t></w:r></w:p>")),
    )
    media = F.array(F.struct(F.lit("pic.png").alias("name"), F.encode(F.coalesce("lang", F.lit("")), "UTF-8").alias("content")), F.struct(F.lit("b.jpg").alias("name"), F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("content")))
    return docx.packages(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.array_join(line, ""), _filled(_TAIL)).alias("body"), media.alias("media")))


def _scan(spark: SparkSession, sf_dir: str, kind: str, *columns: str | Column, read: list[str] | None = None) -> DataFrame:
    """``columns`` of the rows of one kind, of which ``read`` (null: the columns themselves) are read from the packages."""
    return docx.parse(packages(spark, sf_dir), kind, ["path", *(read or columns)]).select(F.col("path").cast("long").alias("doc_id"), *columns)


#: n: the number of lines, so the place of the first block after them.
_D = "with d as (select *, coalesce(text, '') as body, len(string_split(coalesce(text, ''), chr(10))) as n from documents)"


@query("s1_docx_blocks", _D + """, l as (select doc_id, unnest(range(n)) as k, unnest(string_split(body, chr(10))) as line from d)
    select doc_id, k as block_ord, k as para_ord, k as any_ord, 'p' as kind, case when k % 5 = 0 then 'Heading1' end as style, case when k = 0 then 'center' end as alignment, case when k % 5 <> 0 then 21.0 end as indent_pt, false as has_formula, line as text from l
    union all select doc_id, n + k, n + p, n + a, kind, null, null, null, f, replace(replace(replace(t, '[id]', cast(doc_id as varchar)), '[lang]', lang), '[source]', source) from d,
    (values (0, 0, 0, 'p', false, '[lang] [source]see'), (1, null, null, 'tbl', null, '[lang]ab[id]'), (2, 1, 7, 'p', true, 'let  be'), (3, 2, 8, 'p', false, '[lang], 2020'), (4, 3, 9, 'p', false, ''), (5, 4, 10, 'p', false, ''), (6, 5, 11, 'p', false, '')) v(k, p, a, kind, f, t)""")
def s1_docx(spark, sf_dir):
    return _scan(spark, sf_dir, "blocks", "block_ord", "para_ord", "any_ord", "kind", "style", "alignment", "indent_pt", "has_formula", "text")


@query("s2_docx_runs", _D + """, l as (select doc_id, unnest(range(n)) as k, unnest(string_split(body, chr(10))) as line from d)
    select doc_id, k as block_ord, 0 as ord, 'text' as type, line as text, null::boolean as bold, null::boolean as italic, null::double as size_pt, null as color, null as target from l where line <> ''
    union all select doc_id, n + k, o, type, replace(replace(replace(t, '[id]', cast(doc_id as varchar)), '[lang]', lang), '[source]', source), b, i, s, c, a from d,
    (values (0, 0, 'text', '[lang]', true, null, 10.5, 'EE0000', null), (0, 1, 'text', ' [source]', false, true, null, null, null), (0, 2, 'link', 'see', null, null, null, null, 'sec'),
    (2, 0, 'text', 'let ', null, null, null, null, null), (2, 1, 'formula', 'x', null, null, null, null, null), (2, 2, 'text', ' be', null, null, null, null, null), (2, 3, 'formula', 'y^{[id]}', null, null, null, null, null), (3, 4, 'text', '[lang], ', null, null, null, null, null), (3, 5, 'text', '2020', null, null, null, null, null)) v(k, o, type, t, b, i, s, c, a)""")
def s2_docx(spark, sf_dir):
    """Runs with text, in mixed order; field marks, instructions and pictures have none."""
    runs = _scan(spark, sf_dir, "blocks", "block_ord", F.posexplode("runs").alias("ord", "r"), read=["block_ord", "runs"])
    return runs.select("doc_id", "block_ord", "ord", "r.*").filter("text <> ''")


@query("s3_docx_media", "select doc_id, 0 as ord, 'fig1.png' as name, strlen(lang) as size, 'rIm0' as rel_id, lang as content from documents union all select doc_id, 1, 'fig2.jpg', length(cast(doc_id as varchar)), 'rIm1', cast(doc_id as varchar) from documents")
def s3_docx(spark, sf_dir):
    return _scan(spark, sf_dir, "media", "ord", "name", "size", "rel_id", F.decode("content", "UTF-8").alias("content"), read=["ord", "name", "size", "rel_id", "content"])


@query("s4_docx_pictures", _D + " select doc_id, n + k as block_ord, o as ord, rel as rel_id, name from d, (values (4, 0, 'rIm1', 'fig2.jpg'), (5, 0, 'rIm0', 'fig1.png'), (5, 1, 'none', null)) v(k, o, rel, name)")
def s4_docx(spark, sf_dir):
    return _scan(spark, sf_dir, "pictures", "block_ord", "ord", "rel_id", "name")


@query("s5_docx_cells", _D + """ select doc_id, 0 as table_ord, n + 1 as block_ord, r as "row", c as cell, col_start, span as grid_span, v as v_merge, w as width_twips, replace(replace(replace(t, '[id]', cast(doc_id as varchar)), '[lang]', lang), '|', chr(10)) as text, b as top from d,
    (values (0, 0, 0, 2, null, 900, '[lang]', 'single'), (0, 1, 2, 1, 'restart', null, 'a|b', null), (1, 0, 0, 1, null, null, '[id]', null), (1, 1, 1, 1, null, null, '', null), (1, 2, 2, 1, 'continue', null, '', null)) v(r, c, col_start, span, v, w, t, b)""")
def s5_docx(spark, sf_dir):
    return _scan(spark, sf_dir, "cells", "table_ord", "block_ord", "row", "cell", "col_start", "grid_span", "v_merge", "width_twips", "text", F.col("borders")["top"].alias("top"), read=["table_ord", "block_ord", "row", "cell", "col_start", "grid_span", "v_merge", "width_twips", "text", "borders"])


@query("s6_docx_formulas", _D + " select doc_id, n + 2 as block_ord, 0 as ord, 'inline' as type, 'let ' as before, 'x' as latex from d union all select doc_id, n + 2, 1, 'display', 'let  be', concat('y^{', doc_id, '}') from d")
def s6_docx(spark, sf_dir):
    return _scan(spark, sf_dir, "formulas", "block_ord", "ord", "type", "before", "latex")


@query("s7_docx_citations", _D + " select doc_id, n as any_ord, 'hyperlink' as source, 'sec' as target, 'see' as display from d union all select doc_id, n + 8, 'field', concat('_Bib_', doc_id), concat(lang, ', 2020') from d")
def s7_docx(spark, sf_dir):
    return _scan(spark, sf_dir, "citations", "any_ord", "source", "target", "display")
