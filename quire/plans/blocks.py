"""Blocks by what they say about themselves: captions, figure sizes, names, affiliations, preambles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import latex as L
from ..sources import docx, images, reports
from .lines import lines
from .packages import packages
from .registry import query, table
from .scalars import scalar

_LINES = "with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord, unnest(string_split(text, chr(10))) as line from documents)"


def _blocks(spark, sf):
    """Lines as blocks: some begin like captions; sizes, alignment and indent follow from their places and lengths."""
    size = lambda k: F.when((F.col("ord") + k) % 7 < 5, 8.0 + (F.col("ord") * 3 + F.length("line") + k) % 5)
    cut = F.least(F.length("line"), F.lit(5) + F.col("ord") % 9)
    text = F.expr("case ord % 6 when 1 then concat('Figure ', ord, '. ', line) when 3 then concat('表 2.1、', line) when 4 then concat('table of ', line) else line end")
    run = lambda k, t: F.struct(t.alias("text"), size(k).alias("size_pt"))
    return lines(spark, sf).select("doc_id", "ord", text.alias("text"), F.array(run(0, F.substring("line", F.lit(1), cut)), run(1, F.substring("line", cut + 1, F.length("line"))), run(2, F.lit(" "))).alias("runs"), F.when(F.col("ord") % 4 == 0, "center").alias("alignment"), F.when(F.col("ord") % 3 == 0, 21.0).alias("indent"), (10.0 + F.col("ord") % 3).alias("body"))


_SIZED = _LINES + """, z as (select *, least(length(line), 5 + ord % 9) as cut, case when ord % 7 < 5 then 8.0 + (ord * 3 + length(line)) % 5 end as z0, case when (ord + 1) % 7 < 5 then 8.0 + (ord * 3 + length(line) + 1) % 5 end as z1, case when (ord + 2) % 7 < 5 then 8.0 + (ord * 3 + length(line) + 2) % 5 end as z2,
    10.0 + ord % 3 as body, case ord % 6 when 1 then concat('Figure ', ord, '. ', line) when 3 then concat('表 2.1、', line) when 4 then concat('table of ', line) else line end as t from l),
    s as (select *, case when trim(substring(line, 1, cut)) <> '' then z0 end as s0, case when trim(substring(line, cut + 1)) <> '' then z1 end as s1 from z)"""


@query("f3_caption_blocks", _SIZED + r""" select doc_id, ord, trim(t) <> '' and (coalesce(coalesce(s0, s1) * 2 <= body * 2 - 4, false) or coalesce(greatest(s0, s1) < body - 1, false) or regexp_matches(trim(t), '(?i)^(?:[图表]\s*[0-9.]+|Figure|Fig\.|Table|Tab\.|Talbe)') and (ord % 4 = 0 or ord % 3 <> 0)) as by_style,
    regexp_matches(trim(t), '(?i)^(?:Figure|Fig\.?|Table|Tab\.?)\s*[0-9]+(?:\.[0-9]+)*\s*[.:：．]\s+|^(?:图|表)\s*[0-9]+(?:\.[0-9]+)*\s*[.:：．、]\s*\S+') and coalesce(case when z0 = z1 or z0 = z2 then z0 when z1 = z2 then z1 else coalesce(z0, z1, z2) end < body, length(trim(t)) <= 200) as float_caption from s""")
def f3_f6(spark, sf):
    """Captions by style and by number, over blocks with runs of several sizes."""
    b = _blocks(spark, sf)
    c = F.col
    return b.select("doc_id", "ord", B.caption_by_style(c("text"), c("runs"), c("alignment"), c("indent"), c("body")).alias("by_style"), B.float_caption(c("text"), c("runs"), c("body")).alias("float_caption"))


@query("p45_figure_limits", """with f as (select p_partkey, case when p_partkey % 6 <> 0 then cast(p_size * 4 as double) end as w, cast(p_size % 17 * 12 + 5 as double) as h, p_partkey % 5 = 0 as told, case when p_partkey % 7 = 0 then 0.0 else 177.0 end as textw, p_partkey % 3 + 1 as cols, 6.0 as gap, case when p_partkey % 11 = 0 then 0.0 else 206.0 + p_size end as page, case p_partkey % 4 when 0 then 0.7 when 1 then 1.5 end as frac from part),
    g as (select *, case when textw > 0 and cols > 1 then (textw - (cols - 1) * gap) / cols end as one from f), k as (select *, case when one is null then told and w is null when w is null then true else w > one * 1.02 end as full_width from g),
    m as (select *, case when full_width or one is null then nullif(textw, 0) else one end as target, page * case when frac > 0 and frac <= 1 then frac else 0.82 end - 18.0 as usual from k)
    select p_partkey, full_width, round(case when page > 0 then greatest(20.0, case when w / h <= 1.3 then least(greatest(usual, coalesce(target, usual)), page * 0.6) else usual end) end, 6) as height_mm from m""")
def p45(spark, sf):
    """Full width and the height that a figure may take, for widths, columns and pages that are told or not."""
    f = table(spark, sf, "part").selectExpr(
        "p_partkey", "case when p_partkey % 6 <> 0 then cast(p_size * 4 as double) end as w", "cast(p_size % 17 * 12 + 5 as double) as h", "p_partkey % 5 = 0 as told", "case when p_partkey % 7 = 0 then 0.0D else 177.0D end as textw", "cast(p_partkey % 3 + 1 as int) as cols", "6.0D as gap",
        "case when p_partkey % 11 = 0 then 0.0D else 206.0D + p_size end as page", "case p_partkey % 4 when 0 then 0.7D when 1 then 1.5D end as frac")
    c = F.col
    f = f.withColumn("full_width", B.needs_full_width(c("w"), c("told"), c("textw"), c("cols"), c("gap")))
    target = F.when(c("full_width"), F.nullif("textw", F.lit(0.0))).otherwise(F.coalesce(B.column_mm(c("textw"), c("cols"), c("gap")), F.nullif("textw", F.lit(0.0))))
    return f.select("p_partkey", "full_width", F.round(B.height_limit_mm(c("page"), c("frac"), target, c("w") / c("h")), 6).alias("height_mm"))


scalar("p54_bib_names", {"source": "source", "lang": "lang", "t": "case doc_id % 8 when 0 then concat(' {refs', doc_id, '.BIB}') when 1 then concat('a/b', chr(92), 'my', source, '.bib, other') when 2 then 'Your_file' when 3 then concat('a', lang, ' b') when 4 then '..' when 5 then concat('\"', lang, '-', doc_id, '\"') when 6 then '' else null end"},
       lambda: {"name": B.bib_name(F.col("t"))}, {"name": "case doc_id % 8 when 0 then concat('refs', doc_id) when 1 then case when regexp_matches(source, '[<>:\"/|?*\\s]') then 'references' else concat('my', source) end when 5 then concat(lang, '-', doc_id) else 'references' end"})


@query("p54_class_options", "select doc_id, array_to_string(list_concat(['a4', 'final'], case doc_id % 4 when 0 then [lang, 'draft'] when 1 then ['draft'] when 2 then [] else [lang] end), ',') as options from documents")
def p54(spark, sf):
    declared = F.expr("case doc_id % 4 when 0 then array('*') when 1 then array('draft', 'x') when 2 then array('y') else array(lang) end")
    wanted = F.array("lang", F.lit("draft"), F.lit("final"), F.lit(""), F.lit(None).cast("string"))
    made = B.class_options(F.array(F.lit("a4"), F.lit("final")), declared, wanted)
    return table(spark, sf, "documents").select("doc_id", F.array_join(made, ",").alias("options"))


_AFF = "concat(case doc_id % 5 when 0 then concat('$ ^{', doc_id % 9, '}$ ') when 1 then concat('~textsuperscript{', doc_id % 9, ',{a}} ') when 2 then concat('$^', doc_id % 9, '$') when 3 then concat('$^{', doc_id % 9, '} ~mathrm{', lang, '} $ ') else '' end, 'Lab of ', source)"


@query("p55_affiliations", """with a as (select doc_id, case doc_id % 5 when 1 then concat(doc_id % 9, ',{a}') when 4 then '' else cast(doc_id % 9 as varchar) end as label, concat(case doc_id % 5 when 3 then concat(lang, ' ') else '' end, 'Lab of ', source) as body from documents)
    select doc_id, label, body, case doc_id % 3 when 0 then concat(chr(92), 'affiliation', case when label <> '' then concat('[', label, ']') else '' end, '{organization={', body, '}}') when 1 then concat(chr(92), 'affil{', case when label <> '' then concat('$^{', label, '}$') else '' end, body, '}') else 'as it stands' end as command,
      case when doc_id % 2 = 0 then concat('j', doc_id, '@x.org') end as address from a""")
def p55(spark, sf):
    """Affiliations by their raised labels, as three classes write them, and an address that is cut into runs."""
    d = table(spark, sf, "documents").select("doc_id", F.replace(F.expr(_AFF), F.lit("~"), F.lit("\\")).alias("t"), F.expr("case doc_id % 3 when 0 then 'Elsarticle' when 1 then 'nsr' else 'other' end").alias("c"))
    runs = F.transform(F.array(F.lit("Correspondence:"), F.lit(" "), F.lit("("), F.lit("j"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "@").otherwise("at"), F.lit("x.org"), F.lit(")"), F.lit(" tel")), lambda t: F.struct(t.alias("text")))
    command = B.affiliation_command(F.col("t"), F.col("c"))
    as_is = F.when((F.col("c") == "other") & (command == F.concat(F.lit("\\affil[]{"), F.trim("t"), F.lit("}"))), "as it stands").otherwise(command)
    return d.select("doc_id", B.affiliation(F.col("t")).alias("a"), as_is.alias("command"), B.address_in_runs(runs).alias("address")).select("doc_id", "a.label", "a.body", "command", "address")


@query("p57_clean_preambles", _LINES + r""", k as (select doc_id, ord, case ord % 8 when 0 then concat('% ===== ', ord) when 1 then '%  made' when 2 then concat('  % ', line) when 3 then case when ord % 3 = 0 then '' else '% still' end when 4 then concat(chr(92), 'usepackage commands in ', ord) when 5 then concat(chr(92), 'usepackage[x]{', ord, '}') when 6 then concat(chr(92), 'Title Of it') else line end as t from l),
    f as (select *, max(case when regexp_matches(t, '^\s*% ={3,}') then ord end) over w as o, max(case when not starts_with(trim(t), '%') then ord end) over w as e from k window w as (partition by doc_id order by ord))
    select doc_id, coalesce(string_agg(t, chr(10) order by ord) filter (where not (o is not null and (e is null or e < o)) and not regexp_matches(t, '^\s*\\[a-zA-Z]+\s+[a-z]')), '') as text from f group by doc_id""")
def p57(spark, sf):
    t = F.expr(r"case ord % 8 when 0 then concat('% ===== ', ord) when 1 then '%  made' when 2 then concat('  % ', line) when 3 then case when ord % 3 = 0 then '' else '% still' end when 4 then concat(chr(92), 'usepackage commands in ', ord) when 5 then concat(chr(92), 'usepackage[x]{', ord, '}') when 6 then concat(chr(92), 'Title Of it') else line end")
    l = lines(spark, sf).select("doc_id", F.struct("ord", t.alias("t")).alias("x"))  # noqa: E741
    docs = l.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))
    return B.clean_preamble(docs, ["doc_id"], "text")


_RUN = "concat(lang, ' CO2 {α_', doc_id % 7, '} 5% ', doc_id % 3, '; 4')"


@query("p7_styled_runs", r"""with r as (select *, doc_id % 2 = 0 as b, doc_id % 3 = 0 as i, case doc_id % 5 when 0 then 'super' when 1 then 'sub' end as sc, doc_id % 7 = 0 as u, doc_id % 11 = 0 as st, case doc_id % 4 when 0 then 'EE0000' when 1 then '0000FF' when 2 then '00FF00' end as c, case when doc_id % 13 = 0 then 'hyperlink' end as th from documents),
    k as (select *, coalesce(c = 'EE0000', false) or th is not null as cite from r),
    t as (select *, case when cite then concat('\citep{2,', doc_id % 7, ',5,', doc_id % 3, ',4}') else concat(lang, ' CO$_{2}$ \{$\alpha$\_', doc_id % 7, '\} 5\% ', doc_id % 3, '; 4') end as x from k)
    select doc_id, concat(case when st then '\sout{' else '' end, case when u then '\underline{' else '' end, case when c = '0000FF' and not cite then '\blue{' else '' end, case sc when 'super' then '\textsuperscript{' when 'sub' then '\textsubscript{' else '' end, case when b then '\textbf{' else '' end, case when i then '\textit{' else '' end, x,
      case when i then '}' else '' end, case when b then '}' else '' end, case when sc is not null then '}' else '' end, case when c = '0000FF' and not cite then '}' else '' end, case when u then '}' else '' end, case when st then '}' else '' end) as latex from t""")
def p7(spark, sf):
    """Runs with every format: citations by colour and theme, characters that are escaped or written as LaTeX, compounds, and six wrappers."""
    e = F.expr
    run = L.styled_run(e(_RUN), e("doc_id % 2 = 0"), e("doc_id % 3 = 0"), e("case doc_id % 5 when 0 then 'super' when 1 then 'sub' end"), e("doc_id % 7 = 0"), e("doc_id % 11 = 0"), e("case doc_id % 4 when 0 then 'EE0000' when 1 then '0000FF' when 2 then '00FF00' end"), e("case when doc_id % 13 = 0 then 'hyperlink' end"), F.create_map(F.lit("0000FF"), F.lit("\\blue")))
    return table(spark, sf, "documents").select("doc_id", run.alias("latex"))


@query("p25_cosine", """with e as (select vec_id, embedding::double[] as a, case vec_id % 3 when 0 then list_reverse(embedding)::double[] when 1 then embedding[1:5]::double[] else list_transform(embedding, lambda x: 0.0::double) end as b from embeddings)
    select vec_id, round(case when len(a) = len(b) and list_inner_product(b, b) > 0 then list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))) else 0 end, 6) as similarity from e""")
def p25(spark, sf):
    """Cosine of vectors, with those of another size and of zeros, which have none."""
    a = F.transform("embedding", lambda x: x.cast("double"))
    b = F.when(F.col("vec_id") % 3 == 0, F.reverse(a)).when(F.col("vec_id") % 3 == 1, F.slice(a, 1, 5)).otherwise(F.transform(a, lambda x: F.lit(0.0)))
    return table(spark, sf, "embeddings").select("vec_id", F.round(images.cosine(a, b), 6).alias("similarity"))


@query("g15_element_counts", "select doc_id, len(string_split(coalesce(text, ''), chr(10))) + 6 as paragraphs, 1 as tables, 2 as formulas, 2 as media, array_to_string(list_transform(range(0, least(3, (len(string_split(coalesce(text, ''), chr(10))) + 4) // 5)), lambda k: 'Heading1'), ',') as styles from documents")
def g15(spark, sf):
    """Paragraphs, tables, formulas, media and first styles of a package for each document."""
    scanned = docx.gathered(packages(spark, sf), {"blocks": ["kind", "style", "formulas"], "media": ["name"]})
    counts = reports.element_counts(scanned, styles=3)
    return counts.select(F.col("path").cast("long").alias("doc_id"), "paragraphs", "tables", "formulas", "media", F.array_join("styles", ",").alias("styles"))


_NAMED = "case ord % 5 when 0 then 'CO2 and OCO2' when 1 then 'H2 v2' when 2 then concat('GCAS', ord % 9) when 3 then 'XCO2' else 'none2x' end"
_CODES = "case name when 'CO2' then 'CO$_{2}$' when 'XCO2' then 'XCO$_{2}$' when 'H2' then 'H$_{2}$' end"


@query("k2_chemistry_report", _LINES + f""", n as (select doc_id, ord, unnest(case ord % 5 when 0 then ['CO2', 'OCO2'] when 1 then ['H2'] when 2 then [concat('GCAS', ord % 9)] when 3 then ['XCO2'] else [] end) as name from l),
    r as (select doc_id, case when code is null then '2 kept' else '1 converted' end as section, ord, case when code is null then name else concat(name, ' -> ', code) end as line from (select *, {_CODES} as code from n)),
    k as (select *, row_number() over (partition by doc_id, section order by ord, line) as rank, count(*) over (partition by doc_id, section) as n from r),
    s as (select doc_id, section, concat('[', section, '] ', max(n), string_agg(concat(chr(10), '  ', line), '' order by rank) filter (where rank <= 10), case when max(n) > 10 then concat(chr(10), '  ... ', max(n) - 10, ' more') else '' end) as t from k group by 1, 2)
    select doc_id, string_agg(t, chr(10) order by section) as report from s group by 1""")
def k2_chemistry(spark, sf):
    """What became of every name with a number in a document: converted with its code, or kept; ten of each at most, and how many more."""
    t = lines(spark, sf).select("doc_id", "ord", F.expr(_NAMED).alias("t"))
    return reports.section_report(reports.chemistry_rows(t, ["doc_id"], "ord", "t"), ["doc_id"])
