"""Matching in turn, search inside pages, lengths that refer to lengths, paragraphs about floats, tables on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paragraphs as P
from ..operators import rounds as R
from ..operators import search as S
from ..operators import specs as K
from .lines import lines
from .registry import query, table

_CITING = "concat(c_name, ' after S', c_custkey % 40, ', and S', c_custkey * 7 % 40, ' et al. (', 1990 + c_custkey % 5, 'b), no. 2', 1990 + c_custkey % 3)"


@query("j9_contained_in_turn", f"""with recursive b as (select c_nationkey as n, c_custkey, {_CITING} as t from customer), e as (select s_nationkey as n, s_suppkey, concat('S', s_suppkey % 40) as author, cast(1990 + s_suppkey % 5 as varchar) as year from supplier),
    w as (select n, c_custkey, list(s_suppkey order by s_suppkey) as cands, row_number() over (partition by n order by c_custkey) as i from b join e using (n) where contains(t, author) and contains(t, year) group by n, c_custkey),
    turns as (select distinct n, cast(0 as bigint) as i, cast([] as bigint[]) as used, cast(null as bigint) as c_custkey, cast(null as bigint) as s_suppkey from w
      union all select n, i, case when pick is null then used else list_append(used, pick) end, c_custkey, pick from (select t.n, w.i, t.used, w.c_custkey, list_filter(w.cands, lambda x: not list_contains(t.used, x))[1] as pick from turns t join w on w.n = t.n and w.i = t.i + 1))
    select s_suppkey, c_custkey from turns where s_suppkey is not null""")
def j9(spark, sf):
    """Every block, in order, takes the first entry whose author and year it contains and that none before it took; containment is no equivalence (``S4`` stands in ``S41``)."""
    b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey", F.expr(_CITING).alias("t"))
    e = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey") % 40).alias("author"), (F.col("s_suppkey") % 5 + 1990).alias("year"))
    # Entries of one author and year are contained by the same blocks, so blocks meet these, not each entry.
    met = R.containing(b, e.select("n", "author", "year").distinct(), ["n"], "t", "year", "author")
    return R.in_turn_of_classes(met, e, ["n"], "c_custkey", "c_custkey", ["author", "year"], "s_suppkey", "s_suppkey").select("s_suppkey", "c_custkey")


_NEEDLE = "case when doc_id % 3 = 1 then concat(substring(line, length(line) // 3 + 1, 30), repeat('~', 30)) else substring(line, length(line) // 3 + 1, 60) end"


@query("j16_inside_pages", f"""with p as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord, unnest(string_split(text, chr(10))) as line from documents), k as (select doc_id, ord, {_NEEDLE} as needle from p where ord % 3 = 1),
    m as (select k.doc_id, k.ord as needle_ord, p.ord as page, strpos(p.line, substring(needle, 1, l)) - 1 as "at", l as length, row_number() over (partition by k.doc_id, k.ord order by l desc, p.ord) as rn from k, (values {", ".join(f"({n})" for n in S.PREFIXES)}) v(l) join p on p.doc_id = k.doc_id and contains(p.line, substring(needle, 1, l)) where length(needle) >= l)
    select doc_id, needle_ord, page, "at", length from m where rn = 1""")
def j16(spark, sf):
    """Stretches from the middle of lines, a third of them altered behind 30 characters, sought in all lines of their document."""
    p = lines(spark, sf)
    k = p.filter("ord % 3 = 1").select("doc_id", F.col("ord").alias("needle_ord"), F.expr(_NEEDLE.replace("//", "div")).alias("needle"))
    return S.inside_pages(k, p.withColumnRenamed("ord", "page"), ["doc_id"], "needle_ord", "needle", "page", "line")


_LENGTHS = "concat('~newlength{~bleed} ~setlength{~bleed}{9mm} ~setlength{~bleed}{', doc_id % 5 + 2, 'mm}~setlength {~outer} {~dimexpr ', doc_id % 50 + 100, 'mm + 2~bleed~relax} ~setlength{~inner}{~outer-1.5cm}~setlength{~column}{0.5~inner-.25~bleed} ~setlength{~lost}{~nowhere+1mm}~setlength{~alsolost}{2~lost}~setlength{~first}{~second+1mm}~def~second{2~first} ~setlength{~behind}{~first-', doc_id % 3, 'mm}')"


@query("p60_length_graph", """with d as (select doc_id, doc_id % 5 + 2 as b, doc_id % 50 + 100 as w from documents) select doc_id, name, case name when 'bleed' then b when 'outer' then w + 2 * b when 'inner' then w + 2 * b - 15 when 'column' then (w + 2 * b - 15) / 2.0 - b / 4.0 end as mm, name in ('first', 'second', 'behind') as cyclic
    from d, (values ('bleed'), ('outer'), ('inner'), ('column'), ('lost'), ('alsolost'), ('first'), ('second'), ('behind')) v(name)""")
def p60_p28_p59(spark, sf):
    """A chain of four definitions, one that nothing defines, and a cycle, in every document; later definitions count."""
    d = table(spark, sf, "documents").select("doc_id", F.replace(F.expr(_LENGTHS), F.lit("~"), F.lit("\\")).alias("text"))
    return R.resolved(K.length_terms(d, ["doc_id"], "text"), ["doc_id"], "name", "factor", "refers", "mm").select("doc_id", "name", F.round("value", 6).alias("mm"), "cyclic")


_F1, _F2 = (f"concat('~begin{{{kind}}}', {opts}chr(10), 'x ', @, chr(10), chr(10), 'y.', chr(10), '~end{{{kind}}}')" for kind, opts in (("table*", "'[htbp]', "), ("figure", "")))
_GAP = "concat(chr(10), chr(10))"


def _paragraphs(first: str, second: str, third: str) -> str:
    """SQL for three pieces of text with two floats in the first gap and one in the second; the arguments are the gaps' newlines."""
    return f"concat(lang, case when doc_id % 2 = 0 then '.' else ' and' end, {first}, {_F1.replace('@', 'lang')}, {first}, {_F2.replace('@', 'source')}, {first}, case doc_id % 5 when 0 then 'Then' when 1 then '3 of' when 2 then '~so' else 'so' end, ' on', {second}, {_F2.replace('@', 'doc_id')}, {second}, 'é goes on', {third}, 'End')"


@query("p34_float_paragraphs", f"select doc_id, replace(case when doc_id % 2 = 1 and doc_id % 5 > 2 then {_paragraphs('chr(10)', 'chr(10)', _GAP)} else {_paragraphs(_GAP, 'chr(10)', _GAP)} end, '~', chr(92)) as text from documents")
def p34_floats(spark, sf):
    """Paragraphs that two floats, and one, cut apart: joined where the text goes on, whatever floats lie between."""
    t = F.replace(F.expr(_paragraphs(_GAP, _GAP, _GAP)), F.lit("~"), F.lit("\\"))
    return P.merged_around_floats(table(spark, sf, "documents").select("doc_id", t.alias("text")), ["doc_id"], "text")


@query("k4_table_pages", """with recursive l as (select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 as ord, cast(l_quantity as int) % 7 + 1 as h from lineitem),
    pages as (select l_suppkey, ord, h, cast(0 as bigint) as page, h as filled from l where ord = 0
      union all select l.l_suppkey, l.ord, l.h, case when filled + l.h > 40 then page + 1 else page end, case when filled + l.h > 40 then l.h else filled + l.h end from pages p join l on l.l_suppkey = p.l_suppkey and l.ord = p.ord + 1)
    select l_suppkey, ord, page from pages""")
def k4_pages(spark, sf):
    """A long table for each supplier, on pages of 44 with a head of 4 that is repeated on each."""
    w = P.O.ordered(["l_suppkey"], "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    l = table(spark, sf, "lineitem").select("l_suppkey", (F.row_number().over(w) - 1).alias("ord"), (F.col("l_quantity").cast("int") % 7 + 1).cast("double").alias("h"))  # noqa: E741
    return P.page_starts(l, ["l_suppkey"], "ord", "h", 4.0, 44.0)
