"""Bodies of documents put together from several streams, floats at their anchors and in groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assembly as A
from .lines import lines
from .registry import query, table


def streams(spark, sf):
    """Blocks, floats and bibliography numbers of every document, made of all its lines."""
    w = Window.partitionBy("doc_id")
    l = lines(spark, sf).withColumn("n", F.count("*").over(w)).withColumnRenamed("ord", "block_ord")  # noqa: E741
    k = F.col("block_ord") % 9
    kind = (
        F.when(F.col("block_ord") == 0, "title").when(F.col("block_ord") == F.col("n") - 2, "reference").when(k.isin(6, 7), "display_formula").when(k == 3, "heading").when(k == 4, "figure_caption")
        .when(k == 5, "unknown").when(k == 8, "acknowledgement").when(F.trim("line") == "", "empty").otherwise("body")
    )
    text = F.when(k == 5, F.concat(F.lit("short "), "block_ord")).when(k.isin(1, 2), F.concat("line", F.lit(" ["), F.col("block_ord") % 4, F.lit("]"))).otherwise(F.col("line"))
    blocks = l.select("doc_id", "block_ord", text.alias("text"), F.when(k.isin(6, 7), F.concat(F.lit("x_{"), "block_ord", F.lit("}="), F.length("line"))).alias("latex"), F.when(k == 3, F.col("block_ord") % 4).alias("heading_level"), kind.alias("semantic_type"))
    each = F.explode(F.when(F.col("block_ord") % 10 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    floats = l.filter("block_ord % 5 = 1").select("doc_id", F.col("block_ord").alias("anchor"), each.alias("k")).select("doc_id", (F.col("anchor") * 2 + F.col("k")).alias("float_ord"), "anchor", F.concat(F.lit("\\begin{figure}"), "anchor", F.lit("-"), "k", F.lit("\\end{figure}")).alias("code"))
    entries = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("number")).withColumn("cite_key", F.concat(F.lit("k"), "doc_id", F.lit("-"), "number"))
    return blocks, floats, entries


@query("x2_emitted_streams")
def x2(spark, sf):
    """Whole bodies: text, headings, gathered formulas, floats, citations; all rows against a plain loop in the tests."""
    return A.emit(*streams(spark, sf), ["doc_id"])


_B = r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord, unnest(string_split(text, chr(10))) as line from documents), n as (select doc_id, count(*) as n from l group by 1),
    b as (select doc_id, ord, case when ord % 5 = 2 then concat('As Figure ', ord % 4, ' shows. ', line) else line end as text, case when ord = n * 2 // 3 then 'reference' when trim(line) = '' then 'empty' when ord % 7 = 1 then 'heading' when ord % 11 = 3 then 'figure_caption' else 'body' end as k from l join n using (doc_id)),
    s as (select doc_id, min(ord) as stop from b where k = 'reference' group by 1)"""


@query("j6_recovered_anchors", _B + r""", v as (select doc_id, ord, text, lag(ord) over (partition by doc_id order by ord) as prev, coalesce(lag(k = 'heading') over (partition by doc_id order by ord), false) as headed from b join s using (doc_id) where ord < stop and k not in ('figure_caption', 'empty')),
    m as (select doc_id, ord, prev, headed, unnest(list_distinct(regexp_extract_all(text, '(?i)(?:图|Figure|Fig\.?)\s*([0-9]+(?:\.[0-9]+)*)', 1))) as number from v),
    t as (select doc_id, number, arg_min(prev, ord) filter (where headed) as th, arg_max(coalesce(prev, ord), ord) as tm from m group by 1, 2),
    f as (select doc_id, ord as place, ord % 5 as number from l where ord % 3 = 0)
    select f.doc_id, f.place, f.number, case when f.place >= stop then coalesce(th, tm, (select max(ord) from v where v.doc_id = f.doc_id)) else (select max(ord) from v where v.doc_id = f.doc_id and v.ord <= f.place) end as anchor from f join s on s.doc_id = f.doc_id left join t on t.doc_id = f.doc_id and t.number = cast(f.number as varchar)""")
def j6(spark, sf):
    """Floats behind the block before them; those behind the references at the mention of their number, a third of all lines being behind them."""
    l = lines(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))  # noqa: E741
    kind = F.when(F.col("ord") == F.floor(F.col("n") * 2 / 3), "reference").when(F.trim("line") == "", "empty").when(F.col("ord") % 7 == 1, "heading").when(F.col("ord") % 11 == 3, "figure_caption").otherwise("body")
    text = F.when(F.col("ord") % 5 == 2, F.concat(F.lit("As Figure "), F.col("ord") % 4, F.lit(" shows. "), "line")).otherwise(F.col("line"))
    b = l.select("doc_id", F.col("ord").alias("block_ord"), text.alias("text"), F.lit(None).cast("int").alias("heading_level"), kind.alias("semantic_type"))
    f = l.filter("ord % 3 = 0").select("doc_id", F.col("ord").alias("place"), (F.col("ord") % 5).alias("number"))
    return A.anchors(f, b, ["doc_id"])


_FLOATS = 'select conv_id, turn + turn // 4 * 2 as "start", turn + turn // 4 * 2 + turn % 2 as "end", turn // 6 as section, case when turn % 13 <> 12 then turn // 3 - case when turn % 17 = 16 then 2 else 0 end end as page, case when turn % 10 <> 9 then turn // 8 end as major from conversations'


@query("w19_page_groups", f"""with f as ({_FLOATS}), g as (select *, case when lag("start") over w is null or "start" > lag("end") over w + 2 or section is distinct from lag(section) over w or coalesce(major <> lag(major) over w, false) or page is null or lag(page) over w is null or page < lag(page) over w or page > lag(page) over w + 1 then 1 else 0 end as new from f window w as (partition by conv_id order by "start", "end")),
    r as (select *, sum(new) over (partition by conv_id order by "start", "end") as run from g), n as (select *, row_number() over (partition by conv_id, run order by "start", "end") - 1 as k from r)
    select conv_id, "start", "end", section, page, major, sum(case when k % 3 = 0 then 1 else 0 end) over (partition by conv_id order by "start", "end") as "group", k % 3 as nth from n""")
def w19(spark, sf):
    """Floats close to each other, in one section and on pages that go on, three to a group."""
    f = table(spark, sf, "conversations").selectExpr(*[e.strip() for e in ("conv_id", "turn + turn div 4 * 2 as start", "turn + turn div 4 * 2 + turn % 2 as end", "turn div 6 as section", "case when turn % 13 <> 12 then turn div 3 - case when turn % 17 = 16 then 2 else 0 end end as page", "case when turn % 10 <> 9 then turn div 8 end as major")])
    return A.float_groups(f, ["conv_id"])
