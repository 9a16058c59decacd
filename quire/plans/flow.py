"""Citation grouping, float grouping, front matter, run logs and style maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions import omml as M
from ..operators import ordered as O
from .lines import lines
from .registry import query, table


def merged_cites(text):
    """``(\\citep{a}; \\citep{b,c})`` -> ``\\citep{a,b,c}``: the parentheses first, then the run inside."""
    one = r"\\citep\{[^}]+\}"
    bare = F.regexp_replace(text, rf"\(({one}(?:\s*[;,]\s*{one})+)\)", "\u0001$1\u0002")
    inner = F.regexp_replace(bare, r"\}\s*[;,]\s*\\citep\{(?=[^\u0001\u0002]*\u0002)", ",")
    return L.replaced(inner, ("\u0001", ""), ("\u0002", ""))


@query("w10_merged_cites", r"select doc_id, concat('Grouped \citep{', doc_id, ',abc-key,c}. And \citep{x}; \citep{y}') as t from documents")
def w10(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.expr(r"concat(r'Grouped (\citep{', doc_id, r'}; \citep{abc-key}, \citep{c}). And \citep{x}; \citep{y}')").alias("t"))
    return t.select("doc_id", merged_cites(F.col("t")).alias("t"))


@query("w19_float_groups", """with g as (select *, sum(case when p is null or turn > p + 2 or role = 'system' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as island from (select *, lag(turn) over (partition by conv_id order by turn) as p from conversations)),
    n as (select *, (row_number() over (partition by conv_id, island order by turn) - 1) // 3 as part from g) select conv_id, min(turn) as first_turn, count(*) as size from n group by conv_id, island, part""")
def w19(spark, sf):
    """Floats that follow each other within two blocks and a section, three to a group: islands, cut by their row numbers."""
    w = O.ordered(["conv_id"], "turn")
    t = table(spark, sf, "conversations")
    t = t.withColumn("s", (F.col("turn") > F.lag("turn").over(w) + 2) | ((F.col("role") == "system") & F.lag("turn").over(w).isNotNull())).withColumn("island", O.island(F.col("s"), w))
    t = t.withColumn("part", F.floor((F.row_number().over(O.ordered(["conv_id", "island"], "turn")) - 1) / 3))
    return t.groupBy("conv_id", "island", "part").agg(F.min("turn").alias("first_turn"), F.count("*").alias("size")).drop("island", "part")


@query("x3_front_matter", """with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord, unnest(string_split(text, chr(10))) as line from documents), b as (select *, coalesce(min(case when ord >= 3 or length(line) > 300 then ord end) over (partition by doc_id), 1000000000) as stop from l),
    c as (select doc_id, ord, row_number() over (partition by doc_id order by ord) as rn from b where ord < stop and trim(line) <> '') select doc_id, ord, case rn when 1 then 'title' when 2 then 'author' else 'front_matter' end as role from c""")
def x3(spark, sf):
    """Before the first content block: the first text is the title, the next the authors, the rest stays out of the body."""
    stop = F.coalesce(F.min(F.when((F.col("ord") >= 3) | (F.length("line") > 300), F.col("ord"))).over(Window.partitionBy("doc_id")), F.lit(10**9))
    c = lines(spark, sf).withColumn("stop", stop).filter((F.col("ord") < F.col("stop")) & (F.trim("line") != ""))
    rn = F.row_number().over(O.ordered(["doc_id"], "ord"))
    return c.select("doc_id", "ord", F.when(rn == 1, "title").when(rn == 2, "author").otherwise("front_matter").alias("role"))


@query("x10_gated_steps", "with s as (select event_id, user_id, case when value > 95 then 'error' when value > 60 then 'warning' else 'info' end as severity, bool_or(value > 95) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as failed from events) select user_id, count(*) filter (where not coalesce(failed, false)) as ran, count(*) filter (where failed) as skipped, bool_and(severity <> 'error') as success from s group by 1")
def x10_k12(spark, sf):
    """Steps of a run stop at the first error: failures are rows of the log, not exceptions."""
    w = O.ordered(["user_id"], "event_id")
    failed = F.coalesce(F.max(F.col("value") > 95).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    s = table(spark, sf, "events").select("user_id", failed.alias("failed"), (F.col("value") > 95).alias("error"))
    return s.groupBy("user_id").agg(F.count_if(~F.col("failed")).alias("ran"), F.count_if("failed").alias("skipped"), (~F.bool_or("error")).alias("success"))


@query("k10_style_map", "select c_nationkey, string_agg(concat('  ', c_mktsegment, ' = ', n), chr(10) order by c_mktsegment) as report from (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2) group by 1")
def k10_k11(spark, sf):
    """A long-form table (owner, key, value) as text, one owner a row."""
    n = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.groupBy("c_nationkey").agg(F.expr("listagg(concat('  ', c_mktsegment, ' = ', n), chr(10)) within group (order by c_mktsegment)").alias("report"))


@query("k1_json_records", "select doc_id, text, lang, source from documents")
def k1_s22(spark, sf):
    """Records to JSON and back with an explicit schema, in one plan."""
    d = table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "text", "lang", "source")).alias("j"))
    return d.select(F.from_json("j", "doc_id long, text string, lang string, source string").alias("r")).select("r.*")


@query("p38_formula_round_trip", "select case when doc_id % 5 = 4 then 'failed' else 'exact' end as level, count(*) as n from documents group by 1")
def p38_g7(spark, sf):
    """Formulas to Office math and back: how many come back as they were, and how many have no counterpart."""
    kinds = (r"concat(r'\frac{a_{', doc_id, r'}}{\sqrt{b}}+\alpha^{2}')", r"concat(r'\sum_{i}^{n}', 'x_{', doc_id, '}')", r"concat(r'\left(', doc_id, r'+y\right)')", r"concat(r'\mathbf{v}=\hat{', 'x}', doc_id)", r"concat(r'\unknown{', doc_id, '}')")
    case = " ".join(f"when {k} then {e}" for k, e in enumerate(kinds))
    t = table(spark, sf, "documents").select(F.expr(f"case doc_id % 5 {case} end").alias("a"))
    back = t.select("a", M.latex_of(M.omml_of("a")).alias("b"))
    return back.select(F.when(F.col("b").isNull(), "failed").otherwise(L.formula_match(F.col("a"), F.col("b"))).alias("level")).groupBy("level").agg(F.count("*").alias("n"))
