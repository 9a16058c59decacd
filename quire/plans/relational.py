"""Filters, joins, aggregates, windows and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cites as C
from ..functions import text as X
from ..functions import units as U
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ordered as O
from .lines import lines
from .registry import query, table

LINES = "lines as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord, unnest(string_split(text, chr(10))) as line from documents)"


# --- filters and predicates

@query("f1_top_level_blocks", "select conv_id, count(*) as n from conversations where role <> 'system' group by conv_id")
def f1(spark, sf):
    return table(spark, sf, "conversations").filter("role <> 'system'").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("f2_caption_lines", f"""with {LINES}, s as (select doc_id, ord, case when ord % 5 = 0 then concat('Figure ', ord % 7, '. ', line) when ord % 7 = 0 then concat('表 2.', ord % 3, line) else line end as line from lines)
    select doc_id, ord, regexp_matches(line, '(?i)^\\s*(?:图|Figure|Fig\\.?)\\s*[0-9]+(?:\\.[0-9]+)*') as is_figure, regexp_matches(line, '(?i)^\\s*(?:表|Table|Tab\\.?|Talbe)\\s*[0-9]+(?:\\.[0-9]+)*') as is_table from s
    where regexp_matches(line, '(?i)^\\s*(?:图|Figure|Fig\\.?|表|Table|Tab\\.?|Talbe)\\s*[0-9]+')""")
def f2(spark, sf):
    s = lines(spark, sf).withColumn("line", F.expr("case when ord % 5 = 0 then concat('Figure ', ord % 7, '. ', line) when ord % 7 = 0 then concat('表 2.', ord % 3, line) else line end"))
    s = s.select("doc_id", "ord", F.col("line").rlike(r"(?i)^\s*(?:图|Figure|Fig\.?)\s*[0-9]+(?:\.[0-9]+)*").alias("is_figure"), F.col("line").rlike(r"(?i)^\s*(?:表|Table|Tab\.?|Talbe)\s*[0-9]+(?:\.[0-9]+)*").alias("is_table"))
    return s.filter("is_figure or is_table")


@query("f3_caption_by_style", """select l_orderkey, l_linenumber, count(*) as n, count(*) filter (where l_quantity < 20 or l_quantity <= 24 - 4 and l_returnflag = 'A' or l_discount > 0.05 and l_tax > 0.03 or l_linestatus = 'O' and l_quantity < 24 - 1) as captions from lineitem group by all""")
def f3(spark, sf):
    """Four ordered tests on size, style, centring and weight, any of which makes a caption."""
    size, body = F.col("l_quantity"), F.lit(24)
    tests = (size < 20) | ((size <= body - 4) & (F.col("l_returnflag") == "A")) | ((F.col("l_discount") > 0.05) & (F.col("l_tax") > 0.03)) | ((F.col("l_linestatus") == "O") & (size < body - 1))
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(tests).alias("captions"))


@query("f4_red_numbers", """select doc_id, c from (select doc_id, concat('(', doc_id % 30, ', ', doc_id % 7, case when doc_id % 4 = 0 then ' a' else '' end, ')') as c, doc_id % 3 = 0 as red from documents) where red and regexp_matches(c, '^\\([0-9,\\s;–-]+\\)$')""")
def f4(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.expr("concat('(', doc_id % 30, ', ', doc_id % 7, case when doc_id % 4 = 0 then ' a' else '' end, ')')").alias("c"), F.array(F.lit("000000"), F.when(F.col("doc_id") % 3 == 0, "EE0000").otherwise("0000FF")).alias("colours"))
    return s.filter(F.exists("colours", lambda x: x == "EE0000") & F.col("c").rlike(r"^\([0-9,\s;–-]+\)$")).select("doc_id", "c")


@query("f5_short_continuation", f"with {LINES} select doc_id, count(*) as n from lines where length(line) <= 80 and trim(line) <> '' and not regexp_matches(line, '(?i)^\\s*(figure|fig\\.|table|图|表)\\s*[0-9]+') group by doc_id")
def f5(spark, sf):
    return lines(spark, sf).filter((F.length("line") <= 80) & (F.trim("line") != "") & ~F.col("line").rlike(X.CAPTION)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f6_float_caption", "select event_id from events where value < 10 or (value is null and length(props) <= 200) or (event_type = 'click' and length(props) <= 9)")
def f6(spark, sf):
    short = (F.col("value") < 10) | (F.col("value").isNull() & (F.length("props") <= 200)) | ((F.col("event_type") == "click") & (F.length("props") <= 9))
    return table(spark, sf, "events").filter(short).select("event_id")


@query("f7_after_references", f"""with {LINES}, m as (select doc_id, coalesce(min(ord) filter (where ord > 2 and length(line) < 60), min(ord) filter (where ord > 5)) as start from lines group by doc_id)
    select l.doc_id, l.ord from lines l join m using (doc_id) where m.start is null or l.ord < m.start""")
def f7_w6(spark, sf):
    """Blocks before the references: the first heading hit, else the first text hit, found in one window pass."""
    whole = Window.partitionBy("doc_id")
    start = F.coalesce(F.min(F.when((F.col("ord") > 2) & (F.length("line") < 60), F.col("ord"))).over(whole), F.min(F.when(F.col("ord") > 5, F.col("ord"))).over(whole))
    return lines(spark, sf).withColumn("start", start).filter("start is null or ord < start").select("doc_id", "ord")


@query("f8_package_filter", "select conv_id, string_agg(role, ',' order by turn) as kept from conversations c where not exists (select 1 from (values ('system'), ('tool')) b(r) where b.r = c.role) group by conv_id")
def f8(spark, sf):
    builtin = spark.createDataFrame([("system",), ("tool",)], "role string")
    kept = table(spark, sf, "conversations").join(F.broadcast(builtin), "role", "left_anti")  # two rows
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("kept"))


_CUT = "with lines as (select doc_id, unnest(range(len(p))) as ord, unnest(p) as line from (select doc_id, string_split(replace(text, ', ', chr(10)), chr(10)) as p from documents))"


@query("f9_merge_lines", _CUT + r""", n as (select *, lead(line) over (partition by doc_id order by ord) as nxt from lines)
    select doc_id, ord from n where nxt is not null and not regexp_matches(trim(line), '[.!?。！？:：]$') and not regexp_matches(nxt, '^\s*([A-Z0-9]|\\)') and trim(line) <> '' and trim(nxt) <> ''""")
def f9(spark, sf):
    """Lines that go on in the next one; the texts are cut at commas, as narrow columns would cut them."""
    cut = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(", "), F.lit("\n")), "\n", -1)).alias("ord", "line"))
    n = cut.withColumn("nxt", F.lead("line").over(O.ordered(["doc_id"], "ord")))
    return n.filter(F.col("nxt").isNotNull() & ~F.trim("line").rlike("[.!?。！？:：]$") & ~F.col("nxt").rlike(r"^\s*([A-Z0-9]|\\)") & (F.trim("line") != "") & (F.trim("nxt") != "")).select("doc_id", "ord")


@query("f10_urls", "select regexp_extract(url, '^https?://([^/]+)', 1) as host, count(*) as n, count(distinct lower(regexp_replace(url, '[#?].*$', ''))) as n_norm, count(distinct lower(regexp_replace(url, '[#?].*$', ''))) < count(*) as has_equal, count(*) filter (where length(url) > 70) as n_long from pages group by 1")
def f10(spark, sf):
    p = table(spark, sf, "pages").select("url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.lower(F.regexp_replace("url", "[#?].*$", "")).alias("norm"))
    return p.groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("n_norm"), (F.countDistinct("norm") < F.count("*")).alias("has_equal"), F.count_if(F.length("url") > 70).alias("n_long"))


@query("f11_geometry_checks", "select p_partkey, p_size * 5.0 between 80 and 300 as width_ok, p_size * 5.0 > 40 + p_size % 7 as fits from part")
def f11(spark, sf):
    w = F.col("p_size") * 5.0
    return table(spark, sf, "part").select("p_partkey", w.between(80, 300).alias("width_ok"), (w > 40 + F.col("p_size") % 7).alias("fits"))


_RULES = (("missing_text", "error", "text is null or text = ''"), ("short", "warning", "length(text) < 100"), ("no_language", "warning", "lang is null"), ("single_line", "info", "not contains(text, chr(10))"))


@query("f12_quality_rules", " union all ".join(f"select doc_id, '{r}' as rule, '{s}' as severity from documents where {e}" for r, s, e in _RULES))
def f12(spark, sf):
    """All rules in one pass over the table: a row for each broken rule."""
    broken = F.array_compact(F.array(*[F.when(F.expr(e), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, e in _RULES]))
    return table(spark, sf, "documents").select("doc_id", F.explode(broken).alias("b")).select("doc_id", "b.rule", "b.severity")


@query("f13_outer_segments", "select l_orderkey, count(*) filter (where abs(l_quantity - lo) < 0.01 or abs(l_quantity - hi) < 0.01) as n_outer, count(*) as n from (select *, min(l_quantity) over (partition by l_orderkey) lo, max(l_quantity) over (partition by l_orderkey) hi from lineitem) group by 1")
def f13(spark, sf):
    w, q = Window.partitionBy("l_orderkey"), F.col("l_quantity")
    s = table(spark, sf, "lineitem").select("l_orderkey", q, F.min(q).over(w).alias("lo"), F.max(q).over(w).alias("hi"))
    return s.groupBy("l_orderkey").agg(F.count_if((F.abs(q - F.col("lo")) < 0.01) | (F.abs(q - F.col("hi")) < 0.01)).alias("n_outer"), F.count("*").alias("n"))


# --- joins

@query("j1_target_to_key", "select o_orderkey, coalesce(a.c_name, b.c_name) as name from orders o left join customer a on a.c_custkey = o.o_custkey and a.c_custkey % 2 = 0 left join customer b on b.c_custkey = o.o_custkey and a.c_custkey is null")
def j1(spark, sf):
    """Bookmark map first, stripped key second: two lookups in one join, coalesced."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    even = c.filter("o_custkey % 2 = 0").withColumnRenamed("c_name", "by_mark")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(even, "o_custkey", "left").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("by_mark", "c_name").alias("name"))


@query("j2_text_to_entry", """with e as (select n_nationkey, 'Author' || n_nationkey as surname, cast(1990 + n_nationkey % 7 as varchar) as year from nation),
    t as (select c_custkey, 'as author' || (c_custkey % 40) || ' et al., ' || (1990 + c_custkey % 9) || ' says' as text from customer)
    select c_custkey, min(n_nationkey) as n_nationkey from t join e on contains(lower(text), lower(surname)) and contains(text, year) group by 1""")
def j2(spark, sf):
    """The first entry whose surname and year a text holds. Containment has no equality to shuffle on; the entries, 25 by the schema, are the broadcast side."""
    e = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("Author"), "n_nationkey").alias("surname"), (F.col("n_nationkey") % 7 + 1990).cast("string").alias("year"))
    t = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("as author"), F.col("c_custkey") % 40, F.lit(" et al., "), F.col("c_custkey") % 9 + 1990, F.lit(" says")).alias("text"))
    return t.join(F.broadcast(e), F.contains(F.lower("text"), F.lower("surname")) & F.contains("text", F.col("year"))).groupBy("c_custkey").agg(F.min("n_nationkey").alias("n_nationkey"))


@query("j3_missing_keys", "select distinct c.k from (select unnest(string_split(concat('c', doc_id % 400, ',c', doc_id % 900), ',')) as k from documents) c where not exists (select 1 from customer where concat('c', c_custkey * 3) = c.k)")
def j3(spark, sf):
    cited = table(spark, sf, "documents").select(F.explode(C.cited_keys(F.expr(r"concat(r'x \citep{c', doc_id % 400, ', c', doc_id % 900, '}')"))).alias("k")).distinct()
    return cited.join(table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey") * 3).alias("k")), "k", "left_anti")


@query("j4_cited_items", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def j4(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


_ASOF = """select e.event_id, max_o.o_orderkey from events e left join lateral (select o_orderkey from orders o where o.o_custkey = e.user_id and o.o_orderdate < e.ts order by o.o_orderdate desc, o.o_orderkey desc limit 1) max_o on true"""


@query("j5_anchor_before", _ASOF)
def j5(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey")
    return J.asof_backward(e, o, ["k"], "ts", "o_orderdate", ["o_orderkey"], tie="o_orderkey").select("event_id", "o_orderkey")


@query("j6_anchor_or_fallback", f"select event_id, coalesce(o_orderkey, -user_id) as anchor from ({_ASOF}) join events using (event_id)")
def j6(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey")
    return J.asof_backward(e, o, ["k"], "ts", "o_orderdate", ["o_orderkey"], tie="o_orderkey").select("event_id", F.coalesce("o_orderkey", -F.col("k")).alias("anchor"))


_SPANS = "select distinct l_orderkey as k, l_linenumber as lo, l_linenumber + cast(floor(l_quantity) as int) % 6 as hi, l_returnflag as flag from lineitem"


@query("j7_spans_not_contained", f"with s as ({_SPANS}) select k, lo, hi, flag from s a where flag <> 'R' and not exists (select 1 from s b where b.flag = 'R' and b.k = a.k and b.lo <= a.lo and b.hi >= a.hi)")
def j7(spark, sf):
    """Formula spans inside no other span; also J8, red segments inside no bracket."""
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + F.floor("l_quantity").cast("int") % 6).alias("hi"), F.col("l_returnflag").alias("flag")).distinct()
    return J.contained_anti(s.filter("flag <> 'R'"), s.filter("flag = 'R'"), ["k"], "lo", "hi")


@query("j9_items_to_blocks", "with c as (select c_custkey, c_nationkey as n, right(c_name, 1) as tail, row_number() over (partition by c_nationkey, right(c_name, 1) order by c_custkey) as rn from customer), s as (select s_suppkey, s_nationkey as n, right(s_name, 1) as tail, row_number() over (partition by s_nationkey, right(s_name, 1) order by s_suppkey) as rn from supplier) select s_suppkey, c_custkey from s join c using (n, tail, rn)")
def j9(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.right("s_name", F.lit(1)).alias("tail"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.right("c_name", F.lit(1)).alias("tail"))
    return J.first_unused(c, s, ["n", "tail"], "c_custkey", "s_suppkey").select("s_suppkey", "c_custkey")


@query("j10_similar_top1", "select a.vec_id, arg_max(b.vec_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) - b.vec_id * 1e-12) as best from embeddings a, embeddings b where a.vec_id <> b.vec_id and a.label = b.label group by 1")
def j10_p25(spark, sf):
    """Cosine of unit vectors within a label; the best of each vector, ties to the smaller id."""
    return J.nearest_in_group(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")


@query("j12_positional", "select a.conv_id, a.rn, a.role, b.role as other from (select *, row_number() over (partition by conv_id order by turn) rn from conversations) a join (select *, row_number() over (partition by conv_id order by turn desc) rn from conversations) b using (conv_id, rn)")
def j12(spark, sf):
    t, w = table(spark, sf, "conversations"), Window.partitionBy("conv_id")
    both = t.select("conv_id", "role", F.row_number().over(w.orderBy("turn")).alias("rn")), t.select("conv_id", F.col("role").alias("other"), F.row_number().over(w.orderBy(F.desc("turn"))).alias("rn"))
    return both[0].join(both[1], ["conv_id", "rn"])


@query("j13_abbreviations", "select n_name, r_name, count(*) as n from nation join region on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey group by all")
def j13(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@query("j15_prefix_search", "with h as (select l, substring(text, 1, l) as p, min(doc_id) as hay from documents, (values (56), (42), (30), (20), (12)) v(l) where length(text) >= l group by all) select doc_id, hay, length from (select d.doc_id, h.hay, h.l as length, row_number() over (partition by d.doc_id order by h.l desc, h.hay) as rn from documents d join h on substring(d.text, 1, h.l) = h.p and length(d.text) >= h.l) where rn = 1")
def j15_j16(spark, sf):
    d = table(spark, sf, "documents")
    return J.prefix_search(d.select("doc_id", "text"), d.select(F.col("doc_id").alias("hay"), "text"), "text", "text", (56, 42, 30, 20, 12), "doc_id", "hay")


@query("j17_dangling", "select 'dangling' as side, count(*) as n from (select doc_id from labels except select doc_id from documents where doc_id % 3 <> 0) union all select 'orphan', count(*) from (select doc_id from documents where doc_id % 3 <> 0 except select doc_id from labels)")
def j17_u1(spark, sf):
    a, b = table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").filter("doc_id % 3 <> 0").select("doc_id")
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.subtract(b), "dangling").unionByName(count(b.subtract(a), "orphan"))


@query("j18_rowspan", "select user_id, min(event_id) as first_event, event_type, count(*) as span from (select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as g from events) group by user_id, event_type, g")
def j18_w8(spark, sf):
    """A cell with those of the same kind that follow it without a gap: islands, not a self join."""
    w = O.ordered(["user_id"], "event_id")
    t = table(spark, sf, "events").withColumn("s", F.lag("event_type").over(w) != F.col("event_type")).withColumn("g", O.island(F.col("s"), w))
    return t.groupBy("user_id", "g", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("span")).drop("g")


@query("j19_ranked_example", "select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by case when c_mktsegment like '%BUILD%' then 0 else 1 end, c_acctbal desc, c_custkey) rn from customer) where rn = 1")
def j19_j20(spark, sf):
    return J.first_by(table(spark, sf, "customer"), ["c_nationkey"], F.when(F.col("c_mktsegment").contains("BUILD"), 0).otherwise(1), F.desc("c_acctbal"), "c_custkey").select("c_nationkey", "c_custkey")


# --- aggregates

@query("g1_first_mode", "select user_id, event_type, n from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, min(event_id), event_type) as rn from events group by 1, 2) where rn = 1")
def g1_g3(spark, sf):
    return A.first_mode(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query("g2_mode_of_modes", "with m as (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, min(event_id), event_type) as rn, min(event_id) as f from events group by 1, 2) select event_type, count(*) as n from m where rn = 1 group by 1")
def g2(spark, sf):
    return A.first_mode(table(spark, sf, "events"), ["user_id"], "event_type", "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("g4_conditional_counts", r"select doc_id, len(regexp_extract_all(text, '\([0-9]+\)')) as cites, len(regexp_extract_all(text, '[$]')) as formulas, cast(contains(text, '@') as int) as mails from documents")
def g4_g15(spark, sf):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf, "documents").select("doc_id", n(r"\([0-9]+\)").alias("cites"), n("[$]").alias("formulas"), F.col("text").contains("@").cast("int").alias("mails"))


@query("g5_counts_by_class", "select lang, source, count(*) as n from documents group by all")
def g5(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("g6_samples", "select role, conv_id, turn, rank, greatest(n - 5, 0) as overflow from (select *, row_number() over (partition by role order by conv_id, turn) as rank, count(*) over (partition by role) as n from conversations) where rank <= 5")
def g6(spark, sf):
    return A.sample_of_groups(table(spark, sf, "conversations").select("role", "conv_id", "turn"), ["role"], ["conv_id", "turn"], 5)


@query("g7_match_rates", "select quality, count(*) as n, count(*) filter (where toxic = 1) as toxic, round(100.0 * count(*) filter (where toxic = 1) / nullif(count(*), 0), 4) as pct from labels group by 1")
def g7(spark, sf):
    t = F.count_if(F.col("toxic") == 1)
    return table(spark, sf, "labels").groupBy("quality").agg(F.count("*").alias("n"), t.alias("toxic"), F.round(100.0 * t / F.nullif(F.count("*"), F.lit(0)), 4).alias("pct"))


@query("g8_lists_in_order", "select conv_id, string_agg(concat(turn, ':', role), ' ' order by turn) as turns from conversations group by 1")
def g8_k3(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.expr("listagg(concat(turn, ':', role), ' ') within group (order by turn)").alias("turns"))


@query("g9_blanks", "select l_orderkey, round(sum(greatest(l_quantity - 25, 0)), 4) as excess, count(*) filter (where l_quantity > 40) as pages, max(l_quantity) as worst from (select *, row_number() over (partition by l_orderkey order by l_linenumber desc, l_quantity, l_extendedprice) as rn from lineitem) where rn > 1 group by 1")
def g9(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), "l_quantity", "l_extendedprice")
    t = table(spark, sf, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn > 1")
    return t.groupBy("l_orderkey").agg(F.round(F.sum(F.greatest(F.col("l_quantity") - 25, F.lit(0))), 4).alias("excess"), F.count_if(F.col("l_quantity") > 40).alias("pages"), F.max("l_quantity").alias("worst"))


@query("g10_widest_cell", f"with {LINES} select doc_id, max(length(line)) as widest from lines group by 1")
def g10(spark, sf):
    return lines(spark, sf).groupBy("doc_id").agg(F.max(F.length("line")).alias("widest"))


@query("g11_distinct_in_order", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def g11(spark, sf):
    return A.distinct_in_order(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query("g12_any_all", "select conv_id, bool_and(length(text) > 20) as all_long, bool_or(role = 'system') as any_system from conversations group by 1")
def g12(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.bool_and(F.length("text") > 20).alias("all_long"), F.bool_or(F.col("role") == "system").alias("any_system"))


@query("g13_numbering_vote", "select source, case when count(*) filter (where doc_id % 7 = 0) > 0 and count(*) filter (where doc_id % 7 = 0) * 3 > count(*) then 'sectioned' when count(*) filter (where doc_id % 2 = 0) > 0 then 'simple' else 'none' end as mode from documents group by 1")
def g13(spark, sf):
    n = lambda k: F.count_if(F.col("doc_id") % k == 0)
    return table(spark, sf, "documents").groupBy("source").agg(F.when((n(7) > 0) & (n(7) * 3 > F.count("*")), "sectioned").when(n(2) > 0, "simple").otherwise("none").alias("mode"))


@query("g14_column_votes", "select l_returnflag, l_linenumber, rows from (select *, max(rows) over (partition by l_returnflag) as most from (select l_returnflag, l_linenumber, count(distinct l_orderkey) as rows from lineitem group by 1, 2)) where rows >= greatest(0.4 * most, 2)")
def g14(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.countDistinct("l_orderkey").alias("rows"))
    return n.withColumn("most", F.max("rows").over(Window.partitionBy("l_returnflag"))).filter(F.col("rows") >= F.greatest(0.4 * F.col("most"), F.lit(2))).drop("most")


@query("g16_duplicate_ids", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def g16(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


# --- windows

_W = "(partition by user_id order by ts, event_id)"


@query("w1_previous", f"select event_id, lag(event_type) over {_W} as prev from events")
def w1(spark, sf):
    return table(spark, sf, "events").select("event_id", F.lag("event_type").over(O.ordered(["user_id"], "ts", "event_id")).alias("prev"))


@query("w2_latched", f"select event_id, coalesce(bool_or(event_type = 'click') over {_W}, false) as seen from events")
def w2(spark, sf):
    return table(spark, sf, "events").select("event_id", O.latched(F.col("event_type") == "click", O.ordered(["user_id"], "ts", "event_id")).alias("seen"))


@query("w3_forward_fill", f"select event_id, last_value(case when value > 50 then event_type end ignore nulls) over {_W} as section from events")
def w3(spark, sf):
    return table(spark, sf, "events").select("event_id", O.forward_fill(F.when(F.col("value") > 50, F.col("event_type")), O.ordered(["user_id"], "ts", "event_id")).alias("section"))


@query("w4_counters", f"select event_id, section, count(*) filter (where event_type <> 'click') over (partition by user_id, section order by ts, event_id) as equation from (select *, count(*) filter (where event_type = 'click') over {_W} as section from events)")
def w4(spark, sf):
    t = table(spark, sf, "events").withColumn("section", O.running_count(F.col("event_type") == "click", O.ordered(["user_id"], "ts", "event_id")))
    return t.select("event_id", "section", O.running_count(F.col("event_type") != "click", O.ordered(["user_id", "section"], "ts", "event_id")).alias("equation"))


@query("w5_look_ahead", """with n as (select *, row_number() over (partition by user_id order by event_id) as rn from events), s as (
      select event_id, rn, min(case when value > 60 then rn end) over w as hit, min(case when event_type = 'click' then rn end) over w as stop, first_value(case when value > 60 then event_type end ignore nulls) over w as v from n window w as (partition by user_id order by event_id rows between 1 following and 5 following))
    select event_id, case when stop is null or stop > hit then v end as caption from s""")
def w5(spark, sf):
    return O.look_ahead(table(spark, sf, "events"), ["user_id"], "event_id", F.when(F.col("value") > 60, F.col("event_type")), F.col("event_type") == "click", 5, "caption").select("event_id", "caption")


@query("w7_runs_until", f"with {LINES}, f as (select doc_id, min(ord) filter (where length(line) > 120) as stop from lines group by 1) select l.doc_id, count(*) as n from lines l join f using (doc_id) where stop is null or ord < stop group by 1")
def w7(spark, sf):
    stop = F.min(F.when(F.length("line") > 120, F.col("ord"))).over(Window.partitionBy("doc_id"))
    return lines(spark, sf).withColumn("stop", stop).filter("stop is null or ord < stop").groupBy("doc_id").agg(F.count("*").alias("n"))


_PART = "case when event_id % 3 <> 0 then concat('{b}citep{{', cast(event_id * 7 % (case when user_id % 2 = 0 then 9 else 120 end) as {text}), '}}') else event_type end"


@query("w9_merge_runs", f"""with p as (select user_id, event_id, {_PART.format(b=chr(92), text="varchar")} as part from events),
    n as (select *, nullif(regexp_extract(part, '^\\\\citep\\{{([0-9]+)\\}}$', 1), '') as num, lag(nullif(regexp_extract(part, '^\\\\citep\\{{([0-9]+)\\}}$', 1), '')) over (partition by user_id order by event_id) as before from p),
    g as (select *, sum(case when num is null or before is null then 1 else 0 end) over (partition by user_id order by event_id) as run from n)
    select user_id, min(event_id) as event_id, case when count(num) < 2 then min(part) when max(length(num)) = 1 then '{chr(92)}citep{{' || string_agg(num, '' order by event_id) || '}}' else '{chr(92)}citep{{' || string_agg(num, ',' order by event_id) || '}}' end as part
    from g group by user_id, run""")
def w9(spark, sf):
    """Neighbouring citations as one: digits of a split number, or a list."""
    part = F.expr(_PART.format(b=chr(92) * 2, text="string")).alias("part")
    return O.merge_cite_runs(table(spark, sf, "events").select("user_id", "event_id", part), ["user_id"], "event_id", "part")


@query("w11_coalesced_intervals", """with s as (select distinct l_orderkey as k, l_linenumber as lo, l_linenumber + cast(floor(l_quantity) as int) % 3 as hi from lineitem), m as (select *, max(hi) over (partition by k order by lo, hi rows between unbounded preceding and 1 preceding) as reach from s),
    i as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by k order by lo, hi rows unbounded preceding) as g from m) select k, min(lo) as lo, max(hi) as hi from i group by k, g""")
def w11(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + F.floor("l_quantity").cast("int") % 3).alias("hi"))
    return O.coalesce_intervals(s, ["k"], "lo", "hi")


@query("w12_gap_clusters", "with n as (select user_id, value, value - lag(value) over (partition by user_id order by value) >= 5 as s from events), g as (select *, sum(case when coalesce(s, true) then 1 else 0 end) over (partition by user_id order by value rows unbounded preceding) as cluster from n) select user_id, cluster, min(value) as lo, max(value) as hi, round(avg(value), 6) as mean, count(*) as n from g group by 1, 2")
def w12(spark, sf):
    return O.gap_clusters(table(spark, sf, "events"), ["user_id"], "value", 5.0).withColumn("mean", F.round("mean", 6))


@query("w13_anchored_clusters", """with recursive v as (select user_id, value, row_number() over (partition by user_id order by value) as rn from events), r as (
      select user_id, value, rn, value as anchor, 1 as cluster from v where rn = 1 union all
      select v.user_id, v.value, v.rn, case when v.value - r.anchor < 5 then r.anchor else v.value end, case when v.value - r.anchor < 5 then r.cluster else r.cluster + 1 end from r join v on v.user_id = r.user_id and v.rn = r.rn + 1)
    select user_id, cluster, count(*) as n, min(value) as anchor from r group by 1, 2""")
def w13(spark, sf):
    return O.anchored_clusters(table(spark, sf, "events"), "user_id", "value", 5.0).groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("value").alias("anchor"))


@query("w14_midpoints", "select user_id, value, round((lag(value) over w + value) / 2, 6) as lo, round((value + lead(value) over w) / 2, 6) as hi from (select distinct user_id, value from events) window w as (partition by user_id order by value)")
def w14(spark, sf):
    lo, hi = O.midpoints(F.col("value"), O.ordered(["user_id"], "value"))
    return table(spark, sf, "events").select("user_id", "value").distinct().select("user_id", "value", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_SNAPS = {0: ([0.1, 5.05], [0.1, 5.05, 10.0]), 1: ([0.2, 0.1], [0.2, 5.0, 10.0]), 2: ([12.0, -1.0], [-1.0, 5.0, 12.0]), 3: ([7.0], [0.0, 5.0, 10.0]), 4: ([], [0.0, 5.0, 10.0])}


@query("w15_snap", "select p_partkey, unnest(range(3)) as ord, unnest(case p_partkey % 5 " + " ".join(f"when {k} then {want}::double[]" for k, (_, want) in _SNAPS.items()) + " end) as at from part")
def w15(spark, sf):
    """Grid lines at 0, 5 and 10 after the drawn coordinates of five cases; the second needs each snap to see the one before."""
    drawn = F.lit(None).cast("array<double>")
    for k, (x, _) in _SNAPS.items():
        drawn = F.when(F.col("p_partkey") % 5 == k, F.array(*map(F.lit, x)).cast("array<double>")).otherwise(drawn)
    grid = F.array(*map(F.lit, (0.0, 5.0, 10.0)))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(U.snapped(grid, drawn)).alias("ord", "at"))


@query("w16_ranges", "select l_orderkey, min(l_linenumber) as first, max(l_linenumber) as last from (select *, l_linenumber - dense_rank() over (partition by l_orderkey order by l_linenumber) as g from (select distinct l_orderkey, l_linenumber from lineitem where l_quantity > 10)) group by l_orderkey, g")
def w16(spark, sf):
    t = table(spark, sf, "lineitem").filter("l_quantity > 10").select("l_orderkey", "l_linenumber").distinct()
    return t.withColumn("g", F.col("l_linenumber") - F.row_number().over(O.ordered(["l_orderkey"], "l_linenumber"))).groupBy("l_orderkey", "g").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last")).drop("g")


@query("w17_prefix_sums", "select event_id, round(sum(value) over (partition by user_id order by event_id rows unbounded preceding), 4) as at, coalesce(sum(1 + event_id % 3) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as col_start from events")
def w17_w18(spark, sf):
    w = O.ordered(["user_id"], "event_id")
    span = F.sum(1 + F.col("event_id") % 3).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, sf, "events").select("event_id", F.round(F.sum("value").over(O.up_to_here(w)), 4).alias("at"), F.coalesce(span, F.lit(0)).alias("col_start"))


_BRACKETS = {0: ("x (a) y (b", [(2, 4, "a")]), 1: ("(a (b) c) d)", [(0, 8, "a (b) c")]), 2: (") (a", []), 3: ("((q) (r)", [(1, 3, "q"), (5, 7, "r")])}


@query("w20_bracket_pairs", " union all ".join(f"select doc_id, {a} as open, {b} as close, '{inner}' as inside from documents where doc_id % 4 = {k}" for k, (_, pairs) in _BRACKETS.items() for a, b, inner in pairs))
def w20(spark, sf):
    """The outermost pairs of brackets: nested ones, one that never closes, one that never opens."""
    text = F.lit(None).cast("string")
    for k, (t, _) in _BRACKETS.items():
        text = F.when(F.col("doc_id") % 4 == k, t).otherwise(text)
    return O.bracket_pairs(table(spark, sf, "documents").select("doc_id", text.alias("t")), ["doc_id"], "t")


@query("w21_renumbered", "select event_id, dense_rank() over (partition by user_id order by first) as n from (select *, min(event_id) over (partition by user_id, event_type) as first from events)")
def w21(spark, sf):
    t = table(spark, sf, "events").withColumn("first", F.min("event_id").over(Window.partitionBy("user_id", "event_type")))
    return t.select("event_id", F.dense_rank().over(Window.partitionBy("user_id").orderBy("first")).alias("n"))


# --- order, limits and sets

@query("o1_natural_order", "select t, row_number() over (order by array_to_string(list_transform(regexp_extract_all(lower(t), '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]') then lpad(x, 20, '0') else x end), '')) as n from (select distinct concat('Img', doc_id % 40, '.png') as t from documents)")
def o1(spark, sf):
    """The places of at most 40 distinct names."""
    t = table(spark, sf, "documents").select(F.expr("concat('Img', doc_id % 40, '.png')").alias("t")).distinct()
    return t.select("t", F.row_number().over(Window.orderBy(X.natural_key(F.col("t")))).alias("n"))


@query("o2_best_of_group", "select l_orderkey, min(l_extendedprice) as price, max(l_quantity) as most from lineitem group by 1 order by price, l_orderkey limit 20")
def o2_o4_o5(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("price"), F.max("l_quantity").alias("most")).orderBy("price", "l_orderkey").limit(20)


@query("o3_longest_first", "select doc_id, regexp_replace(concat('eq', doc_id % 15, ' eq1 eq12'), 'eq12|eq1|eq2', '#', 'g') as t from documents")
def o3(spark, sf):
    keys = "|".join(sorted(("eq1", "eq2", "eq12"), key=len, reverse=True))
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.expr("concat('eq', doc_id % 15, ' eq1 eq12')"), keys, "#").alias("t"))


@query("u2_union_of_strategies", "select doc_id, 'mail' as kind, null as pages from documents where contains(text, '@') union all select doc_id, 'long', n_chars from documents where n_chars > 3000")
def u2(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter(F.col("text").contains("@")).select("doc_id", F.lit("mail").alias("kind")).unionByName(d.filter("n_chars > 3000").select("doc_id", F.lit("long").alias("kind"), F.col("n_chars").alias("pages")), allowMissingColumns=True)


@query("u3_overlap", "select conv_id, list_has_any(list(role), ['system', 'tool']) as overlaps, len(list_filter(list(distinct role), lambda x: x not in ('user', 'assistant'))) = 0 as subset from conversations group by 1")
def u3(spark, sf):
    roles = F.collect_set("role")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.arrays_overlap(roles, F.array(F.lit("system"), F.lit("tool"))).alias("overlaps"), (F.size(F.array_except(roles, F.array(F.lit("user"), F.lit("assistant")))) == 0).alias("subset"))


@query("u4_overlay", "select d.doc_id, coalesce(l.quality, d.doc_id % 2) as quality, coalesce(l.toxic, 0) as toxic from documents d left join labels l using (doc_id)")
def u4(spark, sf):
    out = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.col("doc_id") % 2).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
