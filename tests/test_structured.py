"""Queries that SQL can't express, all rows of them against plain Python over the same blocks."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.functions import latex, specs, text, units
from quire.operators import classify, joins, ordered, tables
from quire.operators import specs as checks
from quire.plans import registry, structured, templates
from quire.sources import docx, images

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def blocks(spark, sf):
    """Rows of each document's blocks, in order."""
    found = defaultdict(list)
    for r in structured._blocks(spark, sf).orderBy("doc_id", "block_ord").collect():
        found[r.doc_id].append(r)
    return found


def trim(t):
    return t.strip(" ")


def find(pattern, t):
    return re.search(pattern, t, re.A) is not None


def without(pattern, t):
    return re.sub(pattern, "", t, flags=re.A)


def by_itself(b, body):
    t, small = trim(b.text), None if b.size_pt is None else b.size_pt < body
    figure, table = find(classify.FIGURE, t), find(classify.TABLE, t)
    if b.heading_level is not None:
        return "heading"
    if t == "" and not b.has_formula:
        return "empty"
    if find(classify.ABSTRACT_LABEL, t):
        return "abstract_label"
    if find(classify.KEYWORDS, t):
        return "keywords"
    if figure or table:
        caption = "figure_caption" if figure else "table_caption"
        rest = without(classify.TABLE, without(classify.FIGURE, t)).lstrip(" ")
        if find(classify.NARRATIVE, rest) and not small:
            return "body"
        if find(r"(?i)^\s*(?:图|Figure|Fig\.?|表|Table|Talbe)\s*[0-9]+(?:\.[0-9]+)*\s*[:：,，.。、\s]+", t):
            return "body" if small is False else caption
        return "body" if len(t) > 100 and not find(r"[a-zA-Z]\s*[),]", t) and not small else caption
    for kind, pattern in (("reference", classify.REFERENCE), ("acknowledgement", classify.ACKNOWLEDGEMENT), ("declaration", classify.DECLARATION), ("abstract", classify.ABSTRACT)):
        if find(pattern, t):
            return kind
    return None


def classes(own):
    """One document's classes by a single pass with its state."""
    sizes = defaultdict(int)
    for b in own:
        if b.heading_level is None and len(b.text) > 30 and b.size_pt is not None:
            sizes[b.size_pt] += 1
    body = max(sizes, key=sizes.get) if sizes else classify.BODY_PT
    out, inside, title, authors_done = [], False, False, False
    for n, b in enumerate(own):
        t, centred = trim(b.text), b.alignment == "center"
        kind = by_itself(b, body)
        affiliated = find(classify.AFFILIATION, t)
        if kind in ("heading", "keywords"):
            inside = False
        elif kind == "abstract":
            inside = True
        elif kind is None and (inside or out and out[-1] == "abstract_label"):
            kind, inside = "abstract", True
        elif kind is None and n < 5 and centred and len(t) > 5 and not title:
            kind, title = "title", True
        elif kind is None and title and not authors_done and n < 15 and centred and 1 < len(t) < 100 and not affiliated:
            kind = "author"
        elif kind is None and (find(classify.CORRESPONDENCE, t) or find(classify.EMAIL, t)):
            kind = "correspondence"
        elif kind is None and affiliated and (centred or (b.size_pt or body) < body and len(t) < 200):
            kind, authors_done = "affiliation", True
        elif kind is None:
            authors_done |= title and not centred and n < 15
            kind = "body" if (b.indent_pt or 0) > 0 or len(t) > 50 or b.has_cite or b.has_formula else "unknown"
        out.append(kind)
    return out


def test_classes_of_all_blocks(spark, sf, blocks):
    got = {(r.doc_id, r.block_ord): r.semantic_type for r in QUERIES["x1_classified_blocks"](spark, sf).collect()}
    want = {(d, b.block_ord): kind for d, own in blocks.items() for b, kind in zip(own, classes(own))}
    assert got == want and len(set(want.values())) >= 6


def test_escapes_and_chemistry_of_odd_texts(spark):
    """Every special character once, whatever stands beside it; subscripts come and go as without the guard that spares most texts."""
    texts = ["", "a", "\\", "\\%_&#${}~^", "{{}}", "50 % of CO2_flag", "CO2 and H2O", "x\n\ny_1", "é中\U0001f600_\U0001f600", "_{2}", "CO$_{2}$_flag", "a\\textsubscript{2}b", "Fe3", "3Fe", None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", latex.escape(F.col("t")).alias("e"), latex.chemistry(F.col("t")).alias("c")).collect()
    assert [r.e for r in out] == ["".join(latex.ESCAPES.get(c, c) for c in t or "") for t in texts]
    assert [r.c for r in out][5:7] == ["50 % of CO2_flag", "CO$_{2}$ and H2O"] and [r.c for r in out][9:] == ["_{2}", "CO2_flag", "a2b", "Fe$_{3}$", "3Fe", None]


def test_assembling_sorts_the_text_once(spark, sf):
    """The lines of a document meet by one grouping; no window sorts the whole texts before it."""
    blocks = spark.createDataFrame([(1, 0, "a", None, "unknown"), (1, 1, "b", None, "unknown"), (1, 2, "c", 2, "heading"), (2, 3, "CO2 %", None, "body")], "d int, block_ord int, text string, heading_level int, semantic_type string")
    made = classify.assemble(blocks, ["d"])
    assert dict(made.collect()) == {1: "a b\n\\subsection{c}", 2: "CO$_{2}$ \\%"}
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()


def test_assembled_documents(spark, sf, blocks):
    texts = sorted({b.text for own in blocks.values() for b in own})
    escaped = dict(spark.createDataFrame([(t,) for t in texts], "t string").select("t", latex.chemistry(latex.escape(F.col("t")))).collect())
    want = {}
    for d, own in blocks.items():
        out = ""
        for b, kind in zip(own, classes(own)):
            body = escaped[b.text]
            level = b.heading_level or 1
            line = {"heading": "\\" + ("sub" if level == 2 else "subsub" if level >= 3 else "") + f"section{{{body}}}", "title": f"\\title{{{body}}}", "author": f"\\author{{{body}}}", "figure_caption": f"\\caption{{{body}}}", "table_caption": f"\\caption{{{body}}}", "empty": ""}.get(kind, body)
            out += (" " if kind == "unknown" and b is not own[0] else "\n") + line
        want[d] = out.lstrip("\n")
    assert {r.doc_id: r.tex for r in QUERIES["x2_k3_assembled_tex"](spark, sf).collect()} == want


def test_reports_of_all_documents(spark, sf, blocks):
    want = {}
    for d, own in blocks.items():
        of = defaultdict(list)
        for b, kind in zip(own, classes(own)):
            of[kind].append(b)
        lines = []
        for kind in sorted(of):
            lines += [f"{kind}: {len(of[kind])}", *(f"  [{b.block_ord}] {b.text[:40]}" for b in of[kind][:5])] + ([f"  ... {len(of[kind]) - 5} more"] if len(of[kind]) > 5 else [])
        want[d] = "\n".join(lines)
    assert {r.doc_id: r.report for r in QUERIES["k2_block_report"](spark, sf).collect()} == want


def test_image_pairs(spark, sf):
    rows = [(r.label, r.vec_id, [abs(float(x)) for x in r.embedding]) for r in registry.table(spark, sf, "embeddings").collect()]
    width, size, want = (lambda v: v % 7 * 60), (lambda v: v * 2000), {}
    for label in {r[0] for r in rows}:
        free = {v: x for g, v, x in rows if g == label and v % 2}
        for v, x in sorted(((v, x) for g, v, x in rows if g == label and v % 2 == 0), key=lambda r: r[0]):
            best = None
            for o, y in sorted(free.items(), key=lambda r: f"orig{r[0]}.png"):
                dw = abs(width(v) - width(o))
                norm = math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(p * p for p in y))
                far = (1 - (sum(p * q for p, q in zip(x, y)) / norm if norm else 0.0)) * 100
                score = -2000.0 if dw == 0 and abs(size(v) - size(o)) < images.SLACK else -1000 + far if dw == 0 else dw + far if dw < images.NEAR else None
                if score is not None and (best is None or score < best[0] - 1e-9):
                    best = (score, o)
            if best:
                want[f"fig{v}.png"] = f"orig{best[1]}.png"
                del free[best[1]]
    assert {r.extracted: r.original for r in QUERIES["x8_image_match"](spark, sf).collect()} == want


def test_specs_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, r"\def\@maketitle{\LARGE {{}"), (4, r"\usepackage{a, ,b}" * 3), (5, "\\newenvironment{abstract}" + "{x}" * 5000)], "k long, t string")
    got = {r.k: [tuple(f) for f in r.f] for r in df.select("k", specs.facts(F.col("t")).alias("f")).collect()}
    assert got[1] == got[2] == got[3] == []
    assert [f[2] for f in got[4]] == ["a", "b"] * 3 and got[5] == [("abstract_format", "type", "environment")]
    empty = checks.check(df.withColumn("t_id", F.lit(9)), df.limit(0).withColumn("t_id", F.lit(9)).withColumnRenamed("t", "code"), ["k"], "t_id", "t", "code")
    assert empty.filter("k = 1").count() == empty.filter("k = 2").count() > 0
    assert checks.summary(empty, ["k"]).filter("status = 'FAIL'").count() == 5


def test_specs_are_read_once_and_as_sparks_own_searches_read_them(spark):
    code = [p for p, _ in templates.PARTS]
    odd = ["\\", "{", "}", "]", "\\def", "\\newcommand{", "\\if@", "\\fi", "\\maketitle", "\\begin{abstract}", " \t\x0b", "\u00a0", "中", "é", "_", "5pt", ", ,", ": ", "\u0661"]
    pick = random.Random(3).choice
    texts = ["".join(pick(code) if pick("ab") == "a" else pick(odd) + pick(code)[: pick(range(60))] for _ in range(pick((2, 9, 40)))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(4).cache()
    read = df.select("k", F.explode(specs.facts(F.col("t"))).alias("f")).select("k", "f.*")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan  # no search of the whole text for each rule
    got = defaultdict(set)
    for r in read.collect():
        got[r.k, r.category].add((r.key, r.value))
    rules = [r for r in specs.RULES if not r.scope and (r.how == "all" or r.how == "pairs" and r.key)]
    searched = [F.array(*[F.regexp_extract_all("t", F.lit(r.pattern), F.lit(n)) for n in ((1, 2) if r.how == "pairs" else (1,))]) for r in rules]
    for k, *found in df.select("k", *searched).collect():
        for rule, (keys, *read) in zip(rules, found):
            want = {(rule.key + key, v.strip(" ")) for key, v in zip(keys, *read)} if read else {(rule.key, v.strip(" ")) for v in keys}
            assert {f for f in got[k, rule.category] if (f[0].startswith(rule.key) if read else f[0] == rule.key)} == want, (rule, texts[k])


def test_specs_of_bytes_that_are_no_text(spark):
    df = spark.sql(r"select cast(concat(encode('\\\\appendix', 'utf-8'), unhex('FF'), encode('\\\\bibliographystyle{', 'utf-8'), unhex('61C3'), encode('}', 'utf-8')) as string) t")
    assert {tuple(f) for f in df.select(specs.facts(F.col("t"))).first()[0]} == {("appendix_format", "command", "true"), ("bibliography_format", "style", "a\ufffd")}


def test_brackets_against_a_stack(spark):
    texts = [None, "", "()", ")(", "((a)", "(a)b)c(", "(()())((", "x(y(z)w)(", "((((", "(a)(b)"] + ["".join("()a"[(k * j) % 7 % 3] for j in range(1, 20)) for k in range(1, 30)]

    def plain(t):
        stack, pairs = [], []
        for k, c in enumerate(t or ""):
            if c == "(":
                stack.append(k)
            elif c == ")" and stack:
                pairs.append((stack.pop(), k))
        return sorted(p for p in pairs if not any(q[0] < p[0] and p[1] < q[1] for q in pairs))

    got = defaultdict(list)
    for r in ordered.bracket_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), ["k"], "t").collect():
        assert r.inside == texts[r.k][r.open + 1 : r.close]
        got[r.k].append((r.open, r.close))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain(t) for k, t in enumerate(texts) if plain(t)}


def test_first_unused_against_a_loop(spark):
    left, right = [(k, k * 7 % 3) for k in range(20)], [(k, k * 5 % 4) for k in range(9)]
    used, want = set(), []
    for a, g in left:
        free = next((b for b, h in right if h == g and b not in used), None)
        if free is not None:
            used.add(free)
            want.append((a, free))
    a, b = spark.createDataFrame(left, "a long, g long"), spark.createDataFrame(right, "b long, g long")
    assert sorted((r.a, r.b) for r in joins.first_unused(a, b, ["g"], "a", "b").collect()) == want


def test_snapping_of_odd_inputs(spark):
    df = spark.createDataFrame([(1, [], [1.0]), (2, [0.0], []), (3, None, [1.0]), (4, [0.0, 5.0], [5.1, 5.2, 5.3])], "k long, g array<double>, d array<double>")
    got = {r.k: r.x for r in df.select("k", units.snapped(F.col("g"), F.col("d")).alias("x")).collect()}
    assert got == {1: [], 2: [0.0], 3: None, 4: [0.0, 5.3]}


def test_tables_of_odd_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, None, "t", None, None), (1, 1, 0, 1, "restart", None, True, 900), (1, 1, 1, 1, None, "x" * 40, None, None), (1, 3, 0, 1, "continue", "y", None, None), (1, 3, 1, 1, None, "12.5 %" * 9, None, None)], "k long, row int, col_start int, grid_span int, v_merge string, text string, rule_below boolean, row_height int")
    widths = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0)], "k long, col int, width_cm double")
    code = tables.tabular_code(cells, ["k"]).first().code
    assert "\\caption{t}" in code and "\\multirow{1}{*}{} & xxxx" in code and "\\cline{1-1}" in code
    assert [r.cm for r in tables.rebalanced_widths(widths, cells, ["k"]).orderBy("col").select(F.round("width_cm", 6).alias("cm")).collect()] == [1.15, 2.85]
    lines = math.floor(40 * 0.55 * 0.42 / 2) + 1
    assert tables.heights(cells.filter("row < 2"), widths, ["k"]).first().height_cm == pytest.approx(max(lines * 0.55, 900 / 567))
    assert tables.tabular_code(cells.limit(0), ["k"]).count() == tables.heights(cells.limit(0), widths, ["k"]).count() == 0


def test_packages_of_odd_rows(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "<w:p/>", []), ("c", "<w:p", None)], "path string, body string, media array<struct<name:string,content:binary>>")
    assert sorted(r.path for r in docx.parse(docx.packages(df), "blocks").collect()) == ["b"]
    assert docx.parse(docx.packages(df.limit(0)), "media").count() == 0
    assert text.numeric_looking(F.lit("1")) is not None


def test_nearest_over_many_tiles(spark):
    rows = [(k, k % 2, [float(k * 7 % 11), float(k * 5 % 13), 1.0]) for k in range(60)] + [(99, 7, [1.0, 1.0, 1.0]), (98, 0, None)]
    df = spark.createDataFrame(rows, "k long, g long, v array<double>")
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6)
    want = {k: min((-dot(v, w), o) for o, h, w in rows if h == g and o != k and w)[1] for k, g, v in rows[:60]}
    for tile in (7, 4096):
        assert {r.k: r.best for r in joins.nearest_in_group(df, "g", "k", "v", tile=tile).collect()} == want
    assert joins.nearest_in_group(df.limit(0), "g", "k", "v").count() == 0
