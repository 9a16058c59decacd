import struct

from pyspark.sql import functions as F

from quire.functions import equations, omml
from quire.operators import classify, joins
from quire.plans import registry
from quire.sources import docx, images, reports, tex
from quire.streaming import documents as S

R = '<w:r><w:t>{}</w:t></w:r>'
BODY = (
    '<w:p><w:pPr><w:pStyle w:val="Heading 1"/><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="28"/><w:color w:val="EE0000"/></w:rPr><w:t>1 Intro</w:t></w:r></w:p>'
    '<w:tbl><w:tr><w:tc><w:tcPr><w:tcW w:w="1200" w:type="dxa"/><w:gridSpan w:val="2"/><w:tcBorders><w:top w:val="single"/></w:tcBorders></w:tcPr><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:tc></w:tr>'
    '<w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    '<w:p><w:r><w:t>Grouped (</w:t></w:r><w:hyperlink w:anchor="_Bib_1"><w:r><w:t>Jiang et al., 2021</w:t></w:r></w:hyperlink><w:r><w:t>; </w:t></w:r><w:r><w:fldChar w:fldCharType="begin"/></w:r>'
    '<w:r><w:instrText>HYPERLINK \\l "_OtherBookmark"</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>Smith et al., 2024</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:t>).</w:t></w:r></w:p>'
    '<w:p><w:r><w:t>where </w:t></w:r><m:oMath><m:f><m:num><m:r><m:t>α</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath></w:p>'
    '<w:p><a:blip r:embed="rIm0"/></w:p>'
)


def files(spark, *more):
    return spark.createDataFrame([("a.docx", docx.package(BODY, {"x.png": b"png-bytes"})), ("bad.docx", b"no zip"), ("null.docx", None), *more], "path string, content binary")


def test_docx_blocks_and_ordinals(spark):
    rows = docx.parse(files(spark), "blocks").orderBy("block_ord").collect()
    assert [(r.kind, r.para_ord, r.any_ord) for r in rows] == [("p", 0, 0), ("tbl", None, None), ("p", 1, 4), ("p", 2, 5), ("p", 3, 6)]
    head = rows[0]
    assert head.style == "Heading 1" and head.alignment == "center" and head.runs[0].bold and head.runs[0].size_pt == 14.0 and head.runs[0].color == "EE0000"
    assert rows[3].has_formula and [r.type for r in rows[3].runs] == ["text", "formula"]


def test_docx_cells_and_round_trip(spark):
    cells = docx.parse(files(spark), "cells")
    first = sorted(map(tuple, cells.select("row", "col_start", "grid_span", "v_merge", "width_twips", "text").collect()), key=str)
    assert (0, 0, 2, None, 1200, "Head") in first and (1, 0, 1, "restart", None, "a") in first and (1, 1, 1, "continue", None, "b") in first
    again = docx.parse(docx.write_tables(cells), "cells")
    assert sorted(map(tuple, again.select("row", "col_start", "grid_span", "v_merge", "width_twips", "text").collect()), key=str) == first
    assert again.filter("borders['top'] = 'single'").count() == 1


def test_docx_citations_formulas_media(spark):
    cites = [(r.source, r.target, r.display) for r in docx.parse(files(spark), "citations").collect()]
    assert sorted(cites) == [("field", "_OtherBookmark", "Smith et al., 2024"), ("hyperlink", "_Bib_1", "Jiang et al., 2021")]
    (f,) = docx.parse(files(spark), "formulas").collect()
    assert (f.type, f.before, f.latex) == ("inline", "where ", r"\frac{\alpha}{2}")
    (m,) = docx.parse(files(spark), "media").collect()
    assert m.name == "fig1.png" and bytes(m.content) == b"png-bytes" and m.rel_id == "rIm0"


def test_docx_is_opened_once_for_several_kinds(spark):
    (row,) = docx.gathered(files(spark), {"blocks": ["block_ord", "style", "formulas"], "media": ["name"]}).collect()
    blocks = docx.parse(files(spark), "blocks").orderBy("block_ord").collect()
    assert row.path == "a.docx" and [(b.block_ord, b.style) for b in row.blocks] == [(b.block_ord, b.style) for b in blocks]
    assert [b.formulas for b in row.blocks] == [None if b.runs is None else sum(r.type == "formula" for r in b.runs) for b in blocks]
    assert [m.name for m in row.media] == [m.name for m in docx.parse(files(spark), "media").collect()]
    some = docx.parse(files(spark), "blocks", ["path", "kind"])
    assert some.columns == ["path", "kind"] and [r.kind for r in some.collect()] == [b.kind for b in blocks]


def test_docx_rows_of_many_packages(spark):
    df = spark.createDataFrame([(str(k), "<w:p/>" * (1 + k % 7), []) for k in range(3000)], "path string, body string, media array<struct<name:string,content:binary>>").coalesce(1)
    got = docx.parse(docx.packages(df), "blocks", ["path", "block_ord"]).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in got} == {str(k): 1 + k % 7 for k in range(3000)}
    assert docx.gathered(docx.packages(df), {"blocks": ["kind"]}).count() == 3000


def test_docx_folder(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(docx.package(BODY))
    (tmp_path / "y.txt").write_text("no")
    assert docx.read(spark, f"file://{tmp_path}").count() == 5


def test_omml_elements():
    m = lambda x: f'<m:oMath xmlns:m="{omml.M[1:-1]}">{x}</m:oMath>'
    r = lambda t, sty="": "<m:r>" + (f'<m:rPr><m:sty m:val="{sty}"/></m:rPr>' if sty else "") + f"<m:t>{t}</m:t></m:r>"
    e = lambda t: f"<m:e>{r(t)}</m:e>"
    cases = {
        f'<m:nary><m:naryPr><m:chr m:val="∏"/></m:naryPr><m:sub>{r("i")}</m:sub><m:sup>{r("n")}</m:sup>{e("x")}</m:nary>': r"\prod_{i}^{n}x",
        f"<m:rad><m:deg>{r('3')}</m:deg>{e('x')}</m:rad>": r"\sqrt[3]{x}", f"<m:d>{e('a')}{e('b')}</m:d>": r"\left(a b\right)",
        f'<m:d><m:dPr><m:begChr m:val=""/><m:endChr m:val="|"/></m:dPr>{e("a")}</m:d>': r"\left.a\right\|",
        f"<m:m><m:mr>{e('a')}{e('b')}</m:mr><m:mr>{e('c')}{e('d')}</m:mr></m:m>": r"\begin{matrix}a & b \\ c & d\end{matrix}",
        f'<m:acc><m:accPr><m:chr m:val="̄"/></m:accPr>{e("x")}</m:acc>': r"\bar{x}", f"<m:bar>{e('x')}</m:bar>": r"\overline{x}",
        f"<m:sPre><m:sub>{r('a')}</m:sub><m:sup>{r('b')}</m:sup>{e('x')}</m:sPre>": "_{a}^{b}x", r("ab", "p") + r("1", "p") + r("v", "b"): r"\mathrm{ab}1\mathbf{v}",
        f"<m:groupChr>{e('x')}</m:groupChr>": r"\underbrace{x}", f"<m:eqArr>{e('a')}{e('b')}</m:eqArr>": r"\begin{aligned}a \\ b\end{aligned}", r("50%≤γ"): r"50\%\leq\gamma",
    }
    for xml, want in cases.items():
        assert omml.to_latex(m(xml)) == want
    assert omml.to_latex(None) is None and omml.to_latex("<x") is None


def test_equations():
    assert abs(equations.width("a+b") - 2.7) < 1e-9 and abs(equations.width("x^{2}") - 1.7) < 1e-9 and abs(equations.width(r"a_{b^{c}}") - (0.9 + max(0.8, 0.45 * (0.9 + 0.8)))) < 1e-9
    assert equations.break_lines("a+b") == ["a+b"] and equations.break_lines("y=a") == ["y=a"]
    assert equations.break_lines("y = a+b") == ["y &=a", r"&\quad +b"]
    assert equations.break_lines("y = a+b+c+d", 40) == ["y &=a+b", r"&\quad +c+d"]
    assert equations.cleaned("ｘ×y$") == r"x\times y" and equations.cleaned(r"\mathrm{CO2}") == r"\mathrm{CO}_{2}"
    assert equations.with_operands(r"\sum_{i} x_i + 1") == r"\sum_{i}{x_i}+ 1" or equations.with_operands(r"\sum_{i} x_i + 1").startswith(r"\sum_{i}{x_i}")


TABULARS = [
    (r"lcc", r"\toprule Site & Value & Unit \\ \midrule A & 1.0 & ppm \\ B & 2.0 & ppb \\ \bottomrule", 3, 3),
    (r"|l|c|r|", r"\hline Name & Age & Score \\ \hline Alice & 20 & 95 \\ Bob & 22 & 88 \\ \hline", 3, 3),
    (r"p{3cm}cp{4cm}", r"\toprule Description & ID & Details \\ \midrule Long text here & 1 & More \\ Short & 2 & OK \\ \bottomrule", 3, 3),
    (r"lccc", r"\toprule \multicolumn{4}{c}{Group Header} \\ \midrule a & b & c & d \\ e & f & g & h \\ \bottomrule", 4, 3),
    (r"lcc", r"\textbf{B} & \textit{I} & x \\ 1 & 2 & 3 \\", 3, 2),
]


def test_tabular_cases(spark):
    rows = [(k, rf"\begin{{table}}\caption{{Test Table}}\begin{{tabular}}{{{f}}}{b}\end{{tabular}}\end{{table}}") for k, (f, b, _, _) in enumerate(TABULARS)]
    cells = tex.scan(spark.createDataFrame(rows, "doc_id long, text string"), tex.tabulars)
    got = {r.doc_id: r for r in cells.groupBy("doc_id").agg(F.max("columns").alias("c"), (F.max("row") + 1).alias("r"), F.max("caption").alias("cap"), F.max("bold").alias("b"), F.max("italic").alias("i")).collect()}
    for k, (_, _, columns, n) in enumerate(TABULARS):
        assert (got[k].c, got[k].r, got[k].cap) == (columns, n, "Test Table")
    assert got[4].b and got[4].i and not got[0].b


def test_tabulars_whatever_the_braces_hold():
    """Cells and rows cut at once (groups two deep) and mark by mark (deeper, or never closed) are the same."""
    for deep in range(6):
        inner = "{" * deep + r"a & b \\ c \& \{" + "}" * deep
        want = [r"x \& y", *([inner] if deep else ["a", r"b"])]
        got = tex._cells_of(r"x \& y & " + (inner if deep else "a & b"))
        assert got == want
        assert tex._rows_of((inner if deep else "p") + r" \\[2pt] q \\ {r") == [(inner if deep else "p") + " ", " q ", " {r"]
    assert tex._cells_of("a} & b") == ["a} & b"] and tex._cells_of("{a & b") == ["{a & b"]


def test_scan_gives_on_rows_and_fields_as_they_are_wanted(spark, monkeypatch):
    """A batch of large tables goes on in pieces, with the fields asked for only."""
    monkeypatch.setattr(tex, "_BATCH", 7)
    rows = [(k, r"\begin{tabular}{ll}" + r"\\".join(f"{k} & {r}" for r in range(5)) + r"\end{tabular}") for k in range(9)]
    cells = tex.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tex.tabulars, only=("row", "col_start", "text"))
    assert cells.columns == ["doc_id", "row", "col_start", "text"]
    assert sorted(tuple(r) for r in cells.collect()) == sorted((k, r, c, str((k, r)[c])) for k in range(9) for r in range(5) for c in range(2))
    assert tex.scan(spark.createDataFrame([], "doc_id long, text string"), tex.tabulars).count() == 0


def test_tex_scanners_take_anything():
    for scanner in (tex.bib_entries, tex.figures, tex.formulas, tex.tabulars, tex.conditions):
        for text in ("", "{", "}" * 50, r"\begin{tabular}{l", r"@a{b, title={", r"\begin{figure}", "\\", "%", r"\if@x \else \fi \fi", "$", "\\begin{table}\\begin{tabular}{ll}a\\"):
            list(scanner(text))
    assert [c["branch"] for c in tex.conditions(r"\if@a\if@b\textwidth 1mm\fi\else\textheight 2mm\fi")] == ["a/b", "not a"]


def test_table_code_without_description(spark):
    code = spark.createDataFrame([(1, "\\node at (0,-0) {\\textbf{A}};\n\\node at (2,-1) {b};")], "doc_id long, code string")
    assert sorted((r.row, r.col_start, r.text) for r in tex.cells_of_code(code, ["doc_id"]).collect()) == [(0, 0, "A"), (1, 2, "b")]


def test_citation_resolution(spark):
    bib = tex.scan(spark.createDataFrame([(1, "@article{1, author={Jiang, F. and Wang, H.}, year={2021}} @misc{abc-key, author={Smith, A. and Doe, B.}, year=2024}")], "doc_id long, text string"), tex.bib_entries)
    assert [(r.key, r.author, r.year) for r in bib.orderBy("ord").collect()] == [("1", "Jiang, F. and Wang, H.", "2021"), ("abc-key", "Smith, A. and Doe, B.", "2024")]


def test_classification(spark):
    texts = [("A Study of Carbon Flux", "center", 18.0), ("Anna Berg, Max Tal", "center", 12.0), ("University of Somewhere", "center", 12.0), ("Abstract", None, 12.0), ("We study flux in detail here.", None, 12.0), ("Keywords: flux", None, 12.0),
             ("This is the body of the paper and it is long enough to be one.", None, 12.0), ("Figure 1. The map", None, 9.0), ("图 1 中可以看到一个结果", None, 12.0), ("References", None, 12.0), ("mail a@b.org", None, 12.0), ("short", None, 12.0), ("", None, None)]
    rows = [(1, k, t, None, a, s, None, False, False) for k, (t, a, s) in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_ord int, text string, heading_level int, alignment string, size_pt double, indent_pt double, has_formula boolean, has_cite boolean")
    got = [r.semantic_type for r in classify.classify(blocks, ["doc_id"]).orderBy("block_ord").collect()]
    assert got == ["title", "author", "affiliation", "abstract_label", "abstract", "keywords", "body", "figure_caption", "body", "reference", "correspondence", "unknown", "empty"]


def test_images_match(spark, tmp_path):
    ppm = lambda w, h, v: b"P6 %d %d 255\n" % (w, h) + bytes([v, 10, 200]) * (w * h)
    for name, data in (("fig2.ppm", ppm(60, 60, 5)), ("fig10.ppm", ppm(60, 60, 5)), ("orig_a.ppm", ppm(60, 60, 5)), ("orig_b.ppm", ppm(80, 60, 250)), ("no.ppm", b"x")):
        (tmp_path / name).write_bytes(data)
    f = images.read(spark, f"file://{tmp_path}").withColumn("g", F.lit(1)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    got = {r.extracted: r.original for r in images.match(f.filter("path like 'fig%'"), f.filter("path like 'orig%'"), "g").collect()}
    assert got == {"fig2.ppm": "orig_a.ppm", "fig10.ppm": "orig_b.ppm"}
    assert struct.calcsize("d") == 8 and f.count() == 4


def test_many_equal_images_match_without_rounds(spark):
    flat, own = [1.0, 2.0], lambda k: [1.0, float(k)]
    row = lambda g, p, w, s, h: (g, p, w, 60, s, h)
    figs = [row(1, f"fig{k}.png", 60, 10**6 * k, flat) for k in range(150)] + [row(2, "fig1.png", 60, 0, own(3)), row(2, "fig2.png", 109, None, own(3)), row(2, "fig3.png", 500, 0, flat), row(2, "fig4.png", 60, 0, None), row(2, "fig5.png", 60, 0, [1.0, None])]
    originals = [row(1, f"orig{k:03}.png", 60, 10**6 * k + 10**9, flat) for k in range(140)] + [row(2, "a", 60, 5000, own(9)), row(2, "b", 60, 5000, own(4)), row(2, "c", 62, 0, own(3)), row(2, "d", 60, 10**6, [1.0]), row(2, "e", 60, 10**6, None)]
    schema = "g long, path string, width int, height int, file_size long, histogram array<double>"
    spark.sparkContext.setJobGroup("images", "images")
    found = images.match(spark.createDataFrame(figs, schema), spark.createDataFrame(originals, schema), "g").collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("images")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 20  # dealt in rounds, equal images took a job or more each
    got = {(r.g, r.extracted): r.original for r in found}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {f"fig{k}.png": f"orig{k:03}.png" for k in range(140)}
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {"fig1.png": "b", "fig2.png": "c", "fig4.png": "a", "fig5.png": "d"}


def test_greedy_pairs(spark):
    df = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.95), (1, "b", "y", 0.1), (2, "c", "x", 0.5)], "g long, l string, r string, s double")
    assert sorted((r.l, r.r) for r in joins.greedy_pairs(df, "g", "l", "r", "s").collect()) == [("a", "y"), ("b", "x"), ("c", "x")]


def test_json_log_and_streams(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    reports.as_json(docs, f"file://{tmp_path}/j")
    assert sorted(map(tuple, reports.read_json(spark, f"file://{tmp_path}/j", docs.schema).collect())) == sorted(map(tuple, docs.collect()))
    log = spark.createDataFrame([("1", "warning", "m", None)], reports.RUN_LOG)
    reports.log(log, f"file://{tmp_path}/log")
    assert reports.passed(spark.read.parquet(f"file://{tmp_path}/log"))
    docs.write.parquet(f"file://{tmp_path}/in")
    S.apply_to_batches(S.incoming(spark, f"file://{tmp_path}/in"), S.lines_by_class, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").select("doc_id", "line_class", "n_lines").collect())) == sorted(map(tuple, S.lines_by_class(docs).collect()))


def test_event_windows_on_a_stream(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"file://{tmp_path}/in")
    q = S.tumbling(S.incoming(spark, f"file://{tmp_path}/in", S.EVENTS)).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = registry.queries()["e1_tumbling_windows"](spark, sf)
    assert spark.sql("select sum(n) from hours").first()[0] == batch.agg(F.sum("n")).first()[0] and spark.table("hours").count() == batch.count()


def test_latex_to_omml_and_back():
    for tex in (r"\frac{a}{b}", r"x_{1}^{2}", r"\sqrt[3]{x+1}", r"\sum_{i}^{n}", r"\left(a+b\right)", r"\bar{x}", r"\overline{x}", r"\underbrace{ab}", r"\mathbf{v}", r"\mathrm{ab}", r"\alpha\leq\beta", r"a\%", r"\left.a\right\|", r"e^{x_{1}}"):
        assert omml.to_latex(omml.from_latex(tex)) == tex
    for bad in (r"\foo{x}", "{", "}", "_", r"\frac{a}", r"\left(a", "a^"):
        assert omml.from_latex(bad) is None
    assert omml.from_latex(None) is None and omml.to_latex(omml.from_latex("")) == ""
