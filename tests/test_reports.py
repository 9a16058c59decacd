"""Reports, template skeletons and tables of sources on cases of their own."""

from pyspark.sql import functions as F

from quire.functions import specs as S
from quire.operators import grids
from quire.operators import specs as C
from quire.sources import reports, tex


def test_chemistry_and_sections(spark):
    texts = spark.createDataFrame([(1, k, "CO2 v2 OCO2 H2o H2") for k in range(6)] + [(2, 0, "none"), (3, 0, None)], "d int, o int, t string")
    rows = reports.chemistry_rows(texts, ["d"], "o", "t")
    assert {(r.section, r.line) for r in rows.collect()} == {("1 converted", "CO2 -> CO$_{2}$"), ("1 converted", "H2 -> H$_{2}$"), ("2 kept", "OCO2")}
    got = {r.d: r.report for r in reports.section_report(rows, ["d"], samples=3).collect()}
    assert got == {1: "[1 converted] 12\n  CO2 -> CO$_{2}$\n  H2 -> H$_{2}$\n  CO2 -> CO$_{2}$\n  ... 9 more\n[2 kept] 6\n  OCO2\n  OCO2\n  OCO2\n  ... 3 more"}


def test_skeletons(spark):
    codes = ["", None, r"\newenvironment{abstract}{a}{b}\def\disclaimer{x}\def\acknowledgements{\section{T}}\documentclass[x]{own}"]
    df = spark.createDataFrame(list(enumerate(codes)), "k int, t string")
    got = [r.c for r in df.select("k", S.facts(F.col("t")).alias("f")).select("k", C.template_code(F.col("f")).alias("c")).orderBy("k").collect()]
    bare = "\\documentclass{article}\n\\begin{document}\n\\title{Title}\n\\author{Author}\n\\maketitle\n\\section{Introduction}\n\\section{Conclusions}\n\\bibliography{references}\n\\end{document}"
    assert got[:2] == [bare, bare]
    assert "\\documentclass{own}" in got[2] and "\\begin{abstract}\nAbstract\n\\end{abstract}" in got[2] and "\\acknowledgements{}" in got[2]


def test_tables_of_a_source(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, "wide", 100), (1, 1, 0, 1, "a", None), (1, 1, 1, 1, "b {x}", 7)], "k int, row int, col_start int, grid_span int, text string, width_twips int")
    code = tex.table_code(cells, ["k"]).first().code
    text = f"\\begin{{table}}{code.replace(chr(92) + 'begin{tikzpicture}', chr(92) + 'begin{tikzpicture}' + code.split(chr(10))[0] + chr(10))}\\end{{table}} \\begin{{tabular}}{{c}}x\\end{{tabular}}"
    got = grids.tables_of_tex(spark.createDataFrame([(5, text), (6, ""), (7, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.kind, r.table_ord, r.row, r.col_start, r.grid_span, r.text) for r in got) == [(5, "tabular", 0, 0, 0, 1, "x"), (5, "tikz", 0, 0, 0, 2, "wide"), (5, "tikz", 0, 1, 0, 1, "a"), (5, "tikz", 0, 1, 1, 1, "b {x}")]
