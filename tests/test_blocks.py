"""Functions over blocks on odd cases: nulls, nothing, what only looks like it."""

from pyspark.sql import functions as F

from quire.functions import blocks as B
from quire.functions import cites, latex

RUNS = "array<struct<text:string,size_pt:double>>"


def test_captions(spark):
    r = lambda *pairs: [{"text": t, "size_pt": s} for t, s in pairs]
    cases = [
        # text, runs, alignment, indent, body; caption by style, float caption
        ("Some text", r(("Some", 10.0), ("text", 12.0)), None, 21.0, 12.0, True, False), ("Some text", r(("Some", 12.0), ("text", 8.0)), None, 21.0, 12.0, False, False), ("Some text", r(("Some text", 10.5)), None, 21.0, 12.0, True, False),
        ("Figure 1. A", r(("Figure", 12.0)), "center", 21.0, 12.0, True, False), ("Figure 1. A", None, None, 21.0, None, False, True), ("Figure 1. A", [], None, None, 12.0, True, True), ("Figure 1. " + "long " * 60, [], None, 21.0, 12.0, False, False),
        ("图 2.1：x", r(("图", 9.0), (" ", 14.0), ("x", 9.0)), None, 21.0, 12.0, True, True), ("", r(("", 5.0)), None, None, 12.0, False, False), (None, None, None, None, None, None, None), ("Figure shows", r(("a", None)), None, 10.0, 12.0, False, False),
    ]
    df = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], f"k int, text string, runs {RUNS}, alignment string, indent double, body double")
    c = F.col
    got = {x.k: (x.a, x.b) for x in df.select("k", B.caption_by_style(c("text"), c("runs"), c("alignment"), c("indent"), c("body")).alias("a"), B.float_caption(c("text"), c("runs"), c("body")).alias("b")).collect()}
    for k, case in enumerate(cases):
        assert (bool(got[k][0]), bool(got[k][1])) == (bool(case[5]), bool(case[6])), case


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_names_and_affiliations(spark):
    names = {"{a/b\\refs.bib}": "refs", "x.BIB, y": "x", "my bibfile": "references", "a b": "references", "": "references", None: "references", "..": "references", "'q'": "q", "a?": "references"}
    assert {n: one(spark, n, B.bib_name) for n in names} == names
    marks = {r"\textsuperscript{1,{a}} Lab": ("1,{a}", "Lab"), "$^2$X": ("2", "X"), r"$ ^{3}\mathrm{A b} $ c": ("3", "A b c"), "none": ("", "none"), None: ("", ""), "$x$ y": ("", "$x$ y")}
    assert {t: tuple(one(spark, t, B.affiliation)) for t in marks} == marks
    runs = lambda *texts: spark.createDataFrame([([{"text": t, "size_pt": None} for t in texts],)], f"r {RUNS}").select(B.address_in_runs(F.col("r")).alias("x")).first().x
    assert runs("a", " ", "jo", "hn@", "x.org", ")", "b") == "john@x.org" and runs("(me@y.z)") == "me@y.z" and runs("no") is None and runs("@") is None and runs() is None


def test_preambles(spark):
    cases = {"a\n% ===== made\n% one\nb\n% two": "a\nb\n% two", "% ====\n% x\n\n% y": "\n% y", "\\usepackage commands here\n\\usepackage[a]{b}\n\\Title Of": "\\usepackage[a]{b}\n\\Title Of", "": "", "% ===\n% all": ""}
    df = spark.createDataFrame(list(enumerate([*cases, None])), "k int, t string")
    assert [r.t for r in B.clean_preamble(df, ["k"], "t").orderBy("k").collect()] == [*cases.values(), ""]


def test_labels_and_runs(spark):
    labels = {"{Wang et~al.(2022{\\natexlab{a}})Wang, Ding, and Ma}": "Wang et al. (2022)", "Li(2020)": "Li (2020)", "Li(2020)Li and Ng": "Li and Ng (2020)", "{A(1999b)A}": "A (1999)", "no year": "no year", "": ""}
    assert {t: one(spark, t, cites.bbl_label) for t in labels} == labels
    none, no = F.lit(None).cast("string"), F.lit(False)
    run = lambda t, colour: latex.styled_run(t, F.lit(True), no, none, no, no, colour, none, F.create_map(F.lit("x"), F.lit("\\x")))
    assert one(spark, "12, 3", lambda t: run(t, F.lit("EE0000"))) == "\\textbf{\\citep{12,3}}" and one(spark, "red", lambda t: run(t, F.lit("EE0000"))) == "\\textbf{}"
    assert one(spark, "α_{", lambda t: run(t, none)) == "\\textbf{$\\alpha$\\_\\{}" and one(spark, None, lambda t: run(t, F.lit("x"))) == "\\x{\\textbf{}}"
