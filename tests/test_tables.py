"""Depth-aware scanning, tabular placement and drawn tables, each against plain Python or a hand-made case."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import braces, fixes, latex
from quire.operators import grids, rounds
from quire.sources import tex


def column_of(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.k)]


def plain_split(text):
    out, depth, k = [""], 0, 0
    while k < len(text):
        step = text[k : k + 2] if text[k] == "\\" else text[k]
        k += len(step)
        depth = max(0, depth + {"{": 1, "}": -1}.get(step, 0))
        if step == "&" and depth == 0:
            out.append("")
        else:
            out[-1] += step
    return [p.strip(" ") for p in out]


def test_split_equals_plain_python(spark):
    rng = random.Random(7)
    texts = ["", "&", "}&{&}", "a\\", "{" * 40 + "&" + "}" * 40 + "&x", *("".join(rng.choices(["a", "é", "{", "}", "&", "\\", " ", "\\{", "\\&", "\\cmd", "\n"], k=rng.randrange(30))) for _ in range(400))]
    assert column_of(spark, [*texts, None], braces.split) == [*map(plain_split, texts), None]
    assert column_of(spark, ["a&b", ""], lambda t: braces.padded(braces.split(t), F.lit(3))) == [["a", "b", ""], ["", "", ""]]
    assert column_of(spark, ["a&b&c"], lambda t: braces.padded(braces.split(t), F.lit(2))) == [["a", "b"]]


def test_arguments_of_any_depth(spark):
    deep = "{" * 12 + "x" + "}" * 12
    cases = {rf"\a{{1{deep}}} \b{{2\a{{3}}}}": ["1" + deep, "3", r"2\a{3}"], r"\a [o] {x\}y}": [r"x\}y"], r"\ab{no} \a no {no}": [], r"\a{open {in}": ["open {in}"], "": []}
    assert column_of(spark, list(cases), lambda t: braces.bodies(t, "a", "b")) == list(cases.values())
    assert column_of(spark, [rf"p \a{{1{deep}}} q \c{{2\a{{3}}}}", r"\a{\a{x}}", None], lambda t: braces.unwrapped(t, "a")) == [rf"p 1{deep} q \c{{23}}", "x", None]
    made = column_of(spark, [r"x\a{p\a{q}}y\b{z}", r"\a{open"], lambda t: braces.rewritten(t, lambda n, b: F.concat(F.lit("<"), n, F.lit(":"), b, F.lit(">")), "a", "b"))
    assert made == [r"x<a:p\a{q}>y<b:z>", r"\a{open"]
    assert column_of(spark, ["{a{b}c}d", "x", "{open", ""], lambda t: braces.group(t, F.lit(1))) == ["a{b}c", None, "open", None]


def test_columns_and_cells(spark):
    form = r"|l@{\hspace{2pt}{|c|}}||c>{\raggedright{r}}p{2.5cm}|m{1in}b{x}"
    got = [(c.align, c.width_twips, c.rule_left, c.rule_right) for c in column_of(spark, [form], braces.columns)[0]]
    assert got == [("left", None, True, True), ("center", None, False, False), ("left", 1418, False, True), ("left", 1440, False, False), ("left", None, False, False)]
    cells = column_of(spark, [r"\small\textbf{A {\emph{b}}} CO$_2$ \& 5\% $_{12}$ \textsubscript{x}", "", r"a\\b"], braces.cell)
    assert [tuple(c) for c in cells] == [("A b CO₂ & 5% ₁₂ ₓ", True, True, 10), ("", False, False, None), ("a b", False, False, None)]


def plain_placed(rows, columns):
    """Cells on an occupancy grid: what code without empty cells for taller ones means."""
    taken, out = {}, []
    for r, row in enumerate(rows):
        column, cells = 0, list(row)
        while cells or (r, column) in taken:
            if (r, column) in taken:
                start, wide = taken[r, column]
                out.append((r, start, wide, "continue", ""))
                column = start + wide
                continue
            wide, tall, text = cells.pop(0)
            out.append((r, column, wide, "restart" if tall > 1 else None, text))
            taken |= {(r + d, c): (column, wide) for d in range(1, tall) for c in range(column, column + wide)}
            column += wide
    return out


def test_cells_below_taller_ones_move_on():
    rng = random.Random(3)
    for _ in range(300):
        columns, taken, rows, written = rng.randrange(2, 6), set(), [], []
        for r in range(rng.randrange(1, 7)):
            row, full, column = [], [], 0
            while column < columns:
                if (r, column) in taken:
                    full.append((1, 1, ""))
                    column += 1
                    continue
                wide = 2 if rng.random() < 0.3 and column + 1 < columns and (r, column + 1) not in taken else 1
                tall = rng.choice([1, 1, 2, 3])
                cell = (wide, tall, f"{r}.{column}")
                taken |= {(r + d, c) for d in range(1, tall) for c in range(column, column + wide)}
                row.append(cell)
                full.append(cell)
                column += wide
            rows.append(row)
            written.append(full)
        want = plain_placed(rows, columns)
        for form in (rows, written):  # without, and with, an empty cell for every column that is held
            held, got = {}, []
            for r, row in enumerate(form):
                cells, held = tex.placed(row, columns, held)
                got += [(r, c, wide, merge, text) for c, wide, _, merge, text in cells]
            assert got == want


def drawn(spark, codes):
    df = spark.createDataFrame(list(enumerate(codes)), "k int, code string")
    rows = grids.drawn_cells(df, ["k"]).collect()
    return {k: sorted((r.row, r.col_start, r.grid_span, r.v_merge, r.text) for r in rows if r.k == k) for k in range(len(codes))}


def test_drawn_tables_that_are_not_ruled_throughout(spark):
    node = lambda x, y, t: rf"\node[align=center] at ({x},{y}) {{{t}}};"
    rule = lambda *p: rf"\draw[line width=1.2pt] ({p[0]},{p[1]}) -- ({p[2]},{p[3]});"
    # Three rules across and no upright line: columns come from the nodes of the fullest rows, the empty cell stays one.
    booktabs = "\n".join([rule(0, 0, 6, 0), rule(6, -0.6004, 0, -0.6), rule(0, -2, 6, -2.0004), *(node(x, y, f"{x}{{{y}}}") for x in (1, 3, 5) for y in (-0.3, -1, -1.6) if (x, y) != (3, -1.6))])
    # Coordinates that differ by less than the tolerance are one line; the upper two cells on the left are merged.
    merged = "\n".join([rule(0, 0, 2, 0), rule(1.02, -1.0004, 2, -1), rule(0, -2, 2.05, -2), rule(0, 0, 0, -2), rule(1, 0, 1.0003, -2), rule(2.03, 0, 2.03, -2), node(0.5, -1, "tall"), node(1.5, -0.5, "a"), node(1.5, -1.5, "b")])
    # Two nodes of one cell, a slanted line, a picture without nodes and one without lines.
    odd = "\n".join([rule(0, 0, 1, 0), rule(0, -1, 1, -1), rule(0, 0, 0, -1), rule(1, 0, 1, -1), rule(0, 0, 1, -1), node(0.7, -0.5, "second"), node(0.2, -0.5, "first")])
    got = drawn(spark, [booktabs, merged, odd, rule(0, 0, 1, 0), node(1, -1, "alone"), ""])
    assert got[0] == [(r, c, 1, None, "" if (x, y) == (3, -1.6) else f"{x}{{{y}}}") for r, y in enumerate((-0.3, -1, -1.6)) for c, x in enumerate((1, 3, 5))]
    assert got[1] == [(0, 0, 1, "restart", "tall"), (0, 1, 1, None, "a"), (1, 0, 1, "continue", ""), (1, 1, 1, None, "b")]
    assert [t for *_, t in got[2]] in (["first second"], ["first", "second"]) and got[3] == [] and got[5] == []
    assert got[4] == [(0, 0, 1, None, "alone")]


@pytest.mark.parametrize("n", [2, 3000])
def test_repairs_have_no_caps(spark, n):
    """Runs, arguments and lines as long as one likes."""
    run = "".join(f"\\citep{{k{k}}}" for k in range(n))
    long = "a" * n
    cases = {
        f"x{run}y": "x\\citep{" + ",".join(f"k{k}" for k in range(n)) + "}y", f"(({long} et al. {long}))": f"({long} et al. {long})", f"(({long}))": f"(({long}))", "((see 2019a))": "(see 2019a)", "((12019))": "((12019))", "((a (2019)))": "((a (2019)))",
        "\\mathrm{" + "{" * 9 + "+" + long + "}" * 9 + "}": "{" * 9 + "+" + long + "}" * 9, "\\mathrm{" + long + "}": "\\mathrm{" + long + "}", "\\mathrm{open +": "\\mathrm{open +",
    }
    assert column_of(spark, list(cases), fixes.repaired) == list(cases.values())
    deep = "{" * 9 + long + "}" * 9
    more = {f"\\disclaimer{{ Disclaimer: {deep}}}": f"\\section{{Disclaimer}}\n{deep}\n", f"a\\vadjust{{{deep}}}b": "ab", "\\includegraphics[draft , width=2cm]{empty}": "", "\\includegraphics[draftly]{empty}": "\\includegraphics[draftly]{empty}", "x \\includegraphics[draft]{empty}": "x \\includegraphics[draft]{empty}"}
    assert column_of(spark, list(more), fixes.for_converter) == list(more.values())


def test_a_drawing_leaves_no_code_and_no_units_behind(spark):
    code = spark.createDataFrame([(1, "\\draw (0,0) -- (2,0);\\draw (0,-1) -- (2,-1);\\draw (0,0) -- (0,-1);\\draw (2,0) -- (2,-1);\\node at (1,-0.5) {x};"), (None, "\\node at (1,-0.5) {y};")], "k int, code string")
    before = set(rounds._FOLDERS)
    got = grids.drawn_cells(code, ["k"])
    assert [(r.k, r.row, r.col_start, r.text) for r in got.collect()] == [(1, 0, 0, "x")]
    kept = [f.rsplit("/", 1)[1].rsplit("-", 1)[0] for f in set(rounds._FOLDERS) - before]
    assert not {"drawn-code", "drawn-units", "drawn-edges"} & set(kept), kept


def test_drawings_are_read_where_they_stand(spark):
    """Random tables with cells over rows and columns, drawn and read back, without a shuffle or a folder of tables in between."""
    rng, cells, want = random.Random(3), [], []
    for key in range(60):
        rows, columns, taken = rng.randint(1, 6), rng.randint(1, 6), set()
        for row in range(rows):
            for col in range(columns):
                if (row, col) in taken:
                    continue
                # The first row and column hold single cells, so that every line is drawn somewhere.
                tall, wide = (rng.randint(1, rows - row), rng.randint(1, columns - col)) if row and col else (1, 1)
                while any((row, col + k) in taken for k in range(wide)):
                    wide -= 1
                taken |= {(row + r, col + c) for r in range(tall) for c in range(wide)}
                text, pt = rng.choice(["", f"a{{{row}}} & {col}%", "s_1 \\node", f"{key}"]), 0.4 + 0.4 * (key % 3)
                cells.append((key, row, col, wide, tall, text, pt))
                want += [(key, row + r, col, wide, None if tall == 1 else "continue" if r else "restart", tall, "" if r else text, pt if r == 0 else None, pt if r == tall - 1 else None, pt, pt) for r in range(tall)]
    drawing = spark.createDataFrame(cells, "k int, row int, col_start int, grid_span int, row_span int, text string, pt double")
    widths = drawing.selectExpr("k", "explode(sequence(0, 5)) as col").distinct().withColumn("width_cm", F.lit(1.3))
    code = grids.drawn_code(drawing, widths, ["k"]).localCheckpoint()
    before = set(rounds._FOLDERS)
    back = grids.drawn_cells(code, ["k"])
    assert set(rounds._FOLDERS) == before and "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    got = back.withColumn("text", F.replace(F.replace(F.col("text"), F.lit("\\textbackslash{}"), F.lit("~")), F.lit("\\"), F.lit(""))).withColumn("text", F.replace("text", F.lit("~"), F.lit("\\")))
    assert sorted(map(str, map(tuple, got.withColumns({c: F.round(c, 6) for c in back.columns[-4:]}).collect()))) == sorted(str((*w[:7], *[p and round(p, 6) for p in w[7:]])) for w in want)


def test_texts_of_cells_at_once_and_by_marks(spark):
    rng = random.Random(8)
    bits = ["a", " ", "{", "}", "\\", "\\%", "\\\\", "$_{2}$", "$", "\\emph{x}", "\n", "\\\n", "é", "\U0001f600", "\\\U0001f600", "\\@", "*", "~", "^", "#", "&"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~braces.cell_text(F.col("t")).eqNullSafe(braces._cell_marks(F.col("t")))).count() == 0
    assert df.filter(~latex.escape(F.col("t")).eqNullSafe(latex._escape_runs(F.coalesce("t", F.lit(""))))).count() == 0


def test_column_formats_cut_at_once_and_by_the_fold(spark):
    """Formats whose groups close are cut into columns at once; the result is the fold's, which reads any format."""
    rng = random.Random(5)
    bits = ["l", "c", "r", "p", "m{", "p{3cm}", "p{2.55mm}", "b{ 1 in }", "p{3pt}", "p{1.2.3cm}", "p{3cm}{4cm}", "|", "@{", "<{", ">{p{3cm}|}", "{", "}", "{l|r}", "\\|", "\\{", "\\hspace{", " ", "{" * 9, "}" * 9, "\n", "\\", "@{\\hspace{{{l|r}}}}", "p{{3cm}}"]
    forms = ["", "|", "l" * 20_000, "p" + "{a}" * 20_000 + "{1cm}|", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(forms)), "k int, t string").where("k <> 3")
    both = df.select("t", braces.columns(F.col("t")).alias("x"), braces._columns_fold(F.col("t")).alias("y"))
    assert both.filter("not x <=> y").count() == 0
    long = spark.createDataFrame([(forms[3],), (r"|l>{p{3cm}|}p{2cm}|\||c",), ("@{{l|r}}|",), (None,)], "t string")
    got = [[tuple(c) for c in r.x] if r.x is not None else None for r in long.select(braces._columns_cut(F.col("t")).alias("x")).collect()]
    assert got == [[("left", 567, False, True)], [("left", None, True, False), ("left", 1134, False, True), ("center", None, False, False)], [], None]
