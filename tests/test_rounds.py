"""Operators that work in rounds, searches inside pages, paragraphs about floats and pages of tables, against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quire.operators import paragraphs, rounds, search, specs


def turns(wishes):
    """The loop: in order of place, each left takes its first free right."""
    lists = {}
    for left, place, right, rank in wishes:
        lists.setdefault((place, left), []).append((rank, right))
    used, out = set(), {}
    for (_, left), wants in sorted(lists.items()):
        free = [r for _, r in sorted(wants) if r not in used]
        if free:
            out[left] = free[0]
            used.add(free[0])
    return out


WISHES = "l long, p long, r string, o double"


def test_in_turn_equals_the_loop(spark):
    rng = random.Random(2)
    for n, m in ((1, 1), (12, 5), (40, 40), (60, 20)):
        places = rng.sample(range(1000), n)
        wishes = [(k, places[k], f"r{r}", rng.choice([rng.random(), rng.random()])) for k in range(n) for r in rng.sample(range(m), rng.randrange(0, m + 1))]
        got = rounds.in_turn(spark.createDataFrame([*wishes, *wishes[:3]], WISHES), "l", "p", "r", "o").collect()
        assert {r.l: r.r for r in got} == turns(wishes) and len(got) == len({r.l for r in got})
    # Everybody wants the same in the same order: as many rounds as there are wishes, and still the loop's result.
    same = [(k, 100 - k, f"r{r}", float(r)) for k in range(8) for r in range(6)]
    assert {r.l: r.r for r in rounds.in_turn(spark.createDataFrame(same, WISHES), "l", "p", "r", "o").collect()} == turns(same)
    assert rounds.in_turn(spark.createDataFrame([(None, 1, "a", 1.0), (1, 1, None, 1.0)], WISHES), "l", "p", "r", "o").count() == 0


def test_containing_is_a_filtered_product(spark):
    blocks = [(1, 10, "Wang and Li (2019b)"), (1, 11, "12019 Lindt"), (1, 12, None), (2, 13, "Li 2019"), (1, 14, "")]
    entries = [(1, "a", "Li", 2019), (1, "b", "Wang", 2019), (1, "c", "Li", 1201), (2, "d", "Lind", 2019), (1, "e", "", 2019), (1, "f", None, 2019)]
    got = rounds.containing(spark.createDataFrame(blocks, "k int, b int, t string"), spark.createDataFrame(entries, "k int, e string, author string, year int"), ["k"], "t", "year", "author")
    want = {(b, e) for k, b, t in blocks for j, e, author, year in entries if k == j and t and author and str(year) in t and author in t}
    assert sorted((r.b, r.e) for r in got.collect()) == sorted(want) and want


def test_lengths_that_refer_to_lengths(spark):
    texts = {
        1: r"\setlength{\a}{2\b+1mm}\setlength{\b}{-\c}\def\c{1.5cm - 2mm}", 2: r"\setlength{\x}{\y}\setlength{\y}{\z+1mm}\setlength{\z}{\x}\setlength{\w}{\x}", 3: r"\setlength{\q}{\none}", 4: "", 5: None,
        6: "".join(rf"\setlength{{\l{chr(97 + k)}}}{{\l{chr(98 + k)}+1mm}}" for k in range(20)) + r"\setlength{\lu}{1in}", 7: r"\setlength{\s}{\s+1mm}", 8: r"\setlength {\r} {\dimexpr 1mm+1mm+\k+\k\relax}\setlength{\k}{3mm}\setlength{\k}{.5mm}",
    }
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {(r.id, r.name): (None if r.value is None else round(r.value, 6), r.cyclic) for r in rounds.resolved(specs.length_terms(docs, ["id"], "text"), ["id"], "name", "factor", "refers", "mm").collect()}
    want = {(1, "a"): (-25.0, False), (1, "b"): (-13.0, False), (1, "c"): (13.0, False), **{(2, n): (None, True) for n in "xyzw"}, (3, "q"): (None, False), **{(6, f"l{chr(97 + k)}"): (25.4 + 20 - k, False) for k in range(21)}, (7, "s"): (None, True), (8, "r"): (3.0, False), (8, "k"): (0.5, False)}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_turns_over_classes_equal_turns_over_their_rights(spark, seed, monkeypatch):
    rng = random.Random(seed)
    entries = [(rng.randrange(3), rng.choice("abcd"), rng.choice([1990, 1991, None]), r, rng.randrange(40)) for r in range(90)]
    lefts = [(rng.randrange(4), l, rng.randrange(1000)) for l in range(150)]  # noqa: E741
    wishes = [(k, l, p, a, y) for k, l, p in lefts for a in "abcde" for y in (1990, 1991) if rng.random() < 0.3]
    pairs = [(l, (p, l), r, (o, r)) for k, l, p, a, y in wishes for j, b, z, r, o in entries if (k, a, y) == (j, b, z)]
    want = turns(pairs)
    w = spark.createDataFrame(wishes + wishes[:20] + [(0, None, 1, "a", 1990)], "n int, l int, p int, a string, y int")
    e = spark.createDataFrame(entries, "n int, a string, y int, r long, o int")
    monkeypatch.setattr(rounds, "Rounds", None)  # no round is written
    got = rounds.in_turn_of_classes(w, e, ["n"], "l", "p", ["a", "y"], "r", "o")
    assert dict(got.dtypes) == {"l": "int", "r": "bigint"}
    assert sorted((r.l, r.r) for r in got.collect()) == sorted(want if isinstance(want, list) else want.items()) and len(want) > 30


def test_search_inside_pages_equals_brute_force(spark):
    rng = random.Random(9)
    page = lambda: "".join(rng.choices("abé \U0001f600", k=rng.randrange(0, 90)))
    pages = [(k, p, page()) for k in range(3) for p in range(12)] + [(0, 99, None)]
    needles = []
    for n in range(120):
        k, _, t = rng.choice(pages)
        at = rng.randrange(0, len(t or "") + 1)
        needles.append((k, n, ((t or "")[at : at + rng.randrange(0, 40)] + rng.choice(["", "zz"]))))
    needles.append((1, 500, None))
    lengths = (20, 9, 4)
    want = {}
    for k, n, t in needles:
        hits = [(-length, p, text.find(t[:length])) for length in lengths if t and len(t) >= length for j, p, text in pages if j == k and text and t[:length] in text]
        if hits:
            length, p, at = min(hits)
            want[k, n] = (p, len(dict(enumerate(pages[[(j, q) for j, q, _ in pages].index((k, p))][2][:at]))), -length)
    a, b = spark.createDataFrame(needles, "k int, n int, t string"), spark.createDataFrame(pages, "k int, p int, text string")
    old = search.SOUGHT
    try:
        for search.SOUGHT in (old, 50):  # in one pass, and in several
            got = search.inside_pages(a, b, ["k"], "n", "t", "p", "text", lengths).collect()
            assert {(r.k, r.n): (r.p, r["at"], r.length) for r in got} == want and len(want) > 60
    finally:
        search.SOUGHT = old
    assert search.inside_pages(a.limit(0), b, ["k"], "n", "t", "p", "text").count() == 0


def test_search_reads_each_page_once_per_part_of_its_own_needles(spark, monkeypatch):
    """Equal lines, long pages, keys of many needles and batches that cut keys apart; work doesn't grow with the needles of other keys."""
    rng = random.Random(3)
    pages = [(k, p, "the same line everywhere" if p % 2 else "".join(rng.choices("ab é", k=300))) for k in range(4) for p in range(20)]
    needles = [(k, 100 * k + p, t[7 : 7 + rng.randrange(4, 30)]) for k, p, t in pages] + [(9, 1000, "the same line")]
    lengths = (20, 9, 4)
    want = {}
    for k, n, t in needles:
        hits = [(-length, p, text.find(t[:length])) for length in lengths if len(t) >= length for j, p, text in pages if j == k and t[:length] in text]
        if hits:
            want[k, n] = min(hits)
    a, b = spark.createDataFrame(needles, "k int, n int, t string"), spark.createDataFrame(pages, "k int, p int, text string")
    monkeypatch.setattr(search, "SLICE", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for sought, read in ((1 << 16, 1 << 26), (6, 1000)):
            monkeypatch.setattr(search, "SOUGHT", sought)
            monkeypatch.setattr(search, "READ", read)
            found = search.inside_pages(a, b, ["k"], "n", "t", "p", "text", lengths)
            assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one pass, however many are sought
            got = found.collect()
            assert len(got) == len(want) and {(r.k, r.n): (-r.length, r.p, r["at"]) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_search_compares_as_text_when_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(search, "window_hashes", lambda points, lengths: ((n, np.zeros(len(points) - n + 1, np.uint64)) for n in lengths if n <= len(points)))
    texts = pa.array(["needle", "nothing", "needed", "a needle here", "the needed one"])
    got = search._best(texts, np.array([0, 0, 1, 0, 1]), np.array([False, False, False, True, True]), (6, 3))
    assert sorted(zip(*got)) == [(0, 3, 2, 6), (2, 4, 4, 6)]


@pytest.mark.parametrize("room", [10.0, 3.0, 1000.0])
def test_pages_of_tables_equal_the_loop(spark, room):
    rng = random.Random(4)
    tables = {k: [rng.choice([0.0, 1.0, 2.5, 4.0, 12.0]) for _ in range(n)] for k, n in enumerate((1, 2, 7, 90))}
    want = {}
    for k, heights in tables.items():
        page, filled = 0, 0.0
        for n, h in enumerate(heights):
            if n and filled + h > room - 1.0 + 1e-9:
                page, filled = page + 1, 0.0
            filled += h
            want[k, n] = page
    rows = spark.createDataFrame([(k, n, h) for k, hs in tables.items() for n, h in enumerate(hs)], "k int, o int, h double")
    assert {(r.k, r.o): r.page for r in paragraphs.page_starts(rows, ["k"], "o", "h", 1.0, room).collect()} == want


def test_pages_go_on_over_batches_without_rounds(spark, monkeypatch):
    monkeypatch.setattr(rounds.Rounds, "step", None)  # no round is written
    rows = spark.createDataFrame([(k, n, None if n == 4 else 1.0) for k in (None, 1, 2) for n in range(50)], "k int, o int, h double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.k, r.o): r.page for r in paragraphs.page_starts(rows, ["k"], "o", "h", 1.0, 11.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, n): (max(n - 1, 0) if n > 4 else n) // 10 for k in (None, 1, 2) for n in range(50)}


def test_paragraphs_about_floats(spark):
    f, g = "\\begin{table}[h]\nx\n\ny.\n\\end{table}", "\\begin{figure*}\nz\n\\end{figure*}"
    cases = [
        (f"so\n\n{f}\n\nit goes", f"so\n{f}\nit goes"), (f"so\n\n{f}\n\n\n{g}\n\nit goes\n\nEnd", f"so\n{f}\n{g}\nit goes\n\nEnd"), (f"So.\n\n{f}\n\nit goes", None), (f"so\n\n{f}\n\nIt goes", None), (f"so\n\n{f}\n\n2 of", None),
        (f"so\n\n{f}\n\n\\section{{x}}", None), (f"{f}\n\nit goes", None), (f"so\n\n{f}", None), (f"so\n{f}\nit", None), ("no floats\n\nat all", None), ("", None), (f"所以\n\n{f}\n\n导致", f"所以\n{f}\n导致"), (f"a\n\n{f}\n\nb\n\n{g}\n\nC", f"a\n{f}\nb\n\n{g}\n\nC"),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.t for r in paragraphs.merged_around_floats(docs, ["k"], "t").collect()}
    assert got == {k: t if after is None else after for k, (t, after) in enumerate(cases)}
