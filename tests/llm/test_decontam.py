import random

import numpy as np

from quire.llm import decontam
from quire.llm.decontam import Probe, contaminated, decontaminate, edits_within, op2_decontaminate

from .helpers import odd_docs, sf_dir_of


def brute_edits(segment, text):
    """Fewest edits between the segment and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice([[], [rng.choice("abcdefg ")], [s[k], rng.choice("xyz")]])
    return "".join(s)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_alignment_equals_brute_force():
    rng = random.Random(1)
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    for _ in range(60):
        seg, pre = prose(rng, 12), prose(rng, rng.randrange(0, 6))
        text = pre + edited(rng, seg, rng.randrange(0, 7)) + prose(rng, 3)
        want = brute_edits(seg, text)
        got = edits_within(code(seg), code(text), len(pre) - 12, len(pre) + 12, 10)
        assert (got[0] if got else 11) == want or want > 10
        if got:
            assert brute_edits(seg, text[got[1] : got[2]]) == want


def test_finds_what_brute_force_finds():
    rng = random.Random(2)
    items = [(k, prose(rng, n)) for k, n in enumerate([16, 20, 30, 45, 70])]
    probe = Probe.of(items)
    for trial in range(60):
        item, text = items[trial % 5]
        budget = int(probe.budget[probe.items.index(item)])
        n = trial % 3 * budget // 2
        doc = prose(rng, 40) + " " + edited(rng, text.upper() if trial % 2 else text, n) + "  \n" + prose(rng, 40)
        cuts = [(i, c, int(e)) for i, c, e in zip(probe.items, probe.cuts, probe.budget)]
        cp = decontam.normalise(doc)[0].tolist()
        want = {i for i, c, e in cuts if brute_edits(c.tolist(), cp) <= e}
        assert {x[0] for x in probe.search(doc)} == want
        if n == 0:
            assert item in want
            _, start, end, edits = next(x for x in probe.search(doc) if x[0] == item)
            assert edits == 0 and doc[start:end].lower() == text


def test_parts_of_long_items_and_clean_texts():
    rng = random.Random(3)
    text = prose(rng, 120)
    probe = Probe.of([(1, text), (2, None), (3, ""), (4, "short")])
    assert [x[0] for x in probe.search(prose(rng, 30) + text[200:460])] == [1]
    assert probe.search(prose(rng, 3000)) == [] and probe.search(None) == [] and probe.search("a short one") == []
    assert probe.search(text[:50]) == []


def test_table_equals_exact_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    flat = lambda s: " ".join(s.lower().split())
    want = {(d.doc_id, i.item_id) for d in docs for i in items if flat(i.text) in flat(d.text)}
    got = {(r.doc_id, r.item_id) for r in op2_decontaminate(spark, sf).collect()}
    assert want and want <= got
    by_id = {d.doc_id: flat(d.text) for d in docs}
    probe = Probe.of([(i.item_id, i.text) for i in items])
    for d, i in got - want:  # near matches, verified by full alignment
        assert any(brute_edits("".join(map(chr, c)), by_id[d]) <= e for j, c, e in zip(probe.items, probe.cuts, probe.budget) if j == i)


def test_odd_rows_blocks_and_filter(spark, tmp_path):
    rng = random.Random(4)
    item = prose(rng, 25)
    docs = odd_docs(spark, [f"a {item} b", item.upper(), prose(rng, 200)])
    bench = spark.createDataFrame([(1, item, "x"), (2, item, "y"), (None, prose(rng, 20), None), (3, None, None), (4, "", "")], "item_id long, text string, doc_id string")
    sf = sf_dir_of(spark, tmp_path, documents=docs, benchmark=bench)
    got = sorted((r.doc_id, r.item_id) for r in op2_decontaminate(spark, sf).collect())
    n = docs.count()
    assert len(got) == 4 and {i for _, i in got} == {1, 2}
    bad = {d for d, _ in got}
    small = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, 60).collect())
    assert small == got
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == n - 2 and not bad & {r.doc_id for r in kept.collect()}
    assert decontaminate(docs.limit(0), bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == n


def test_short_items_are_only_found_as_whole_texts():
    probe = Probe.of([(1, "yes"), (2, " YES "), (3, "no")])
    assert sorted(x[0] for x in probe.search("\nYes ")) == [1, 2] and probe.search("no") == [(3, 0, 2, 0)]
    assert probe.search("yes and no") == [] and probe.search("") == []


def test_slices_lose_nothing(monkeypatch):
    rng = random.Random(6)
    item = prose(rng, 300)
    probe = Probe.of([(1, item)])
    monkeypatch.setattr("quire.llm.decontam.SLICE", 1500)
    for at in range(0, 3000, 97):
        before, after = prose(rng, at), prose(rng, 4000)
        text = f"{before} {item} {after}"
        (found,) = probe.search(text)
        assert found[0] == 1 and found[3] == 0 and found[1] <= len(before) + 2 and found[2] >= len(before) + len(item) - 1
    assert probe.search(prose(rng, 9000)) == []


def test_blocks_of_a_benchmark_give_what_one_gives(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(tuple, contaminated(docs, bench).collect()))
    assert want and sorted(map(tuple, contaminated(docs, bench, 4000).collect())) == want
    clean = sorted(r.doc_id for r in decontaminate(docs, bench, 4000).collect())
    assert clean == sorted({r.doc_id for r in docs.collect()} - {r[0] for r in want})
