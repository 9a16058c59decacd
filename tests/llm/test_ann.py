import numpy as np

from quire.llm import ann
from quire.llm.ann import op10_ann

from .helpers import sf_dir_of


def brute(rows, k=20):
    ok = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: (r[0], r[1] if None not in r[1] else [])):
        if None not in v and np.isfinite(v).all() and any(v):
            ok.setdefault(i, v)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids], np.float64)
    out = {}
    for i in ids[ids % 20 == 0].tolist():
        s = (x * np.array(ok[i], np.float64)).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def compare(rows, want):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, w in want.items():
        assert len(got.get(q, [])) == len(w)
        assert [(-s, i) for i, s in got.get(q, [])] == sorted((-s, i) for i, s in got.get(q, []))
        exact = dict(w)
        hits += len(exact.keys() & dict(got.get(q, [])).keys())
        total += len(w)
        for i, s in got.get(q, []):
            if i in exact:
                assert abs(s - exact[i]) < 1e-12
    return hits / max(1, total)


def test_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert compare(op10_ann(spark, sf).collect(), brute(rows)) >= 0.9


def test_recall_over_many_lists_and_blocks(spark, tmp_path, monkeypatch):
    for name, value in (("PER_LIST", 100), ("BLOCK", 60), ("QUERIES", 20)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 24))
    x[1000:1400] = x[0]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    sf = sf_dir_of(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out, want = op10_ann(spark, sf).collect(), brute(rows)
    assert compare(out, want) >= 0.9
    mine = [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 0]
    assert mine == [i for i, _ in want[0]]  # ties: the smaller ids


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, v string")
    out = op10_ann(spark, sf_dir_of(spark, tmp_path, embeddings=df)).collect()
    assert compare(out, brute([r for r in rows if r[0] != 9])) == 1.0
    assert op10_ann(spark, sf_dir_of(spark, tmp_path / "e", embeddings=df.limit(0))).count() == 0


def test_rows_come_only_from_the_probed_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 50)
    monkeypatch.setattr(ann.Index, "_probes", lambda self, sample, k=20: 2)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 16))
    sf = sf_dir_of(spark, tmp_path, vectors=spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>"))
    vectors = spark.read.parquet(f"{sf}/vectors.parquet")
    index = ann.fit(vectors, 1000)  # the sample is the whole table
    lists = ann.nearest(x, index.coarse)
    out = ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect()
    size = np.bincount(lists, minlength=len(index.coarse))
    for q in range(0, 1000, 20):
        order = np.argsort(-(index.coarse @ x[q]), kind="stable")
        probed = order[: max(2, int((np.cumsum(size[order]) <= 20).sum()) + 1)]
        inside = [i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q and lists[i] in probed][:20]
        assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] == inside


def test_near_copies_a_third_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32))
    x[:2000] = x[0] + 0.001 * rng.normal(size=(2000, 32))  # nearer to each other than the codes tell
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    sf = sf_dir_of(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out, want = op10_ann(spark, sf).collect(), brute(rows)
    assert compare([r for r in out if r.query_id < 2000], {q: w for q, w in want.items() if q < 2000}) >= 0.9
