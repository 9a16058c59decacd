import hashlib
import math
import re
import zlib
from collections import Counter

from quire.llm import resample
from quire.llm.resample import op13_resample

from .helpers import odd_docs, sf_dir_of
from ..compare import connect, differ


def plain(docs, targets):
    """The contract, one feature at a time; docs are (doc_id, text)."""

    def features(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for text in targets for b in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000.0) / ((s[b] + 1.0) * (t_all + 10000.0))))
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in rows], key=str)


def rows_of(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_equals_its_sql(spark, sf):
    assert differ(op13_resample(spark, sf), connect(sf), resample.oracle()) is None


def test_equals_plain_python(spark, sf):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    want = plain(read("documents", "doc_id"), [t for _, t in read("benchmark", "item_id")])
    assert rows_of(op13_resample(spark, sf)) == want and sum(r[4] is not None for r in want) >= 5


def test_long_texts_in_chunks(spark, tmp_path):
    """Chunks of two words: every run is counted once, whichever chunk it starts in."""
    old = resample.LONG, resample.CHUNK
    texts = ["A b C d e", "", " . ! " * 20, "one", "one two", "One TWO three é ÉÀ 12 x", " ".join(f"w{k % 7}" for k in range(500)), " ".join(f"w{k}" for k in range(30))]
    docs = odd_docs(spark, [*texts, *texts])
    target = spark.createDataFrame([(1, "w1 w2 w3 w4"), (2, None), (3, texts[6])], "item_id long, text string")
    found = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain(found, ["w1 w2 w3 w4", None, texts[6]])
    try:
        for resample.LONG, resample.CHUNK in ((3, 2), (3, 1), (0, 3), (100, 5), old):
            where = tmp_path / f"{resample.LONG}-{resample.CHUNK}"
            clash = docs.selectExpr("*", "1 as row", "2 as own", "3 as rank", "'x' as score", "5 as bucket")
            assert rows_of(op13_resample(spark, sf_dir_of(spark, where, documents=clash, benchmark=target))) == want
    finally:
        resample.LONG, resample.CHUNK = old


def test_chunks_own_every_start_once():
    for n in range(12):
        found = [f"w{k}".encode() for k in range(n)]
        for size in (1, 2, 3, 5, 20):
            got = list(resample.chunks(b" ".join(found), size=size))
            assert [w for held, own in got for w in held[:own]] == found
            assert all(held == found[k * size : k * size + size + 2] for k, (held, own) in enumerate(got))


def test_ties_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string"
    same = spark.createDataFrame([(k, "w " * 25) for k in range(100)] + [(7, "w " * 25)] * 3, schema)
    none = spark.createDataFrame([], "item_id long, text string")
    got = rows_of(op13_resample(spark, sf_dir_of(spark, tmp_path / "a", documents=same, benchmark=none)))
    assert got == plain([(r.doc_id, r.text) for r in same.collect()], [])
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4, 5]
    assert rows_of(op13_resample(spark, sf_dir_of(spark, tmp_path / "b", documents=same.limit(0), benchmark=none))) == []
