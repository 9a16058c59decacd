import random
import re

from quire.llm.common import shared_dir
from quire.llm.substring import WindowIndex, dedup_texts, digest_batches, op5_substring_dedup

from .helpers import odd_docs, sf_dir_of, sha


def brute(rows, window=20):
    docs = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t in rows]
    first = {}
    for d, words in docs:
        for i in range(len(words) - window + 1):
            key, at = tuple(words[i : i + window]), (float("inf") if d is None else d, i)
            first[key] = min(at, first.get(key, at))
    out = []
    for d, words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (float("inf") if d is None else d, i):
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d, len(words), len(gone), sha(" ".join(kept))))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def repeating(seed=4):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(400)}"
    shared = [[word() for _ in range(n)] for n in (20, 21, 35, 70, 19)]
    out = []
    for _ in range(40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [word() for _ in range(rng.randrange(0, 40))] + rng.choice(shared)
        out.append(" ".join(words))
    return out + ["loop " * 50, "ab cd " * 30, out[3], out[5] + " tail"]


def test_equals_brute_force(spark, tmp_path):
    docs = odd_docs(spark, repeating()).repartition(3)
    out = op5_substring_dedup(spark, sf_dir_of(spark, tmp_path, documents=docs))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_batches_and_compaction_make_no_difference(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(repeating(9))], "doc_id long, text string")
    want = sorted(brute([tuple(r) for r in docs.collect()]))
    for batches, fanout in ((1, 1), (5, 1), (7, 2)):
        assert sorted(map(tuple, digest_batches(docs, batches, fanout=fanout).collect())) == want


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, op5_substring_dedup(spark, sf).collect())) == sorted(brute([tuple(r) for r in docs.collect()]))


def test_incremental_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    index = WindowIndex(spark, shared_dir(spark, "t"), 16)
    a = spark.createDataFrame([(1, "intro " + passage), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(3, passage + " coda")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_texts(a, index).collect()} == {1: "intro " + passage, 2: ""}
    assert {r.doc_id: r.text for r in dedup_texts(b, index).collect()} == {3: "coda"}


def test_empty_table(spark):
    assert digest_batches(odd_docs(spark).limit(0)).count() == 0
