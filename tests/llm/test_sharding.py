import heapq
import random
import zlib
from collections import defaultdict

from quire.llm.sharding import op9_shard, schedule, shard

from .helpers import odd_docs, sf_dir_of


def brute(sizes, shards):
    """Loads of the schedule, one item after the other."""
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_classes_are_dealt_as_one_by_one():
    rng = random.Random(2)
    assert schedule([(7, 1), (5, 1), (4, 2), (3, 1)], 2) == {7: [1, 0], 5: [0, 1], 4: [1, 1], 3: [0, 1]}
    for _ in range(200):
        classes = [(s, rng.choice((1, 2, 3, 50, 1000))) for s in rng.sample(range(1, 60), rng.randrange(1, 9))]
        shards = rng.randrange(1, 9)
        loads = [sum(s * got[k] for s, got in schedule(classes, shards).items()) for k in range(shards)]
        assert loads == brute([s for s, n in classes for _ in range(n)], shards)


def test_loads_equal_brute_force_in_small_cells(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randrange(40) for _ in range(600)] + ["hot text"] * 400 + [f"{k:04d}" for k in range(500)] + [None] * 30
    rng.shuffle(texts)
    rows = shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8, cell=64).collect()
    laws(rows, list(enumerate(texts)))
    sizes = defaultdict(int)
    for t in texts:
        sizes[t or ""] += len(t or "") + 1
    loads = defaultdict(int)
    for r in rows:
        loads[r.shard] += r["size"]
    assert [loads[s] for s in range(8)] == brute(sizes.values(), 8)


def laws(rows, docs):
    assert len(rows) == len(docs)
    want = sorted((d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in rows) == want
    slots, load = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    text = {d: t or "" for d, t in docs}
    where, sizes = defaultdict(set), defaultdict(int)
    for r in rows:
        where[text[r.doc_id]].add(r.shard)
        sizes[text[r.doc_id]] += r["size"]
    assert all(len(w) == 1 for w in where.values())
    loads = [load[s] for s in range(8)]
    return max(loads) - min(loads), max(sizes.values()), sum(loads)


def test_laws_on_odd_rows(spark, tmp_path):
    docs = odd_docs(spark).repartition(3)
    rows = op9_shard(spark, sf_dir_of(spark, tmp_path, documents=docs)).collect()
    spread, largest, _ = laws(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert spread <= largest
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_laws_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    spread, largest, total = laws(op9_shard(spark, sf).collect(), docs)
    assert spread <= largest


def test_empty_table(spark, tmp_path):
    assert op9_shard(spark, sf_dir_of(spark, tmp_path, documents=odd_docs(spark).limit(0))).count() == 0
