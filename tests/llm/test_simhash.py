import random

import xxhash

from quire.llm.simhash import near_duplicates, op8_simhash

from .helpers import odd_docs, sf_dir_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text, k=4):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=4):
    fps = sorted({fp for _, fp in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, fp in rows:
        if d is not None:
            r = find(fp)
            least[r] = min(d, least.get(r, d))
    return [(d, fp, least.get(find(fp))) for d, fp in rows]


def near_texts():
    rng = random.Random(3)
    out = []
    for _ in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(5):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(900)}"
            out.append(" ".join(copy))
    return out


def test_equals_brute_force(spark, tmp_path):
    docs = odd_docs(spark, near_texts()).repartition(3)
    out = op8_simhash(spark, sf_dir_of(spark, tmp_path, documents=docs))
    want = brute_components([(r.doc_id, brute_fp(r.text)) for r in docs.collect()])
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out.collect()), key=key) == sorted(want, key=key)
    assert out.filter("fingerprint = '0000000000000000'").count() == 4


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute_components([(r.doc_id, brute_fp(r.text)) for r in docs.collect()])
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op8_simhash(spark, sf).collect()) == sorted(want)


def test_many_buckets_and_radii(spark):
    # Fingerprints by way of texts can't be dealt at will, so the link search is tested on its own.
    from quire.llm.components import connected_components
    from quire.llm.simhash import links

    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for _ in range(rng.randrange(1, 6)):
                f ^= 1 << rng.randrange(64)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for radius in (2, 4):
        got = {(r.node % 2**64): r.root % 2**64 for r in connected_components(links(df, radius)).collect()}
        groups = {}
        for _, fp, c in brute_components([(i, f) for i, f in enumerate(sorted(fps))], radius):
            groups.setdefault(c, set()).add(fp)
        mine = {}
        for f in fps:
            mine.setdefault(got.get(f, f), set()).add(f)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_empty_table(spark):
    assert near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_components_by_rounds_equal_those_in_one_task(spark, monkeypatch):
    from quire.llm import components

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 300)] + [(rng.randrange(1000, 1600), rng.randrange(1000, 1600)) for _ in range(250)] + [(-5, 7), (7, 7), (7, -5), (9, -2**62)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {}
    for a, b in edges:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        if want[a] is not want[b]:
            want[a] |= want[b]
            for x in want[b]:
                want[x] = want[a]
    small = {x: min(group) for x, group in want.items() if min(group) != x}
    one = {r.node: r.root for r in components.connected_components(df).collect()}
    monkeypatch.setattr(components, "ONE_TASK", 0)
    rounds = {r.node: r.root for r in components.connected_components(df).collect()}
    assert one == rounds == small
    assert components.connected_components(df.limit(0)).count() == 0
