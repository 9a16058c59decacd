"""Near duplicates of the pipeline at the threshold itself, without a tolerance."""

import random

from quire.llm import simhash


def shingles(text, k=5):
    words = text.split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(a, b):
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def brute(docs, similarity=0.8):
    """Smallest ids of the components over all pairs."""
    root, docs = {i: i for i, _ in docs}, [(i, shingles(s)) for i, s in docs]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(docs):
        for j, t in docs[:k]:
            if jaccard(s, t) >= similarity:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if root[i] == i}


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"n{rng.randrange(10**9)}"
    return out


def kept(spark, docs):
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_every_pair_at_the_threshold_is_found(spark):
    rng, texts = random.Random(3), []
    for n in (8, 20, 60, 300):
        for _ in range(30):
            words = [f"w{rng.randrange(3000)}" for _ in range(n)]
            texts += [" ".join(words), *(" ".join(edited(rng, words, e)) for e in (max(1, n // 50), n // 40 + 1))]
        line = [f"w{rng.randrange(3000)}" for _ in range(n // 2 + 5)]
        texts += [" ".join([*line, *(f"own{k}x{i}" for i in range(n // 8))]) for k in range(12)]  # many that share most
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    sets = [shingles(t) for t in texts]
    assert sum(0.8 <= jaccard(a, b) < 0.86 for k, a in enumerate(sets) for b in sets[:k]) > 30
    assert kept(spark, docs) == brute(docs)


def test_texts_below_the_threshold_stay(spark):
    rng, docs = random.Random(4), []
    line = " ".join(f"line{i}" for i in range(24))
    for k in range(6):  # a line of 20 shingles, repeated 30 times, in texts of their own
        docs.append((len(docs), " ".join([line] * 30 + [f"own{k}x{i}" for i in range(300)])))
    for n in (60, 300):
        for _ in range(15):  # a tail of its own: Jaccard about 0.75
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            docs += [(len(docs) + e, " ".join(words[: n - e * n // 7] + [f"t{rng.randrange(10**9)}" for _ in range(e * n // 7)])) for e in (0, 1)]
    assert kept(spark, docs) == brute(docs) == {i for i, _ in docs}


def test_a_group_of_near_copies_is_not_listed_pair_by_pair(spark, monkeypatch):
    rng, base = random.Random(28), [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(edited(rng, base, 4 + (k % 3 > 0)))) for k in range(90)]  # half of the pairs are below the threshold
    listed, near = [], simhash._near_pairs

    def counted(*args):
        pairs = near(*args)
        listed.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash, "_near_pairs", counted)
    want = brute(docs)
    assert kept(spark, docs) == want == {0}
    sets = [shingles(t) for _, t in docs]
    assert sum(jaccard(a, b) >= 0.8 for k, a in enumerate(sets) for b in sets[:k]) > 1500
    assert sum(listed) < 2 * len(docs)
