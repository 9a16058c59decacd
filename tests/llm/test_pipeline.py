import random

import corpus_pipeline
from quire.llm import langid

from .helpers import odd_docs, sf_dir_of, sha
from .test_bpe import LIB
from .test_spans import brute_secrets

BY_NAME = dict(corpus_pipeline.STAGES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def shingles(text, k=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def check_groups(docs, kept):
    """Texts that share 0.8 of their shingles are linked, links chain, and the first of each group is what stays: no more and no less."""
    sets, first = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def root(d):
        while first[d] != d:
            first[d] = d = first[first[d]]
        return d

    ids = sorted(sets)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and root(a) != root(b):
                first[max(root(a), root(b))] = min(root(a), root(b))
    assert kept == {d for d in ids if root(d) == d}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    docs, originals = [], set()
    for g in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 400))]
        originals.add(len(docs))
        for n in range(4):
            copy = list(words)
            for _ in range(n * len(words) // 250):  # each edit changes up to five shingles
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(5000)}"
            docs.append((len(docs), " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in BY_NAME["near_duplicates"](spark, df, "").collect()}
    assert originals <= kept
    check_groups(docs, kept)


def redacted(text):
    out, at = "", 0
    for kind, start, end in brute_secrets(text):
        if start >= at:
            out += text[at:start] + f"[SECRET:{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stay = BY_NAME["language"](spark, docs, sf)
    assert stay.schema == docs.schema
    model = langid.train(langid.teaching(docs))  # test_langid compares its decisions with a plain version
    assert rows(stay) == [r for r in rows(docs) if model.known(r[1])] and stay.count() >= 0.99 * docs.count()

    deduped = BY_NAME["near_duplicates"](spark, stay, sf)
    assert deduped.schema == docs.schema and set(rows(deduped)) <= set(rows(stay))
    check_groups([(r[0], r[1]) for r in rows(stay)], {r[0] for r in rows(deduped)})

    clean = BY_NAME["decontamination"](spark, deduped, sf)
    flat = lambda s: " ".join(s.lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [r for r in rows(deduped) if not any(i in flat(r[1]) for i in items)]
    assert clean.schema == docs.schema and set(rows(clean)) <= set(left) and len(left) - clean.count() <= len(left) * 0.02

    safe = BY_NAME["secrets"](spark, clean, sf)
    assert safe.columns == docs.columns
    assert rows(safe) == [(r[0], redacted(r[1]), *r[2:4], len(redacted(r[1]))) for r in rows(clean)]

    out = BY_NAME["tokens"](spark, safe, sf).collect()
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert len(out) == len(texts)
    for r in out:
        assert r.n_tokens == len(LIB.encode_ordinary(texts[r.doc_id])) and r.decoded_sha256 == sha(texts[r.doc_id])


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = odd_docs(spark, ["password=abcdefgh12 here", "another fine document with words"])
    bench = spark.createDataFrame([(1, "an item that no document here holds at all")], "item_id long, text string")
    sf = sf_dir_of(spark, tmp_path, documents=docs, benchmark=bench)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() <= docs.count()
        if name != "tokens":
            assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, sf).count() > 0
    kept = BY_NAME["near_duplicates"](spark, docs, sf)
    assert kept.filter("text = 'same text here'").collect()[0].doc_id == 5 and kept.filter("text = 'same text here'").count() == 1
    assert kept.filter("doc_id is null").count() == 1
    empty = sf_dir_of(spark, tmp_path / "e", documents=docs.limit(0), benchmark=bench.limit(0))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_extra_columns_with_clashing_names_pass_through(spark, tmp_path):
    from pyspark.sql import functions as F

    from quire.llm import decontam, langid, pii, secrets, simhash

    names = ["_text", "_id", "_base", "_terms", "blob", "fp", "root", "node", "w0", "t", "bits", "kind", "start", "term", "score", "lang_pred"]
    docs = spark.createDataFrame([(1, "a fine text password=abcdefgh1", "en", "s", 30), (2, "mail a@b.org for the other text", "en", "s", 31), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"v-{n}").alias(n) for n in names])
    bench = spark.createDataFrame([(1, "an item that no document here holds at all", "x")], "item_id long, text string, doc_id string")
    for out in (secrets.redact(docs), pii.sanitise(docs), simhash.keep_one(docs), decontam.decontaminate(docs, bench), langid.keep_identified(docs, langid.train(langid.teaching(docs)))):
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == f"v-{n}" for n in names)
    path = sf_dir_of(spark, tmp_path, documents=docs, benchmark=bench)
    from quire.llm.queries import QUERIES

    pages = spark.createDataFrame([(1, "u", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(20 * k, [1.0, float(k)], k) for k in range(5)], "vec_id long, embedding array<float>, label int")
    more = [F.lit(f"v-{n}").alias(n) for n in (*names, "sha1", "first_id", "n", "own", "record_type", "data", "v", "d", "list", "codes", "query_id", "rank", "block")]
    wide = sf_dir_of(spark, tmp_path / "wide", pages=pages.select("*", *more), embeddings=vectors.select("*", *more))
    assert {(r.page_id, r.payload_bytes) for r in QUERIES["op3_warc"](spark, wide).collect()} == {(1, 8), (2, 0)}
    assert sorted((r.query_id, r.rank, r.vec_id) for r in QUERIES["op10_ann"](spark, wide).collect()) == sorted((q, n + 1, v) for q in range(0, 100, 20) for n, v in enumerate(sorted((v for v in range(0, 100, 20) if v != q), key=lambda v: (-(1 + q * v / 400), v))))
    for name in ("op1_pii", "op2_decontaminate", "op4_bpe", "op5_substring_dedup", "op6_language", "op7_secret_scan", "op8_simhash", "op9_shard"):
        assert QUERIES[name](spark, path).count() == (0 if name == "op2_decontaminate" else 3)
