import math
import random
import zlib
from collections import Counter

import numpy as np

from quire.llm import langid
from quire.llm.langid import op6_language

from .helpers import odd_docs, sf_dir_of


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_language(spark, sf).collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        d = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
        if r.held_out and d.lang and len(d.text.split()) >= 10:
            total += 1
            right += r.lang_pred == d.lang
    assert total > 20 and right / total >= 0.97


def test_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    rows = op6_language(spark, sf_dir_of(spark, tmp_path, documents=docs)).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        blank = not any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred == "und") == blank and 0 <= r.score <= 1
    kept = langid.keep_identified(docs, langid.train(langid.teaching(docs)))
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)  # too few rows for a floor


def test_nothing_to_learn_from(spark, tmp_path):
    docs = odd_docs(spark).withColumn("lang", langid.F.lit(None).cast("string"))
    rows = op6_language(spark, sf_dir_of(spark, tmp_path, documents=docs)).collect()
    assert {r.lang_pred for r in rows} == {"und"} and {r.score for r in rows} == {0.0}
    assert op6_language(spark, sf_dir_of(spark, tmp_path / "e", documents=docs.limit(0))).count() == 0


def test_families_then_pairs(spark):
    words = {"en": "the and thing house water", "de": "der und ding haus wasser", "es": "el y cosa casa agua", "fr": "le et chose maison eau", "xx": "qqo zzu wwi"}
    rng = np.random.default_rng(0)
    docs = [(" ".join(rng.choice(w.split(), 30)), lang) for lang, w in words.items() for _ in range(40)]
    model = langid.train(spark.createDataFrame(docs, "text string, lang string"))
    assert model.families == ["germanic", "romance", "xx"] and {f: len(w) for f, w in model.inner.items()} == {"germanic": 1, "romance": 1, "xx": 0}
    assert all(model.predict(w * 3)[0] == lang for lang, w in words.items())


def test_long_texts_are_read_whole():
    tail = langid.features("ab " * 400_000 + "xyz " * 400_000)  # the last words weigh as much as the first
    assert abs(tail @ langid.features("xyz " * 1000) - langid.features("xyz " * 1000 + "ab " * 1000) @ langid.features("xyz " * 1000)) < 0.02
    old, langid.SLICE = langid.SLICE, 64
    try:
        assert np.allclose(langid.features("some words, über alles! " * 40), whole := langid.features("some words, über alles! " * 40))
    finally:
        langid.SLICE = old
    assert np.allclose(whole, langid.features("some words, über alles! " * 40))


def plain_features(text):
    """Hash slot -> weight, one n-gram at a time."""
    words, out = "".join(c if c.isalpha() else " " for c in text.lower()).split(), Counter()
    line = " " + "".join(w + " " for w in words)
    for at in range(len(line)):
        h = 0
        for n, c in enumerate(line[at : at + 3]):
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) * (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)[n] & 0xFFFFFFFF)
            out[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    size = math.sqrt(sum(out.values()))
    return {k: math.sqrt(v) / size for k, v in out.items()}


def test_predictions_equal_a_plain_reimplementation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(langid.teaching(docs))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id].lang_pred == "und"
            continue
        x = plain_features(r.text)
        dot = lambda w: float(w[-1]) + sum(float(w[k]) * v for k, v in x.items())  # noqa: E731, B023
        margins = [dot(w) for w in model.outer]
        family = model.families[margins.index(max(margins))]
        langs, votes = model.members[family], Counter()
        pairs = [(a, b) for i, a in enumerate(langs) for b in langs[i + 1 :]]
        for (a, b), w in zip(pairs, model.inner[family]):
            votes[a if dot(w) >= 0 else b] += 1
        assert got[r.doc_id].lang_pred == max(langs, key=lambda lang: votes[lang])


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(5)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    junk = [made(letters, n) for letters in ("bcdfgxzqwk   ", "абвгдежзиклмнопрстуфхцчшыьэюя     ") for n in (400, 1500, 4000) for _ in range(3)]
    more = spark.createDataFrame([(10**9 + k, t, None, None, len(t)) for k, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in langid.keep_identified(docs.unionByName(more), langid.train(langid.teaching(docs))).collect()}
    assert not any(k >= 10**9 for k in kept)
    letters = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert kept <= letters and len(kept) >= 0.998 * len(letters)


def test_every_label_is_learned(spark):
    docs = [(f"{made} " * 20 + str(k), f"l{k:03d}") for k in range(90) for made in (f"{chr(0x4E00 + 7 * k)}{chr(0x4E01 + 7 * k)}", f"{chr(0x4E02 + 7 * k)}")]
    docs += [("the and of to", "en")] * 300  # copies teach once
    model = langid.train(spark.createDataFrame(docs, "text string, lang string"), sample=200)
    assert len(model.families) == 91
    assert sum(model.predict(t)[0] == lang for t, lang in docs[:180]) >= 170
