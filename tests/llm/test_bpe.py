import hashlib

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from quire.llm import bpe
from quire.llm.bpe import op4_bpe

from .helpers import odd_docs, sf_dir_of, sha

LIB = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
TEXTS = [
    "Hello, world's  end.\n\n  It'll do\t42 times", "\x1c\x1d a\x1e\x1fb\x85c\xa0d e f g　h ​ i", "\U0001f600\U0001f9d1‍\U0001f680 १२३ ½ 五 한국어 العربية",
    "   ", " \n x", "àé ǅ ß", "<|endoftext|>", "ab" * 4000, "é" * 3000, " " * 5000 + "x", "0" * 300 + "١٢", "thndanat anor that eringsh", "᠎﻿⁠ x",
]


def same(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        ids = LIB.encode_ordinary(t)
        assert r.n_tokens == len(ids), t[:80]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t[:80]
        assert r.decoded_sha256 == sha(t)


def test_equals_the_library(spark, tmp_path):
    docs = odd_docs(spark, TEXTS).filter("doc_id is not null").dropDuplicates(["doc_id"])
    same(op4_bpe(spark, sf_dir_of(spark, tmp_path, documents=docs)).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    same(op4_bpe(spark, sf).collect(), texts)


def test_pieces_beyond_the_table_are_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    same(bpe.digests(docs, limit=50).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_fold_equals_merge(spark):
    ranks = bpe.load_ranks()
    words = ["a", "é", "hello", " thndanat", "Ünverständlichkeit", "zzzzzzzzzzzz", "abcabcabcabc", "\U0001f600x", "1234567890", "'ll", "qqqqqqqqq qq"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold_merges(F.encode("w", "UTF-8"), ranks).alias("ids"))
    for r in df.collect():
        assert r.ids == bpe.merge(r.w.encode(), ranks) == LIB._core_bpe.encode_single_piece(r.w.encode())


def test_long_pieces_equal_the_simple_rule():
    ranks = bpe.load_ranks()
    for piece in (b"ab" * 200, "é".encode() * 101, b"abcde" * 60, b"z" * 501, b"the" * 90 + b"q"):
        assert bpe._merge_long(piece, ranks) == LIB._core_bpe.encode_single_piece(piece)


def test_round_trip_of_tokens(spark):
    docs = odd_docs(spark, TEXTS[:8]).filter("doc_id is not null and length(text) < 4000").dropDuplicates(["doc_id"])
    back = bpe.decoded(bpe.Encoder(docs).encode(docs))
    want = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in back.collect()} == want


def test_empty_table(spark):
    assert bpe.digests(odd_docs(spark).limit(0)).count() == 0
