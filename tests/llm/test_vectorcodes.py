import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import vectorcodes
from quire.llm.vectorcodes import op12_vector_codes

from .helpers import sf_dir_of
from ..compare import connect, differ

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """The contract one component at a time, with Python's own numbers; rows are (vec_id, embedding, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    books = [[v[p * width : (p + 1) * width] for _, v, _ in kept[:16]] for p in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(book))

    for _ in range(6):
        for p, book in enumerate(books):
            parts = [v[p * width : (p + 1) * width] for _, v, _ in kept]
            near = [nearest(part, book)[1] for part in parts]
            for k in range(len(book)):
                own = [part for part, n in zip(parts, near) if n == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [nearest(v[p * width : (p + 1) * width], book) for p, book in enumerate(books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return sorted([(i, code, error, sums[label], sha) for i, code, error, label in out], key=str)


def run(spark, tmp_path, rows, schema=SCHEMA):
    df = op12_vector_codes(spark, sf_dir_of(spark, tmp_path, embeddings=spark.createDataFrame(rows, schema)))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_equals_its_sql(spark, sf):
    assert differ(op12_vector_codes(spark, sf), connect(sf), vectorcodes.oracle()) is None


def test_equals_plain_python_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, [rng.choice([-1.5, 0.25, rng.gauss(0, 1)]) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(60)]
    rows += [(100, None, 1), (101, [None] * 16, 1), (102, [math.nan] + [0.0] * 15, 2), (103, [math.inf] * 16, None), (104, [-0.00001] * 16, 7)]
    rows += [rows[3], rows[3], (None, [0.5] * 16, None)]  # repeated rows, no id
    assert run(spark, tmp_path, rows) == plain(rows)


def test_few_rows_none_and_equal_ones(spark, tmp_path):
    few = [(k, [float(k)] * 8, None) for k in range(3)]
    assert run(spark, tmp_path / "few", few) == plain(few)
    same = [(k, [0.1] * 8, 1) for k in range(40)]  # all entries equal: every part goes to entry 0
    got = run(spark, tmp_path / "same", same)
    assert got == plain(same) and {r[1] for r in got} == {"00" * 8}
    assert run(spark, tmp_path / "none", [(1, None, 1)]) == [] and run(spark, tmp_path / "empty", []) == []


def test_dimensions_blocks_and_clashing_columns(spark, tmp_path):
    rows = [(k, [float(k % 5), 1.0, -2.0], 1) for k in range(30)] + [(99, [1.0], 1), (98, [], 1)]
    got = run(spark, tmp_path / "odd", rows)  # three components are filled up to eight; rows of other dimensions go
    assert [r[0] for r in sorted(got)] == list(range(30)) and {r[2] for r in got} == {0}
    huge = run(spark, tmp_path / "huge", [(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1)])
    assert [r[2] for r in huge] == [0, 0]
    old, vectorcodes.BLOCK = vectorcodes.BLOCK, 7
    try:
        many = [(k, [math.sin(k * j) for j in range(8)], k % 3) for k in range(100)]
        wide = [(*r, "x", 1, "y") for r in many]
        assert run(spark, tmp_path / "blocks", wide, SCHEMA + ", code string, error int, of string") == plain(many)
    finally:
        vectorcodes.BLOCK = old


def test_decoding_gives_vectors_at_the_error(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    codes, books = vectorcodes.compress(vectors)
    back = {r.vec_id: r.v for r in vectorcodes.decode(codes, books).collect()}
    v = {r.vec_id: r.v for r in vectorcodes.whole(vectors).collect()}
    for r in codes.limit(200).collect():
        assert sum((a - b) ** 2 for a, b in zip(v[r.vec_id], back[r.vec_id])) == r.error
    # More rounds never make the sum of errors on real numbers larger; on whole numbers it stays far below the seeds'.
    first = vectorcodes.encode(vectorcodes.blocks(vectorcodes.whole(vectors)), vectorcodes.seeds(vectorcodes.whole(vectors)))
    assert codes.agg(F.sum("error")).first()[0] < first.agg(F.sum("error")).first()[0]


def test_bounds():
    with pytest.raises(ValueError):
        vectorcodes.compress(None, entries=257)
    near, far = vectorcodes.assign(np.array([[0, 5], [0, 5]], np.int32), np.array([[5, 5], [0, 0], [0, 0]]))
    assert near.tolist() == [1, 0] and far.tolist() == [0, 0]  # the lower index on ties
