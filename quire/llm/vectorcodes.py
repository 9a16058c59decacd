"""Vector code compression: a codebook for each part of a vector, all in whole numbers.

Vectors are packed once into columnar blocks (a row of a block's array is one component of all its vectors), each of a
bounded number of vectors, which are written. A round is one ``treeAggregate`` over the blocks: a task measures squared
distances by adding one component after the other, and adds its parts to int64 tensors of sums and counts with
``np.add.at``; the tensors, whose size is that of the codebooks, merge through a reduction tree. Whole numbers make the
result the same in whatever order they merge.

Defined results: rows whose vector is null or empty or holds null or non-finite components are left out. So are rows of another
dimension than most (of the smaller one on a tie). Components beyond +-2**15 count as that, so that squared distances fit a long. A dimension that
``parts`` doesn't divide is filled up with zeros. Rows without an id are coded like others and stand last among the seeds;
rows that share an id stand in the order of their vectors. Fewer rows than ``entries`` give codebooks of as many entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sent_if_small, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block at most, and the largest whole number of a component.
BLOCK, LARGEST = 4096, 1 << 27


def whole(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows that are kept, with components as whole numbers and a dimension that ``parts`` divides."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    number = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("int")
    good = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad))
    sizes = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = sizes[0].d if sizes else parts
    v = F.transform("embedding", number)
    if d % parts:
        v = F.concat(v, F.array_repeat(F.lit(0), parts - d % parts))
    return good.filter(F.size("embedding") == d).select("vec_id", "label", v.alias("v"))


def blocks(rows: DataFrame) -> DataFrame:
    """(n, ids, labels, x): vectors of up to BLOCK rows, as int32 components one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(part.num_rows, -1)
                made = [[part.num_rows], [part.column(0).to_pylist()], [part.column(1).to_pylist()], [np.ascontiguousarray(x.T).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()))], ["n", "ids", "labels", "x"])

    return rows.mapInArrow(run, "n int, ids array<long>, labels array<string>, x binary")


def columns_of(n: int, x: bytes) -> np.ndarray:
    """(components, rows) of a block."""
    return np.frombuffer(x, "<i4").reshape(-1, n)


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, the lower index on ties, and its squared distance, of each column of ``x`` (components, rows); ``book`` is (entries, components)."""
    far = np.zeros((x.shape[1], len(book)), np.int64)
    for values, entry in zip(x.astype(np.int64), book.T):
        far += (values[:, None] - entry[None, :]) ** 2
    near = far.argmin(1)
    return near, far[np.arange(len(near)), near]


def add_block(total: tuple[np.ndarray, np.ndarray], block: tuple[int, bytes], books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums (parts, entries, components) and counts (parts, entries) with a block's parts added."""
    sums, counts = total
    x, (parts, _, width) = columns_of(*block), books.shape
    for p in range(parts):
        own = x[p * width : (p + 1) * width]
        near, _ = assign(own, books[p])
        np.add.at(sums[p], near, own.T)
        np.add.at(counts[p], near, 1)
    return sums, counts


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a[0][...] += b[0]
    a[1][...] += b[1]
    return a


def train(packed: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components) after ``rounds`` rounds over all blocks; entries that no part is nearest to stay."""
    context = packed.sparkSession.sparkContext
    stored = packed.select("n", "x").rdd.map(lambda r: (r.n, bytes(r.x)))
    for _ in range(rounds):
        sent = context.broadcast(books)
        zero = (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
        sums, counts = stored.treeAggregate(zero, lambda total, block, sent=sent: add_block(total, block, sent.value), merge, depth=2)
        books = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        sent.unpersist()
    return books


def seeds(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """First codebooks: the parts of the rows with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # ``entries`` rows
    if not first:
        return np.empty((parts, 0, 0), np.int64)
    v = np.array([r.v for r in first], np.int64)
    return np.ascontiguousarray(v.reshape(len(first), parts, -1).transpose(1, 0, 2))


def encode(packed: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the blocks."""
    sent = packed.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = sent.value.shape
        for batch in batches:
            for n, ids, labels, x in zip(*(batch.column(k) for k in range(4))):
                x = columns_of(n.as_py(), x.as_py())
                found = [assign(x[p * width : (p + 1) * width], sent.value[p]) for p in range(parts)]
                codes = np.stack([near for near, _ in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(far for _, far in found), pa.int64())], ["vec_id", "label", "code", "error"])

    return packed.mapInArrow(run, "vec_id long, label string, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, v): the whole-number vectors that codes of ``encode`` stand for."""
    whole_books = [F.array(*[F.array(*[F.lit(int(c)) for c in entry]) for entry in book]) for book in books]
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1
    return codes.select("vec_id", F.concat(*[F.element_at(book, index(p)) for p, book in enumerate(whole_books)]).alias("v"))


def digest(books: np.ndarray) -> str:
    """SHA-256, in lowercase hex, of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every row that is kept, and the codebooks. ``entries`` are 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = whole(vectors, parts, scale)
    packed = written(blocks(rows), "vector-blocks")
    first = seeds(rows, parts, entries)
    books = train(packed, first, rounds) if first.size else first
    return (encode(packed, books), books) if books.size else (rows.limit(0).selectExpr("vec_id", "label", "'' as code", "0L as error"), books)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector of ``embeddings`` that is kept.

    Errors are added up by label before they are shuffled, and the few sums are joined back, null labels together.
    """
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = written(codes, "vector-codes")
    sums = written(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "vector-label-errors")
    out = codes.join(sent_if_small(sums), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL for the same rows: the rounds, written out one after the other over single components."""
    ctes = [
        f"e as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"x as materialized (select vec_id, cast((j - 1) // (len(v) // {parts}) as int) as p, j, v[j] as x from e, lateral (select unnest(range(1, len(v) + 1)) as j))",
        f"c0 as materialized (select k, p, j, x as c from x join (select vec_id, row_number() over (order by vec_id) - 1 as k from e order by vec_id limit {entries}) using (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} as materialized (select vec_id, p, min(d) as d, arg_min(k, d * {entries} + k) as k from (select vec_id, x.p, k, sum((x - c) * (x - c)) as d from x join c{r} as c using (j) group by vec_id, x.p, k) group by vec_id, p)")
        if r < rounds:
            ctes.append(f"c{r + 1} as materialized (select c.k, c.p, c.j, coalesce((s - ((s % n) + n) % n) // n, c.c) as c from c{r} as c left join (select p, k, j, sum(x) as s, count(*) as n from x join a{r} as a using (vec_id, p) group by p, k, j) as m using (p, k, j))")
    return f"""with {", ".join(ctes)},
    g as (select vec_id, string_agg(printf('%02x', k), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by vec_id)
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
      (select sha256(string_agg(cast(c as varchar), ',' order by p, k, j)) from c{rounds}) as codebooks_sha256
    from g join e using (vec_id)"""
