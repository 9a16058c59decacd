"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Vectors lie in the list of their nearest coarse centroid; the residual is coded by product quantisation. A query
looks into the ``probes`` lists with the best centroids. There each code is scored from the query's asymmetric
distance table; all that the quantisation's error leaves among the best are reranked exactly, on the original vectors. Lists and their queries are cut into
blocks of bounded size, so neither a common vector nor a growing table fills one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

#: Rows that the index is fitted on at most; vectors in a list at about, lists at most.
SAMPLE, PER_LIST, LISTS = 16_384, 1024, 4096
#: Parts of a vector that are quantised one by one, and codes of a part.
PARTS, CODES = 16, 256
#: Vectors and queries of a block at most, at about.
BLOCK, QUERIES = 8192, 8192
#: Recall on the sample from which no further list is probed, and sampled queries that it is measured on.
AIM, TRIALS = 0.96, 200


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part. Not those without an id, null, empty, of zeros, with a null or non-finite component,
    or of another dimension than most; rows that repeat an id count once, with the smallest of its vectors."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("v")).filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    good = good.filter(F.size("v") == (sizes[0].d if sizes else 0))
    return good.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one moves to the farthest row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, c, with_distance=True)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[np.argsort(-far)[: (n == 0).sum()]]
    return c


def nearest(x: np.ndarray, c: np.ndarray, with_distance: bool = False):
    """The nearest centroid of each row, by Euclidean distance; the smaller number on ties."""
    out, far = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 4096):
        d = (c * c).sum(1) - 2 * (x[at : at + 4096] @ c.T)
        out[at : at + 4096] = d.argmin(1)
        far[at : at + 4096] = d.min(1) + (x[at : at + 4096] ** 2).sum(1)
    return (out, far) if with_distance else out


class Index:
    """Coarse centroids, codebooks, and how many lists to probe; fitted on a bounded sample."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, n: int):
        dim = sample.shape[1]
        self.dim, self.parts, self.ids, self.sample = dim, min(PARTS, dim), ids, sample
        self.coarse = kmeans(sample, max(1, min(LISTS, max(n // PER_LIST, math.isqrt(n) // 4), len(sample) // 8)))
        self.cuts = np.linspace(0, dim, self.parts + 1).astype(int)
        self.lists = nearest(sample, self.coarse)
        residual = sample - self.coarse[self.lists]
        self.books = [kmeans(residual[:, a:b], CODES, 8) for a, b in zip(self.cuts, self.cuts[1:])]
        self.probes = self._probes(sample)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each row."""
        lists = nearest(x, self.coarse)
        residual = x - self.coarse[lists]
        return lists, np.stack([nearest(residual[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): inner products of each query's parts with the codebooks."""
        out = np.zeros((len(q), self.parts, CODES), np.float32)
        for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out[:, k, : len(book)] = q[:, a:b] @ book.T
        return out

    def decode(self, number: int, codes: np.ndarray) -> np.ndarray:
        """What the codes of a list stand for."""
        return self.coarse[number] + np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)

    def scores(self, q: np.ndarray, number: int, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """(queries, rows): asymmetric scores of one list's codes."""
        out = np.repeat((q @ self.coarse[number]).astype(np.float32)[:, None], len(codes), 1)
        for k in range(self.parts):
            out += tables[:, k][:, codes[:, k]]
        return out

    def bounds(self, ids: np.ndarray, q: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
        """For each query, the k-th best exact score among the sampled rows of its probed lists, itself left out; -inf if they are fewer.

        Those rows stand in the lists, so k rows of the lists reach it; it only spares passing on others.
        """
        out = np.full(len(q), -np.inf)
        if len(self.sample) < k:
            return out
        for at in range(0, len(q), 256):
            rough = q[at : at + 256] @ self.sample.T
            rough[~probed[at : at + 256][:, self.lists]] = -np.inf
            rough[ids[at : at + 256, None] == self.ids[None, :]] = -np.inf
            edge = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
            out[at : at + 256] = edge - 1e-9 * np.maximum(1.0, np.abs(edge), where=np.isfinite(edge), out=np.ones(len(edge)))
        return out

    def _probes(self, sample: np.ndarray, k: int = 20) -> int:
        """The fewest lists that reach AIM on the sample, with a tenth more for what the sample doesn't show."""
        lists, pick = nearest(sample, self.coarse), np.random.default_rng(1).choice(len(sample), min(TRIALS, len(sample)), replace=False)
        exact = sample[pick] @ sample.T
        exact[np.arange(len(pick)), pick] = -np.inf
        top = np.argsort(-exact, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(sample[pick] @ self.coarse.T), axis=1), axis=1)  # of each list, for each query
        need = np.take_along_axis(place, lists[top], axis=1)
        for probes in range(1, len(self.coarse) + 1):
            if (need < probes).mean() >= AIM:
                break
        return min(len(self.coarse), math.ceil(probes * 1.1))


_CODED = "list int, vec_id long, v array<double>, codes binary"


def fit(vectors: DataFrame, n: int) -> Index | None:
    """An index fitted on about SAMPLE rows of (vec_id, v), chosen by hash of the id; None if there are none."""
    luck = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    rows = vectors.filter(luck).limit(2 * SAMPLE).toArrow()
    if not rows.num_rows:
        rows = vectors.limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by("vec_id")  # the order of arrival doesn't matter
    return Index(rows.column("vec_id").to_numpy(), _matrix(rows.column("v")), n)


def build(vectors: DataFrame, index: Index) -> DataFrame:
    """(list, vec_id, v, codes): every vector in its list, coded."""
    sent = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, codes = sent.value.encode(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "vec_id", "v", "codes"])

    return vectors.select("vec_id", "v").mapInArrow(run, _CODED)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries`` (vec_id, v) among ``vectors``, itself left out.

    Both as from ``usable``. score is the inner product in double precision; ties go to the smaller vec_id.
    """
    spark, n = vectors.sparkSession, vectors.count()
    index = fit(vectors, n)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    coded = written(build(vectors, index), "ann-lists")
    sizes = {r.list: r.n for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
    many = np.array([sizes.get(i, 0) for i in range(len(index.coarse))])
    sent = spark.sparkContext.broadcast((index, many))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, many = sent.value
        for batch in batches:
            q = _matrix(batch.column(1))
            order = np.argsort(-(q @ index.coarse.T), axis=1, kind="stable") if len(q) else np.empty((0, 1), int)
            enough = (np.cumsum(many[order], axis=1) <= k).sum(1) + 1  # lists that hold k others
            count = np.minimum(np.maximum(index.probes, enough), len(index.coarse))
            rows = np.repeat(np.arange(len(q)), count)
            lists = np.concatenate([o[:c] for o, c in zip(order, count)]) if len(q) else np.empty(0, int)
            probed = np.zeros((len(q), len(index.coarse)), bool)
            probed[rows, lists] = True
            least = index.bounds(batch.column(0).to_numpy(), q, probed, k)[rows]
            whole = pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(least)], ["list", "query_id", "q", "least"])
            yield from (whole.slice(at, 8192) for at in range(0, max(whole.num_rows, 1), 8192))

    routed = written(queries.select("vec_id", "v").mapInArrow(route, "list int, query_id long, q array<double>, least double"), "ann-queries")
    asked = {r.list: r.n for r in routed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = [(i, max(1, -(-sizes.get(i, 0) // BLOCK)), max(1, -(-asked.get(i, 0) // QUERIES))) for i in range(len(index.coarse))]
    of_list = lambda: F.broadcast(spark.createDataFrame(parts, "list int, v_parts int, q_parts int"))  # noqa: E731  a row for each list
    # Every block of a list meets every block of its queries.
    stored = coded.join(of_list(), "list").withColumn("vp", F.pmod(F.xxhash64("vec_id"), F.col("v_parts")).cast("int")).withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    asking = routed.join(of_list(), "list").withColumn("qp", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int")).withColumn("vp", F.explode(F.sequence(F.lit(0), F.col("v_parts") - 1)))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        index, number = sent.value[0], key[0].as_py()
        left = left.sort_by("vec_id")
        ids, v, qids, q, least = left.column("vec_id").to_numpy(), _matrix(left.column("v")), right.column("query_id").to_numpy(), _matrix(right.column("q")), right.column("least").to_numpy()
        if not len(ids) or not len(qids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        off = np.linalg.norm(v - index.decode(number, codes), axis=1)  # of each row from what its code stands for
        largest, take = np.linalg.norm(v, axis=1).max(), min(k + 1, len(ids))
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(qids), 128):
            some, own = q[at : at + 128], qids[at : at + 128]
            rough, length = index.scores(some, number, codes, index.tables(some)), np.linalg.norm(some, axis=1)
            # A score is wrong by no more than this, rounding included, so rows that can't reach the k-th are known.
            error = length[:, None] * (off + 1e-5 * (largest + off))
            low = -np.partition(error - rough, take - 1, axis=1)[:, take - 1]
            may = rough + error >= np.maximum(low, least[at : at + 128])[:, None]
            some_rows = np.flatnonzero(may.any(axis=0))
            exactly = np.where(may[:, some_rows], some @ v[some_rows].T, -np.inf)
            for r in range(len(some)):
                rows, near = some_rows, exactly[r]
                if len(rows) > take:
                    edge = -np.partition(-near, take - 1)[take - 1]
                    rows, near = rows[near >= edge - 1e-9 * length[r] * largest], near[near >= edge - 1e-9 * length[r] * largest]  # with all that tie
                rows = rows[np.isfinite(near)]
                rows = rows[ids[rows] != own[r]]
                exact = (v[rows] * some[r]).sum(1)
                rows, exact = rows[exact >= least[at + r]], exact[exact >= least[at + r]]  # others can't be among the k nearest
                best = np.lexsort((ids[rows], -exact))[:k]
                out_q.append(np.full(len(best), own[r]))
                out_v.append(ids[rows[best]])
                out_s.append(exact[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    near = (
        stored.groupBy("list", "vp", "qp").cogroup(asking.groupBy("list", "vp", "qp"))
        .applyInArrow(meet, "query_id long, vec_id long, score double")
    )
    # At most k rows from each block, and none below what k sampled rows of the probed lists have.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all others."""
    vectors = written(usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "ann-vectors")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
