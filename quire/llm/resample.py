"""Importance resampling towards a target distribution, over hashed word n-grams.

Runs of one to three words fall into buckets. How much likelier a bucket is in the target than in the corpus is its gain; the gains of a
document's runs add up to its weight, and a Gumbel draw on top of the weights chooses documents without replacement.

Few very long texts would otherwise hold up their tasks: texts above LONG bytes are cut at word boundaries into chunks
that own the runs starting in them and carry the next n - 1 words, so that no run is lost or counted twice; chunks are dealt
over all tasks, and their counts and weights are summed by document. Shorter texts stay where they were read. What is sent
is a number for each bucket. Ranks come from a sort by ranges and the row counts of its parts, not from one task.

Defined results: a null text has no words. A row without an id is drawn by the hash of ``42:`` alone and stands behind
others on ties. Rows that share an id are scored each by its own text. Without a target, or an empty corpus, counts are zero.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sent_if_small, table, written

BUCKETS, RUN, SEED = 10_000, 3, 42
#: Words that a document needs in order to be drawn, and documents drawn of a hundred.
LEAST, PERCENT = 20, 5
#: Bytes from which a text is cut, and words that start in a chunk.
LONG, CHUNK = 65_536, 8192
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(PATTERN.encode())


def words(text: bytes) -> Iterator[bytes]:
    """Words of a UTF-8 text with A-Z lowered, which is what lowering bytes does; bytes beyond ASCII all belong to words."""
    return (m.group() for m in _WORD.finditer(text.lower()))


def bucket_numbers(found: list[bytes], own: int, n: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of 1 to ``n`` words that start with one of the first ``own``: CRC-32 goes on from each run to the next longer one."""
    after, sums = [b" " + w for w in found], [crc32(w) for w in found[:own]]
    out = [sums]
    for k in range(1, n):
        sums = [crc32(w, s) for w, s in zip(after[k:], sums)]
        out.append(sums)
    return np.concatenate([np.array(s, np.int64) for s in out]) % buckets


def chunks(text: bytes, n: int = RUN, size: int = CHUNK) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them are the chunk's own) of a text, each with the n - 1 words that follow its own."""
    stream = words(text)
    held = list(islice(stream, size + n - 1))
    while held:
        yield held, min(size, len(held))
        held = held[size:]
        if not held:
            return
        held += islice(stream, size)


def cut(long: DataFrame) -> DataFrame:
    """(row, doc_id, own, text): the chunks of texts as rows, dealt over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                for found, own in chunks(text.as_py()):
                    made = [[row.as_py()], [doc_id.as_py()], [own], [b" ".join(found)]]
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)], ["row", "doc_id", "own", "text"])

    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return long.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, own long, text binary").repartition(parts, "row", F.xxhash64("text"))


def pieces(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, own, text) of whole short texts, where ``own`` is null, and of chunks of long ones."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    is_long = F.length("text") > LONG
    return rows.filter(~is_long).select("row", "doc_id", F.lit(None).cast("long").alias("own"), "text"), cut(rows.filter(is_long))


def counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of the pieces (own, text) fall into each bucket; a task gives one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1)):
                found = list(words(text.as_py()))
                total += np.bincount(bucket_numbers(found, len(found) if own.as_py() is None else own.as_py(), buckets=buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("own", "text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the corpus."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of each piece."""
    sent = texts.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            made = []
            for own, text in zip(batch.column(2), batch.column(3)):
                found = list(words(text.as_py()))
                own = len(found) if own.as_py() is None else own.as_py()
                numbers = bucket_numbers(found, own, buckets=len(gain))
                made.append((own, len(numbers), int(gain[numbers].sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[k] for m in made], pa.int64()) for k in range(3))], ["row", "doc_id", "n_words", "n_features", "weight"])

    return texts.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")


def luck(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number that the id decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3... in that order: sorted by ranges, numbered within them, and shifted by the counts of those before."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = written(rows.orderBy(*order).withColumns({"__part": part, "__place": place}), "resample-order")
    before, shifts = 0, []
    for r in stored.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():  # a row for each part
        shifts.append((r["__part"], before))
        before += r.n
    shift = F.broadcast(rows.sparkSession.createDataFrame(shifts, "__part int, __before long"))
    return stored.join(shift, "__part").withColumn("rank", F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text); ``row`` only tells rows apart."""
    short, long = pieces(docs)
    long = written(long, "resample-chunks")
    goal = target.select(F.lit(0).alias("doc_id"), "text")
    gain = gains(counts(short.unionByName(long), buckets), counts(_all(pieces(goal)), buckets))
    whole = weigh(long, gain).groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    # A long text without any word has no chunk.
    bare = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter((F.length("text") > LONG) & ~F.col("text").cast("string").rlike(PATTERN))
    bare = bare.select("row", "doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight")])
    return weigh(short, gain).unionByName(whole).unionByName(bare).withColumn("score", F.col("weight") + luck(F.col("doc_id"), seed))


def _all(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    return parts[0].unionByName(parts[1])


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; the ``percent`` of a hundred of documents of ``least`` words that are drawn have a rank."""
    rows = written(scored(docs, target, buckets, seed), "resample-scores")
    fit = rows.filter(F.col("n_words") >= least)
    drawn = percent * fit.count() // 100
    first = ranked(fit.select("row", "score", "doc_id"), [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row")]).filter(F.col("rank") <= drawn)
    first = written(first.select(F.col("row").alias("of"), "rank"), "resample-ranks")
    return rows.join(sent_if_small(first), F.col("row") == F.col("of"), "left").select("doc_id", "n_features", "weight", "score", "rank")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document, drawn towards ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's UTF-8 bytes, by its table of 256 steps."""
    steps = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        steps.append(x)
    digit = lambda at: f"strpos('0123456789ABCDEF', substring(hex(encode({text})), {at}, 1)) - 1"
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: cast(({digit('i')}) * 16 + {digit('i + 1')} as bigint))"
    return f"xor(list_reduce({octets}, lambda a, x: xor(a >> 8, {steps}[(xor(a, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"


def oracle(buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST, percent: int = PERCENT) -> str:
    """DuckDB SQL for the same rows; the CRC-32 of each distinct run is worked out once."""
    found = lambda source: f"regexp_extract_all(translate(coalesce({source}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')"
    return f"""
with d as (select row_number() over () as r, doc_id, {found("text")} as w from documents),
b as (select {found("text")} as w from benchmark),
df as materialized (select r, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_filter([w[i], w[i] || ' ' || w[i + 1], w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]], lambda x: x is not null)))) as f from d),
bf as materialized (select unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_filter([w[i], w[i] || ' ' || w[i + 1], w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]], lambda x: x is not null)))) as f from b),
k as materialized (select f, {_crc32("f")} % {buckets} as k from (select f from df union select f from bf)),
s as (select k, count(*) as s from df join k using (f) group by k), t as (select k, count(*) as t from bf join k using (f) group by k),
g as (select k, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select count(*) from df) + {buckets}::double) / ((coalesce(s, 0) + 1.0::double) * ((select count(*) from bf) + {buckets}::double)))) as bigint) as gain
  from s full join t using (k)),
x as (select r, count(*) as n, cast(sum(gain) as bigint) as weight from df join k using (f) join g using (k) group by r),
y as (select r, doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substring(sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score from d left join x using (r)),
z as (select r, row_number() over (order by score desc, doc_id nulls last) as place from y where n_words >= {least})
select doc_id, n_features, weight, score, case when place <= {percent} * (select count(*) from z) // 100 then place end as rank from y left join z using (r)
"""
