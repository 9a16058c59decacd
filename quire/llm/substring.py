"""Substring deduplication over a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words. The index holds the windows of all earlier batches as sorted,
immutable runs, cut into buckets by the top bits of the fingerprint. A new batch's windows are dealt to
the buckets as packed, sorted blocks, and each bucket merge-joins them with its runs: a window is a
repeat if history holds it, or if the batch holds it at a smaller (doc_id, start). Of windows that are equal within a
block only the first goes to its bucket, the others are repeats whatever it finds; so no window is sent more often than
there are blocks. A match needs 64 bits of one polynomial fingerprint and is verified by 32 bits of another, over
hashes of the words with another seed. The bucket's new windows become the next run; when ``FANOUT`` runs have
gathered, they are compacted into it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, discard, drop_dead_shuffles, keep_until_exit, remove, shared_dir, table, written

WINDOW = 20
#: Windows that a task packs at once, and that a bucket gets from the whole corpus at about; buckets at least.
BLOCK, PER_BUCKET, MIN_BUCKETS = 1_000_000, 2_000_000, 64
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000
#: Runs that are compacted into one.
FANOUT = 2
#: Parts, by doc_id, in which the query feeds the corpus to the index.
BATCHES = 4

_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so invertible modulo 2**64
_NO_ID = 2**63 - 1
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _rolling(words: np.ndarray, base: int, window: int) -> np.ndarray:
    """Polynomial hash of every window, by differences of one prefix sum."""
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(base, len(words)), out=prefix[1:])
    n = len(words) - window + 1
    h = (prefix[window:] - prefix[:-window]) * _power(pow(base, -1, 2**64), n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def split_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09 to 0x0D."""
    return (text or "").encode().split()


_words: dict[bytes, bytes] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Two hashes of each word, by different seeds, as rows."""
    of, known = xxhash.xxh64_digest, _words
    if len(known) > REMEMBERED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = of(w) + of(w, 1)
    return np.frombuffer(b"".join([known[w] for w in words]), ">u8").astype(np.uint64).reshape(-1, 2)


def window_hashes(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and check of the window at every start."""
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    h = _word_hashes(words)
    return _rolling(np.ascontiguousarray(h[:, 0]), _P, window), (_rolling(np.ascontiguousarray(h[:, 1]), _Q, window) >> np.uint64(32)).astype(np.uint32)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte plane by byte plane, compressed; the first, sorted, as differences."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in (first, *columns[1:]))
    return len(first).to_bytes(8, "little") + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    planes, out, at = np.frombuffer(pa.decompress(blob[16:], size, "zstd", asbytes=True), np.uint8), [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


_ENTRY = (np.uint64, np.uint32, np.int64, np.int32)  # fingerprint, check, doc_id, start
_RUN = (np.uint64, np.uint32)
_DEALT = "bucket int, doc_id long, blob binary"


def _starts(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct doc_ids, and the packed starts of each."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return doc, []
    cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    return doc[cut], [np.diff(x, prepend=np.int32(0)).astype("<i4").tobytes() for x in np.split(start, cut[1:])]


def _blocks(docs: DataFrame, bits: int, window: int) -> DataFrame:
    """(bucket, doc_id, blob): the windows of ``docs`` as packed entries, sorted by fingerprint within each blob, without a doc_id;
    and the packed starts of a document's windows that repeat one of their block, in any one bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, check, doc, start = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.argsort(h)
            h, check, doc, start = h[order], check[order], doc[order], start[order]
            again = _repeats(h, check, doc, start, [])[0]
            docs_, starts = _starts(doc[again], start[again])
            for lo in range(0, len(docs_), 4096):
                some = docs_[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array((some % 2**bits).astype(np.int32)), pa.array(some), pa.array(starts[lo : lo + 4096], pa.binary())], ["bucket", "doc_id", "blob"])
            h, check, doc, start = h[~again], check[~again], doc[~again], start[~again]
            edge = np.searchsorted(h >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
            for lo in range(0, 2**bits, 64):
                some = [k for k in range(lo, min(lo + 64, 2**bits)) if edge[k] < edge[k + 1]]
                blobs = [pack(*(c[edge[k] : edge[k + 1]] for c in (h, check, doc, start))) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "doc_id", "blob"])

        count = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, check = window_hashes(split_words(text.as_py()), window)
                if len(h):
                    held.append((h, check, np.full(len(h), doc, np.int64), np.arange(len(h), dtype=np.int32)))
                    count += len(h)
                if count >= BLOCK:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    return docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text").mapInArrow(run, _DEALT)


def _repeats(h: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray, history: list[list[np.ndarray]]):
    """Of entries sorted by h: a mask of repeats, and the (h, check) that history lacks, sorted."""
    repeat = np.zeros(len(h), bool)
    same = h[1:] == h[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    order = tied[np.lexsort((start[tied], doc[tied], check[tied], h[tied]))]
    if len(order):
        head = np.r_[True, (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])]
        first = order[head][np.cumsum(head) - 1]  # the smallest (doc_id, start) of each entry's window
        repeat[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    alone = np.ones(len(h), bool)
    alone[order] = False
    if len(order):
        alone[order[head]] = True
    known = np.zeros(len(h), bool)
    for old_h, old_check in history:
        lo, hi = np.searchsorted(old_h, h, "left"), np.searchsorted(old_h, h, "right")
        at = np.flatnonzero(hi > lo)
        hit = old_check[lo[at]] == check[at]
        for k in np.flatnonzero(~hit & (hi[at] - lo[at] > 1)):  # several checks under one fingerprint
            hit[k] = check[at[k]] in old_check[lo[at[k]] : hi[at[k]]]
        known[at[hit]] = True
    new = alone & ~known
    return repeat | known, h[new], check[new]


class WindowIndex:
    """The runs of all batches so far, under ``root`` in the shared folder.

    root/run-<n>/<bucket> holds a bucket's part of run n: packed fingerprints and checks, sorted. A run that
    is compacted covers the runs before it, whose files go once the batch is done.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int, window: int = WINDOW, fanout: int = FANOUT):
        self.spark, self.root, self.bits, self.window, self.fanout = spark, root, max(0, (buckets - 1).bit_length()), window, fanout
        self.runs: list[int] = []
        self.made = 0

    def add(self, docs: DataFrame) -> DataFrame:
        """(doc_id, starts): packed starts of repeated windows, a row for each bucket and document that has any.

        Adds the windows of ``docs`` to the index. Null ids stand for one id after all others.
        """
        root, bits, runs, number = self.root, self.bits, list(self.runs), self.made
        compacting = len(runs) >= self.fanout

        def merge(key: tuple, group: pa.Table) -> pa.Table:
            bucket, store = key[0].as_py(), Shared(root)
            sure = pc.is_valid(group.column("doc_id"))
            passed = group.filter(sure).select(["doc_id", "blob"]).rename_columns(["doc_id", "starts"])
            parts = [unpack(b.as_py(), *_ENTRY) for b in group.filter(pc.invert(sure)).column("blob")] or [[np.empty(0, k) for k in _ENTRY]]
            h, check, doc, start = (np.concatenate(c) for c in zip(*parts))
            del parts
            order = np.argsort(h)
            h, check, doc, start = h[order], check[order], doc[order], start[order]
            history = [unpack(blob, *_RUN) for n in runs if (blob := store.get(f"run-{n}/{bucket}"))]
            repeat, new_h, new_check = _repeats(h, check, doc, start, history)
            if compacting:
                new_h, new_check = (np.concatenate([new, *old]) for new, old in zip((new_h, new_check), zip(*history))) if history else (new_h, new_check)
                order = np.argsort(new_h, kind="stable")
                new_h, new_check = new_h[order], new_check[order]
            store.put(f"run-{number}/{bucket}", [pack(new_h, new_check)])
            docs_, starts = _starts(doc[repeat], start[repeat])
            return pa.concat_tables([passed, pa.table({"doc_id": pa.array(docs_), "starts": pa.array(starts, pa.binary())})])

        dealt = _blocks(docs, bits, self.window)
        if compacting:  # buckets that the batch doesn't touch are carried over, too
            dealt = dealt.unionByName(self.spark.range(2**bits).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), F.lit(pack(*(np.empty(0, k) for k in _ENTRY))).alias("blob")))
        out = written(dealt.groupBy("bucket").applyInArrow(merge, "doc_id long, starts binary"), "substring-repeats")
        self.runs = [number] if compacting else [*runs, number]
        self.made += 1
        if compacting:
            store = Shared(root)
            for n in runs:
                store.remove_dir(f"run-{n}")
        return out


def covered(n_words: int, starts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Mask of the words that the windows at ``starts`` cover."""
    at = np.concatenate([np.cumsum(np.frombuffer(s, "<i4")) for s in starts]) if starts else np.empty(0, np.int64)
    step = np.bincount(at, minlength=n_words + 1)[: n_words + 1] - np.bincount(np.minimum(at + window, n_words), minlength=n_words + 1)[: n_words + 1]
    return np.cumsum(step)[:n_words] > 0


def _kept(docs: DataFrame, repeats: DataFrame, window: int, emit, schema: str) -> DataFrame:
    """Applies ``emit(row's words, kept words)`` to each document; ``docs`` may have any columns besides doc_id and text."""
    starts = repeats.groupBy("doc_id").agg(F.collect_list("starts").alias("__quire_starts")).withColumnRenamed("doc_id", "__quire_id")
    names = ["doc_id", *schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts in zip(batch.column(1), batch.column(2)):
                words = split_words(text.as_py())
                gone = covered(len(words), starts.as_py() or [], window)
                rows.append(emit(words, [w for w, x in zip(words, gone.tolist()) if not x]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(schema.items())}}).select(names)

    sql = {pa.int64(): "long", pa.string(): "string"}
    joined = docs.select("doc_id", "text").join(starts, F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("__quire_id"), "left").select("doc_id", "text", "__quire_starts")
    return joined.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {sql[k]}" for c, k in schema.items()))


def dedup_texts(docs: DataFrame, index: WindowIndex) -> DataFrame:
    """(doc_id, n_words, n_removed, text): every text without the words that repeated windows cover, joined by single spaces."""
    repeats = index.add(docs)
    return _kept(docs, repeats, index.window, lambda words, kept: (len(words), len(words) - len(kept), b" ".join(kept).decode()), {"n_words": pa.int64(), "n_removed": pa.int64(), "text": pa.string()})


def _digests(docs: DataFrame, repeats: DataFrame, window: int) -> DataFrame:
    return _kept(docs, repeats, window, lambda words, kept: (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()})


def digest_batches(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``, fed to a new index in ``batches`` parts.

    The parts are ranges of doc_id, so what is in the index is earlier than what comes. Null texts have no
    words. Rows that share a doc_id are one document for the rule: equal starts aren't earlier than each other.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    cuts, size = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000), F.sum(F.octet_length("text"))).first()
    buckets = max(MIN_BUCKETS, (size or 0) // 6 // PER_BUCKET)
    index = WindowIndex(spark, keep_until_exit(spark, shared_dir(spark, "substring-index")), buckets, window, fanout)
    cuts = sorted(set(cuts or []))
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = docs
        if low is not None:
            part = part.filter((F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        repeats = index.add(part)
        parts.append(written(_digests(part, repeats, window), "substring-digests"))
        discard(repeats)
        del repeats, part
        drop_dead_shuffles(spark)
    remove(spark, index.root)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of the kept words of every document."""
    return digest_batches(table(spark, sf_dir, "documents"))
