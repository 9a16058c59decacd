"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments. A text that holds a segment of n characters within e edits
shares at least n - q + 1 - q * e of its q-grams with it, all on e + 1 neighbouring diagonals (position in
the text less position in the segment). Shared q-grams are counted in bands of diagonals that overlap by e, so
that no such region falls between two; bands that reach the bound are verified by banded alignment. Items shorter
than a q-gram have none: they are found only in a text that is nothing else. Long texts are searched a slice at a
time, and slices overlap by more than a stretch can take up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

#: Characters of a q-gram, of a segment and between segments; edits allowed per character.
Q, SEGMENT, STEP, BUDGET = 10, 160, 80, 0.08
#: Code points of a text that are searched at once, and that slices overlap by.
SLICE, LAP = 32_768, 1024
#: Bytes of benchmark text that are sent to the executors at once; a larger benchmark goes in blocks.
BLOCK_BYTES = 16 * 1024 * 1024

_BASE = 0x9E3779B97F4A7C15
_FILTER_BITS = 22
_FOUND = "doc_id long, item_id long, start int, end int, edits int"
_powers = np.ones(1, np.uint64)


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with white space runs as single spaces, and the place of each in ``text``."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    white = (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0xA0)
    at = np.flatnonzero(~(white & np.r_[False, white[:-1]]))
    out = cp[at].copy()
    out[white[at]] = 32
    return out, at


def _stripped(cp: np.ndarray) -> np.ndarray:
    return cp[int(len(cp) > 0 and cp[0] == 32) : len(cp) - int(len(cp) > 1 and cp[-1] == 32)]


def grams(cp: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at every place."""
    global _powers
    n = len(cp) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if len(_powers) < len(cp):
        _powers = np.full(max(len(cp), 65_536), _BASE, np.uint64)
        _powers[0] = 1
        np.cumprod(_powers, out=_powers)
        _powers.flags.writeable = False
    # Times a falling power of the base, the window's sum no longer depends on its place.
    prefix = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(cp * _powers[: len(cp)], out=prefix[1:])
    h = (prefix[q:] - prefix[:-q]) * _inverse(n)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xFF51AFD7ED558CCD)


_inverses = np.ones(1, np.uint64)


def _inverse(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        _inverses = np.full(max(n, 65_536), pow(_BASE, -1, 2**64), np.uint64)
        _inverses[0] = 1
        np.cumprod(_inverses, out=_inverses)
    return _inverses[:n]


def edits_within(segment: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best stretch of ``text`` for the whole segment on diagonals low to high; None beyond the budget.

    Rows go down the segment; a column is a diagonal, so a substitution stays in its column. Insertions along
    a row are a running minimum.
    """
    width, far = high - low + 1, np.int64(1 << 40)
    column = np.arange(width)
    pad = np.full(width + len(segment), -1, np.int64)  # text[low], ..., with -1 outside
    a, b = max(low, 0), min(low + len(pad), len(text))
    if b > a:
        pad[a - low : b - low] = text[a:b]
    # A cost and the place where it began, in one number: the smaller cost, then the later start.
    big = np.int64(1 << 20)
    start = low + column
    row = np.where((start >= 0) & (start <= len(text)), big - 1 - column, far)
    for i, c in enumerate(segment):
        inside = pad[i : i + width] >= 0
        diagonal = np.where(inside, row + np.where(pad[i : i + width] == c, 0, big), far)
        skip = np.r_[row[1:] + big, far]  # a character of the segment is missing in the text
        row = np.minimum(diagonal, skip)
        row = np.minimum.accumulate(row - column * big) + column * big
    best = int(np.argmin(row))
    cost = int(row[best] // big)
    if cost > budget:
        return None
    return cost, low + int(big - 1 - row[best] % big), low + best + len(segment)


@dataclass
class Probe:
    """Segments of benchmark items, with a sorted index of their q-grams."""

    items: list  # item id of each segment
    cuts: list  # code points of each segment
    budget: np.ndarray
    need: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    seg: np.ndarray
    place: np.ndarray
    flag: np.ndarray
    band: int
    short: dict  # bytes of an item shorter than a q-gram -> item ids

    @staticmethod
    def of(items: list[tuple], q: int = Q, segment: int = SEGMENT, step: int = STEP, budget: float = BUDGET) -> Probe:
        """Items are (id, text); null and blank ones are nowhere."""
        ids, cuts, short = [], [], {}
        for item, text in items:
            cp = _stripped(normalise(text or "")[0])
            if 0 < len(cp) < q:
                short.setdefault(cp.tobytes(), []).append(item)
            for at in range(0, max(1, len(cp) - segment + step), step):
                at = min(at, max(0, len(cp) - segment))
                if len(cut := cp[at : at + segment]) >= q:
                    ids.append(item)
                    cuts.append(cut)
        size = np.array([len(c) for c in cuts], np.int64)
        # Edits at the rate of ``budget``, but no more than leave half the q-grams that the lemma needs.
        edits = np.minimum((size * budget).astype(np.int64), np.maximum(0, (size - q + 1) // (2 * q)))
        edits = np.where(size >= q * 4, np.minimum((size * budget).astype(np.int64), (size - q) // q), edits)
        need = size - q + 1 - q * edits
        hashes = [grams(c, q) for c in cuts]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        seg = np.repeat(np.arange(len(cuts)), [len(x) for x in hashes]) if hashes else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        gram, first = np.unique(h[order], return_index=True)
        flag = np.zeros(1 << _FILTER_BITS, bool)
        flag[gram >> np.uint64(64 - _FILTER_BITS)] = True
        band = 1 << int(max(1, edits.max(initial=1))).bit_length()  # wider than any budget
        return Probe(ids, cuts, edits, need, gram, np.r_[first, len(h)], seg[order], place[order], flag, band, short)

    def search(self, text: str | None, q: int = Q) -> list[tuple]:
        """(item_id, start, end, edits) of every item found: the stretch that its segments cover, and the fewest edits of one."""
        cp, at = normalise(text or "")
        if len(cp) <= q + 1 and (ids := self.short.get(_stripped(cp).tobytes())):
            return [(item, 0, len(text), 0) for item in ids]
        found: dict = {}
        for begin in range(0, max(1, len(cp) - LAP), SLICE):
            self._search(cp[begin : begin + SLICE + LAP], at[begin : begin + SLICE + LAP], q, found)
        return [(item, *span) for item, span in found.items()]

    def _search(self, cp: np.ndarray, at: np.ndarray, q: int, found: dict) -> None:
        """Adds (start, end, edits) of the items found in a slice; ``at``: the place of its code points in the text."""
        h = grams(cp, q)
        where = np.flatnonzero(self.flag[h >> np.uint64(64 - _FILTER_BITS)])
        if not len(where):
            return
        k = np.searchsorted(self.gram, h[where])
        hit = (k < len(self.gram)) & (self.gram[np.minimum(k, len(self.gram) - 1)] == h[where])
        where, k = where[hit], k[hit]
        count = self.first[k + 1] - self.first[k]
        if not len(k):
            return
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[k], count)
        seg, diagonal = self.seg[entry], np.repeat(where, count) - self.place[entry] + SEGMENT * 2  # not negative
        band = diagonal // self.band
        over = diagonal % self.band < self.budget[seg]  # also in the band before, which reaches so far
        bands = (len(cp) + SEGMENT * 4) // self.band + 2
        key, n = np.unique(np.r_[seg * bands + band, (seg * bands + band - 1)[over]], return_counts=True)
        key = key[n >= self.need[key // bands]]
        for s, b in zip((key // bands).tolist(), (key % bands).tolist()):
            e, low = int(self.budget[s]), b * self.band - SEGMENT * 2
            best = edits_within(self.cuts[s], cp, low, low + self.band + e, e)
            if best is not None:
                cost, start, end = best
                end = min(max(end, start + 1), len(at))
                was = found.get(self.items[s], (1 << 30, -1, 1 << 30))
                found[self.items[s]] = (min(was[0], int(at[start])), max(was[1], int(at[end - 1]) + 1), min(was[2], cost))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple], bool]]:
    """(item_id, text) rows of the benchmark, at most about ``block_bytes`` at a time; and whether there are several blocks."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [tuple(r) for r in part.collect()], blocks > 1  # bounded by block_bytes


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits): a row for each document row and item found in it; clean documents have none.

    start and end are code points of the text. Null texts are clean; repeated rows give repeated results. A benchmark of
    several blocks takes a pass for each, whose rows are written before the next block is sent, so that one is held at a time.
    """
    spark, found, several = docs.sparkSession, [], False
    for items, several in _blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(Probe.of(items))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for x in sent.value.search(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(run, _FOUND)
        if several:
            part = written(part, "decontam-found")
            sent.destroy()
        found.append(part)
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, as they are, whose text holds no benchmark item. Blocks as in ``contaminated``: each leaves fewer rows."""
    left = docs
    for items, several in _blocks(benchmark, block_bytes):
        sent, place = docs.sparkSession.sparkContext.broadcast(Probe.of(items)), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.search(t.as_py()) for t in batch.column(place)], pa.bool_()))

        before, left = left, left.mapInArrow(run, docs.schema)
        if several:
            left = written(left, "decontam-left")
            sent.destroy()
            if before is not docs:
                discard(before)
    return left


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, the place and the edits."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
