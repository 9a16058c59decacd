"""Search for texts anywhere inside pages, by hashed windows that stream past the needles of their keys, not a join of every needle with every page."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths of the prefixes that a needle is sought by.
PREFIXES = (56, 44, 34, 26, 18, 12)
#: Needles, and code points of pages, of one key that a task takes at most at about; more are dealt out to cells of both.
SOUGHT, READ = 1 << 16, 1 << 26
#: Code points hashed at once, which bounds memory for long pages.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def window_hashes(points: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, a 64-bit polynomial hash of every window of that many code points), by doubling: a window is two shorter ones side by side."""
    made = {n: None for n in lengths if n <= len(points)}
    piece, width, power = points.astype(np.uint64) + np.uint64(1), 1, np.uint64(_BASE)
    with np.errstate(over="ignore"):
        while made:
            for n, (out, done, out_power) in ((n, x or (None, 0, np.uint64(1))) for n, x in list(made.items()) if n & width):
                last = done + width == n
                size = len(points) - n + 1 if last else len(piece) - done
                if out is None:
                    out = piece[:size]
                else:
                    out = piece[done : done + size] * out_power
                    out += made[n][0][:size]
                made[n] = out, done + width, out_power * power
                if last:
                    yield n, made.pop(n)[0]
            if made:
                piece, power, width = piece[:-width] + piece[width:] * power, power * power, 2 * width


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _cells(needles: DataFrame, pages: DataFrame, keys: list[str], needle: str, text: str) -> DataFrame:
    """(keys, parts, reads): parts of the needles and of the pages of each key that has more of them than one task takes; few do."""
    size = needles.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > SOUGHT).select(*keys, "n", F.lit(0).alias("c"))
    long = pages.groupBy(*keys).agg(F.sum(F.length(text)).alias("c")).filter(F.col("c") > READ).select(*keys, F.lit(0).alias("n"), "c")
    part = lambda c, most: F.greatest(F.ceil(F.max(c) / most), F.lit(1)).cast("int")
    return size.unionByName(long).groupBy(*keys).agg(part("n", SOUGHT).alias("parts"), part("c", READ).alias("reads"))


def inside_pages(needles: DataFrame, pages: DataFrame, keys: list[str], needle_id: str, needle: str, page: str, text: str, lengths: tuple[int, ...] = PREFIXES) -> DataFrame:
    """(keys, needle_id, page, at, length): for each needle the page of its keys that holds the longest of its prefixes, at any place.

    Ties go to the smaller page; ``at`` is the first place in it, from 0. Needles shorter than all lengths, and prefixes that stand
    nowhere, give nothing. Needles and pages of one key meet in one shuffle on the key, needles first; every place of a page is hashed once for every
    length, in one vectorised pass, as it streams past the needles of its key, and what agrees is compared as text. So work and shuffle are in
    proportion to both tables. A key with more than SOUGHT needles, or READ code points, is dealt out to cells of a part of both.
    """
    kinds, lengths = {**dict(pages.dtypes), needle_id: dict(needles.dtypes)[needle_id]}, tuple(sorted(lengths, reverse=True))
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    asks = needles.filter(known & (F.length(needle) >= lengths[-1])).select(*keys, F.col(needle_id).alias("__quire_id"), F.substring(needle, 1, lengths[0]).alias("__quire_text"))
    reads = pages.filter(known & (F.length(text) >= lengths[-1])).select(*keys, F.col(page).alias("__quire_page"), F.col(text).alias("__quire_text"))
    cells = F.broadcast(_cells(asks, reads, keys, "__quire_text", "__quire_text"))
    own = lambda c, of: F.pmod(F.xxhash64(c), F.coalesce(of, F.lit(1))).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(of), F.lit(1)) - 1))
    a = asks.join(cells, keys, "left").withColumn("__quire_a", own("__quire_id", F.col("parts"))).withColumn("__quire_b", every("reads")).drop("parts", "reads")
    b = reads.join(cells, keys, "left").withColumn("__quire_b", own("__quire_page", F.col("reads"))).withColumn("__quire_a", every("parts")).drop("parts", "reads")
    cell = [*keys, "__quire_a", "__quire_b"]
    both = a.withColumn("__quire_reads", F.lit(False)).unionByName(b.withColumn("__quire_reads", F.lit(True)), allowMissingColumns=True)
    both = both.select(*cell, "__quire_reads", "__quire_id", "__quire_page", "__quire_text").repartition(*cell).sortWithinPartitions(*cell, "__quire_reads", "__quire_page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # needles of the last cell
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            new = np.zeros(rows.num_rows, bool)
            for c in rows.columns[: len(cell)]:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            group, is_page = np.cumsum(new), rows.column(len(cell)).to_numpy(zero_copy_only=False)
            needle_at, page_at, place, length = _best(rows.column(rows.num_columns - 1), group, is_page, lengths)
            asked, read = rows.take(pa.array(needle_at, pa.int64())), rows.column(len(cell) + 2).take(pa.array(page_at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*asked.columns[: len(keys)], asked.column(len(cell) + 1), read, pa.array(place, pa.int32()), pa.array(length, pa.int32())], [*keys, needle_id, page, "at", "length"])
            held = rows.filter(pa.array((group == group[-1]) & ~is_page))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, needle_id, page)) + ", at int, length int"
    best = F.min(F.struct((-F.col("length")).alias("less"), F.col(page).alias("page"), "at")).alias("best")
    found = both.mapInArrow(run, schema).groupBy(*keys, needle_id).agg(best)
    return found.select(*keys, needle_id, F.col("best.page").alias(page), F.col("best.at").alias("at"), (-F.col("best.less")).alias("length"))


def _best(texts: pa.Array, group: np.ndarray, is_page: np.ndarray, lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(needle's row, page's row, first place, length) of each needle that a page of its group holds a prefix of: the longest prefix, the first page."""
    asks, reads = np.flatnonzero(~is_page), np.flatnonzero(is_page)
    out: tuple[list[int], list[int], list[int], list[int]] = ([], [], [], [])
    if not len(asks) or not len(reads):
        return out
    needles, pages = texts.take(pa.array(asks, pa.int64())).to_pylist(), texts.take(pa.array(reads, pa.int64())).to_pylist()
    mixed = group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # groups of a batch apart
    sizes = np.fromiter(map(len, needles), np.int64, len(needles))
    starts, of_needles = np.cumsum(sizes) - sizes, {}
    for n, h in window_hashes(_points("".join(needles)), lengths):
        long = np.flatnonzero(sizes >= n)
        sought, which = np.unique(h[starts[long]] ^ mixed[asks[long]], return_inverse=True)
        bits = np.zeros(1 << 20, bool)
        bits[(h[starts[long]] >> np.uint64(44)).astype(np.int64)] = True
        of_needles[n] = sought, bits, dict(zip(long.tolist(), which.tolist())), np.full((2, len(sought)), -1)  # the last: page and place found first
    for points, page, begins, at in _slices(pages, lengths[0]):
        for n, h in window_hashes(points, tuple(of_needles)):
            sought, bits, _, first = of_needles[n]
            where = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            piece = np.searchsorted(begins, where, side="right") - 1
            inside = where + n <= np.r_[begins[1:], len(points)][piece]
            where, piece = where[inside], piece[inside]
            h = h[where] ^ mixed[reads[page[piece]]]
            place = np.minimum(np.searchsorted(sought, h), max(len(sought) - 1, 0))
            hit = np.flatnonzero(sought[place] == h) if len(sought) else place[:0]
            found, earliest = np.unique(place[hit], return_index=True)
            earliest, new = hit[earliest], first[0, found] < 0
            found, earliest = found[new], earliest[new]
            first[:, found] = page[piece[earliest]], where[earliest] - begins[piece[earliest]] + at[piece[earliest]]
    of_group: dict[int, list[int]] = {}
    for k, text in enumerate(needles):
        for n in lengths:
            which = of_needles[n][2].get(k) if n in of_needles else None
            if which is None or of_needles[n][3][0, which] < 0:
                continue
            (p, at), prefix = of_needles[n][3][:, which].tolist(), text[:n]
            if pages[p][at : at + n] != prefix:  # the hash alone agrees: look at all pages
                if not of_group:
                    for j, r in enumerate(reads):
                        of_group.setdefault(int(group[r]), []).append(j)
                p, at = next(((j, x) for j in of_group[int(group[asks[k]])] if (x := pages[j].find(prefix)) >= 0), (-1, -1))
            if p >= 0:
                for column, value in zip(out, (int(asks[k]), int(reads[p]), at, n)):
                    column.append(value)
                break
    return out


def _slices(pages: list[str], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(points, page, begins, at): about SLICE code points of pages side by side, the page of each piece, where it begins among them and in its page.

    Pieces of a page overlap by one less than the longest window; all windows are in one of them, in order.
    """
    texts, page, at, held = [], [], [], 0
    for k, text in enumerate(pages):
        for start in range(0, max(len(text) - longest + 1, 1), SLICE):
            texts.append(text[start : start + SLICE + longest - 1])
            page.append(k)
            at.append(start)
            held += len(texts[-1])
            if held >= SLICE:
                yield _side_by_side(texts, page, at)
                texts, page, at, held = [], [], [], 0
    if texts:
        yield _side_by_side(texts, page, at)


def _side_by_side(texts: list[str], page: list[int], at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return _points("".join(texts)), np.array(page), np.cumsum(sizes) - sizes, np.array(at)
