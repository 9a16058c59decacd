"""SimHash near-duplicates with pivot distance tables.

Fingerprints that link (``radius`` or fewer differing bits) agree fully on some ``BLOCKS - radius`` of
``BLOCKS`` blocks of bits, so rows are dealt out by every such combination of blocks; that is exact. Inside
a bucket each fingerprint has a row of the pivot table: its Hamming distances to fixed reference
fingerprints. By the triangle inequality a pair whose coordinates differ by more than the radius
anywhere can't link and is discarded; survivors are verified bit by bit. A bucket gives a spanning
forest of its links, never all pairs of a group.

A pivot's distance alone leaves over half of random pairs (it varies by 4 around 32), so as an index it
would have to look at all pairs; hence the buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, drop_dead_shuffles, sent_if_small, table, written
from .components import connected_components

#: Blocks of bits at least; buckets hold about this many unrelated fingerprints at most.
BLOCKS, BUCKET = 6, 16
#: Shingles hashed at once, which bounds memory for very long texts.
SLICE = 65_536
PIVOTS = np.random.default_rng(20).integers(0, 2**64, (16, 1), dtype=np.uint64)

#: For similarity rather than a radius: words of 64 bits, texts that common shingles are counted in at about, and common shingles at most.
LANES, SAMPLE, COMMON = 4, 4096, 131_072
#: Rows of one key, or texts compared with one, that a task takes at most at about.
GROUP = 4096
WIDE_PIVOTS = np.random.default_rng(22).integers(0, 2**64, (4, LANES), dtype=np.uint64)


def _shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every word shingle, a slice at a time; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D only
    if not words:
        return
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    starts, ends, n = starts[: len(words) - k + 1], ends[k - 1 :], len(words) - k + 1
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        yield np.array([hash_of(joined[a:b], 42) for a, b in zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist())], np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    """64 bits; each is set where it is set in over half the shingles' hashes. No words: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in _shingle_hashes(text, shingle):
        ones, n = ones + _ones(h), n + len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every whole text; null counts as empty."""

    return docs.select("doc_id", "text").mapInArrow(_print_rows(shingle), "doc_id long, fp long")


def _print_rows(shingle: int):
    """Replaces the last column, a text, by its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def _block_masks(n: int, radius: int) -> list[tuple[int, int]]:
    """(number, mask) of every combination of blocks on which a linked pair can agree, for n fingerprints."""
    blocks = max(BLOCKS, radius + 2)
    while 2 ** (64 * (blocks - radius) // blocks) * BUCKET < n and blocks < 2 * radius + 2:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    single = [(2**b - 2**a) for a, b in zip(cuts, cuts[1:])]
    return [(k, sum(c)) for k, c in enumerate(combinations(single, blocks - radius))]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of lanes."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _pivot_rows(fps: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """Rows of the pivot table: distances of each fingerprint (n, lanes) to every pivot (p, lanes)."""
    return np.stack([_apart(fps, p) for p in pivots], axis=1).astype(np.int16) if len(fps) else np.empty((0, len(pivots)), np.int16)


def _forest(fps: np.ndarray, rows: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among fingerprints (n, lanes); rows: their rows of the pivot table."""
    left, edges = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            where = np.arange(len(left))
            for p in range(0, rows.shape[1], 4):  # a few coordinates at a time, on what is left
                where = where[(np.abs(rows[left[where], p : p + 4] - rows[at, p : p + 4]) <= radius).all(axis=1)]
            where = where[_apart(fps[left[where]], fps[at]) <= radius]
            found = left[where]
            edges += [(at, x) for x in found]
            queue += found.tolist()
            left = np.delete(left, where)
    return edges


def _bucket_edges(names: np.ndarray, fps: np.ndarray, rows: np.ndarray, first: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of linked rows of each bucket; ``first`` has the place where each bucket begins, ``rows`` the rows of the pivot table."""
    size = np.diff(np.r_[first, len(names)])
    two = first[size == 2]
    two = two[(np.abs(rows[two] - rows[two + 1]) <= radius).all(axis=1)]
    two = two[_apart(fps[two], fps[two + 1]) <= radius]
    a, b = [names[two]], [names[two + 1]]
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        if found := _forest(fps[at : at + n], rows[at : at + n], radius):
            x = np.array(found) + at
            a.append(names[x[:, 0]])
            b.append(names[x[:, 1]])
    return np.concatenate(a), np.concatenate(b)


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that rows that agree in the first ``keys`` columns stay together."""
    held: list[list[np.ndarray]] = []  # of the last key

    def joined() -> list[np.ndarray]:
        return [np.concatenate(parts) for parts in zip(*held)]

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        if held and any(held[-1][k][-1] != cols[k][0] for k in range(keys)):
            yield joined()
            held = []
        other = np.flatnonzero(np.any([cols[k] != cols[k][-1] for k in range(keys)], axis=0))
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            held.append([c[:last] for c in cols])
            yield joined()
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield joined()


def _in_buckets(dealt: DataFrame, radius: int) -> DataFrame:
    """(a, b): links within the buckets (t, bits) of rows (t, bits, fp, p0, p1), which stream through in the order of their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bits, fp, p0, p1 in _whole_keys(batches, 2):
            first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (bits[1:] != bits[:-1])])
            rows = np.stack([p0, p1], axis=1).astype("<i8").view(np.uint8).astype(np.int16)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _bucket_edges(fp, fp[:, None].view(np.uint64), rows, first, radius)], ["a", "b"])

    return dealt.select("t", "bits", "fp", "p0", "p1").repartition("t", "bits").sortWithinPartitions("t", "bits").mapInArrow(run, "a long, b long").distinct()


def pivot_table(prints: DataFrame) -> DataFrame:
    """(fp, p0, p1): each distinct fingerprint with its distances to the 16 pivots, a byte each, worked out once."""
    signed = lambda m: int(m) - 2**64 if m >= 2**63 else int(m)
    apart = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("long") for p in PIVOTS[:, 0].tolist()]
    packed = lambda some: reduce(Column.bitwiseOR, [F.shiftleft(d, 8 * k) for k, d in enumerate(some)])
    return prints.select("fp").filter(F.col("fp").isNotNull()).distinct().select("fp", packed(apart[:8]).alias("p0"), packed(apart[8:]).alias("p1"))


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect just what all links of ``radius`` or fewer bits connect."""
    rows = written(pivot_table(prints), "simhash-pivots")
    masks = _block_masks(rows.count(), radius)
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    keys = F.array(*[F.struct(F.lit(k).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for k, m in masks])
    return _in_buckets(rows.select("fp", "p0", "p1", F.explode(keys).alias("key")).select("key.t", "key.bits", "fp", "p0", "p1"), radius)


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: component_id is the smallest doc_id reachable over links.

    Null texts count as empty; all texts without words share the fingerprint zero, which links like any other.
    Rows may repeat; a row without an id gets the smallest id of its component, null if there is none.
    """
    prints = written(fingerprints(docs, shingle), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(prints, radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending."""
    parts = [np.unique(h) for h in _shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def parity_bits(hashes: np.ndarray) -> bytes:
    """About four bits for each shingle, a power of two of them and LANES words at least; each is the parity of the shingles that fall on it.

    A shingle that only one of two sets has changes one bit, so sets differ in at least as many shingles as
    their bits: what is discarded by the bits, or by pivots, is never similar.
    """
    size = max(64 * LANES, 1 << (4 * len(hashes) - 1).bit_length()) if len(hashes) else 64 * LANES
    ones = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % size, minlength=size)
    return np.packbits((ones & 1).astype(bool), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> bytes:
    """The parity bits that the same set has in ``size`` bytes, fewer or as many, a power of two."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0).tobytes()


def folded_apart(a: bytes, b: bytes) -> int:
    """Differing bits of two parity fingerprints, the longer one folded."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(np.frombuffer(folded(a, size), np.uint64) ^ np.frombuffer(folded(b, size), np.uint64)).sum())


def _prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest hashes, as many that two similar sets share one of them. Any one order of all hashes is exact; here what is common comes last."""
    if not len(hashes):
        return hashes
    take = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    often = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[:take]]


def _common(marked: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; counts): shingles that stand in several texts of a bounded sample."""
    luck = F.pmod(F.xxhash64("__quire_text"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(marked.count(), 1)) * (1 << 30))
    some = marked.filter(luck).select("__quire_text", "text").dropDuplicates(["__quire_text"]).limit(2 * SAMPLE).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle).view(np.int64))], ["h"])

    found = some.mapInArrow(run, "h long").groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    hashes, counts = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _nearest_forest(part: np.ndarray, root: np.ndarray, size: np.ndarray, width: np.ndarray, fps: dict[int, np.ndarray], rows: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """The lightest spanning forest of what sizes, pivots and bits don't keep apart; weights are shares of the bits that may differ, rows of one root are one.

    It has at most as many links as there are roots, and those most likely to be similar.
    """
    share, across = (1 - similarity) / (1 + similarity), (part != part[0]).any()
    left, links = np.arange(len(size)), []
    best, by = np.full(len(size), np.inf), np.zeros(len(size), np.int64)
    while len(left):
        k = int(np.argmin(best[left]))
        i = int(left[k])
        left = np.delete(left, k)
        if 0 <= best[i] < np.inf:
            links.append((int(by[i]), i))
        best[left[root[left] == root[i]]] = -1.0
        j = left[(best[left] > 0) & ((part[left] != part[i]) | (not across))]
        j = j[np.minimum(size[j], size[i]) + 1e-9 >= np.maximum(size[j], size[i]) * similarity]
        radius = (size[j] + size[i]) * share + 1e-9
        near = (np.abs(rows[j] - rows[i]) <= radius[:, None]).all(axis=1)
        j, radius = j[near], radius[near]
        apart = np.empty(len(j))
        for w in np.unique(width[j]).tolist():
            these, own = width[j] == w, fps[min(w, int(width[i]))]
            apart[these] = _apart(own[j[these]], own[i])
        weight = apart / np.maximum(radius, 1.0)
        closer = (apart <= radius) & (weight < best[j])
        best[j[closer]], by[j[closer]] = weight[closer], i
    return links


def _near_pairs(company: DataFrame, similarity: float, forest: bool = False) -> DataFrame:
    """(a, b): rows (key, node, n, root, size, bits) of one key and several roots that sizes, pivots and bits don't keep apart; of these, if asked for, a ``forest``.

    A key of more than GROUP rows is cut into cells of two parts of about GROUP rows, so no task holds more.
    """
    share = (1 - similarity) / (1 + similarity)  # of both sizes, that similar sets differ in at most

    def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
        for at, end in zip(first.tolist(), np.r_[first[1:], len(cols[0])].tolist()):
            order = at + np.argsort(cols[5][at:end], kind="stable")
            part, node, root, size = (c[order] for c in cols[2:6])
            across = (part != part[0]).any()  # within a part, pairs are of the cell that has it alone
            bits = cols[6][order]
            # Larger sets have more bits, which fold to those of smaller ones.
            width = np.fromiter(map(len, bits), np.int64, len(bits))
            fps = {}
            for w in np.unique(width).tolist():
                fps[w] = np.zeros((len(bits), w // 8), np.uint64)
                wide = np.flatnonzero(width >= w)
                fps[w][wide] = np.stack([np.frombuffer(folded(b, w), np.uint64) for b in bits[wide]])
            rows = _pivot_rows(np.stack([np.frombuffer(folded(b, 8 * LANES), np.uint64) for b in bits]), WIDE_PIVOTS)
            if forest:
                if found := _nearest_forest(part, root, size, width, fps, rows, similarity):
                    at_a, at_b = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(node[at_a]), pa.array(node[at_b])], ["a", "b"])
                continue
            last = np.searchsorted(size, size / similarity + 1e-9, side="right")
            a, b, held = [], [], 0
            for i in range(len(node) - 1):
                j = np.arange(i + 1, last[i])
                j = j[(root[j] != root[i]) & ((part[j] != part[i]) | (not across))]
                radius = (size[j] + size[i]) * share + 1e-9
                near = (np.abs(rows[j] - rows[i]) <= radius[:, None]).all(axis=1)
                j, radius = j[near], radius[near]
                own = fps[width[i]]
                j = j[_apart(own[j], own[i]) <= radius]
                a.append(np.full(len(j), node[i]))
                b.append(node[j])
                held += len(j)
                if held > SLICE or i == len(node) - 2:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                    a, b, held = [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_keys(batches, 2):
            yield from pairs(cols)

    parts = F.ceil(F.col("n") / GROUP).cast("long")
    own = company.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    cell = F.least("part", "other") * parts + F.greatest("part", "other")
    # A cell of two parts also gets the rows of both; the cell of one part gets them once.
    rows = own.withColumn("cell", cell).select("key", "cell", "part", "node", "root", "size", "bits").repartition("key", "cell").sortWithinPartitions("key", "cell")
    found = rows.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_sides(pairs: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with the columns of ``a`` and of ``b``, as <column>_a and <column>_b."""
    for s in ("a", "b"):
        side = classes.select(F.col("node").alias(f"node_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
        pairs = pairs.join(side, F.col(s) == F.col(f"node_{s}")).drop(f"node_{s}")
    return pairs


def _few_bits_agree(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, radius): written, those of the pairs that sizes and the first parity bits don't rule out; radius: bits they may differ in."""
    lanes = [f"w{k}" for k in range(LANES)]
    both = _with_sides(pairs, classes, "size", *lanes)
    bits = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in lanes), F.lit(0))
    sizes = F.least("size_a", "size_b") + 1e-9 >= F.greatest("size_a", "size_b") * similarity
    radius = (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    return written(both.filter(sizes & (bits <= radius)).select("a", "b", radius.alias("radius")), "simhash-near")


def _all_bits_agree(near: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): those pairs that all of their parity bits don't rule out either; nothing similar has gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (folded_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(4)))
            keep = np.fromiter(apart, np.int64, batch.num_rows) <= batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return _with_sides(near, classes, "wide").select("a", "b", "radius", "wide_a", "wide_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, marked: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets of distinct shingles have the Jaccard similarity, computed from the texts.

    Texts go to the pairs' ``a``, at most about GROUP of them to one place, and stream past it one at a time.
    What needs a text is written first: while it is small, it is sent to the texts, which then aren't shuffled.
    """
    near = _few_bits_agree(pairs, classes, similarity)
    pairs = written(_all_bits_agree(near, classes), "simhash-pairs")
    discard(near)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    wanted = dealt.unionByName(dealt.select("a", "part", F.col("a").alias("b")).distinct())
    place = classes.select(F.col("node").alias("b"), F.col("doc_id").alias("__quire_id"), F.col("__quire_text").alias("__quire_own"))
    need = written(wanted.join(place, "b").select(F.col("a").alias("__quire_a"), F.col("part").alias("__quire_part"), F.col("b").alias("__quire_b"), "__quire_id", "__quire_own"), "simhash-need")
    texts = marked.join(sent_if_small(need), F.col("doc_id").eqNullSafe(F.col("__quire_id")) & (F.col("__quire_text") == F.col("__quire_own")))
    texts = texts.select("__quire_a", "__quire_part", "__quire_b", "text").repartition("__quire_a", "__quire_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            found: list[tuple] = []
            for a, part, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if a == b:
                    if at != (a, part):  # rows of the centre itself come first
                        at, centre = (a, part), shingle_set(text.as_py(), shingle)
                    continue
                own = shingle_set(text.as_py(), shingle)
                shared = int((centre[np.minimum(np.searchsorted(centre, own), len(centre) - 1)] == own).sum()) if len(centre) else 0
                if shared * (1 + similarity) + 1e-9 >= similarity * (len(centre) + len(own)):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    streamed = texts.sortWithinPartitions("__quire_a", "__quire_part", F.col("__quire_a") != F.col("__quire_b"))
    edges = written(streamed.mapInArrow(run, "a long, b long").distinct(), "simhash-edges")
    discard(pairs, need)
    drop_dead_shuffles(marked.sparkSession)
    return edges


def similar_links(classes: DataFrame, marked: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): verified links between rows of ``classes`` that connect just what all links of that similarity connect.

    Similar sets share one of their rarest shingles (``keys``), so candidates share a key; that is exact. Each row is
    verified against one set of its key first. Of what is still apart, a forest of the nearest in each key comes next, no more than there are rows, and
    links most of it; what is then still apart, and only that, is verified pair by pair.
    """
    hubs = classes.select(F.explode("keys").alias("key"), "node").groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1")
    company = classes.select(F.explode("keys").alias("key"), "node").join(hubs, "key")
    company = written(company, "simhash-company")
    drop_dead_shuffles(classes.sparkSession)
    stars = company.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = _verified(stars, classes, marked, shingle, similarity)
    rows = company.filter("n > 2").select("key", "node", "n")
    for forest in (True, False):
        roots = connected_components(edges)
        rooted = rows.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        apart = written(rooted.join(mixed, "key"), "simhash-apart")
        discard(company, roots)
        edges = edges.unionByName(_verified(_near_pairs(apart.join(classes.select("node", "size", "bits"), "node"), similarity, forest), classes, marked, shingle, similarity))
        company, rows = apart, apart.select("key", "node", "n")
    discard(apart)
    return edges


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs``, as it is, of each group of texts that are similar: the smallest doc_id (null last), then the smaller hash of the text.

    Similar: Jaccard ``similarity`` or more of the distinct word shingles, or linked by a chain of such texts, so a text that
    goes may be less like the one kept. Texts without words are one group. Rows that repeat are one.
    """
    spark = docs.sparkSession
    marked = docs.withColumn("__quire_text", F.xxhash64("text"))
    lanes = [f"w{k}" for k in range(LANES)]
    sent = spark.sparkContext.broadcast(_common(marked, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                node, size, wide, some, bits, keys = [], [], [], [], [], []
                for t in batch.column(2):
                    h = shingle_set(t.as_py(), shingle)
                    node.append(xxhash.xxh64_intdigest(h.tobytes(), 42))
                    size.append(len(h))
                    wide.append(parity_bits(h))
                    some.append(folded(wide[-1], min(len(wide[-1]), 64 * LANES)))
                    bits.append(np.frombuffer(folded(wide[-1], 8 * LANES), "<u8"))
                    keys.append(_prefix(h, similarity, *sent.value).view(np.int64))
                bits = np.stack(bits).view(np.int64)
                made = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(wide, pa.binary()), pa.array(some, pa.binary()), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(LANES)], pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "__quire_text", "node", "size", "wide", "bits", *lanes, "keys"])

    schema = "doc_id long, __quire_text long, node long, size long, wide binary, bits binary, " + ", ".join(f"{w} long" for w in lanes) + ", keys array<long>"
    prints = marked.select("doc_id", "__quire_text", "text").mapInArrow(run, schema)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "__quire_text", "size", "wide", "bits", *lanes, "keys")).alias("first")
    classes = written(prints.groupBy("node").agg(first).select("node", "first.*"), "simhash-classes")
    drop_dead_shuffles(spark)
    links_ = similar_links(classes, marked, shingle, similarity)
    roots = connected_components(links_)
    kept = (
        classes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min(F.struct("late", "doc_id", "__quire_text")).alias("first")).select(F.col("first.doc_id").alias("__quire_id"), F.col("first.__quire_text").alias("__quire_own"))
    )
    kept = written(kept, "simhash-kept")
    discard(classes, roots)
    same = F.col("doc_id").eqNullSafe(F.col("__quire_id")) & (F.col("__quire_text") == F.col("__quire_own"))
    # Only rows that repeat are shuffled to drop the repeats.
    here = sent_if_small(kept)
    often = marked.select("doc_id", "__quire_text").join(here, same, "left_semi").groupBy(F.col("doc_id").alias("__quire_id"), F.col("__quire_text").alias("__quire_own")).count().filter("count > 1").drop("count")
    often = sent_if_small(written(often, "simhash-repeated"))
    out = marked.join(here, same, "left_semi")
    once, repeated = out.join(often, same, "left_anti"), out.join(often, same, "left_semi")
    return once.unionByName(repeated.dropDuplicates(["doc_id", "__quire_text"])).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, at four words and four bits."""
    out = near_duplicates(table(spark, sf_dir, "documents"), 4, 4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
