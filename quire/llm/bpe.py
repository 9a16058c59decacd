"""Byte-level BPE by folded merges, and back.

Pieces of text (matches of the tokenizer's pattern) are counted over all documents. Higher-order functions
fold the ranked merges over the byte array of each distinct frequent piece, with the rank file as a literal
map. The result, at most ``PIECES`` rows of at most ``PIECE_BYTES`` bytes, goes to the executors,
which look up each document's pieces; a piece beyond that table is merged where it occurs, by the same rule
(over a heap if it is long), so nothing is dropped and no text is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_dead_shuffles, table, text_or_empty, written

#: Distinct pieces that are broadcast at most, bytes of each at most, and pieces that a worker remembers besides.
PIECES, PIECE_BYTES, REMEMBERED = 262_144, 48, 50_000
#: Slots of the literal rank map.
SLOTS = 16_384
_NONE = 2**31 - 1
#: The characters of White_Space, which ``\\s`` stands for in the pattern's own engine, as a character class in Java and Python.
_WHITE = r"\x09-\x0d \x85\xa0  -     　"

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def portable(pattern: str = PATTERN) -> str:
    """The pattern with white space spelt out, since engines differ on what ``\\s`` matches."""
    return pattern.replace(r"[^\s", "[^" + _WHITE).replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one piece: its own rank, or else the lowest-ranked adjacent pair is merged, leftmost first, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 96:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != _NONE:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """``merge`` with a heap of (rank, start) over linked parts, for n log n steps."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def rank_map(ranks: dict[bytes, int]) -> Callable[[Column], Column]:
    """Looks up a binary column in a literal map, cut by hash into slots of ``;token=rank;`` text.

    One literal of a few strings a slot: a map of maps, as objects, makes the plan that goes to every task ten times larger.
    """
    slots = [[""] for _ in range(SLOTS)]
    for token, rank in ranks.items():
        slots[zlib.crc32(token) % SLOTS].append(f"{token.hex().upper()}={rank}")
    literal = F.split(F.lit(",".join(";".join([*s, ""]) for s in slots)), ",")  # folded to a constant

    def rank(token: Column) -> Column:
        slot = F.get(literal, (F.crc32(token) % SLOTS).cast("int"))
        after = F.split_part(slot, F.concat(F.lit(";"), F.hex(token), F.lit("=")), F.lit(2))
        return F.coalesce(F.split_part(after, F.lit(";"), F.lit(1)).try_cast("int"), F.lit(_NONE))

    return rank


def fold_merges(piece: Column, ranks: dict[bytes, int]) -> Column:
    """array<int>: tokens of a binary column, by folding one merge after the other over its parts.

    The state holds the parts, their tokens (a merged part's token is the rank of its pair), the ranks of adjacent
    pairs, and the pairs that still lack theirs (all at first, then the two beside the last merge) with their place. So the
    literal map stands in the expression once. A piece that is a token as a whole isn't looked up as such.
    """
    rank, size = rank_map(ranks), F.length(piece)
    ints, blobs = F.array().cast("array<int>"), F.array().cast("array<binary>")
    byte = F.split(F.lit(",".join(str(ranks[bytes([k])]) for k in range(256))), ",")
    parts = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(piece, i, F.lit(1)))
    ids = F.transform(parts, lambda p: F.get(byte, F.conv(F.hex(p), 16, 10).cast("int")).cast("int"))
    todo = F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(piece, i, F.lit(2)))).otherwise(blobs)

    def ranked(acc: Column) -> Column:
        pairs, at = acc["pairs"], acc["at"]
        whole = F.concat(F.slice(pairs, F.lit(1), at - 1), F.transform(acc["todo"], rank), F.slice(pairs, at, F.greatest(F.size(pairs), F.lit(1))))
        return F.struct(acc["parts"].alias("parts"), acc["ids"].alias("ids"), whole.alias("pairs"))

    def merged(s: Column) -> Column:
        parts, pairs = s["parts"], s["pairs"]
        least = F.coalesce(F.array_min(pairs), F.lit(_NONE))
        i = F.array_position(pairs, least).cast("int")
        one = F.concat(F.get(parts, i - 1), F.get(parts, i))
        left = F.when(i > 1, F.array(F.concat(F.get(parts, i - 2), one))).otherwise(blobs)
        right = F.when(i + 1 < F.size(parts), F.array(F.concat(one, F.get(parts, i + 1)))).otherwise(blobs)
        rest = lambda array, new: F.concat(F.slice(array, F.lit(1), i - 1), F.array(new), F.slice(array, i + 2, F.size(array)))
        kept = F.concat(F.slice(pairs, F.lit(1), F.greatest(i - 2, F.lit(0))), F.slice(pairs, i + 2, F.size(pairs)))
        done = _state(parts, s["ids"], pairs, F.lit(1), blobs)
        return F.when(least == _NONE, done).otherwise(_state(rest(parts, one), rest(s["ids"], least), kept, F.greatest(i - 1, F.lit(1)), F.concat(left, right)))

    step = lambda acc, _: F.get(F.transform(F.transform(F.array(acc), ranked), merged), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), size), _state(parts, ids, ints, F.lit(1), todo), step, lambda acc: acc["ids"])


def _state(parts: Column, ids: Column, pairs: Column, at: Column, todo: Column) -> Column:
    return F.struct(parts.alias("parts"), ids.alias("ids"), pairs.alias("pairs"), at.alias("at"), todo.alias("todo"))


def frequent_pieces(docs: DataFrame, limit: int = PIECES) -> DataFrame:
    """(piece, n): the most frequent distinct pieces over all documents, at most ``limit``, of at most PIECE_BYTES bytes.

    The cut is a count, found from a histogram of a few hundred classes, so nothing is sorted in one place.
    """
    pieces = docs.select(F.explode(F.regexp_extract_all(text_or_empty(), F.lit(portable()), F.lit(0))).alias("piece"))
    counts = written(pieces.groupBy("piece").agg(F.count("*").alias("n")).filter(F.octet_length("piece") <= PIECE_BYTES), "bpe-pieces")
    level = F.floor(F.log2("n") * 16)
    classes = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level)
    total, above, share = 0, None, 0.0
    for r in classes:
        if total + r.words > limit:
            share = (limit - total) / r.words  # of the first class that doesn't fit, a part by hash
            break
        total, above = total + r.words, r.level
    part = (level == (F.lit(r.level) if share else F.lit(None))) & (F.pmod(F.xxhash64("piece"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return counts.filter(part | (level >= above) if above is not None else part) if classes else counts.limit(0)


def _collected(folded: DataFrame) -> pa.Table:
    """The rows, with the literal map left out of the descriptions that Spark keeps of the plan."""
    conf, name = folded.sparkSession.conf, "spark.sql.maxPlanStringLength"
    before = conf.get(name)
    conf.set(name, "10000")
    try:
        return folded.toArrow()
    finally:
        conf.set(name, before)


def _packed(table: bytes, ranks: dict[bytes, int]) -> dict[str, bytes]:
    """Piece -> its tokens as little-endian unsigned 32-bit integers. A piece that is a token is that token, as in the tokenizer's own encoder."""
    rows = pa.ipc.open_stream(table).read_all()
    ids = rows.column("ids").combine_chunks()
    packed = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    ends = (np.cumsum(np.r_[0, ids.value_lengths().to_numpy(zero_copy_only=False)]) * 4).tolist() if len(ids) else [0]
    out = {}
    for piece, a, b in zip(rows.column("piece").to_pylist(), ends[:-1], ends[1:]):
        whole = ranks.get(piece.encode())
        out[piece] = packed[a:b] if whole is None else whole.to_bytes(4, "little")
    return out


class Encoder:
    """Frequent pieces with their tokens, and the ranks for the rest; sent to the executors once."""

    def __init__(self, docs: DataFrame, path: str = RANKS, limit: int = PIECES):
        self.ranks = load_ranks(path)
        # A bounded number of short rows: a task for each core, so that the literal map goes out no more often than that.
        frequent = frequent_pieces(docs, limit).repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism))
        folded = frequent.select("piece", fold_merges(F.encode("piece", "UTF-8"), self.ranks).alias("ids"))
        known = _collected(folded)  # at most ``limit`` short rows
        with pa.BufferOutputStream() as out:
            with pa.ipc.new_stream(out, known.schema) as stream:
                stream.write_table(known)
            self.sent = docs.sparkSession.sparkContext.broadcast((out.getvalue().to_pybytes(), self.ranks))
        drop_dead_shuffles(docs.sparkSession)

    def apply(self, docs: DataFrame, emit: Callable[[bytes, list[bytes]], tuple], schema: dict[str, str]) -> DataFrame:
        """doc_id and the columns of ``emit(tokens as little-endian unsigned 32-bit integers, token bytes by id)`` for every document."""
        sent, pattern, names = self.sent, portable(), list(schema)
        kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, ranks = sent.value
            known, more, split = _packed(table, ranks), {}, regex.compile(pattern).findall
            by_id = [b""] * (max(ranks.values(), default=-1) + 1)
            for token, k in ranks.items():
                by_id[k] = token

            def rare(piece: str) -> bytes:
                if (found := more.get(piece)) is None:
                    if len(more) >= REMEMBERED:
                        more.clear()
                    found = np.array(merge(piece.encode(), ranks), "<u4").tobytes()
                    if len(piece) <= PIECE_BYTES:
                        more[piece] = found
                return found

            for batch in batches:
                rows = []
                for text in batch.column(1):
                    rows.append(emit(b"".join([known.get(p) or rare(p) for p in split(text.as_py() or "")]), by_id))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{c: pa.array([r[k] for r in rows], kinds[schema[c]]) for k, c in enumerate(names)}})

        return docs.select("doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {kind}" for c, kind in schema.items())]))

    def encode(self, docs: DataFrame) -> DataFrame:
        """(doc_id, ids) for every document; null texts count as empty."""
        return self.apply(docs, lambda tokens, _: (np.frombuffer(tokens, "<i4"),), {"ids": "array<int>"})


def decode(ids: bytes, by_id: list[bytes]) -> bytes:
    """The bytes that packed tokens stand for: their pieces, one after the other."""
    return b"".join(map(by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decoded(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, text) for rows of (doc_id, ids): binary pieces concatenated, in SQL functions. Null ids give null."""
    ranks = load_ranks(path)
    by_id = [""] * (max(ranks.values(), default=-1) + 1)
    for token, k in ranks.items():
        by_id[k] = token.hex()
    pieces = F.from_json(F.lit(json.dumps(by_id)), "array<string>")
    return tokens.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("ids", lambda k: F.get(pieces, k)), "")), "UTF-8").alias("text"))


def digests(docs: DataFrame, path: str = RANKS, limit: int = PIECES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``."""

    def emit(tokens: bytes, by_id: list[bytes]) -> tuple:
        return len(tokens) // 4, hashlib.sha256(tokens).hexdigest(), hashlib.sha256(decode(tokens, by_id)).hexdigest()

    return Encoder(docs, path, limit).apply(docs, emit, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, encoded and decoded again."""
    return digests(table(spark, sf_dir, "documents"))
