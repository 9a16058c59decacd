"""Positions of regular-expression matches with built-in functions only.

``split`` gives the text between matches and ``regexp_extract_all`` the matches, so running lengths give each
match's place, in code points and in bytes (ends exclusive). Running values are folded in two levels, within blocks
of an array and over the blocks, so that the time follows the length of a text and not its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``at`` and ``stop`` are the place in bytes.
SPAN = "array<struct<kind:string,rank:int,start:int,end:int,value:string,at:int,stop:int>>"
BLOCK = 256


def no_spans(kind: str = SPAN) -> Column:
    return F.array().cast(kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, add: Callable, emit: Callable, empty: Column) -> Column:
    """The arrays that ``emit(carry, item)`` gives for each item, one after the other.

    carry is what ``add(carry, item)`` gives from ``zero`` over the items before; ``add(carry, None, other)`` joins two carries.
    """

    def over(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: add(a, x)))
        start = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("out"))
        before = F.aggregate(sums, start, lambda a, s: F.struct(add(a["now"], None, s).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")), lambda a: a["out"])
        step = lambda a, x: F.struct(add(a["now"], x).alias("now"), F.concat(a["out"], emit(a["now"], x)).alias("out"))
        return F.flatten(F.zip_with(blocks, before, lambda b, c: F.aggregate(b, F.struct(c.alias("now"), empty.alias("out")), step, lambda a: a["out"])))

    def cut(whole: Column) -> Column:
        last = F.floor((F.greatest(F.size(whole), F.lit(1)) - 1) / BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(whole, k * BLOCK + 1, F.lit(BLOCK))), over)

    return let(items, lambda whole: F.when(F.size(whole) == 0, empty).otherwise(cut(whole)))


def _gaps(text: Column, kind: str, rank: int, pattern: str, probe: Column | None, keep: Callable[[Column], Column] | None) -> Column:
    """The matches of a pattern, each with the text before it, and a last one for the text behind them all; none where ``probe`` fails."""
    gaps = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda m, p: F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), m.alias("value"), (m.isNotNull() & (keep(m) if keep else F.lit(True))).alias("wanted"),
            F.length(p).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size"), F.octet_length(p).alias("byte_gap"), F.coalesce(F.octet_length(m), F.lit(0)).alias("byte_size"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,rank:int,value:string,wanted:boolean,gap:int,size:int,byte_gap:int,byte_size:int>>")
    return F.when(probe if probe is not None else text.rlike(pattern), gaps).otherwise(none)


def find_all(text: Column, *rules: tuple) -> Column:
    """Leftmost non-overlapping matches of each rule's pattern whose value passes its condition, rule by rule.

    A rule is (kind, rank, pattern, probe, keep). probe: a cheap condition that holds wherever a match can be kept, or None for the pattern
    itself; other rows skip the two passes. keep: the condition, or None. Places are folded by one expression, whatever the number of rules.
    """
    place = lambda chars, octets: F.struct(chars.alias("chars"), octets.alias("octets"))

    def add(a: Column, x: Column | None, other: Column | None = None) -> Column:
        if x is None:
            return place(a["chars"] + other["chars"], a["octets"] + other["octets"])
        return place(a["chars"] + x["gap"] + x["size"], a["octets"] + x["byte_gap"] + x["byte_size"])

    def emit(a: Column, x: Column) -> Column:
        start, at = a["chars"] + x["gap"], a["octets"] + x["byte_gap"]
        span = F.struct(
            x["kind"].alias("kind"), x["rank"].alias("rank"), start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"), at.alias("at"), (at + x["byte_size"]).alias("stop")
        )
        return F.when(x["wanted"], F.array(span)).otherwise(no_spans())

    return F.flatten(F.transform(F.array(*[_gaps(text, *rule) for rule in rules]), lambda gaps: running(gaps, place(F.lit(0), F.lit(0)), add, emit, no_spans())))


def find_spans(text: Column, kind: str, rank: int, pattern: str, probe: Column | None = None, keep: Callable[[Column], Column] | None = None) -> Column:
    """``find_all`` of one rule."""
    return find_all(text, (kind, rank, pattern, probe, keep))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with each span replaced by ``label(span)``.

    Of spans that overlap, the first (by start, then end) gives its label; the others only lengthen what goes.
    """
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("at", "stop", "start", "end", "rank", "kind", "value")])))

    def add(a: Column, x: Column | None, other: Column | None = None) -> Column:
        return F.greatest(a, other if x is None else x["stop"])

    def whole(raw: Column) -> Column:
        def emit(a: Column, x: Column) -> Column:
            gap = F.decode(F.substring(raw, a + 1, F.greatest(x["at"] - a, F.lit(0))), "UTF-8")
            return F.when(x["at"] >= a, F.array(gap, label(x))).otherwise(no_spans("array<string>"))

        parts = running(sorted_, F.lit(0), add, emit, no_spans("array<string>"))
        end = F.array_max(F.transform(spans, lambda s: s["stop"]))
        return F.concat(F.array_join(parts, ""), F.decode(F.substring(raw, end + 1, F.length(raw)), "UTF-8"))

    return F.when(F.size(spans) == 0, text).otherwise(let(text.cast("binary"), whole))
