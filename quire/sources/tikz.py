"""Drawn tables: the cells of one picture of lines and nodes, by a sweep over its rows."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

from .tex import group_at

# Centimetres within which coordinates are one line, and up to which a segment counts as straight.
SNAP_CM, STRAIGHT_CM = 0.15, 0.001
#: Distance of a made outer line from its outermost node, and width of a line that tells none.
BEYOND_CM, LINE_PT = 1.0, 0.4
_NUMBER = r"(-?[0-9.]++)"
_PLACE = rf"\(\s*+{_NUMBER}\s*+,\s*+{_NUMBER}\s*+\)"
_SEGMENT = re.compile(rf"\\draw\s*+(?:\[([^\]]*+)\]\s*+)?{_PLACE}\s*+--\s*+{_PLACE}\s*+;", re.A)
_NODE = re.compile(rf"\s*(?:\[[^\]]*\])?\s*(?:at\s*)?{_PLACE}\s*", re.A)
_NODE_COMMAND = re.compile(r"\\node(?![A-Za-z])")
# A node without commands in its options whose text, if it has one, is a group without groups in it.
_PLAIN_NODE = re.compile(rf"\\node(?![A-Za-z])\s*+(?:\[[^\]\\]*+\])?\s*+(?:at\s*+)?{_PLACE}\s*+(?:\{{((?:[^\\{{}}]++|\\(?!node)[\s\S])*+)\}}|(?!\{{))", re.A)
_WIDTH = re.compile(r"line width=([0-9.]+)pt")


@lru_cache(1024)
def _pt(attrs: str) -> float:
    try:
        return float(m[1]) if (m := _WIDTH.search(attrs)) else LINE_PT
    except ValueError:
        return LINE_PT


def nodes(code: str) -> list[tuple[float, float, int, str]]:
    """(y, x, node, text) of the nodes, whatever braces their texts hold; y points down. A place that is no number is none."""
    plain = _PLAIN_NODE.findall(code)
    if len(plain) != code.count("\\node"):
        parts = ((_NODE.match(part), part) for part in _NODE_COMMAND.split(code)[1:])
        plain = [(m[1], m[2], group_at(part, m.end())[0] if part.startswith("{", m.end()) else "") for m, part in parts if m]
    found = []
    for k, (x, y, text) in enumerate(plain):
        try:
            found.append((-float(y), float(x), k, text))
        except ValueError:
            pass
    return found


def segments(code: str) -> tuple[list[tuple[float, float, float, float]], list[tuple[float, float, float, float]]]:
    """(at, lo, hi, pt) of the straight lines across, and of the upright ones. A place that is no number is none."""
    across, upright = [], []
    for attrs, a, b, c, d in _SEGMENT.findall(code):
        try:
            x1, y1, x2, y2 = float(a), -float(b), float(c), -float(d)
        except ValueError:
            continue
        if -STRAIGHT_CM < y1 - y2 < STRAIGHT_CM:
            across.append((y1, x1, x2, _pt(attrs)) if x1 <= x2 else (y1, x2, x1, _pt(attrs)))
        elif -STRAIGHT_CM < x1 - x2 < STRAIGHT_CM:
            upright.append((x1, y1, y2, _pt(attrs)) if y1 <= y2 else (x1, y2, y1, _pt(attrs)))
    return across, upright


def _snapped(values: Iterable[float]) -> list[float]:
    """The first value of each cluster of values."""
    out, last = [], None
    for v in sorted(values):
        if last is None or not v - last < SNAP_CM:
            out.append(v)
        last = v
    return out


def _told(points: list[tuple[float, float]], drawn: list[float]) -> list[float]:
    """Lines that nodes (across, v) tell: between neighbours in the fullest rows that no drawn line parts, and beyond the outermost."""
    groups, last = [], None
    for across, v in sorted(points):
        if last is None or not across - last < SNAP_CM:
            groups.append([])
        groups[-1].append(v)
        last = across
    middles, full = set(), max(map(len, groups))
    for group in groups:
        if len(group) == full > 1:
            group.sort()
            for before, v in zip(group, group[1:]):
                if v - before >= SNAP_CM and (not (k := bisect_right(drawn, v)) or drawn[k - 1] <= before):
                    middles.add((v + before) / 2)
    first, last = min(v for _, v in points), max(v for _, v in points)
    outer = [first - BEYOND_CM] if not drawn or drawn[0] > first else []
    return [*_snapped(middles), *outer, *([last + BEYOND_CM] if not drawn or drawn[-1] < last else [])]


def _grid(points: list[tuple[float, float]], ends: set[float]) -> tuple[list[bool], dict[float, int]]:
    """Whether each line of an axis is drawn, in order, and for each place the number of the last line at or before it (-1: none)."""
    drawn = _snapped(ends)
    lines = sorted([*((v, True) for v in drawn), *((v, False) for v in _told(points, drawn))])
    at = [v for v, _ in lines]
    return [real for _, real in lines], {v: bisect_right(at, v) - 1 for v in {*ends, *(v for _, v in points)}}


def _filled(parts: list[tuple[int, int, float]], n: int) -> list[float | None]:
    """The largest width drawn along each of ``n`` units."""
    out: list[float | None] = [None] * n
    for lo, hi, pt in parts:
        for k in range(lo, hi):
            if out[k] is None or out[k] < pt:
                out[k] = pt
    return out


def _closed(block: tuple) -> list[tuple]:
    """The cells of a block of rows that is complete."""
    first, start, span, sides, texts = block
    text = texts[0][3] if len(texts) == 1 else " ".join([t[3] for t in sorted(texts)])
    n = len(sides)
    if n == 1:
        return [(first, start, span, None, 1, text, *sides[0])]
    return [(first + k, start, span, "continue" if k else "restart", n, "" if k else text, *side) for k, side in enumerate(sides)]


def cells(code: str) -> Iterator[tuple]:
    """(row, col_start, grid_span, v_merge, row_span, text, top_pt, bottom_pt, left_pt, right_pt) of a picture; nothing without nodes.

    Only the lines, the nodes and the cells that are still open at a row are held, never all unit cells.
    """
    found = nodes(code)
    if not found:
        return
    across, upright = segments(code)
    ys, xs = {s[0] for s in across}, {s[0] for s in upright}
    for _, lo, hi, _ in across:
        xs.add(lo)
        xs.add(hi)
    for _, lo, hi, _ in upright:
        ys.add(lo)
        ys.add(hi)
    real_y, row_at = _grid([(n[1], n[0]) for n in found], ys)
    real_x, col_at = _grid([n[:2] for n in found], xs)
    rows, columns = len(real_y) - 1, len(real_x) - 1
    if rows < 1 or columns < 1:
        return
    along, down, texts = defaultdict(list), defaultdict(list), defaultdict(list)
    for at, lo, hi, pt in across:
        along[row_at[at]].append((col_at[lo], col_at[hi], pt))
    for at, lo, hi, pt in upright:
        down[row_at[lo]].append((row_at[hi], col_at[at], pt))
    for node in found:
        texts[row_at[node[0]], col_at[node[1]]].append(node)

    reach: list[tuple[int, int, float]] = []
    above: dict[tuple[int, int], tuple] = {}
    below = _filled(along[0], columns)
    for row in range(rows):
        top, below = below, _filled(along[row + 1], columns)
        reach = [s for s in reach + down[row] if s[0] > row]
        upright_at: list[float | None] = [None] * (columns + 1)
        for _, k, pt in reach:
            if upright_at[k] is None or upright_at[k] < pt:
                upright_at[k] = pt
        goes_on, blocks, start = real_y[row], {}, 0
        while start < columns:
            end = start + 1
            while end < columns and upright_at[end] is None and real_x[end]:
                end += 1
            if end == start + 1:
                upper, side, inside = top[start], (top[start], below[start], upright_at[start], upright_at[end]), texts.get((row, start), ())
            else:
                of_top, of_below = [pt for pt in top[start:end] if pt is not None], [pt for pt in below[start:end] if pt is not None]
                upper = max(of_top, default=None)
                side = upper if len(of_top) == end - start else None, max(of_below) if len(of_below) == end - start else None, upright_at[start], upright_at[end]
                inside = [t for k in range(start, end) for t in texts.get((row, k), ())]
            block = above.pop((start, end), None) if goes_on and upper is None else None
            if block is None:
                block = row, start, end - start, [side], [*inside]
            else:
                block[3].append(side)
                block[4].extend(inside)
            blocks[start, end] = block
            start = end
        for block in above.values():
            yield from _closed(block)
        above = blocks
    for block in above.values():
        yield from _closed(block)
