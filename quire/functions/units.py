"""Lengths and sizes; the unit is in each name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Millimetres of a LaTeX unit, as the length reader and the geometry reader have them.
UNIT_MM = {"pt": 0.3515, "mm": 1.0, "cm": 10.0, "in": 25.4, "bp": 0.3528, "dd": 0.376, "cc": 4.512}


def border_eighths(pt: Column) -> Column:
    """Line width in points to Word's steps in eighths of a point."""
    return F.when(pt >= 1.0, 8).when(pt >= 0.7, 6).otherwise(4)


def border_pt(eighths: Column) -> Column:
    return F.when(eighths >= 8, F.lit(1.2)).when(eighths >= 4, F.lit(0.4)).otherwise(F.lit(0.0))


def cm_to_twips(cm: Column) -> Column:
    return F.bround(cm * 567).cast("long")


def length_mm(text: Column) -> Column:
    """Number and unit at the start of the text, in millimetres; null without one."""
    pattern = r"^\s*([0-9.]+)\s*(pt|mm|cm|in|bp|dd|cc)"
    units = F.create_map(*[F.lit(x) for pair in UNIT_MM.items() for x in pair])
    return F.round(F.regexp_extract(text, pattern, 1).try_cast("double") * F.element_at(units, F.regexp_extract(text, pattern, 2)), 6)


def dimension_mm(text: Column) -> Column:
    """Signed sum of terms with units: ``210mm-2cm+1in``."""
    units = F.create_map(*[F.lit(x) for pair in UNIT_MM.items() for x in pair])
    pattern = F.lit(r"([+-]?)\s*([0-9.]+)\s*(pt|mm|cm|in|bp|dd|cc)")
    signs, values, names = (F.regexp_extract_all(text, pattern, F.lit(k)) for k in (1, 2, 3))
    signed = F.zip_with(signs, values, lambda s, v: F.when(s == "-", -1).otherwise(1) * v.try_cast("double"))
    return F.round(F.aggregate(F.zip_with(signed, names, lambda v, n: v * F.element_at(units, n)), F.lit(0.0), lambda a, x: a + x), 6)


def line_capacity(width_mm: Column) -> Column:
    """Characters that a displayed equation may take on a line."""
    return F.when(width_mm > 0, F.greatest(F.lit(32.0), width_mm / 2.35))


def twips_to_cm(twips: Column) -> Column:
    return twips / 567.0


def snapped(positions: Column, drawn: Column, near: float = 0.15, beyond: float = 0.01) -> Column:
    """Grid positions after the drawn coordinates, taken in ascending order: each moves the nearest position if it is closer
    than ``near``, else the first or last if it lies ``beyond`` them. Positions that have moved count as moved."""

    def step(at: Column, x: Column) -> Column:
        gap = F.transform(at, lambda p: F.abs(p - x))
        place = F.when(F.array_min(gap) < near, F.array_position(gap, F.array_min(gap))).when(x < F.get(at, 0) - beyond, 1).when(x > F.get(at, F.size(at) - 1) + beyond, F.size(at))
        return F.when(place.isNull(), at).otherwise(F.transform(at, lambda p, k: F.when(k + 1 == place, x).otherwise(p)))

    return F.aggregate(F.array_sort(drawn), positions, step)
