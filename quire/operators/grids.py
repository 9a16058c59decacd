"""Tables that are only drawn: TikZ code of lines and nodes from cells, and the cells back from lines and nodes.

Reading goes through a planar grid, and a picture is read where its code stands, so nothing is shuffled. Coordinates snap to lines; a
point finds its line by its place among them. Lines cut the table into unit cells with an edge on each side. Neighbours without
an edge between them are one cell: runs within a row are islands, equal runs without an edge between rows are islands again,
so spans and vertical merges are rectangles found by one sweep down the rows. A line that is drawn nowhere, only told by nodes, always separates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import braces, latex
from ..sources import tex, tikz
from . import ordered as O
from .rounds import settled

#: Fixed value: height of a drawn row in centimetres.
ROW_CM = 0.6


def drawn_code(cells: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code): a tikzpicture with the four sides of each cell as lines and its text as a node in its middle.

    ``cells`` has (keys, row, col_start, grid_span, row_span, text, pt), merged cells once; ``widths`` has (keys, col, width_cm).
    Cells meet the places of all columns of their key at once, and lines are written only where a key's cells have come together.
    Places are written as text once for each cell and column, not once for each side.
    """
    w = O.ordered(keys, "col")
    right = F.sum("width_cm").over(O.up_to_here(w))
    cm = lambda c: F.format_string("%.3f", c)
    places = widths.filter("col is not null").select(*keys, F.col("col").cast("long").alias("__quire_col"), (right - F.col("width_cm")).alias("x0"), right.alias("x1"))
    places = places.select(*keys, "__quire_col", F.struct("x0", "x1", cm(F.col("x0")).alias("left"), cm(F.col("x1")).alias("right")).alias("__quire_at"))
    places = places.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__quire_col", "__quire_at"))).alias("__quire_places"))
    y0, y1 = F.col("row") * F.lit(-ROW_CM), (F.col("row") + F.col("row_span")) * F.lit(-ROW_CM)
    written = cells.select(
        *keys, "row", "col_start", "grid_span", "row_span", "pt", cm(y0).alias("__quire_upper"), cm(y1).alias("__quire_lower"), F.format_string("\\draw[line width=%.1fpt] (", F.col("pt")).alias("draw"),
        F.concat(F.lit(","), cm((y0 + y1) / 2), F.lit(") {"), latex.escape(F.col("text")), F.lit("};")).alias("node"),
    )
    # What comes behind a place of x in a line: a place of y, and the rest of the code up to the next place, or to the end.
    ends = [F.concat(F.lit(","), f"__quire_{n}", F.lit(rest)).alias(f"{n}_{kind}") for n in ("upper", "lower") for kind, rest in (("turn", ") -- ("), ("stop", ");"))]
    cell = F.struct("row", "col_start", "grid_span", "row_span", "pt", "node", "draw", *ends)
    made = written.select(*keys, cell.alias("__quire_cell")).groupBy(*keys).agg(F.array_sort(F.collect_list("__quire_cell")).alias("__quire_all")).join(places, keys)
    at = lambda col: F.try_element_at("__quire_places", col.cast("long"))
    placed = F.transform("__quire_all", lambda c: F.struct(c.alias("c"), at(c["col_start"]).alias("a"), at(c["col_start"] + c["grid_span"] - 1).alias("b")))
    made = made.withColumn("__quire_all", F.filter(placed, lambda p: p["a"]["x0"].isNotNull() & p["b"]["x1"].isNotNull())).filter(F.size("__quire_all") > 0)

    def sides(p: Column) -> Column:
        left, right = p["a"]["left"], p["b"]["right"]
        line = lambda x0, begin, x1, end: F.concat(p["c"]["draw"], x0, p["c"][f"{begin}_turn"], x1, p["c"][f"{end}_stop"])
        return F.array(line(left, "upper", right, "upper"), line(left, "lower", right, "lower"), line(left, "upper", left, "lower"), line(right, "upper", right, "lower"))

    node = lambda p: F.concat(F.lit("\\node[align=center] at ("), cm((p["a"]["x0"] + p["b"]["x1"]) / 2), p["c"]["node"])
    lines = F.array_distinct(F.flatten(F.transform("__quire_all", sides)))
    code = F.concat(F.lit("\\begin{tikzpicture}\n"), F.array_join(F.concat(lines, F.transform("__quire_all", node)), "\n"), F.lit("\n\\end{tikzpicture}"))
    return made.select(*keys, code.alias("code"))


_CELL = {"row": pa.int32(), "col_start": pa.int32(), "grid_span": pa.int32(), "v_merge": pa.string(), "row_span": pa.int32(), "text": pa.string(), "top_pt": pa.float64(), "bottom_pt": pa.float64(), "left_pt": pa.float64(), "right_pt": pa.float64()}
_KINDS = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double"}
#: Cells that are given on at once, at most.
_BATCH = 10_000


def drawn_cells(code: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col_start, grid_span, v_merge, row_span, text, top_pt, bottom_pt, left_pt, right_pt) of drawn tables in ``code``.

    ``v_merge`` is ``restart`` at the first row of a cell over several and ``continue`` below, where the text is empty. A side has a
    width if all of it is drawn, the largest of its parts. Several nodes of a cell are joined by spaces, from the top and the left.
    A picture without nodes is no table. A row of ``code`` is a picture, whose cells come in no order; rows without a key give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ((k, *cell) for k, text in enumerate(batch.column(len(keys))) for cell in tikz.cells(text.as_py() or ""))
            while some := list(islice(found, _BATCH)):
                at, *columns = zip(*some)
                own = [batch.column(n).take(pa.array(at, pa.int32())) for n in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns, _CELL.values())], [*keys, *_CELL])

    own = code.select(*keys, "code").dropna(subset=keys)
    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} {_KINDS[t]}" for n, t in _CELL.items())]))


def tables_of_tex(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, kind, table_ord, row, col_start, grid_span, v_merge, text): the cells of all tables of TeX sources, each kind numbered by place.

    ``tabular`` ones are read row by row; ``tikz`` ones from their own description where they carry one, else from their lines and nodes.
    """
    shape = ["row", "col_start", "grid_span", "v_merge", "text"]
    tabular = tex.scan(docs, tex.tabulars, text, key).select(key, F.lit("tabular").alias("kind"), "table_ord", *shape)
    pictures = settled(tex.scan(docs, tex.tikz_tables, text, key).select(key, F.col("ord").alias("table_ord"), F.col("body").alias("code")), "tikz-tables")
    described = F.col("code").contains("% table-meta: ")
    told = tex.cells_of_code(pictures.filter(described), [key, "table_ord"]).withColumn("v_merge", F.lit(None).cast("string"))
    seen = drawn_cells(pictures.filter(~described), [key, "table_ord"]).withColumn("text", braces.cell_text(F.col("text")))
    tikz = told.select(key, "table_ord", *shape).unionByName(seen.select(key, "table_ord", *shape))
    return tabular.unionByName(tikz.select(key, F.lit("tikz").alias("kind"), "table_ord", *shape))
