"""TeX, bibliography and class sources: balanced scans in Arrow batches, everything regular in SQL functions."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import braces, cites, latex


_BRACE = re.compile(r"\\.|[{}]", re.S)


_FLAT = re.compile(r"\{([^\\{}]*+)\}")


def group_at(text: str, start: int) -> tuple[str, int]:
    """Content of the brace group that opens at ``start``, and the place after it; to the end if nothing closes it. Escaped braces are text."""
    if flat := _FLAT.match(text, start):
        return flat[1], flat.end()
    depth = 0
    for m in _BRACE.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return text[start + 1 : m.start()], m.end()
    return text[start + 1 :], len(text)


def command_arg(text: str, name: str) -> tuple[str, int] | None:
    """Argument of the first ``\\name{...}``, and the place after it."""
    m = re.search(rf"\\{name}\s*\{{", text)
    return group_at(text, m.end() - 1) if m else None


# --- scanners: text -> rows

def bib_entries(text: str) -> Iterator[dict]:
    for k, m in enumerate(re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", text)):
        if m[1].lower() in ("comment", "preamble", "string"):
            continue
        body, _ = group_at(text, text.index("{", m.start()))
        fields = {}
        for f in re.finditer(r'(?:^|[,\s])(author|year|title)\s*=\s*(\{|"|\d+)', body, re.I):
            value = group_at(body, f.end() - 1)[0] if f[2] == "{" else body[f.end() : body.find('"', f.end())] if f[2] == '"' else f[2]
            fields.setdefault(f[1].lower(), " ".join(value.split()))
        yield {"ord": k, "key": m[2].strip(), "author": fields.get("author", ""), "year": fields.get("year", ""), "title": fields.get("title", "")}


def figures(text: str) -> Iterator[dict]:
    """figure, figure* and strip environments that hold a picture."""
    for m in re.finditer(r"\\begin\{(figure\*?|strip)\}(.*?)\\end\{\1\}", text, re.S):
        body = m[2]
        picture = re.search(r"\\includegraphics(?:\[([^\]]*)\])?\{([^}]+)\}", body)
        if not picture or m[1] == "strip" and not re.search(r"\\@captype\s*\{figure\}", body):
            continue
        caption, after = command_arg(body, "caption") or ("", None)
        number = re.search(r"\\renewcommand\{\\thefigure\}\{([^}]+)\}", body)
        legend = [s for line in (body[after:].split("\n") if after is not None else ()) if (s := line.strip()) and s[0] not in "\\%"]
        yield {"path": picture[2], "width": picture[1] or "", "number": number[1].strip() if number else "", "caption": caption, "legend": "\n".join(legend), "is_full_width": m[1] != "figure", "start": m.start(), "end": m.end()}


_DISPLAY = r"\\begin\{((?:equation|align|multline|alignat|flalign|gather)\*?)\}(.*?)\\end\{\1\}|\\\[(.*?)\\\]|(?<!\\)\$([^$]+)\$"


def formulas(text: str) -> Iterator[dict]:
    """Displayed and inline formulas by place; a formula inside another isn't one. A label belongs to the formula before it."""
    n = 0
    for m in re.finditer(_DISPLAY, text, re.S):
        env = m[1] or ("[]" if m[3] is not None else "$")
        body = next(x for x in (m[2], m[3], m[4]) if x is not None)
        for line in re.split(r"\\\\", body) if env.startswith("gather") else [body]:
            label = command_arg(line, "label")
            clean = re.sub(r"\\label\{[^}]*\}|\\nonumber|\\notag", "", line).strip()
            if clean:
                yield {"ord": n, "type": "inline" if env == "$" else "display", "env": env, "latex": clean, "label": label[0] if label else None, "start": m.start(), "end": m.end()}
                n += 1


_MARK = re.compile(r"\\.|[{}&]", re.S)
# Stretches of cells and rows whose groups all close, two deep at most; what is deeper or stays open goes mark by mark.
_PLAIN_CELL = re.compile(r"(?:[^\\{}&]++|\\.|\{(?:[^\\{}]++|\\.|\{(?:[^\\{}]++|\\.)*+\})*+\})*+", re.S)
_ESCAPES = r"\\\\(?:\[[^\]]*\])?|\\[^\\]"
_PLAIN_ROW = re.compile(rf"(?:[^\\{{}}]++|\\[^\\]|\{{(?:[^\\{{}}]++|{_ESCAPES}|\{{(?:[^\\{{}}]++|{_ESCAPES})*+\}})*+\}})*+", re.S)
_BREAK = re.compile(r"\\\\(?:\[[^\]]*\])?")
_ROW_MARK = re.compile(r"\\\\(?:\[[^\]]*\])?|\\.|[{}]", re.S)


def _cells_of(row: str) -> list[str]:
    """Cells of a row: its parts between ``&`` outside of braces, trimmed."""
    out, at = [], 0
    while True:
        end = _PLAIN_CELL.match(row, at).end()
        out.append(row[at:end].strip())
        if end == len(row):
            return out
        if row[end] != "&":
            break
        at = end + 1
    out, depth, begin = [], 0, 0
    for m in _MARK.finditer(row):
        mark = m[0]
        if mark == "&":
            if depth == 0:
                out.append(row[begin : m.start()].strip())
                begin = m.end()
        elif mark == "{":
            depth += 1
        elif mark == "}":
            depth -= 1
    return [*out, row[begin:].strip()]


def _rows_of(body: str) -> list[str]:
    """Rows of a tabular: its parts between double backslashes outside of braces."""
    out, at = [], 0
    while True:
        end = _PLAIN_ROW.match(body, at).end()
        out.append(body[at:end])
        if end == len(body):
            return out
        cut = _BREAK.match(body, end)
        if not cut:
            break
        at = cut.end()
    out, depth, begin = [], 0, 0
    for m in _ROW_MARK.finditer(body):
        mark = m[0]
        if mark == "{":
            depth += 1
        elif mark == "}":
            depth = max(0, depth - 1)
        elif depth == 0 and mark.startswith("\\\\"):
            out.append(body[begin : m.start()])
            begin = m.end()
    return [*out, body[begin:]]


def columns_of(form: str) -> list[str]:
    """Column kinds of a tabular format: letters, with their widths; what ``@``, ``!``, ``<`` and ``>`` put between goes, ``*{3}{..}`` is written out."""
    out, at = [], 0
    while at < len(form):
        kind, at = form[at], at + 1
        if kind not in "@!<>*pmb":
            out += [kind] if kind in "lcr" else []
            continue
        if form[at : at + 1] != "{":
            continue
        inside, at = group_at(form, at)
        if kind in "pmb":
            out.append(f"{kind}{{{inside}}}")
        elif kind == "*" and form[at : at + 1] == "{":
            repeated, at = group_at(form, at)
            out += columns_of(repeated) * (int(inside) if inside.strip().isdigit() else 1)
    return out


@lru_cache(1024)
def _width_of(form: str) -> int:
    """How many columns a format has; sources repeat theirs."""
    return len(columns_of(form))


_SPANNING = {name: re.compile(rf"\\{name}\s*(?=\{{)") for name in ("multicolumn", "multirow")}


def _told(cell: str, name: str, groups: int) -> list[str] | None:
    """The ``groups`` arguments of ``\\name`` at the start of a cell, whatever braces they hold; None if it doesn't begin with that."""
    m = _SPANNING[name].match(cell)
    if not m:
        return None
    found, at = [], m.end()
    for _ in range(groups):
        if cell[at : at + 1].isspace():
            at = len(cell) - len(cell[at:].lstrip())
        if cell[at : at + 1] != "{":
            return None
        inside, at = group_at(cell, at)
        found.append(inside)
    return found


def _spans(cell: str) -> tuple[int, int, str]:
    """Columns, rows and content of a cell; \\multicolumn and \\multirow stand in either order."""
    wide, tall = 1, 1
    for _ in range(2):
        if not cell.startswith("\\multi"):
            break
        if (told := _told(cell, "multicolumn", 3)) and told[0].strip().isdigit():
            wide, cell = int(told[0]), told[2].strip()
        elif (told := _told(cell, "multirow", 3)) and told[0].strip().isdigit():
            tall, cell = int(told[0]), told[2].strip()
    return wide, tall, cell


def placed(row: list[tuple[int, int, str]], columns: int, held: dict[int, tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, str | None, str]], dict[int, tuple[int, int, int]]]:
    """The cells (columns, rows, content) of a row at their columns, and what taller cells hold for the next row.

    ``held`` has (rows left, first column, columns) for each column that a cell above still covers. There the row goes on with that
    cell; the empty cell that code usually writes for it is passed over. A row that writes none, since its cells would fit beside
    what is held, just moves on. Gives (col_start, grid_span, row_span, v_merge, content).
    """
    writes = sum(wide for wide, _, _ in row) > columns - len(held)
    out, after, column, todo = [], {}, 0, list(row)
    while todo or column in held:
        if column in held:
            left, first, wide = held[column]
            after |= {c: (left - 1, first, wide) for c in range(first, first + wide) if left > 1}
            wide -= column - first  # less than all of it only where a cell overlaps it, which code shouldn't do
            out.append((column, wide, 1, "continue", ""))
            passed = 0
            while writes and todo and passed < wide:
                passed += todo.pop(0)[0]
            column += wide
        else:
            wide, tall, content = todo.pop(0)
            out.append((column, wide, tall, "restart" if tall > 1 else None, content))
            after |= {c: (tall - 1, column, wide) for c in range(column, column + wide) if tall > 1}
            column += wide
    return out, after


_TABULAR = re.compile(r"\\begin\{tabular\}\s*\{")
_RULE = re.compile(r"\\(?:toprule|midrule|bottomrule|hline|cline)")
_RULES = re.compile(r"\\(?:toprule|midrule|bottomrule|hline|cline\{[^}]*\}|cmidrule(?:\([^)]*\))?\{[^}]*\})")
_COMMAND, _SIGNS = re.compile(r"\\[A-Za-z]+\s*"), re.compile(r"[{}$]")


def _read_cell(code: str) -> tuple[int, int, tuple[str, bool, bool]]:
    """Columns and rows of a cell, and its content: plain text, whether bold, whether italic."""
    wide, tall, inner = _spans(code)
    if "\\" not in inner:
        return wide, tall, (_SIGNS.sub("", inner).strip(), False, False)
    plain = _SIGNS.sub("", _COMMAND.sub("", inner)).strip()
    return wide, tall, (plain, "\\textbf" in inner or "\\bfseries" in inner, "\\textit" in inner or "\\itshape" in inner)


#: Short cells come again and again (units, flags, empty ones), so the last of them are kept read.
_read_short = lru_cache(8192)(_read_cell)
_SHORT = 64


def tabulars(text: str) -> Iterator[dict]:
    """A row for each cell of each tabular, wherever it stands; spans by \\multicolumn and \\multirow, cells below a taller one as its continuation, rules as borders."""
    for t, m in enumerate(_TABULAR.finditer(text)):
        form, at = group_at(text, m.end() - 1)
        end = text.find(r"\end{tabular}", at)
        body, columns = text[at : end if end >= 0 else len(text)], _width_of(form)
        outer = text.rfind(r"\begin{table", 0, m.start())
        closed = text.rfind(r"\end{table", 0, m.start())
        caption = command_arg(text[outer : m.start()], "caption") if outer > closed else None
        if caption is None and outer > closed and end >= 0:
            caption = command_arg(text[end : text.find(r"\end{table", end)], "caption")
        r, held = 0, {}
        for line in _rows_of(body):
            rules = _RULE.search(line) is not None
            line = _RULES.sub("", line).strip()
            if not line and not (held and len(held) == columns):
                continue
            cells, held = placed([_read_short(c) if len(c) <= _SHORT else _read_cell(c) for c in _cells_of(line)] if line else [], columns, held)
            for column, wide, tall, merge, content in cells:
                plain, bold, italic = content or ("", False, False)
                yield {"table_ord": t, "columns": columns, "caption": caption[0] if caption else None, "row": r, "col_start": column, "grid_span": wide, "row_span": tall, "v_merge": merge, "text": plain, "bold": bold, "italic": italic, "rule_above": rules}
            r += 1


# The comments that keep a long table's TikZ code, and the mark of a full-width one.
_KEPT = r"% WORD_SUPERTABLE_BEGIN number=([^\n]*)\n% WORD_SUPERTABLE_TIKZ=([A-Za-z0-9+/=]+)\n(.*?)% WORD_SUPERTABLE_END"
_FULL_WIDTH = "% meta:full_width=1"


def _decoded(code: str) -> str | None:
    try:
        return base64.b64decode(code, validate=True).decode()
    except ValueError:
        return None


def tikz_tables(text: str) -> Iterator[dict]:
    """TikZ pictures that are tables: in table environments, in strips that say so, and kept as comments of long tables."""
    found = []
    for m in re.finditer(r"\\begin\{(table\*?|strip)\}(.*?)\\end\{\1\}", text, re.S):
        picture = re.search(r"\\begin\{tikzpicture\}(.*?)\\end\{tikzpicture\}", m[2], re.S)
        if not picture:
            continue
        around = m[2][: picture.start()] + m[2][picture.end() :]
        if m[1] == "strip" and not re.search(r"\\@captype\s*\{table\}", around):
            continue
        number = re.search(r"\\renewcommand\{\\thetable\}\{([^}]+)\}", around)
        found.append((m, m[1], number[1].strip() if number else "", command_arg(around, "caption"), picture[1], m[1] != "table"))
    for m in re.finditer(_KEPT, text, re.S):
        body = _decoded(m[2])
        if body is not None:
            found.append((m, "supertabular", m[1].strip(), command_arg(m[3], "tablecaption"), body, _FULL_WIDTH in body))
    for k, (m, kind, number, caption, body, full) in enumerate(sorted(found, key=lambda f: f[0].start())):
        yield {"ord": k, "kind": kind, "number": number, "caption": caption[0] if caption else "", "body": body, "is_full_width": full, "start": m.start(), "end": m.end()}


def conditions(text: str) -> Iterator[dict]:
    """Parameters of a class file with the branch that they stand in, by a real stack of \\if ... \\else ... \\fi."""
    stack: list[list] = []
    pattern = r"\\if@?(?:stage@)?(\w+)|\\(else)\b|\\(fi)\b|\\@(twocolumntrue)|\\(textwidth|textheight|columnsep)\s*=?\s*(?:\{)?([0-9.]+)\s*mm"
    for m in re.finditer(pattern, text):
        if m[1]:
            stack.append([m[1], True])
        elif m[2] and stack:
            stack[-1][1] = False
        elif m[3] and stack:
            stack.pop()
        elif m[4] or m[5]:
            branch = "/".join(("" if yes else "not ") + name for name, yes in stack) or "shared"
            yield {"branch": branch, "param": "column_count" if m[4] else m[5], "value": 2.0 if m[4] else float(m[6])}


_SCHEMAS = {
    bib_entries: "ord int, key string, author string, year string, title string",
    figures: "path string, width string, number string, caption string, legend string, is_full_width boolean, start int, end int",
    formulas: "ord int, type string, env string, latex string, label string, start int, end int",
    tabulars: "table_ord int, columns int, caption string, row int, col_start int, grid_span int, row_span int, v_merge string, text string, bold boolean, italic boolean, rule_above boolean",
    tikz_tables: "ord int, kind string, number string, caption string, body string, is_full_width boolean, start int, end int",
    conditions: "branch string, param string, value double",
}
_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


#: Records that ``scan`` gives on at once, at about.
_BATCH = 10_000


def scan(docs: DataFrame, scanner: Callable[[str], Iterator[dict]], text: str = "text", key: str = "doc_id", only: tuple[str, ...] = ()) -> DataFrame:
    """The key of each row of ``docs`` with every record that ``scanner`` finds in its text, or only some fields of it; null texts give none."""
    fields = [f for f in (f.split() for f in _SCHEMAS[scanner].split(", ")) if not only or f[0] in only]
    kind = dict(docs.dtypes)[key]
    own = pa.int64() if kind == "bigint" else pa.string()
    schema = pa.schema([(key, own), *((n, _KINDS[k]) for n, k in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [], []

        def made() -> pa.RecordBatch:
            columns = [keys, *([r[n] for r in rows] for n, _ in fields)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r in scanner(t or ""):
                    keys.append(k)
                    rows.append(r)
                if len(rows) >= _BATCH:
                    yield made()
                    keys.clear()
                    rows.clear()
        yield made()

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, " + ", ".join(" ".join(f) for f in fields))


# --- bibliography lists, in SQL functions

def bbl_items(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ord, item_key, label, cite, plain_text, doi_url, external_url) of a .bbl text: split at \\bibitem, cut at the list's end.

    ``label`` is what stands in square brackets, whatever it holds, else the running number; ``cite`` is how it is cited.
    """
    body = F.regexp_replace(text, r"(?s)\\end\{thebibliography\}.*", "")
    parts = F.filter(F.split(body, r"\\bibitem"), lambda x, k: k > 0)
    items = docs.select(key, F.posexplode(parts).alias("ord", "item")).withColumn("__quire_label", braces.group(F.col("item"), F.lit(1), "[", "]"))
    rest = F.when(F.col("__quire_label").isNull(), F.col("item")).otherwise(F.substring("item", F.length("__quire_label") + 3, F.length("item")))
    items = items.withColumn("__quire_rest", rest)
    head = r"(?s)^\{([^}]+)\}(.*)$"
    raw = F.trim(F.regexp_extract("__quire_rest", head, 2))
    told = F.nullif("__quire_label", F.lit(""))
    number = (F.col("ord") + 1).cast("string")
    return items.filter(F.col("__quire_rest").rlike(head) & (raw != "")).select(
        key, "ord", F.trim(F.regexp_extract("__quire_rest", head, 1)).alias("item_key"), F.coalesce(told, number).alias("label"), F.coalesce(cites.bbl_label(told), number).alias("cite"),
        latex.bbl_plain(raw).alias("plain_text"), cites.doi(raw).alias("doi_url"), cites.url(raw).alias("external_url"),
    )


# --- tables as TikZ with their own description, and back

def table_code(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code): TikZ of a table's cells (row, col_start, grid_span, text, width_twips) in one aggregation, the cells themselves as a base64 comment first."""
    cell = F.struct("row", "col_start", "grid_span", "text", "width_twips")
    node = lambda c: F.format_string("\\\\node at (%d,-%d) {%s};", c["col_start"], c["row"], latex.escape(c["text"]))
    grouped = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    meta = F.regexp_replace(F.base64(F.encode(F.to_json("cells"), "UTF-8")), r"\s", "")
    lines = F.array_join(F.transform("cells", node), "\n")
    return grouped.select(*keys, F.concat(F.lit("% table-meta: "), meta, F.lit("\n\\begin{tikzpicture}\n"), lines, F.lit("\n\\end{tikzpicture}")).alias("code"))


CELLS = "array<struct<row:int,col_start:int,grid_span:int,text:string,width_twips:int>>"


def cells_of_code(code: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of TikZ tables: from the description where there is one, all in SQL functions; else from the nodes' places."""
    meta = F.regexp_extract("code", r"% table-meta: ([A-Za-z0-9+/=]+)", 1)
    told = code.filter(meta != "").select(*keys, F.inline(F.from_json(F.decode(F.unbase64(meta), "UTF-8"), CELLS)))
    node = r"\\node at \(([0-9.]+),-?([0-9.]+)\) \{((?:[^{}]|\{[^{}]*\})*)\};"
    parts = [F.regexp_extract_all("code", F.lit(node), F.lit(k)) for k in (1, 2, 3)]
    seen = code.filter(meta == "").select(*keys, F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "xyt")])).alias("c"))
    guessed = seen.select(*keys, F.col("c.y").try_cast("double").cast("int").alias("row"), F.col("c.x").try_cast("double").cast("int").alias("col_start"), F.lit(1).alias("grid_span"), latex.plain(F.col("c.t")).alias("text"), F.lit(None).cast("int").alias("width_twips"))
    return told.unionByName(guessed)


def decode_meta(code: str) -> list[dict]:
    """The description that a table's code carries."""
    found = re.search(r"% table-meta: ([A-Za-z0-9+/=]+)", code)
    return json.loads(base64.b64decode(found[1])) if found else []
