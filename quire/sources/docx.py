"""Word packages as typed rows: blocks, runs, table cells, field citations, formulas, media; and a writer for tables.

A package is a ``binaryFile`` row; parsing keeps mixed-content order, so it runs in Arrow batches. Each file is parsed once
for each kind of row asked for, or once for several (``gathered``), and only columns asked for are worked out. All kinds share one ordinal: (path, block_ord), the place in the body. The
older ordinals over paragraphs only, from 0 (para_ord) and over all paragraphs, cells included (any_ord), are columns.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import omml

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = omml.M
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P, _TBL, _T, _TAB, _PPR, _RUN_TAG, _LINK, _BLIP = W + "p", W + "tbl", W + "t", W + "tab", W + "pPr", W + "r", W + "hyperlink", _A + "blip"
_FORMULAS = (M + "oMath", M + "oMathPara")
#: Bytes of finished packages, or rows read from them, that go on together at about.
TOGETHER, ROWS = 1 << 20, 4096

_RUN = pa.struct([("type", pa.string()), ("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("size_pt", pa.float64()), ("color", pa.string()), ("target", pa.string())])
SCHEMAS = {
    "blocks": pa.schema([("path", pa.string()), ("block_ord", pa.int32()), ("para_ord", pa.int32()), ("any_ord", pa.int32()), ("kind", pa.string()), ("style", pa.string()), ("alignment", pa.string()), ("indent_pt", pa.float64()), ("text", pa.string()), ("has_formula", pa.bool_()), ("runs", pa.list_(_RUN))]),
    "cells": pa.schema([("path", pa.string()), ("table_ord", pa.int32()), ("block_ord", pa.int32()), ("row", pa.int32()), ("cell", pa.int32()), ("col_start", pa.int32()), ("grid_span", pa.int32()), ("v_merge", pa.string()), ("width_twips", pa.int32()), ("text", pa.string()), ("borders", pa.map_(pa.string(), pa.string()))]),
    "citations": pa.schema([("path", pa.string()), ("any_ord", pa.int32()), ("source", pa.string()), ("target", pa.string()), ("display", pa.string())]),
    "formulas": pa.schema([("path", pa.string()), ("block_ord", pa.int32()), ("ord", pa.int32()), ("type", pa.string()), ("before", pa.string()), ("latex", pa.string())]),
    "pictures": pa.schema([("path", pa.string()), ("block_ord", pa.int32()), ("ord", pa.int32()), ("rel_id", pa.string()), ("name", pa.string())]),
    "media": pa.schema([("path", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("rel_id", pa.string()), ("content", pa.binary())]),
}
_SQL = {
    "blocks": "path string, block_ord int, para_ord int, any_ord int, kind string, style string, alignment string, indent_pt double, text string, has_formula boolean, runs array<struct<type:string,text:string,bold:boolean,italic:boolean,size_pt:double,color:string,target:string>>",
    "cells": "path string, table_ord int, block_ord int, row int, cell int, col_start int, grid_span int, v_merge string, width_twips int, text string, borders map<string,string>",
    "citations": "path string, any_ord int, source string, target string, display string",
    "formulas": "path string, block_ord int, ord int, type string, before string, latex string",
    "pictures": "path string, block_ord int, ord int, rel_id string, name string",
    "media": "path string, ord int, name string, size long, rel_id string, content binary",
}


#: Columns of blocks beyond SCHEMAS, for those who ask: ``formulas``, how many runs of a paragraph are formulas.
_MORE = {"blocks": pa.schema([("formulas", pa.int32())])}


def _val(e: ET.Element | None, path: str) -> str | None:
    found = e.find(W + path) if e is not None else None
    return None if found is None else found.get(W + "val", "true")


def _on(e: ET.Element | None, name: str) -> bool | None:
    v = _val(e, name)
    return None if v is None else v not in ("0", "false", "none")


def _text(e: ET.Element) -> str:
    return "".join(["\t" if t.tag == _TAB else t.text or "" for t in e.iter() if t.tag == _T or t.tag == _TAB])


def _number(v: str | None, scale: float) -> float | None:
    return None if v is None or not re.fullmatch(r"-?\d+", v) else int(v) / scale


def _runs(p: ET.Element) -> Iterator[dict]:
    for e in p:
        if e.tag == _RUN_TAG:
            pr = e.find(W + "rPr")
            if pr is None:
                yield {"type": "text", "text": _text(e)}
                continue
            color = pr.find(W + "color")
            yield {"type": "text", "text": _text(e), "bold": _on(pr, "b"), "italic": _on(pr, "i"), "size_pt": _number(_val(pr, "sz"), 2), "color": None if color is None else color.get(W + "val"), "target": None}
        elif e.tag == _LINK:
            yield {"type": "link", "text": _text(e), "target": e.get(W + "anchor") or e.get(_R + "id")}
        elif e.tag in _FORMULAS:
            yield {"type": "formula", "text": omml.inside(e)}


def _indent(p: ET.Element, pr: ET.Element | None) -> float | None:
    ind = pr.find(W + "ind") if pr is not None else None
    return _number(ind.get(W + "firstLine"), 20) if ind is not None else None


#: What a paragraph and its properties give for a column.
_PARAGRAPH = {
    "style": lambda p, pr: _val(pr, "pStyle"), "alignment": lambda p, pr: _val(pr, "jc"), "indent_pt": _indent, "text": lambda p, pr: _text(p), "has_formula": lambda p, pr: next(p.iter(M + "oMath"), None) is not None,
    "runs": lambda p, pr: list(_runs(p)), "formulas": lambda p, pr: sum(1 for e in p if e.tag in _FORMULAS),
}


def _internal(instruction: str) -> str:
    found = re.search(r'HYPERLINK\s+\\l\s+"([^"]+)"|\bREF\s+(\S+)', instruction)
    return (found[1] or found[2]) if found else ""


class _Package:
    def __init__(self, path: str, content: bytes):
        self.path, self.zip = path, zipfile.ZipFile(io.BytesIO(content))
        document = self.zip.read("word/document.xml")
        self.body, self.size = ET.fromstring(document).find(W + "body"), len(content) + len(document)

    def blocks(self, columns: list[str]) -> Iterator[dict]:
        any_ord = para = 0
        made = [(c, _PARAGRAPH[c]) for c in columns if c in _PARAGRAPH]
        for k, e in enumerate(self.body):
            if e.tag == _TBL:
                yield {"path": self.path, "block_ord": k, "kind": "tbl", "text": _text(e) if "text" in columns else None}
                any_ord += sum(1 for _ in e.iter(_P))
            elif e.tag == _P:
                pr = e.find(_PPR)
                row = {"path": self.path, "block_ord": k, "para_ord": para, "any_ord": any_ord, "kind": "p"}
                for c, of in made:
                    row[c] = of(e, pr)
                yield row
                para, any_ord = para + 1, any_ord + 1

    def cells(self, columns: list[str]) -> Iterator[dict]:
        tables = [(k, e) for k, e in enumerate(self.body) if e.tag == W + "tbl"]
        for t, (k, table) in enumerate(tables):
            for r, row in enumerate(table.findall(W + "tr") or list(table.iter(W + "tr"))):
                column = 0
                for n, cell in enumerate(row.findall(W + "tc")):
                    pr = cell.find(W + "tcPr")
                    span = int(_val(pr, "gridSpan") or 1)
                    merge, width, edges = (pr.find(W + x) if pr is not None else None for x in ("vMerge", "tcW", "tcBorders"))
                    yield {
                        "path": self.path, "table_ord": t, "block_ord": k, "row": r, "cell": n, "col_start": column, "grid_span": span, "v_merge": None if merge is None else merge.get(W + "val", "continue"),
                        "width_twips": int(width.get(W + "w", "0")) if width is not None else None, "text": "\n".join(_text(p) for p in cell.findall(W + "p")),
                        "borders": [(b.tag.removeprefix(W), b.get(W + "val", "")) for b in edges] if edges is not None else None,
                    }
                    column += span

    def citations(self, columns: list[str]) -> Iterator[dict]:
        """Fields (begin, instruction, separate, display, end) and internal hyperlinks."""
        for k, p in enumerate(self.body.iter(W + "p")):
            field, shown = None, False
            for e in p:
                if e.tag == W + "hyperlink" and e.get(W + "anchor"):
                    yield {"path": self.path, "any_ord": k, "source": "hyperlink", "target": e.get(W + "anchor"), "display": _text(e)}
                mark = e.find(W + "fldChar") if e.tag == W + "r" else None
                kind = mark.get(W + "fldCharType") if mark is not None else None
                if kind == "begin":
                    field, shown = ["", ""], False
                elif kind == "separate":
                    shown = True
                elif kind == "end" and field is not None:
                    if target := _internal(field[0]):
                        yield {"path": self.path, "any_ord": k, "source": "field", "target": target, "display": field[1]}
                    field = None
                elif field is not None and e.tag == W + "r":
                    field[0] += "".join(t.text or "" for t in e.iter(W + "instrText"))
                    field[1] += _text(e) if shown else ""

    def formulas(self, columns: list[str]) -> Iterator[dict]:
        for k, p in enumerate(self.body):
            before, n = "", 0
            for e in p if p.tag == W + "p" else ():
                if e.tag in (M + "oMath", M + "oMathPara"):
                    yield {"path": self.path, "block_ord": k, "ord": n, "type": "display" if e.tag == M + "oMathPara" else "inline", "before": before, "latex": omml.inside(e)}
                    n += 1
                else:
                    before += _text(e)

    def _relations(self) -> dict[str, str]:
        """Target of each relation, below word/."""
        name = "word/_rels/document.xml.rels"
        if name not in self.zip.namelist():
            return {}
        return {r.get("Id"): r.get("Target", "").removeprefix("/").removeprefix("word/") for r in ET.fromstring(self.zip.read(name))}

    def pictures(self, columns: list[str]) -> Iterator[dict]:
        """Pictures in the body with the media that they show: the relation's target, else the first media whose name it holds."""
        media, rels = [n for n in self.zip.namelist() if n.startswith("word/media/")], self._relations()
        for k, e in enumerate(self.body):
            for n, blip in enumerate(e.iter(_BLIP)):
                rel = blip.get(_R + "embed")
                target = rels.get(rel)
                shown = None if not target else next((i for i, m in enumerate(media) if m == f"word/{target}"), next((i for i, m in enumerate(media) if m.rsplit("/", 1)[-1] in target), None))
                yield {"path": self.path, "block_ord": k, "ord": n, "rel_id": rel, "name": None if shown is None else f"fig{shown + 1}{media[shown][media[shown].rfind('.'):]}"}

    def media(self, columns: list[str]) -> Iterator[dict]:
        """Media in the order of the package; rel_id of the first picture in the body that shows it."""
        names = [n for n in self.zip.namelist() if n.startswith("word/media/")]
        rels = {target: rel for rel, target in self._relations().items()}
        shown = {b.get(_R + "embed") for b in self.body.iter(_A + "blip")}
        for k, name in enumerate(names):
            data, rel = self.zip.read(name) if {"size", "content"} & set(columns) else b"", rels.get(name.removeprefix("word/"))
            yield {"path": self.path, "ord": k, "name": f"fig{k + 1}{name[name.rfind('.'):]}", "size": len(data), "rel_id": rel if rel in shown else None, "content": data}


def _opened(batch: pa.RecordBatch) -> Iterator[_Package]:
    for k in range(batch.num_rows):  # one at a time: a batch has no bound but that of its rows
        try:
            yield _Package(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
        except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError, TypeError):
            continue


def _read(package: _Package, kind: str, columns: list[str]) -> list[dict]:
    """Rows of one kind; none if the package lacks what they need."""
    try:
        return list(getattr(package, kind)(columns))
    except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError, TypeError):
        return []


def _schema(kind: str, columns: list[str] | None) -> tuple[pa.Schema, str]:
    """Arrow and SQL schema of the columns (null: all) of a kind."""
    types = {f.name: f for f in [*SCHEMAS[kind], *_MORE.get(kind, [])]}
    sql = {**dict(c.split(" ", 1) for c in _SQL[kind].split(", ")), **{f.name: "int" for f in _MORE.get(kind, [])}}
    names = columns or SCHEMAS[kind].names
    return pa.schema([types[c] for c in names]), ", ".join(f"{c} {sql[c]}" for c in names)


def parse(files: DataFrame, kind: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of one kind from (path, content) rows, with these ``columns`` (null: all of SCHEMAS). A file that is no Word package gives none."""
    schema, sql = _schema(kind, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for package in _opened(batch):
                rows += _read(package, kind, schema.names)
                held += package.size
                if len(rows) >= ROWS or held >= TOGETHER:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        yield _batch(rows, schema)

    return files.select("path", "content").mapInArrow(run, sql)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def gathered(files: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """(path, an array of rows for each kind): what ``parse`` gives for several kinds and their ``columns``, a row for each package, which is opened once."""
    schemas = {kind: _schema(kind, names) for kind, names in columns.items()}
    kinds = [pa.list_(pa.struct(list(s))) for s, _ in schemas.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), *kinds])], ["path", *columns])

        rows, held = [], 0
        for batch in batches:
            for package in _opened(batch):
                rows.append((package.path, *[_read(package, kind, names) for kind, names in columns.items()]))
                held += package.size
                if len(rows) >= ROWS or held >= TOGETHER:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)

    structs = [f"{kind} array<struct<" + ", ".join(c.replace(" ", ":", 1) for c in sql.split(", ")) + ">>" for kind, (_, sql) in schemas.items()]
    return files.select("path", "content").mapInArrow(run, "path string, " + ", ".join(structs))


def read(spark: SparkSession, path: str, kind: str = "blocks") -> DataFrame:
    """Blocks, cells, citations, formulas or media of all .docx files below a folder."""
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path), kind)


def _cell_xml(cell: dict) -> str:
    merge = "" if not cell.get("v_merge") else f'<w:vMerge w:val="{cell["v_merge"]}"/>'
    span = f'<w:gridSpan w:val="{cell["grid_span"]}"/>' if (cell.get("grid_span") or 1) > 1 else ""
    width = f'<w:tcW w:w="{cell["width_twips"]}" w:type="dxa"/>' if cell.get("width_twips") else ""
    edges = "".join(f'<w:{k} w:val="{escape(v)}"/>' for k, v in (cell.get("borders") or []))
    edges = f"<w:tcBorders>{edges}</w:tcBorders>" if edges else ""
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in (cell.get("text") or "").split("\n"))
    return f"<w:tc><w:tcPr>{width}{span}{merge}{edges}</w:tcPr>{paragraphs}</w:tc>"


_CONTENT_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELATIONS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_HEAD, _FOOT = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}" xmlns:m="{M[1:-1]}" xmlns:r="{_R[1:-1]}" xmlns:a="{_A[1:-1]}"><w:body>', "</w:body></w:document>"


def package(body_xml: str, media: dict[str, bytes] | None = None) -> bytes:
    """A Word package around the XML of a body; only the body is compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("[Content_Types].xml"), _CONTENT_TYPES)
        z.writestr(zipfile.ZipInfo("_rels/.rels"), _RELATIONS)
        z.writestr(zipfile.ZipInfo("word/document.xml"), _HEAD + body_xml + _FOOT, zipfile.ZIP_DEFLATED)
        rels = "".join(f'<Relationship Id="rIm{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/{name}"/>' for k, name in enumerate(media or {}))
        z.writestr(zipfile.ZipInfo("word/_rels/document.xml.rels"), f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for name, data in (media or {}).items():
            z.writestr(zipfile.ZipInfo(f"word/media/{name}"), data)
    return out.getvalue()


def packages(bodies: DataFrame) -> DataFrame:
    """(path, content): a Word package for each (path, body, media), media an array of (name, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents, held = [], [], 0
            for k in range(batch.num_rows):  # one body at a time, and about TOGETHER of finished packages
                path, body, media = (c[k].as_py() for c in batch.columns)
                paths.append(path)
                contents.append(package(body or "", {m["name"]: m["content"] for m in media or []}))
                held += len(contents[-1])
                if held >= TOGETHER or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, held = [], [], 0

    return bodies.select("path", "body", "media").mapInArrow(run, "path string, content binary")


def write_tables(cells: DataFrame) -> DataFrame:
    """(path, content): a Word package for each path, with its tables, from rows as ``read(..., 'cells')`` gives them."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda c: (c["table_ord"], c["row"], c["cell"]))
        xml = ""
        for t in dict.fromkeys(c["table_ord"] for c in rows):
            mine = [c for c in rows if c["table_ord"] == t]
            lines = "".join("<w:tr>" + "".join(_cell_xml(c) for c in mine if c["row"] == r) + "</w:tr>" for r in dict.fromkeys(c["row"] for c in mine))
            xml += f"<w:tbl>{lines}</w:tbl><w:p/>"
        return pa.table({"path": pa.array([key[0].as_py()]), "content": pa.array([package(xml)], pa.binary())})

    return cells.groupBy("path").applyInArrow(run, "path string, content binary")
