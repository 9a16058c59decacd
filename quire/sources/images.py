"""Image features and their one-to-one match."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import natural_key

#: Scores: same size and bytes within SLACK; same size; within NEAR pixels of it.
SLACK, NEAR = 1000, 50
FEATURES = "path string, width int, height int, file_size long, histogram array<double>"


def pixels(content: bytes) -> np.ndarray | None:
    """(height, width, 3) bytes of a binary PPM; of other formats where Pillow is installed; else None."""
    head = re.match(rb"P6\s+(\d+)\s+(\d+)\s+255\s", content)
    if head:
        w, h = int(head[1]), int(head[2])
        return np.frombuffer(content, np.uint8, w * h * 3, head.end()).reshape(h, w, 3)
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    except Exception:  # noqa: BLE001  whatever the codec raises, the file is no image
        return None


def histogram(rgb: np.ndarray) -> list[float]:
    """16 classes of each channel, as shares of all."""
    counts = np.concatenate([np.bincount(rgb[..., k].ravel() // 16, minlength=16) for k in range(3)])
    return (counts / counts.sum()).tolist()


def features(files: DataFrame) -> DataFrame:
    """Features of (path, content) rows; files that are no images give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, c, rgb) for p, c in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))) if (rgb := pixels(c)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[2].shape[1] for r in rows], pa.int32()), pa.array([r[2].shape[0] for r in rows], pa.int32()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([histogram(r[2]) for r in rows], pa.list_(pa.float64()))], names=["path", "width", "height", "file_size", "histogram"])

    return files.select("path", "content").mapInArrow(run, FEATURES)


def read(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg,ppm,gif,bmp,tif,tiff}") -> DataFrame:
    return features(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def cosine(a, b):
    """Cosine of two arrays; 0 if their sizes differ or one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


class _Originals:
    """The originals of one group: vectors by exact size, component by component, and which names are still free."""

    def __init__(self):
        self.names: list[str] = []
        self.free = np.empty(0, bool)
        self.rows: dict[tuple, list[tuple]] = {}  # of a size: (place of the name, bytes, vector or None)
        self.packed: dict[tuple, list[tuple]] = {}

    def add(self, name: str, size: tuple, file_size: int | None, vector: np.ndarray | None) -> None:
        if not self.names or self.names[-1] != name:
            self.names.append(name)
        self.rows.setdefault(size, []).append((len(self.names) - 1, file_size, vector))

    def pack(self) -> None:
        """Vectors of each size and length as columns of one array; sizes by cells of NEAR pixels."""
        self.free, self.cells = np.ones(len(self.names), bool), {}
        for size, rows in self.rows.items():
            by_length: dict[int, list[tuple]] = {}
            for row in rows:
                by_length.setdefault(-1 if row[2] is None else len(row[2]), []).append(row)
            self.packed[size] = []
            for n, some in by_length.items():
                x = np.array([r[2] for r in some], np.float64).T.copy() if n > 0 else np.empty((0, len(some)))
                bytes_ = np.array([np.nan if r[1] is None else r[1] for r in some], np.float64)
                self.packed[size].append((n, np.array([r[0] for r in some]), bytes_, x, np.sqrt(_dot(x, x))))
            self.cells.setdefault((size[0] // NEAR, size[1] // NEAR), []).append(size)
        self.rows = {}

    def near(self, size: tuple) -> Iterator[tuple]:
        cw, ch = size[0] // NEAR, size[1] // NEAR
        for cell in ((cw + i, ch + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            yield from (s for s in self.cells.get(cell, ()) if abs(s[0] - size[0]) < NEAR and abs(s[1] - size[1]) < NEAR)

    def scores(self, size: tuple, file_size: int | None, vector: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of names, scores) of the free originals of near sizes."""
        own = None if vector is None else np.sqrt(_dot(vector[:, None], vector[:, None]))[0]
        for other in self.near(size):
            apart = abs(other[0] - size[0]) + abs(other[1] - size[1])
            for k, (n, at, bytes_, x, norms) in enumerate(self.packed[other]):
                free = self.free[at]
                if 2 * np.count_nonzero(free) < len(at):  # what is taken never comes back
                    at, bytes_, x, norms = at[free], bytes_[free], np.ascontiguousarray(x[:, free]), norms[free]
                    self.packed[other][k], free = (n, at, bytes_, x, norms), np.ones(len(at), bool)
                if not len(at):
                    continue
                alike = np.zeros(len(at))
                if own is not None and len(vector) == n:
                    norm = own * norms
                    some = (norm > 0) | np.isnan(norm)
                    alike[some] = (_dot(x, vector[:, None]) / np.where(some, norm, 1.0))[some]
                far = (1 - alike) * 100
                score = np.where(np.abs(bytes_ - (np.nan if file_size is None else file_size)) < SLACK, -2000.0, -1000 + far) if apart == 0 else apart + far
                yield at[free], score[free]

    def take(self, rows: list[tuple]) -> tuple[str, float] | None:
        """The best free original of an image that has these rows, and the score; it is free no more."""
        found = [f for row in rows for f in self.scores(*row)]
        at = np.concatenate([f[0] for f in found]) if found else np.empty(0, int)
        if not len(at):
            return None
        score = np.concatenate([f[1] for f in found])
        best = np.lexsort((at, score))[0] if np.isnan(score).all() else np.flatnonzero(score == np.nanmin(score))
        best = best if np.ndim(best) == 0 else best[np.argmin(at[best])]
        self.free[at[best]] = False
        return self.names[at[best]], float(score[best])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of columns, added component by component as ``cosine`` does, so equal vectors have equal scores."""
    out = np.zeros(max(a.shape[1], b.shape[1]))
    with np.errstate(all="ignore"):
        for x, y in zip(a, b):
            out += x * y
    return out


def match(extracted: DataFrame, originals: DataFrame, group: str) -> DataFrame:
    """(group, extracted, original, score): in natural order, each extracted image takes the best original still free, ties to the smaller name.

    Turns depend on each other, so the extracted images of a group stream in order past its originals, the groups side by side. An image is scored in its turn,
    against what is still free of near sizes, so pairs are neither listed nor dealt out in rounds; a task holds the originals of one
    group, of the images nothing. Repeated names are one image with several features.
    """
    side = lambda df, asks: df.dropna(subset=[group, "path", "width", "height"]).select(group, F.lit(asks).alias("asks"), "path", "width", "height", "file_size", "histogram")
    both = side(originals, False).unionByName(side(extracted, True)).repartition(group)
    both = both.sortWithinPartitions(group, "asks", F.when(F.col("asks"), natural_key(F.col("path"))), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, turn, rows = None, _Originals(), None, []
        out: list[tuple] = []

        def end_turn() -> None:
            nonlocal turn, rows
            if rows and (found := held.take(rows)):
                out.append((at, turn, *found))
            turn, rows = None, []

        for batch in batches:
            lists = batch.column(6)
            for k, (g, asks, path, w, h, size) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:6]])):
                x = lists[k].values
                vector = None if x is None or x.null_count else x.to_numpy(zero_copy_only=False).astype(np.float64)
                if g != at or path != turn or not asks:
                    end_turn()
                if g != at:
                    at, held = g, _Originals()
                if not asks:
                    held.add(path, (w, h), size, vector)
                    continue
                if held.rows:
                    held.pack()
                turn = path
                if held.packed:
                    rows.append(((w, h), size, vector))
            yield made(batch.schema.field(0).type, out)
            out.clear()
            kind = batch.schema.field(0).type
        if rows:
            end_turn()
            yield made(kind, out)

    def made(kind: pa.DataType, out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((kind, pa.string(), pa.string(), pa.float64()))], [group, "extracted", "original", "score"])

    return both.mapInArrow(run, f"`{group}` {dict(extracted.dtypes)[group]}, extracted string, original string, score double")
