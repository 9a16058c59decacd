"""Language identification by hierarchical discrimination.

A linear classifier picks the language family; within it, one-versus-one linear support vector machines
separate the languages, by vote. Features are hashed character 1- to 3-grams of the whole lower-cased text.
Models are trained here, on a bounded sample of labelled documents, in which every label has a share. A text that lies
farther from every family than labelled texts of its length do is in no learned language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Hash slots; labelled rows that are learned from, shared out evenly over the labels, and rows of a label at least that are asked for.
SLOTS, SAMPLE, LEAST = 4096, 4000, 10
#: The floor of a length's margins: a share of a low quantile of the labelled rows' margins, from so many rows at least.
SHARE, QUANTILE, ENOUGH = 0.3, 0.01, 100
UNKNOWN = "und"
#: Characters hashed at once, which bounds memory for very long texts.
SLICE = 1 << 20

# Families of languages by ISO 639-1 code. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = np.zeros(0x110000, bool)
_SALT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


def features(text: str | None) -> np.ndarray | None:
    """Unit vector over the hash slots, of the square roots of n-gram counts; None for a text without letters."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[cp]
    if not letter.any():
        return None
    cp = np.where(letter, cp, 32).astype(np.uint32)
    cp = np.r_[np.uint32(32), cp[letter | np.r_[False, letter[:-1]]], np.uint32(32)]  # one space between words
    counts = np.zeros(SLOTS, np.int64)
    for at in range(0, len(cp), SLICE):
        part = cp[at : at + SLICE + 2]
        h = np.zeros(len(part), np.uint32)
        for n in range(3):
            h = h[: len(part) - n] * np.uint32(0x01000193) ^ part[n:] * _SALT[n]
            own = h[: min(len(h), SLICE)]
            counts += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12), minlength=SLOTS)
    out = np.sqrt(counts.astype(np.float32))
    return out / np.linalg.norm(out)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by accelerated gradient; y is 1, -1, or 0 for rows that don't count.

    The last column of x is the constant 1. Rows stay where they are, so no part of x is copied.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), np.where(y < 0, 0.5 / max(1, (y < 0).sum()), 0)).astype(np.float32)  # classes weigh the same
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1 / (2 * 2 + penalty)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (penalty * v - 2 * ((weight * y * slack) @ x))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


class Model:
    """Families with a machine each (one against the rest), and a machine for each pair of languages of a family. The last column of x is 1."""

    def __init__(self, langs: list[str], x: np.ndarray, letters: list[int]):
        family = np.array([_FAMILY_OF.get(lang, lang) for lang in langs])
        names = np.array(langs)
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(names[family == f].tolist())) for f in self.families}
        side = lambda where: np.where(where, 1, -1).astype(np.float32)
        self.outer = np.stack([train_svm(x, side(family == f)) for f in self.families]) if len(self.families) > 1 else np.zeros((len(self.families), SLOTS + 1), np.float32)
        self.inner = {}  # of each family, the machines of its pairs as rows
        for f in self.families:
            made = [train_svm(x, np.where(names == a, 1, np.where(names == b, -1, 0)).astype(np.float32)) for a, b in combinations(self.members[f], 2)]
            self.inner[f] = np.stack(made) if made else np.zeros((0, SLOTS + 1), np.float32)
        self.floors = self._floors(x, np.array(letters, np.int64))

    def _floors(self, x: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The least margin of a text in a learned language, by the power of two of its letters.

        From rows of that length, half or twice it; where they are too few, the floor of the next shorter length holds.
        """
        out = np.full(64, -np.inf)
        if len(self.families) < 2 or not len(x):
            return out  # one family has no margin
        best, size = (x @ self.outer.T).max(axis=1), np.frexp(letters)[1]
        for k in range(1, 64):
            near = best[np.abs(size - k) <= 1]
            out[k] = SHARE * np.quantile(near, QUANTILE) if len(near) >= ENOUGH else out[k - 1]
        return out

    def known(self, text: str | None) -> bool:
        """Whether the text is in a learned language: it has a letter, and its best family's margin is no less than its length's floor."""
        x = features(text)
        if x is None or not self.families:
            return False
        letters = sum(map(str.isalpha, text))
        return bool((self.outer @ np.append(x, np.float32(1))).max() >= self.floors[np.frexp(letters)[1]])

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the family's share, by softmax of margins, times the mean sigmoid of the winner's margins."""
        x = features(text)
        if x is None or not self.families:
            return UNKNOWN, 0.0
        x = np.append(x, np.float32(1))
        margins = self.outer @ x
        share = np.exp(4 * (margins - margins.max()))
        best = int(np.argmax(margins))
        score, langs = float(share[best] / share.sum()), self.members[self.families[best]]
        if len(langs) == 1:
            return langs[0], score
        votes, sure = dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 0.0)
        for (a, b), margin in zip(combinations(langs, 2), (self.inner[self.families[best]] @ x).tolist()):
            p = 1 / (1 + math.exp(-4 * margin))
            votes[a if margin >= 0 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
        winner = max(langs, key=lambda lang: (votes[lang], sure[lang]))
        return winner, min(1.0, score * sure[winner] / (len(langs) - 1))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the rows of ``docs`` (text, lang), of which those without a language or letters teach nothing.

    Every label is learned, from those of its distinct texts whose hash falls into its share, so the order of arrival doesn't
    matter: about sample / labels of each, or all if they are fewer, but LEAST at least; so about max(sample, LEAST * labels)
    rows in all, within a few roots of that. Copies teach once.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("h"))
    counts = labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each label
    if not counts:
        return Model([], np.empty((0, SLOTS + 1), np.float32), [])
    each = max(LEAST, sample // len(counts))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r.lang, min(1.0, each / r.n))])
    luck = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.filter(luck < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "h"])  # as many rows as the docstring says

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [features(t) for t in texts]
            packed = pa.array([None if v is None else v.astype(np.float16).tobytes() for v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([sum(map(str.isalpha, t)) for t in texts], pa.int64()), packed], ["lang", "h", "letters", "x"])

    rows = chosen.mapInArrow(run, "lang string, h long, letters long, x binary").filter("x is not null").toArrow()
    rows = rows.take(pc.sort_indices(rows, [("lang", "ascending"), ("h", "ascending")]))
    x = np.ones((rows.num_rows, SLOTS + 1), np.float32)
    for k, v in enumerate(rows.column("x")):
        x[k, :-1] = np.frombuffer(v.as_buffer(), np.float16)
    langs, letters = rows.column("lang").to_pylist(), rows.column("letters").to_pylist()
    del rows
    return Model(langs, x, letters)


def held_out(doc_id):
    """True for the quarter of documents, by CRC-32 of the id as text, that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def teaching(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from; a row without an id is in neither part and teaches nothing."""
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from the text alone; ``und`` and 0 where it is null or has no letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, as they are, whose text is in a learned language (``Model.known``); repeated rows stay or go together."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([sent.value.known(t.as_py()) for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, by a model of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(teaching(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
