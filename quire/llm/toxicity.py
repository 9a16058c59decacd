"""Toxicity by a weighted finite-state grammar over clauses.

A clause is a stretch without ``.!?;`` or line breaks. Its words become symbols: insult, threat, target, negation, report,
quotation mark or other. Five small transducers read them in turn: negation marks the attacks in its reach, reported speech those
behind a verb of saying or between quotation marks, insults and threats tell attacks from bare words, and target ties them to whom they are aimed at.
``compose`` makes one deterministic machine of the five. It adds up, along its path through a clause, what the arcs emit: the weights of the
insults by kind (plain, negated, reported), and whether they are repeated, aimed, or threats. The clauses' sums, not the words, are scored.

Which words and stems insult, and how much, is learned from labels, from their lift in toxic texts over others where the
evidence is beyond chance. A word counts once for a text, and once for all texts in which it first stands between the same
two words, so near copies teach once. What the kinds are worth is fitted by logistic regression, held near a prior, so kinds
that labels don't show keep a sensible worth. Labelled rows are a bounded sample, SAMPLED of each label; every document is scored, by its whole text.

Defined results: a null text is an empty one. Without an attack the score is that of an empty text. Rows without an id, repeated labels
with the smaller mark, and labels other than 0 and 1 teach nothing. Without any label the prior alone scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .langid import held_out

#: Labelled rows that are learned from, at about: toxic ones, others.
SAMPLED = (4000, 12_000)
#: Least likelihood-ratio statistic and least lift of a term, terms of a length in the lexicon at most, letters of a stem.
EVIDENCE, LIFT, TERMS, STEM = 30.0, 4.0, 20_000, range(3, 8)
#: The score from which a text is called toxic.
THRESHOLD = 0.3
#: Characters of a clause at about, which bounds memory for texts without any stop; words remembered by a task.
CLAUSE, REMEMBERED = 4096, 200_000
#: Words after a negation that it reaches, and words between a threat and its target.
REACH, NEAR = 3, 4

# Closed word classes of English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself he she him her they them their du dich dir dein deine ihr euch eure er sie ihn ihm ihnen tu te toi ton ta tes vous votre vos il elle ils elles lui leur leurs tú ti tus usted ustedes vosotros él ella ellos ellas".split())
NEGATIONS = frozenset("not no never none nobody nothing neither nor cannot n't without nicht kein keine keinen keiner nie niemals niemand nichts ohne ne pas jamais aucun aucune rien personne sans nunca jamás nadie nada ningún ninguna sin tampoco".split())
REPORTS = frozenset("said says say saying told tells wrote writes claims claimed claim quoted quote reported reports allegedly called sagte sagt sagen sagten schrieb schreibt behauptet behauptete laut angeblich zitiert dit dire disait disent écrit prétend affirme selon dijo dice dicen decir escribió escribe afirma según".split())
THREATS = frozenset("kill hurt beat destroy shoot stab burn strangle murder punch smash crush töten töte umbringen schlagen erschießen verbrennen vernichten zerstören tuer frapper détruire brûler étrangler massacrer matar golpear destruir quemar disparar apuñalar estrangular".split())
QUOTES = frozenset('"“”„«»')

#: What a path adds up: weights of insults by kind, then numbers of events.
KINDS = ("plain", "negated", "reported", "repeated", "aimed", "threat", "doubtful_threat")
#: What a kind is worth before anything is learned, on the logarithm of its sum; the score of a text without attacks, in log odds; the pull of both.
PRIOR, BASE, PULL = np.array([1.5, 0.4, 0.4, 0.5, 1.0, 3.0, 0.6]), -4.0, 2.0

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"""n['’]t\b|[^\W\d_]+?(?=n['’]t\b)|[^\W\d_]+|["“”„«»]""")
_CLAUSE = re.compile(rf"[^.!?;\n]{{1,{CLAUSE}}}[^\W\d_]*")


class Transducer:
    """A total, deterministic transducer: ``arcs[state, symbol]`` is (next state, output symbol, kinds emitted)."""

    def __init__(self, alphabet: Iterable, start, step):
        """``step(state, symbol)`` gives an arc; states are found from ``start`` on."""
        self.alphabet, self.start, self.arcs = tuple(alphabet), start, {}
        todo = [start]
        seen = {start}
        while todo:
            state = todo.pop()
            for symbol in self.alphabet:
                arc = self.arcs[state, symbol] = step(state, symbol)
                if arc[0] not in seen:
                    seen.add(arc[0])
                    todo.append(arc[0])

    @property
    def outputs(self) -> list:
        return sorted({out for _, out, _ in self.arcs.values()})

    def run(self, symbols: Iterable) -> tuple[list, list]:
        """Output symbols, and the kinds emitted at each."""
        state, out, kinds = self.start, [], []
        for symbol in symbols:
            state, made, emitted = self.arcs[state, symbol]
            out.append(made)
            kinds.append(emitted)
        return out, kinds


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that gives what ``second`` makes of the output of ``first``; emissions of both are joined."""

    def step(states, symbol):
        a, b = states
        a, middle, left = first.arcs[a, symbol]
        b, out, right = second.arcs[b, middle]
        return (a, b), out, left + right

    return Transducer(first.alphabet, (first.start, second.start), step)


# Symbols are (class, marks): I insult, H threat, T target, N negation, R report, Q quotation mark, O other, A attack; marks n and r are negated and reported.
PLAIN = tuple((c, "") for c in "IHTNRQO")


def _negation() -> Transducer:
    def step(left, symbol):
        kind, marks = symbol
        if kind == "N":
            return REACH, ("O", ""), ()
        return max(0, left - 1), (kind, marks + "n") if left and kind in "IH" else symbol, ()

    return Transducer(PLAIN, 0, step)


def _reported(alphabet) -> Transducer:
    def step(state, symbol):
        said, quoted = state
        kind, marks = symbol
        if kind == "R":
            return (True, quoted), ("O", ""), ()
        if kind == "Q":
            return (said, not quoted), ("O", ""), ()
        return state, (kind, marks + "r") if (said or quoted) and kind in "IH" else symbol, ()

    return Transducer(alphabet, (False, False), step)


def _insult(alphabet) -> Transducer:
    """Emits an insult's kind; one within two words of another is repeated."""

    def step(left, symbol):
        kind, marks = symbol
        if kind != "I":
            return max(0, left - 1), symbol, ()
        emitted = ("reported",) if "r" in marks else ("negated",) if "n" in marks else ("plain", "repeated") if left else ("plain",)
        return 2, ("A", marks), emitted

    return Transducer(alphabet, 0, step)


def _threat(alphabet) -> Transducer:
    """A threat is an attack once a target follows it closely; the target carries it on."""

    def step(state, symbol):
        left, held = state
        kind, marks = symbol
        if kind == "H":
            return (NEAR, marks), ("O", ""), ()
        if kind == "T" and left:
            return (0, ""), ("X", held), ("doubtful_threat",) if held else ("threat",)
        return (left - 1, held) if left > 1 else (0, ""), symbol, ()

    return Transducer(alphabet, (0, ""), step)


def _target(alphabet) -> Transducer:
    """Emits ``aimed`` once for a clause in which an insult that is neither negated nor reported meets a target, before or after."""

    def step(state, symbol):
        target, attack = state
        kind, marks = symbol
        now = (target or kind in "TX", attack or (kind == "A" and not marks))
        return now, symbol, ("aimed",) if all(now) and not all(state) else ()

    return Transducer(alphabet, (False, False), step)


def grammar() -> Transducer:
    """The five transducers as one, with its states numbered."""
    machine = _negation()
    for part in (_reported, _insult, _threat, _target):
        machine = compose(machine, part(machine.outputs))
    numbers, fresh = {}, count()
    number = lambda state: numbers.setdefault(state, next(fresh)) if state not in numbers else numbers[state]
    number(machine.start)
    machine.arcs = {(number(state), symbol[0]): (number(after), out, emitted) for (state, symbol), (after, out, emitted) in machine.arcs.items()}
    machine.start, machine.alphabet = 0, tuple("IHTNRQO")
    return machine


class Lexicon:
    """Weights of insulting words, and of stems, which end in ``*``."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def weight(self, word: str) -> float:
        """The weight of the word, or of the longest stem of it that is known; 0 if it insults nobody."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            get = self.weights.get
            got = get(word) or next((w for n in reversed(STEM) if n < len(word) and (w := get(word[:n] + "*"))), 0.0)
            self.known[word] = got
        return got

    def symbol(self, word: str) -> str:
        if self.weight(word):
            return "I"
        for kind, words in (("H", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("Q", QUOTES)):
            if word.replace("’", "'") in words:
                return kind
        return "O"


class Model:
    """Grammar, lexicon, and what the kinds are worth."""

    def __init__(self, weights: dict[str, float], worth: np.ndarray = PRIOR, base: float = BASE):
        self.lexicon, self.worth, self.base, self.machine = Lexicon(weights), worth, base, grammar()

    def clauses(self, text: str) -> Iterator[tuple[int, int, dict[str, float]]]:
        """(start, end, sums by kind) of every clause with an attack; places count in the lower-cased text."""
        weight, machine = self.lexicon.weight, self.machine
        for clause in _CLAUSE.finditer(text.lower()):
            words = _WORD.findall(clause.group())
            if not any(weight(w) or w in THREATS for w in words):
                continue
            sums, state = {}, machine.start
            for token in _TOKEN.findall(clause.group()):
                state, _, emitted = machine.arcs[state, self.lexicon.symbol(token)]
                for kind in emitted:
                    sums[kind] = sums.get(kind, 0.0) + (weight(token) if kind in KINDS[:3] else 1.0)
            if sums:
                yield clause.start(), clause.end(), sums

    def features(self, text: str | None) -> np.ndarray:
        """Logarithms of one and the clauses' sums by kind."""
        total = dict.fromkeys(KINDS, 0.0)
        for _, _, sums in self.clauses(text or ""):
            for kind, n in sums.items():
                total[kind] += n
        return np.log1p(np.array([total[k] for k in KINDS]))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + float(self.features(text) @ self.worth))))))


def first_contexts(text: str) -> dict[str, int]:
    """For each distinct word, a hash of the words around its first place."""
    found, before, word = {}, "", None
    for m in _WORD.finditer(text.lower()):
        if word is not None and word not in found:
            found[word] = hash_of(before, m.group())
        before, word = word or "", m.group()
    if word is not None and word not in found:
        found[word] = hash_of(before, "")
    return found


def hash_of(before: str, after: str) -> int:
    """A number of the two words that is the same in every process."""
    out = 0xCBF29CE484222325
    for c in f"{before} {after}".encode("utf-8", "surrogatepass"):
        out = (out ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return out - (1 << 63)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, weight): about SAMPLED labelled rows of those that may be learned from; ``weight`` is how many rows one stands for."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("of")).agg(F.min("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    shares = [min(1.0, SAMPLED[0 if t else 1] / sizes.get(t, 1)) for t in (0, 1)]
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    luck = F.pmod(F.xxhash64("of"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marks.filter(luck < share).select("of", "toxic", (1 / share).alias("weight"))
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("of")).select("text", "toxic", "weight")  # SAMPLED bounds what is sent


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Insulting words and stems of the sampled rows with their weights, the logarithm of their lift.

    Words first, then stems from long to short, each judged by the words that nothing longer explains, so ``stu*`` says
    nothing because of ``stupid``. TERMS of each length at most, by evidence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                found = first_contexts(text.as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([toxic.as_py()] * len(found), pa.int32())], ["word", "context", "toxic"])

    once = rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "word string, context long, toxic int").distinct()
    left = written(once.groupBy("word").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")), "toxicity-words")
    yes_all, no_all = left.agg(F.coalesce(F.sum("yes"), F.lit(0)), F.coalesce(F.sum("no"), F.lit(0))).first()
    if not yes_all or not no_all:
        return {}
    share, found = yes_all / (yes_all + no_all), {}
    part = lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("yes") + F.col("no")) * s))).otherwise(0.0)
    lift = ((F.col("yes") + 0.5) / (yes_all + 1)) / ((F.col("no") + 0.5) / (no_all + 1))
    for n in (None, *sorted(STEM, reverse=True)):  # a fixed number of rounds
        term = F.col("word") if n is None else F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*")))
        named = left.withColumn("term", term)
        counts = named.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        scored = counts.select("term", (2 * (part("yes", share) + part("no", 1 - share))).alias("g"), lift.alias("lift"))
        good = scored.filter((F.col("g") >= EVIDENCE) & (F.col("lift") >= LIFT)).orderBy(F.desc("g"), "term").limit(TERMS).collect()  # TERMS rows at most
        if good:
            found |= {r.term: math.log(r.lift) for r in good}
            taken = rows.sparkSession.createDataFrame([(r.term,) for r in good], "term string")
            left = named.join(F.broadcast(taken), "term", "left_anti").drop("term")  # TERMS bounds what is sent
    return found


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Worth of the kinds and base, by Newton's steps on the weighted logistic loss with a pull towards the prior; no kind is worth less than nothing."""
    z, prior = np.c_[x, np.ones(len(x))], np.append(PRIOR, BASE)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + PULL * (w - prior)
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + PULL * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text) that aren't held out."""
    rows = written(sample(docs, labels), "toxicity-sample")
    model = Model(lexicon(rows))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sent.value.features(t.as_py()).tolist() for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "toxic", "weight"])

    found = rows.select("text", F.col("toxic").cast("int"), "weight").mapInArrow(run, "x array<double>, toxic int, weight double").toArrow().to_pydict()  # SAMPLED rows at about
    if not found["toxic"]:
        return model
    order = sorted(range(len(found["x"])), key=lambda k: (found["x"][k], found["toxic"][k], found["weight"][k]))  # the same sums in whatever order rows came
    x, y, weight = (np.array([found[c][k] for k in order], float) for c in ("x", "toxic", "weight"))
    return Model(model.lexicon.weights, *fit(x, y, weight))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sent.value.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def matches(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, kinds, score) of every clause with an attack: its place in the lower-cased text, the sums by kind, and its score alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = list(model.clauses(text.as_py() or ""))
                if found:
                    alone = [1 / (1 + math.exp(-(model.base + sum(math.log1p(s.get(k, 0.0)) * w for k, w in zip(KINDS, model.worth.tolist()))))) for _, _, s in found]
                    made = ([doc_id.as_py()] * len(found), [f[0] for f in found], [f[1] for f in found], [list(f[2].items()) for f in found], alone)
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.float64()), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)], ["doc_id", "start", "end", "kinds", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, kinds map<string,double>, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model of the labelled ones that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
