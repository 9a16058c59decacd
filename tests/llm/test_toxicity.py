import math
import random
import zlib

import numpy as np

from quire.llm import toxicity as T
from quire.llm.toxicity import op11_toxicity

from .helpers import odd_docs, sf_dir_of

LABELS = "doc_id long, quality int, toxic int"


def by_rule(symbols):
    """What a clause emits, kind by kind, from the rules in words and not from any machine."""
    out, last_insult, threat = [], None, None
    aimed = target = attack = False
    for k, s in enumerate(symbols):
        near = [x for x in symbols[max(0, k - T.REACH) : k]]
        negated, reported = "N" in near, "R" in symbols[:k] or symbols[:k].count("Q") % 2 == 1
        if s == "I":
            if reported or negated:
                out.append("reported" if reported else "negated")
            else:
                out.append("plain")
                attack = True
                if last_insult is not None and k - last_insult <= 2:
                    out.append("repeated")
            last_insult = k
        elif s == "H":
            threat = (k, reported or negated)
        elif s == "T":
            target = True
            if threat and k - threat[0] <= T.NEAR:
                out.append("doubtful_threat" if threat[1] else "threat")
                threat = None
        if target and attack and not aimed:
            aimed = True
            out.append("aimed")
    return sorted(out)


def test_the_machine_follows_the_rules():
    machine, rng = T.grammar(), random.Random(1)
    for _ in range(4000):
        symbols = rng.choices("IHTNRQO", [4, 3, 3, 2, 1, 1, rng.choice([1, 8])], k=rng.randrange(14))
        state, got = machine.start, []
        for s in symbols:
            state, _, emitted = machine.arcs[state, s]
            got += emitted
        assert sorted(got) == by_rule(symbols), symbols


def test_composition_is_one_after_the_other():
    parts = [T._negation()]
    for part in (T._reported, T._insult, T._threat, T._target):
        parts.append(part(T.Transducer(parts[-1].alphabet, parts[-1].start, lambda state, symbol, p=parts[-1]: p.arcs[state, symbol]).outputs))
    whole, rng = parts[0], random.Random(2)
    for part in parts[1:]:
        whole = T.compose(whole, part)
    for _ in range(500):
        symbols = [(c, "") for c in rng.choices("IHTNRQO", k=9)]
        out, emitted = symbols, [()] * 9
        for part in parts:
            out, more = part.run(out)
            emitted = [a + b for a, b in zip(emitted, more)]
        assert whole.run(symbols) == (out, emitted)


def test_clauses_not_words():
    model = T.Model({"idiot": 3.0, "schuft*": 2.0})
    sums = lambda text: [s for _, _, s in model.clauses(text)]
    assert sums("You are an IDIOT. She said he is an idiot! Not an idiot; fine") == [{"plain": 3.0, "aimed": 1.0}, {"reported": 3.0}, {"negated": 3.0}]
    assert sums("He isn't an idiot\nwe call it “idiot”") == [{"negated": 3.0}, {"reported": 3.0}]
    assert sums("I will kill you. kill the process. he never will kill you") == [{"threat": 1.0}, {"doubtful_threat": 1.0}]
    assert sums("Schuftig, Schufterei idiot") == [{"plain": 7.0, "repeated": 2.0}] and sums("schuft") == []
    assert [("ab idiot"[a:b]) for a, b, _ in model.clauses("ab idiot")] == ["ab idiot"]
    score = model.score
    assert score("you idiot") > score("idiot") > score("not an idiot") > score("nothing at all") == score("") == score(None)
    assert score("a" * 3 * T.CLAUSE + " idiot") == score("idiot") == score("x " * T.CLAUSE + "idiot")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op11_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    hits = {0: [], 1: []}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in label:
            hits[label[r.doc_id]].append(r.predicted)
    assert np.mean(hits[1]) >= 0.92 and np.mean(hits[0]) <= 0.02 and len(hits[1]) > 80


def test_nothing_is_learned_from_held_out_labels(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("la", "mo", "tir", "ne") for b in ("po", "ras", "tin", "ou")]
    text = lambda *more: " ".join(rng.sample([*rng.choices(words, k=25), *more], 25 + len(more)))
    rows, labels = [], []
    for k in range(400):
        out, bad = zlib.crc32(str(k).encode()) % 4 == 2, k % 4 == 0
        rows.append((k, text("zlurp") if out and not bad else text("grunk") if bad else text(), None, None, 1))
        labels.append((k, 1, int(not bad) if out else int(bad)))  # held-out labels say the opposite
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    where = sf_dir_of(spark, tmp_path, documents=docs, labels=spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r.predicted for r in op11_toxicity(spark, where).collect()}
    assert all(got[k] == (k % 4 == 0) for k in range(400))


def test_copies_teach_once(spark):
    rows = [("one long text with flumpf in it", 1)] * 500 + [(f"word{k} more words of its own number{k}", 0) for k in range(500)]
    lexicon = T.lexicon(spark.createDataFrame([(t, y, 1.0) for t, y in rows], "text string, toxic int, weight double"))
    assert "flumpf" not in lexicon


def test_stems_are_judged_by_what_longer_terms_leave(spark):
    rng = random.Random(6)
    rows = []
    for k in range(600):
        base = [f"{rng.choice('abcdefghij')}{rng.choice('klmnop')}stu{rng.choice('xyz')}", f"stu{rng.choice('aeiou')}{rng.choice('bcd')}", f"n{k % 37}x"]
        more = ["stupid"] if k % 6 == 0 else [f"vequ{rng.choice('aeiou')}{rng.choice('bcdfgh')}{rng.choice('aeiou')}"] if k % 6 == 1 else []
        words = [*(f"w{rng.randrange(50)}" for _ in range(6)), *base, *more]
        rng.shuffle(words)
        rows.append((" ".join(words), int(bool(more)), 1.0))
    lexicon = T.lexicon(spark.createDataFrame(rows, "text string, toxic int, weight double"))
    assert "stupid" in lexicon and not any(t.startswith("stu") and t.endswith("*") for t in lexicon)
    assert T.Lexicon(lexicon).weight("vequolum") > 0 and T.Lexicon(lexicon).weight("vera") == 0


def test_odd_rows_and_missing_labels(spark, tmp_path):
    docs = odd_docs(spark, ["kill you"]).selectExpr("*", "1 as toxic", "2 as weight", "'x' as score", "3 as of")
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    some = spark.createDataFrame([(k, None, k % 2) for k in range(8)] + [(None, 1, 1), (3, 1, 0), (3, 1, None), (4, 1, 7), (10**6, 1, 1)], LABELS)
    for name, labels in (("some", some), ("none", some.limit(0)), ("one", some.filter("toxic = 1"))):
        rows = op11_toxicity(spark, sf_dir_of(spark, tmp_path / name, documents=docs, labels=labels)).collect()
        assert sorted((r.doc_id for r in rows), key=str) == sorted(ids, key=str)
        assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
    assert op11_toxicity(spark, sf_dir_of(spark, tmp_path / "empty", documents=docs.limit(0), labels=some)).count() == 0


def test_matches_have_places_and_kinds(spark):
    docs = spark.createDataFrame([(1, "Fine. You idiot! Bye"), (2, None), (3, "clean")], "doc_id long, text string")
    rows = T.matches(docs, T.Model({"idiot": 3.0})).collect()
    assert [(r.doc_id, "Fine. You idiot! Bye"[r.start : r.end], r.kinds) for r in rows] == [(1, " You idiot", {"plain": 3.0, "aimed": 1.0})]
