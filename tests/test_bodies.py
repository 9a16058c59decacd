"""Bodies of documents against a loop that keeps lines in a list, floats against the loop over their neighbours."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from quire.functions import latex
from quire.operators import assembly
from quire.plans import bodies, registry

SHORT, ELSEWHERE = assembly.SHORT, assembly.ELSEWHERE


def loop(blocks, floats, keys_by_number, escaped):
    """One document: its blocks in order, each appended to a list of [line, is text]."""
    out, section, number, n = [], 0, 0, len(blocks)
    stop = next((b.block_ord for b in blocks if b.semantic_type == "reference"), None)
    live = [b for b in blocks if (stop is None or b.block_ord < stop) and b.semantic_type not in ELSEWHERE]
    events = [(b.block_ord, 0, 0, b) for b in live] + [(f.anchor, 1, f.float_ord, f) for f in floats]
    formulas = {b.block_ord for k, b in enumerate(live) if b.semantic_type == "display_formula"}
    order = [b.block_ord for b in live]
    prev = {o: order[k - 1] if k else None for k, o in enumerate(order)}
    after = {o: order[k + 1] if k + 1 < len(order) else None for k, o in enumerate(order)}
    for _, sub, _, x in sorted(events, key=lambda e: e[:3]):
        if sub:
            out.append([x.code, False])
            continue
        text = x.text.strip(" ")
        body = re.sub(r"\[([0-9]+)\]", lambda m: f"\\citep{{{keys_by_number[m[1]]}}}" if m[1] in keys_by_number else m[0], escaped[text])
        if x.semantic_type == "display_formula":
            number += 1
            label = f"{x.latex or ''} \\label{{eq{section}-{number}}}" if section else f"{x.latex or ''} \\label{{eq{number}}}"
            before, behind = prev[x.block_ord] in formulas, after[x.block_ord] in formulas
            if before or behind:
                out.append([("" if before else "\\begin{gather}\n") + label + (" \\\\" if behind else "\n\\end{gather}"), False])
            else:
                out.append([f"\\begin{{equation}}\n{label}\n\\end{{equation}}", False])
        elif x.semantic_type == "heading":
            level = 1 if x.heading_level is None else x.heading_level
            if level == 1:
                section, number = section + 1, 0
            out.append(["\\" + ("sub" if level == 2 else "subsub" if level >= 3 else "") + f"section{{{body}}}", False])
        elif x.semantic_type == "acknowledgement":
            out.append([f"\\begin{{acknowledgements}}\n{body}\n\\end{{acknowledgements}}", False])
        elif text == "":
            out.append(["", False])
        elif x.semantic_type == "unknown" and len(text) < SHORT and any(is_text for _, is_text in out):
            target = next(line for line in reversed(out) if line[1])
            target[0] += body
        else:
            out.append([body, True])
    return "\n".join(line + ("\n" if is_text else "") for line, is_text in out)


def grouped(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def escapes(spark, blocks):
    texts = sorted({b.text.strip(" ") for own in blocks.values() for b in own})
    return dict(spark.createDataFrame([(t,) for t in texts], "t string").select("t", latex.chemistry(latex.escape(F.col("t")))).collect())


def check(spark, streams, got):
    blocks, floats, entries = map(grouped, streams)
    escaped, want = escapes(spark, blocks), {}
    for d, own in blocks.items():
        tex = loop(sorted(own, key=lambda b: b.block_ord), floats[d], {str(e.number): e.cite_key for e in entries[d]}, escaped)
        live = [b for b in own if b.semantic_type not in ELSEWHERE]
        if floats[d] or any(all(r.semantic_type != "reference" or r.block_ord > b.block_ord for r in own) and b.semantic_type != "reference" for b in live):
            want[d] = tex
    assert {r.doc_id: r.tex for r in got.collect()} == want
    return want


def test_emitted_streams(spark, sf):
    want = check(spark, bodies.streams(spark, sf), registry.queries()["x2_emitted_streams"](spark, sf))
    everything = "\n".join(want.values())
    for part in ("\\begin{gather}", "\\begin{equation}", "\\citep{k", "\\begin{figure}", "\\subsubsection{", "\\begin{acknowledgements}", "short 5"):
        assert part in everything


def test_odd_documents(spark):
    b = [
        (1, 0, "ab", None, None, "unknown"), (1, 1, "cd", None, None, "unknown"), (1, 2, "", None, None, "empty"), (1, 3, "ef", None, None, "unknown"), (2, 0, "x", "y", None, "display_formula"), (2, 1, "", "z", None, "display_formula"),
        (2, 2, "T", None, 1, "heading"), (2, 3, "", "w", None, "display_formula"), (2, 4, "gone", None, None, "reference"), (2, 5, "gone", None, None, "body"), (3, 0, "only a title", None, None, "title"), (4, 7, "see [1] [2] [", None, None, "body"), (4, 9, "tail", None, None, "unknown"),
    ]
    blocks = spark.createDataFrame(b, "doc_id long, block_ord int, text string, latex string, heading_level int, semantic_type string")
    floats = spark.createDataFrame([(4, 5, 7, "F5"), (4, 4, 7, "F4"), (3, 1, 0, "F"), (9, 1, 0, "nobody's")], "doc_id long, float_ord int, anchor int, code string")
    entries = spark.createDataFrame([(4, 1, "k")], "doc_id long, number int, cite_key string")
    got = assembly.emit(blocks, floats, entries, ["doc_id"])
    want = check(spark, (blocks, floats, entries), got)
    assert want[1] == "abcdef\n\n" and want[4] == "see \\citep{k} [2] [tail\n\nF4\nF5" and want[3] == "F"
    assert want[2] == "\\begin{gather}\ny \\label{eq1} \\\\\nz \\label{eq2}\n\\end{gather}\n\\section{T}\n\\begin{equation}\nw \\label{eq1-1}\n\\end{equation}"
    assert assembly.emit(blocks.limit(0), floats, entries, ["doc_id"]).count() == 0


def test_recovered_floats(spark, sf):
    rows = registry.queries()["j6_recovered_anchors"](spark, sf).collect()
    late = [r for r in rows if r.anchor is not None and r.place > r.anchor + 3]
    assert len(late) > 20 and len({(r.doc_id, r.anchor) for r in late}) > 10


def test_float_groups_equal_the_loop(spark):
    rows = [(1, s, s + k % 2, s // 9, None if s % 11 == 10 else s // 4, None if s % 7 == 3 else s // 12) for k, s in enumerate(sorted({(k * k * 3) % 61 for k in range(60)}))]
    got = sorted(assembly.float_groups(spark.createDataFrame(rows, "k int, start int, end int, section int, page int, major int"), ["k"]).collect(), key=lambda r: r.start)
    group, run, before = 0, 0, None
    for r in got:
        goes_on = before is not None and r.start <= before.end + 2 and r.section == before.section and not (None not in (r.major, before.major) and r.major != before.major) and None not in (r.page, before.page) and before.page <= r.page <= before.page + 1
        run = run + 1 if goes_on else 0
        group += run % 3 == 0
        assert (r.group, r.nth) == (group, run % 3)
        before = r
    assert max(r.nth for r in got) == 2 and group > 5
