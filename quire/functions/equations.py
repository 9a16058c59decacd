"""Displayed equations: width estimate, line breaks, clean-up; recursive or NFKC, so in Arrow-batched Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Width in characters of commands, of a letter, digit or sign, of another sign; of scripts.
COMMAND_WIDTH = {r"\times": 1.0, r"\quad": 2.0, r"\,": 0.3, r"\;": 0.6}
PLAIN_WIDTH, OTHER_WIDTH, SCRIPT_SHARE, SCRIPT_LEAST, SCRIPT_SINGLE = 0.9, 0.7, 0.45, 0.8, 0.6
_WRAP = re.compile(r"\\(?:mathbf|mathrm|boldsymbol|text|operatorname)\{([^{}]*)\}")


def width(body: str | None) -> float | None:
    """Estimated characters that an equation takes, scripts counting less."""
    if body is None:
        return None
    body, total = re.sub(r"\\(?:label|tag)\{[^{}]*\}", "", body), 0.0
    for command, w in COMMAND_WIDTH.items():
        total += w * body.count(command)
        body = body.replace(command, " ")
    body = re.sub(r"\\[A-Za-z]+", "x", _WRAP.sub(r"\1", body))
    levels = [[total, 0.0]]  # of each open script: its width so far, and what is around it
    at = 0
    opened: list[str] = []
    while at < len(body):
        c = body[at]
        if c in "^_" and body[at + 1 : at + 2] == "{":
            levels.append([0.0, 0.0])
            opened.append("script")
            at += 2
            continue
        if c in "^_":
            levels[-1][0] += SCRIPT_SINGLE
            at += 2
            continue
        if c == "{":
            opened.append("group")
        elif c == "}":
            if opened and opened.pop() == "script":
                inner = levels.pop()[0]
                levels[-1][0] += max(SCRIPT_LEAST, SCRIPT_SHARE * inner)
        elif not c.isspace():
            levels[-1][0] += PLAIN_WIDTH if c.isalnum() or c in "+-=,.:;" else OTHER_WIDTH
        at += 1
    while len(levels) > 1:  # scripts that nothing closes
        inner = levels.pop()[0]
        levels[-1][0] += max(SCRIPT_LEAST, SCRIPT_SHARE * inner)
    return levels[0][0]


def _length(text: str) -> int:
    return len(re.sub(r"[{}\s]", "", re.sub(r"\\[A-Za-z]+", "x", _WRAP.sub(r"\1", text))))


def break_lines(body: str | None, capacity: float | None = None) -> list[str] | None:
    """An equation broken before plus signs: two terms a line at most, 85 % of the capacity; two balanced lines if one would do."""
    if body is None:
        return None
    equals = re.search(r"(?<![{\\])=", body)
    if not equals:
        return [body]
    left, right = body[: equals.start()].rstrip(), body[equals.end() :].strip()
    cuts = [m.start() for m in re.finditer(r"(?<![{\\])\+", right)]
    edges = [0, *cuts, len(right)]
    terms = [t for a, b in zip(edges, edges[1:]) if (t := right[a:b].strip())]
    if not cuts or len(terms) < 2:
        return [body]
    limit = 0.85 * (capacity if capacity and capacity > 0 else max(_length(body) / 2, 35.0))
    lines: list[list[str]] = [[]]
    for term in terms:
        head = f"{left} =" if len(lines) == 1 else r"\quad "
        if lines[-1] and (len(lines[-1]) >= 2 or width(head + "".join([*lines[-1], term])) > limit):
            lines.append([])
        lines[-1].append(term)
    if len(lines) == 1:
        halves = [(f"{left} ={right[:c].strip()}", right[c:].strip(), c) for c in cuts]
        cut = min((_length(a) < _length(b), abs(_length(a) - _length(b)), c) for a, b, c in halves)[2]
        lines = [[right[:cut].strip()], [right[cut:].strip()]]
    texts = ["".join(x).strip() for x in lines]
    return [f"{left} &={texts[0].lstrip('+').strip()}", *[r"&\quad " + (t if t.startswith("+") else "+" + t) for t in texts[1:]]]


# Artefacts of the formula converter and what they stand for, in the order of application.
CLEANUP = (
    (r"\\times(?=[A-Za-z\\])", r"\\times "), (r"\\(?:mathbf|boldsymbol|mathrm)\{\\times\s*([A-Za-z])\}", r"\\times \1"),
    (r"\\mathrm\{(\\[A-Za-z]+)\}", r"\1"), ("[\ufffc\ufffd$]", ""), (r"\\(?:boldsymbol|mathbf|textbf)\{\s*\}", ""),
    (r"\\(?:boldsymbol|mathbf)\{\\times\}", r"\\times"), (r"\\times\s*([+\-])", r"\1"), (r"\\(?:boldsymbol|mathbf)\{([=+\-])\}", r"\1"),
    (r"\\mathrm\{CO2\}", r"\\mathrm{CO}_{2}"), (r"\s+", " "),
)


def cleaned(formula: str | None) -> str | None:
    """A formula in NFKC without converter artefacts."""
    if formula is None:
        return None
    out = unicodedata.normalize("NFKC", formula).replace("−", "-").replace("×", r"\times ")
    for old, new in CLEANUP:
        out = re.sub(old, new, out)
    return out.strip()


@F.pandas_udf(T.DoubleType())
def width_of(body: pd.Series) -> pd.Series:
    return body.map(width, na_action="ignore").astype("float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def lines_of(body: pd.Series, capacity: pd.Series) -> pd.Series:
    return pd.Series([break_lines(b, None if pd.isna(c) else c) for b, c in zip(body, capacity)])


@F.pandas_udf(T.StringType())
def cleaned_of(formula: pd.Series) -> pd.Series:
    return formula.map(cleaned, na_action="ignore")

# Operators that take an operand.
NARY = ("sum", "prod", "int", "iint", "iiint", "oint", "bigcup", "bigcap", "bigvee", "bigwedge", "bigoplus", "bigotimes", "coprod", "biguplus", "bigsqcup")
_NARY = re.compile(r"\\(?:%s)(?![A-Za-z])" % "|".join(sorted(NARY, key=len, reverse=True)))


def _skip_script(text: str, at: int) -> int:
    """The place after a sub- or superscript that begins at ``at``."""
    at += 1
    if text[at : at + 1] == "{":
        depth = 0
        while at < len(text):
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
            if depth == 0:
                break
        return at
    m = re.match(r"\\[A-Za-z]+|.", text[at:])
    return at + (m.end() if m else 0)


def with_operands(formula: str | None) -> str | None:
    """Braces around what an operator applies to: up to the next sign or relation outside all brackets."""
    if formula is None:
        return None
    out, at = "", 0
    while m := _NARY.search(formula, at):
        k = m.end()
        while formula[k : k + 1] in ("_", "^") and k < len(formula):
            k = _skip_script(formula, k)
        while formula[k : k + 1] == " ":
            k += 1
        end, depth = k, 0
        while end < len(formula) and not (depth == 0 and formula[end] in "+-=<>,;&"):
            depth += {"{": 1, "(": 1, "[": 1, "}": -1, ")": -1, "]": -1}.get(formula[end], 0)
            if depth < 0:
                break
            end += 1
        operand = formula[k:end].strip()
        wrapped = operand.startswith("{") and operand.endswith("}")
        out += formula[at:k].rstrip() if operand else formula[at:k]
        out += "" if not operand else operand if wrapped else "{" + with_operands(operand) + "}"
        at = end
    return out + formula[at:]


@F.pandas_udf(T.StringType())
def with_operands_of(formula: pd.Series) -> pd.Series:
    return formula.map(with_operands, na_action="ignore")
