"""Office math to LaTeX: a table of element rules over the parsed tree, applied in Arrow batches."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"

# Greek letters in order; a name stands for the letter at its place.
_LOWER = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi . pi rho varsigma sigma tau upsilon phi chi psi omega"
GREEK = {chr(0x3B1 + k): "\\" + name for k, name in enumerate(_LOWER.split()) if name != "."}
GREEK |= {c: "\\" + n for c, n in zip("ΓΔΘΛΞΠΣΦΨΩ", "Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega".split())}
# Operators, accents, delimiters, signs and group characters.
OPERATORS = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "⋀": r"\bigwedge", "⋁": r"\bigvee", "⋂": r"\bigcap", "⋃": r"\bigcup"}
ACCENTS = {"\u0302": r"\hat", "\u0303": r"\tilde", "\u0304": r"\bar", "\u0307": r"\dot", "\u0308": r"\ddot", "\u20d7": r"\vec", "\u0300": r"\grave", "\u0301": r"\acute", "\u0311": r"\breve"}
DELIMITERS = {"{": r"\{", "}": r"\}", "|": r"\|"}
SIGNS = {"×": r"\times", "°": r"\circ", "≤": r"\leq", "≥": r"\geq", "±": r"\pm", "≈": r"\approx", "≠": r"\neq", "∞": r"\infty", "∝": r"\propto", "·": r"\cdot"}
GROUPS = {"⏟": r"\underbrace", "⏞": r"\overbrace", "⏜": r"\widehat", "⏝": r"\widetilde"}
STYLES = {"b": r"\mathbf", "bi": r"\boldsymbol", "i": r"\mathit"}
_TEXT = str.maketrans({**GREEK, **SIGNS, "&": r"\&", "%": r"\%", "#": r"\#"})


def _value(e: ET.Element, path: str, otherwise: str) -> str:
    found = e.find("/".join(M + p for p in path.split("/")))
    return otherwise if found is None else found.get(M + "val", otherwise)


def _part(e: ET.Element, name: str) -> str:
    found = e.find(M + name)
    return "" if found is None else inside(found)


def _parts(e: ET.Element, name: str = "e") -> list[str]:
    return [inside(x) for x in e.findall(M + name)]


def _scripts(e: ET.Element) -> str:
    sub, sup = _part(e, "sub"), _part(e, "sup")
    return (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "")


def _run(e: ET.Element) -> str:
    raw = "".join(t.text or "" for t in e.iter(M + "t"))
    text, style = raw.translate(_TEXT), _value(e, "rPr/sty", "")
    if not raw:
        return ""
    if style == "p":
        return f"\\mathrm{{{text}}}" if any(c.isalpha() for c in text) else text
    return f"{STYLES[style]}{{{text}}}" if style in STYLES else text


def _delimited(e: ET.Element) -> str:
    a, b = (_value(e, f"dPr/{n}", c) or "." for n, c in (("begChr", "("), ("endChr", ")")))
    return f"\\left{DELIMITERS.get(a, a)}{' '.join(_parts(e))}\\right{DELIMITERS.get(b, b)}"


def _accent(e: ET.Element) -> str:
    mark = _value(e, "accPr/chr", "\u0302")
    return f"{ACCENTS[mark]}{{{_part(e, 'e')}}}" if mark in ACCENTS else f"\\overset{{{mark}}}{{{_part(e, 'e')}}}"


def _rows(kind: str, rows: list[str]) -> str:
    return f"\\begin{{{kind}}}{' \\\\ '.join(rows)}\\end{{{kind}}}"


#: Element name -> LaTeX. An element without a rule gives what is inside it.
RULES = {
    "r": _run,
    "f": lambda e: f"\\frac{{{_part(e, 'num')}}}{{{_part(e, 'den')}}}",
    "sSup": lambda e: _part(e, "e") + _scripts(e), "sSub": lambda e: _part(e, "e") + _scripts(e), "sSubSup": lambda e: _part(e, "e") + _scripts(e),
    "sPre": lambda e: _scripts(e) + _part(e, "e"),
    "nary": lambda e: OPERATORS.get(c := _value(e, "naryPr/chr", "∑"), c) + _scripts(e) + _part(e, "e"),
    "bar": lambda e: f"\\{'overline' if _value(e, 'barPr/pos', 'top') == 'top' else 'underline'}{{{_part(e, 'e')}}}",
    "d": _delimited,
    "rad": lambda e: f"\\sqrt{f'[{deg}]' if (deg := _part(e, 'deg')) else ''}{{{_part(e, 'e')}}}",
    "acc": _accent,
    "m": lambda e: _rows("matrix", [" & ".join(_parts(r)) for r in e.findall(M + "mr")]),
    "eqArr": lambda e: _rows("aligned", _parts(e)),
    "groupChr": lambda e: f"{GROUPS.get(_value(e, 'groupChrPr/chr', '⏟'), GROUPS['⏟'])}{{{_part(e, 'e')}}}",
}


def inside(e: ET.Element) -> str:
    """LaTeX of an element's children; property elements (…Pr) have none."""
    out = []
    for child in e:
        name = child.tag.removeprefix(M)
        if not name.endswith("Pr"):
            out.append(RULES[name](child) if name in RULES else inside(child))
    return "".join(out)


def to_latex(xml: str | None) -> str | None:
    """LaTeX of an ``m:oMath`` element; null for null, and for what is no XML."""
    if xml is None:
        return None
    try:
        return inside(ET.fromstring(xml))
    except ET.ParseError:
        return None


@F.pandas_udf(T.StringType())
def latex_of(xml: pd.Series) -> pd.Series:
    return xml.map(to_latex, na_action="ignore")


# --- LaTeX to Office math

_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[{}^_\[\]]|\s+|[^\\{}^_\[\]\s]", re.S)
_LETTERS = {v: k for k, v in {**GREEK, **SIGNS}.items()}
_OPERATOR_OF = {v: k for k, v in OPERATORS.items()}
_ACCENT_OF = {v: k for k, v in ACCENTS.items()}
_GROUP_OF = {v: k for k, v in GROUPS.items()}
_STYLE_OF = {v: k for k, v in STYLES.items()} | {r"\mathrm": "p"}


def _joined(xml: str) -> str:
    """Plain runs side by side as one."""
    return re.sub(r"(?:<m:r><m:t>[^<]*</m:t></m:r>)+", lambda m: f"<m:r><m:t>{''.join(re.findall('<m:t>([^<]*)', m[0]))}</m:t></m:r>", xml)


class _Reader:
    """Recursive descent over the tokens of a formula; raises ValueError for what it doesn't know."""

    def __init__(self, tex: str):
        self.tokens, self.at = [t for t in _TOKEN.findall(tex) if not t.isspace()], 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if (t := self.peek()) is None:
            raise ValueError("the formula ends early")
        self.at += 1
        return t

    def sequence(self, *ends: str) -> str:
        out = ""
        while (t := self.peek()) is not None and t not in ends:
            out += self.scripted()
        if ends and self.take() not in ends:
            raise ValueError("nothing closes the group")
        return out

    def argument(self) -> str:
        """A group, or the next atom."""
        if self.peek() == "{":
            self.take()
            return self.sequence("}")
        return self.atom()

    def scripts(self) -> dict[str, str]:
        found: dict[str, str] = {}
        while self.peek() in ("_", "^"):
            found.setdefault({"_": "sub", "^": "sup"}[self.take()], self.argument())
        return found

    def scripted(self) -> str:
        if self.peek() in _OPERATOR_OF:
            sign, found = _OPERATOR_OF[self.take()], self.scripts()
            operand = self.argument() if self.peek() == "{" else ""
            inner = "".join(f"<m:{k}>{v}</m:{k}>" for k, v in found.items())
            return f'<m:nary><m:naryPr><m:chr m:val="{sign}"/></m:naryPr>{inner}<m:e>{operand}</m:e></m:nary>'
        base, found = self.argument(), self.scripts()
        if not found:
            return base
        name = {("sub",): "sSub", ("sup",): "sSup"}.get(tuple(found), "sSubSup")
        return f"<m:{name}><m:e>{base}</m:e>{''.join(f'<m:{k}>{found[k]}</m:{k}>' for k in ('sub', 'sup') if k in found)}</m:{name}>"

    def atom(self) -> str:
        t = self.take()
        if t == r"\frac":
            return f"<m:f><m:num>{self.argument()}</m:num><m:den>{self.argument()}</m:den></m:f>"
        if t == r"\sqrt":
            deg = ""
            if self.peek() == "[":
                self.take()
                deg = f"<m:deg>{self.sequence(']')}</m:deg>"
            return f"<m:rad>{deg}<m:e>{self.argument()}</m:e></m:rad>"
        if t in (r"\overline", r"\underline"):
            return f'<m:bar><m:barPr><m:pos m:val="{"top" if t == chr(92) + "overline" else "bot"}"/></m:barPr><m:e>{self.argument()}</m:e></m:bar>'
        if t in _ACCENT_OF:
            return f'<m:acc><m:accPr><m:chr m:val="{_ACCENT_OF[t]}"/></m:accPr><m:e>{self.argument()}</m:e></m:acc>'
        if t in _GROUP_OF:
            return f'<m:groupChr><m:groupChrPr><m:chr m:val="{_GROUP_OF[t]}"/></m:groupChrPr><m:e>{self.argument()}</m:e></m:groupChr>'
        if t in _STYLE_OF:
            body = _joined(self.argument())
            return body.replace("<m:r>", f'<m:r><m:rPr><m:sty m:val="{_STYLE_OF[t]}"/></m:rPr>')
        if t == r"\left":
            begin = self.take()
            inner = ""
            while self.peek() not in (r"\right", None):
                inner += self.scripted()
            self.take()
            a, b = ("" if d == "." else d.removeprefix("\\") for d in (begin, self.take()))
            return f'<m:d><m:dPr><m:begChr m:val={quoteattr(a)}/><m:endChr m:val={quoteattr(b)}/></m:dPr><m:e>{inner}</m:e></m:d>'
        if t in ("}", "^", "_"):
            raise ValueError(f"{t} stands alone")
        text = _LETTERS.get(t) or (t[1:] if t in (r"\&", r"\%", r"\#", r"\{", r"\}") else None if t[0] == "\\" else t)
        if text is None:
            raise ValueError(f"{t} is unknown")
        return f"<m:r><m:t>{escape(text)}</m:t></m:r>"


def from_latex(tex: str | None) -> str | None:
    """``m:oMath`` XML of a formula; null for null, and for a formula with commands that have no counterpart here."""
    if tex is None:
        return None
    try:
        body = _Reader(tex).sequence()
    except ValueError:
        return None
    return f'<m:oMath xmlns:m="{M[1:-1]}">{_joined(body)}</m:oMath>'


@F.pandas_udf(T.StringType())
def omml_of(tex: pd.Series) -> pd.Series:
    return tex.map(from_latex, na_action="ignore")
