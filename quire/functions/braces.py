"""Braces of any depth: one fold over a text's marks, from which splits, groups, arguments, column formats and cell texts follow.

A text is cut into commands, escaped characters, braces, separators and the runs between them; the fold keeps a place and a
depth, and a list grows only where something begins or ends. So the work is linear in the marks, and besides a walk through the text for each
part that is cut out: right for rows, cells and arguments, not for splitting a whole book at once. Escaped braces and separators are text. A closing brace without an opening one counts for nothing; a group that nothing closes ends with the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import latex as L

_MARKS = r"(?s)\\[A-Za-z@]+\*?|\\.|[{}&]|[^\\{}&]+|\\"
_ARGUMENT = "struct<name:string,start:int,open:int,close:int>"


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """What ``make`` gives for a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), make), 0)


def marks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_MARKS), F.lit(0))


def _deeper(depth: Column, mark: Column) -> Column:
    return F.greatest(F.lit(0), depth + F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0))


def split(text: Column, separator: str = "&") -> Column:
    """The parts of a text between separators (``&``) outside of braces, trimmed."""
    return let(text, lambda t: _split(t, separator))


def _split(text: Column, separator: str) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("begin"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, mark: Column) -> Column:
        cuts, after = (mark == separator) & (acc["depth"] == 0), acc["at"] + F.length(mark)
        part = F.substring(text, acc["begin"] + 1, acc["at"] - acc["begin"])
        return F.struct(after.alias("at"), F.when(cuts, after).otherwise(acc["begin"]).alias("begin"), _deeper(acc["depth"], mark).alias("depth"), F.when(cuts, F.array_append(acc["out"], part)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(marks(text), zero, step, lambda acc: F.array_append(acc["out"], F.substring(text, acc["begin"] + 1, acc["at"] - acc["begin"])))
    return F.transform(whole, lambda x: F.trim(x))


def padded(parts: Column, n: Column) -> Column:
    """``n`` parts: those that lack are empty, those beyond go."""
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), F.greatest(n - F.size(parts), F.lit(0)))), 1, n)


def group(text: Column, start: Column, opening: str = "{", closing: str = "}") -> Column:
    """Content of the brace (or bracket) at ``start`` (1-based) up to its match; null if none is there."""
    return let(F.substring(text, start, F.length(text)), lambda rest: _group(rest, opening, closing))


def _group(rest: Column, opening: str, closing: str) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))
    either = "".join(f"\\{c}" for c in (opening, closing))
    found = F.regexp_extract_all(rest, F.lit(rf"(?s)\\.|[{either}]|[^\\{either}]+|\\"), F.lit(0))

    def step(acc: Column, mark: Column) -> Column:
        depth = F.greatest(F.lit(0), acc["depth"] + F.when(mark == opening, 1).when(mark == closing, -1).otherwise(0))
        closes = acc["end"].isNull() & (mark == closing) & (depth == 0)
        return F.struct((acc["at"] + F.length(mark)).alias("at"), depth.alias("depth"), F.when(closes, acc["at"]).otherwise(acc["end"]).alias("end"))

    inside = F.aggregate(found, zero, step, lambda acc: F.substring(rest, F.lit(2), F.coalesce(acc["end"], acc["at"]) - 1))
    return F.when(rest.startswith(opening), inside)


def arguments(text: Column, *names: str) -> Column:
    """array<struct<name, start, open, close>> of the first arguments of commands, inner before outer: places from 0 of the
    backslash, of the opening brace and of the closing one. Options in square brackets may stand between. Without names, of all commands."""
    none = F.array().cast(f"array<{_ARGUMENT}>")
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("start"),
        F.array().cast("array<struct<name:string,start:int,open:int,depth:int>>").alias("held"), none.alias("out"),
    )
    wanted = (lambda mark: F.substring(mark, 2, 1 << 20).isin(*names)) if names else (lambda mark: F.lit(True))

    def step(acc: Column, mark: Column) -> Column:
        command = mark.rlike(r"^\\[A-Za-z@]") & wanted(mark)
        opens, depth, held = (mark == "{") & acc["name"].isNotNull(), _deeper(acc["depth"], mark), acc["held"]
        last = F.get(held, F.size(held) - 1)
        closes = (mark == "}") & (F.size(held) > 0) & (last["depth"] == depth)
        options = mark.rlike(r"^\s*(?:\[[^\]]*\]\s*)*$")
        push = F.struct(acc["name"].alias("name"), acc["start"].alias("start"), acc["at"].alias("open"), acc["depth"].alias("depth"))
        done = F.struct(last["name"].alias("name"), last["start"].alias("start"), last["open"].alias("open"), acc["at"].alias("close"))
        return F.struct(
            (acc["at"] + F.length(mark)).alias("at"), depth.alias("depth"),
            F.when(command, F.substring(mark, 2, 1 << 20)).when(options & (mark != "{"), acc["name"]).alias("name"), F.when(command, acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(opens, F.array_append(held, push)).when(closes, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(held).alias("held"),
            F.when(closes, F.array_append(acc["out"], done)).otherwise(acc["out"]).alias("out"),
        )

    def rest(acc: Column) -> Column:
        open_ended = F.transform(F.reverse(acc["held"]), lambda h: F.struct(h["name"].alias("name"), h["start"].alias("start"), h["open"].alias("open"), acc["at"].alias("close")))
        return F.concat(acc["out"], open_ended)

    return F.aggregate(marks(text), zero, step, rest)


def bodies(text: Column, *names: str) -> Column:
    """Contents of the first arguments of the commands, inner before outer."""
    return let(text, lambda t: F.transform(arguments(t, *names), lambda a: F.substring(t, a["open"] + 2, a["close"] - a["open"] - 1)))


def unwrapped(text: Column, *names: str) -> Column:
    """The text without the commands, their options and their braces; what is between the braces stays, whatever it holds."""
    return let(text, lambda t: _unwrapped(t, *names))


def _unwrapped(text: Column, *names: str) -> Column:
    found = arguments(text, *names)
    # Every argument takes away two stretches: from its command to its opening brace, and its closing brace.
    gone = F.array_sort(F.flatten(F.transform(found, lambda a: F.array(F.struct(a["start"].alias("a"), (a["open"] + 1).alias("b")), F.struct(a["close"].alias("a"), (a["close"] + 1).alias("b"))))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, g: F.struct(g["b"].alias("at"), F.array_append(acc["out"], F.substring(text, acc["at"] + 1, g["a"] - acc["at"])).alias("out"))
    return F.aggregate(gone, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def rewritten(text: Column, make: Callable[[Column, Column], Column], *names: str) -> Column:
    """The text with each outermost ``\\name{body}``, options included, replaced by ``make(name, body)``. One that nothing closes stays."""
    return let(text, lambda t: _rewritten(t, make, *names))


def _rewritten(text: Column, make: Callable[[Column, Column], Column], *names: str) -> Column:
    found = F.array_sort(F.transform(F.filter(arguments(text, *names), lambda a: a["close"] < F.length(text)), lambda a: F.struct(a["start"].alias("start"), a["name"].alias("name"), a["open"].alias("open"), a["close"].alias("close"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, a: Column) -> Column:
        inner = a["start"] < acc["at"]
        body = F.substring(text, a["open"] + 2, a["close"] - a["open"] - 1)
        more = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, a["start"] - acc["at"]), let(body, lambda b: make(a["name"], b))))
        return F.struct(F.when(inner, acc["at"]).otherwise(a["close"] + 1).alias("at"), F.when(inner, acc["out"]).otherwise(more).alias("out"))

    return F.aggregate(found, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


# --- column formats of a tabular

# Alignment of a column letter, and twips of a unit of length.
ALIGNMENTS = {"l": "left", "c": "center", "r": "right", "p": "left", "m": "left", "b": "left"}
TWIPS = {"cm": 567.0, "mm": 56.7, "in": 1440.0}
_FORM = r"(?s)\\[A-Za-z@]+|\\.|[{}|]|[lcrpmb]|[@!<>]|[^\\{}|lcrpmb@!<>]+|\\"
_COLUMN = "struct<align:string,width:string,rule_left:boolean,rule_right:boolean>"


# Groups that close, eight deep at most, and what stands outside of groups in a format besides its columns and bars.
_CLOSED = r"\{(?:[^\\{}]++|\\.)*+\}"
for _ in range(7):
    _CLOSED = rf"\{{(?:[^\\{{}}]++|\\.|{_CLOSED})*+\}}"
_ASIDE = rf"\\[A-Za-z@]++|\\.|{_CLOSED}"
_LENGTH = r"\s*([0-9.]+)\s*(cm|mm|in)\s*"


def columns(form: Column) -> Column:
    """array<struct<align, width_twips, rule_left, rule_right>> of a column format.

    A bar belongs to the column before it, at the start to the first column. Groups after ``@``, ``!``, ``<`` and ``>`` may hold
    anything, at any depth. A width in another unit than cm, mm or in is null, as is that of a column without one. Formats whose groups
    all close, eight deep at most, are cut into columns at once; the fold, mark by mark, is for the others.
    """
    return let(form, lambda f: F.when(f.rlike(rf"(?s)^(?:[^\\{{}}]++|{_ASIDE})*+\z"), _columns_cut(f)).otherwise(_columns_fold(f)))


def _twips(number: Column, unit: Column) -> Column:
    units = F.create_map(*[F.lit(x) for pair in TWIPS.items() for x in pair])
    return F.bround(number.try_cast("double") * F.element_at(units, unit)).cast("int")


def _align(letter: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ALIGNMENTS.items() for x in pair]), letter)


def _columns_cut(form: Column) -> Column:
    """Every match is a column letter, the groups right behind it and what follows up to the next; of several groups the last is the width."""
    other = rf"(?:[^\\{{}}lcrpmb]++|{_ASIDE})*+"
    bar = lambda stretch: stretch.contains("|") & (~stretch.rlike(r"[\\{]") | F.regexp_replace(stretch, rf"(?s){_ASIDE}", "").contains("|"))
    width = rf"(?s)^[pmb](?:{_CLOSED}(?=\{{))*+\{{{_LENGTH}\}}"
    first = bar(F.regexp_extract(form, rf"(?s)^{other}", 0))
    parts = F.regexp_extract_all(form, F.lit(rf"(?s)\G(?:^{other})?([lcrpmb]{other})"), F.lit(1))
    measured = lambda p: F.when(p.rlike(width), _twips(F.regexp_extract(p, width, 1), F.regexp_extract(p, width, 2)))
    return F.transform(parts, lambda p, k: F.struct(_align(F.substring(p, 1, 1)).alias("align"), measured(p).alias("width_twips"), ((k == 0) & first).alias("rule_left"), bar(p).alias("rule_right")))


def _columns_fold(form: Column) -> Column:
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kind"), F.lit("").alias("inside"), F.lit(False).alias("bar"), F.array().cast(f"array<{_COLUMN}>").alias("out"))

    def step(acc: Column, mark: Column) -> Column:
        depth, out = _deeper(acc["depth"], mark), acc["out"]
        top, last = (acc["depth"] == 0), F.get(out, F.size(out) - 1)
        column = top & mark.rlike("^[lcrpmb]$")
        bar, measured = top & (mark == "|"), (mark == "}") & (depth == 0) & (acc["kind"] == "width") & (F.size(out) > 0)
        new = F.struct(_align(mark).alias("align"), F.lit(None).cast("string").alias("width"), (acc["bar"] & (F.size(out) == 0)).alias("rule_left"), F.lit(False).alias("rule_right"))
        changed = F.struct(last["align"].alias("align"), F.when(measured, acc["inside"]).otherwise(last["width"]).alias("width"), last["rule_left"].alias("rule_left"), (last["rule_right"] | bar).alias("rule_right"))
        return F.struct(
            depth.alias("depth"),
            F.when(top & mark.isin("p", "m", "b"), "width").when(top & (mark != "{"), "").otherwise(acc["kind"]).alias("kind"),
            F.when(top, "").otherwise(F.concat(acc["inside"], F.when(depth > 0, mark).otherwise(""))).alias("inside"),
            (acc["bar"] | bar).alias("bar"),
            F.when(column, F.array_append(out, new)).when((bar | measured) & (F.size(out) > 0), F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), changed)).otherwise(out).alias("out"),
        )

    found = F.aggregate(F.regexp_extract_all(form, F.lit(_FORM), F.lit(0)), zero, step, lambda acc: acc["out"])
    length = rf"^{_LENGTH}$"
    twips = lambda w: _twips(F.regexp_extract(w, length, 1), F.regexp_extract(w, length, 2))
    return F.transform(found, lambda c: F.struct(c["align"].alias("align"), F.when(c["width"].rlike(length), twips(c["width"])).alias("width_twips"), c["rule_left"].alias("rule_left"), c["rule_right"].alias("rule_right")))


# --- cell texts

# Point sizes that a cell's size command stands for.
CELL_SIZES = {"tiny": 6, "scriptsize": 8, "footnotesize": 9, "small": 10, "normalsize": 12, "large": 14, "Large": 16, "LARGE": 18, "huge": 20, "Huge": 24}
_CELL = r"(?s)\$_\{[^}]+\}\$|\$_[^$]+\$|\\textsubscript\{[^{}]*\}|\\[A-Za-z@]+\*?\s*|\\.|[{}$]|[^\\{}$]+|\\|\$"


def cell(text: Column) -> Column:
    """struct<text, bold, italic, size_pt> of a cell's code: commands and braces of any depth dropped, subscripts as characters, escaped characters as they read."""
    return let(text, _cell)


def cell_text(text: Column) -> Column:
    """The text alone of ``cell``. Without commands and dollars it is one replacement; the marks are for the others."""
    return let(text, _cell_text)


def _cell_text(text: Column) -> Column:
    escapes = F.trim(F.regexp_replace(text, r"(?s)\\(.)|[{}\\]", "$1"))
    return F.when(~text.rlike(r"\$|\\[\\A-Za-z@]"), escapes).otherwise(_cell_marks(text))


def _cell_marks(text: Column) -> Column:
    lowered = lambda mark: L.subscript(F.regexp_replace(mark, r"^\$_\{?|^\\textsubscript\{|\}?\$$|\}$", ""))
    shown = lambda mark: (
        F.when(mark.rlike(r"^(?:\$_.|\\textsubscript\{)"), lowered(mark)).when(mark.rlike(r"^\\[^A-Za-z@]$"), F.when(mark == "\\\\", " ").otherwise(F.substring(mark, 2, 1)))
        .when(mark.rlike(r"^(?:\\|[{}$]$)"), "").otherwise(mark)
    )
    return F.trim(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_CELL), F.lit(0)), shown), ""))


def _cell(text: Column) -> Column:
    found = F.lit(None).cast("int")
    for name, pt in reversed(CELL_SIZES.items()):
        found = F.when(text.rlike(rf"\\{name}(?![A-Za-z])"), F.lit(pt)).otherwise(found)
    return F.struct(_cell_text(text).alias("text"), text.rlike(r"\\(?:textbf|bfseries|bf)(?![A-Za-z])").alias("bold"), text.rlike(r"\\(?:textit|emph|itshape|it)(?![A-Za-z])").alias("italic"), found.alias("size_pt"))
