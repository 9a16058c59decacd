"""What a block says about itself, as Columns over a block's text, runs and measures: captions, figure sizes, names, affiliations, preamble lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordered as O
from .braces import group, let

# How a caption begins, by style and by number; what it is behind body text, in points, and how long it may be without sizes.
CAPTION_START = r"(?i)^(?:[图表]\s*[0-9.]+|Figure|Fig\.|Table|Tab\.|Talbe)"
CAPTION_NUMBER = r"(?i)^(?:Figure|Fig\.?|Table|Tab\.?)\s*[0-9]+(?:\.[0-9]+)*\s*[.:：．]\s+"
CAPTION_NUMBER_ZH = r"^(?:图|表)\s*[0-9]+(?:\.[0-9]+)*\s*[.:：．、]\s*\S+"
SMALLER_HALVES, SMALLER_PT, LONGEST, BODY_PT = 4, 1.0, 200, 12.0


def _sizes(runs: Column) -> Column:
    """Sizes of the runs that hold more than blanks."""
    return F.transform(F.filter(runs, lambda r: (F.trim(r["text"]) != "") & r["size_pt"].isNotNull()), lambda r: r["size_pt"])


def first_mode_of(values: Column) -> Column:
    """The most frequent element, the first of equals; null of none."""
    counted = lambda vs: F.transform(vs, lambda v, k: F.struct(F.size(F.filter(vs, lambda o: o == v)).alias("n"), (-F.array_position(vs, v)).alias("at"), v.alias("v")))
    return let(values, lambda vs: F.array_max(counted(vs))["v"])


def caption_by_style(text: Column, runs: Column, alignment: Column, indent_pt: Column, body_pt: Column) -> Column:
    """Whether a block is a caption, by the first test that says so: its first size lies two points or more below the body's; its largest more than
    one; it is centred and begins like a caption; it begins like one and has no indent. Tests on sizes that aren't told say nothing."""
    sizes, starts = _sizes(runs), F.trim(text).rlike(CAPTION_START)
    smaller = F.round(F.get(sizes, 0) * 2) <= F.round(body_pt * 2) - SMALLER_HALVES
    all_smaller = F.array_max(sizes) < body_pt - SMALLER_PT
    by_place = starts & ((F.coalesce(alignment, F.lit("")) == "center") | (F.coalesce(indent_pt, F.lit(0.0)) == 0))
    return (F.trim(text) != "") & (F.coalesce(smaller, F.lit(False)) | F.coalesce(all_smaller, F.lit(False)) | by_place)


def float_caption(text: Column, runs: Column, body_pt: Column) -> Column:
    """Whether a block is a float's caption: it begins with a number and a mark, and its usual size is below the body's; without sizes, if it is short."""
    t = F.trim(text)
    usual = first_mode_of(F.transform(F.filter(runs, lambda r: r["size_pt"].isNotNull()), lambda r: r["size_pt"]))
    return (t.rlike(CAPTION_NUMBER) | t.rlike(CAPTION_NUMBER_ZH)) & F.coalesce(usual < F.coalesce(body_pt, F.lit(BODY_PT)), F.length(t) <= LONGEST)


# How much wider than a column a figure may be; the share of a page's height that floats take if a class tells none, what is
# kept for the caption, the least height, and what a tall figure (by its width over its height) may take, in millimetres.
SLACK, FRACTION, CAPTION_MM, LEAST_MM, TALL, TALL_SHARE = 1.02, 0.82, 18.0, 20.0, 1.3, 0.60


def column_mm(text_mm: Column, columns: Column, gap_mm: Column) -> Column:
    """Width of one of several columns; null where there is one, or no width."""
    return F.when((text_mm > 0) & (columns > 1), (text_mm - (columns - 1) * gap_mm) / columns)


def needs_full_width(width_mm: Column, told: Column, text_mm: Column, columns: Column, gap_mm: Column) -> Column:
    """Whether a figure goes over all columns: if it is wider than one, or of unknown width; without columns, if it says so and tells no width."""
    one = column_mm(text_mm, columns, gap_mm)
    return F.when(one.isNull(), F.coalesce(told, F.lit(False)) & width_mm.isNull()).when(width_mm.isNull(), True).otherwise(width_mm > one * SLACK)


def height_limit_mm(page_mm: Column, fraction: Column, target_mm: Column, aspect: Column) -> Column:
    """The height that a figure may take, null without a page height. A tall one may be as high as it is wide, but not take more than its share of a page."""
    share = F.when((fraction > 0) & (fraction <= 1), fraction).otherwise(FRACTION)
    usual = page_mm * share - CAPTION_MM
    tall = F.least(F.greatest(usual, F.coalesce(target_mm, usual)), page_mm * TALL_SHARE)
    return F.when(page_mm > 0, F.greatest(F.lit(LEAST_MM), F.when(aspect <= TALL, tall).otherwise(usual)))


# --- names

# Words that show a placeholder instead of a file's name.
PLACEHOLDERS = ("your", "bibdatabase", "bib database", "bibfile", "bib file", "filename", "database")


def bib_name(value: Column, default: str = "references") -> Column:
    """A bibliography's name without its folder and suffix; the default for placeholders and names that a file system or TeX doesn't take."""
    first = F.regexp_replace(F.split(F.trim(F.regexp_replace(F.trim(value), r"^[{}]+|[{}]+$", "")), ",")[0], r"""^[\s"']+|[\s"']+$""", "")
    stem = F.regexp_replace(F.trim(F.regexp_extract(F.translate(first, "\\", "/"), r"([^/]*)$", 1)), r"(?i)\.bib$", "")

    def checked(s: Column) -> Column:
        placeholder = F.lit(False)
        for word in PLACEHOLDERS:
            placeholder = placeholder | F.lower(s).contains(word)
        return F.when(s.isin("", ".", "..") | placeholder | s.rlike(r"""[<>:"/\\|?*\s]"""), default).otherwise(s)

    return let(F.coalesce(stem, F.lit("")), checked)


def class_options(defaults: Column, declared: Column, wanted: Column) -> Column:
    """Options of a class: its defaults and those wanted that it declares, or any if it declares ``*``; each once, in that order."""
    accepted = F.filter(wanted, lambda w: w.isNotNull() & (w != "") & (F.array_contains(declared, "*") | F.array_contains(declared, w)))
    return F.array_distinct(F.concat(defaults, accepted))


# --- affiliations and addresses

def affiliation(text: Column) -> Column:
    """struct<label, body> of an affiliation: a superscript in front, as a formula or a command, is its label."""

    def parts(t: Column) -> Column:
        formula = r"(?s)^\$\s*\^(?:\{([^{}]+)\}|([^{}\s$]+))\s*(?:\\mathrm\{([^{}]*)\}\s*)?\$\s*(.*)$"
        command = "\\textsuperscript{"
        raised = group(t, F.lit(len(command)))
        by_command = F.struct(F.trim(raised).alias("label"), F.trim(F.substring(t, F.length(raised) + len(command) + 2, F.length(t))).alias("body"))
        piece = lambda k: F.trim(F.regexp_extract(t, formula, k))
        by_formula = F.struct(F.concat(piece(1), piece(2)).alias("label"), F.trim(F.concat_ws(" ", F.nullif(piece(3), F.lit("")), piece(4))).alias("body"))
        return F.when(t.startswith(command), by_command).when(t.rlike(formula), by_formula).otherwise(F.struct(F.lit("").alias("label"), t.alias("body")))

    return let(F.trim(F.coalesce(text, F.lit(""))), parts)


def affiliation_command(text: Column, class_name: Column) -> Column:
    """An affiliation as its class writes it."""

    def made(a: Column) -> Column:
        label, body = a["label"], F.when(a["body"] == "", F.trim(text)).otherwise(a["body"])
        elsevier = F.concat(F.lit("\\affiliation"), F.when(label != "", F.concat(F.lit("["), label, F.lit("]"))).otherwise(""), F.lit("{organization={"), body, F.lit("}}"))
        raised = F.concat(F.lit("\\affil{"), F.when(label != "", F.concat(F.lit("$^{"), label, F.lit("}$"))).otherwise(""), body, F.lit("}"))
        return F.when(F.lower(class_name) == "elsarticle", elsevier).when(F.lower(class_name) == "nsr", raised).otherwise(F.concat(F.lit("\\affil[]{"), F.trim(text), F.lit("}")))

    return let(affiliation(text), made)


def address_in_runs(runs: Column) -> Column:
    """The first e-mail address of a block whose editor has cut it into several runs; blank runs and brackets end it. Null without one."""
    ended = F.array_join(F.transform(runs, lambda r: F.when(F.trim(r["text"]).isin("", "(", ")"), "\u0000").otherwise(F.trim(r["text"]))), "")
    return F.get(F.filter(F.transform(F.split(ended, "\u0000"), lambda s: F.regexp_replace(s, r"^[() ]+|[() ]+$", "")), lambda s: s.contains("@") & (F.length(s) > 3)), 0)


# --- preambles

def clean_preamble(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text): a preamble without blocks of made comments, which begin with ``% ===`` and go on to the first line that is no comment,
    and without commands that are only prose (a command, a blank and a small letter)."""
    rows = docs.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("__quire_at", "line"))
    w = O.ordered(keys, "__quire_at")
    opens, ends = F.col("line").rlike(r"^\s*% ={3,}"), ~F.trim("line").startswith("%")
    rows = rows.withColumns({"__quire_open": O.forward_fill(F.when(opens, F.col("__quire_at")), w), "__quire_end": O.forward_fill(F.when(ends, F.col("__quire_at")), w)})
    inside = F.col("__quire_open").isNotNull() & (F.col("__quire_end").isNull() | (F.col("__quire_end") < F.col("__quire_open")))
    prose = F.col("line").rlike(r"^\s*\\[a-zA-Z]+\s+[a-z]")
    kept = rows.filter(~inside & ~prose).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__quire_at", "line"))), lambda x: x["line"]), "\n").alias("__quire_text"))
    return docs.select(*keys).join(kept, keys, "left").select(*keys, F.coalesce("__quire_text", F.lit("")).alias(text))
