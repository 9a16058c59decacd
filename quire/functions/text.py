"""Text predicates and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAPTION = r"(?i)^\s*(figure|fig\.|table|图|表)\s*[0-9]+"
NUMBERED = r"^[0-9]+(\.[0-9]+)*\s+\S"


def line_class(line: Column) -> Column:
    """empty, caption, heading, short or body."""
    return (
        F.when(F.trim(line) == "", "empty").when(line.rlike(CAPTION), "caption")
        .when(line.rlike(NUMBERED) & (F.length(line) <= 80), "heading").when(F.length(line) <= 80, "short").otherwise("body")
    )


def heading_level(style: Column) -> Column:
    """1 to 4 from the style's name, else null."""
    out = F.lit(None).cast("int")
    for k in (4, 3, 2, 1):
        out = F.when(style.contains(f"Heading {k}"), k).otherwise(out)
    return out


def repaired_level(level: Column, text: Column) -> Column:
    """A second-level heading with a plain number is of the first level."""
    plain = text.rlike(r"^[0-9]+[\s、．.]") | text.rlike(r"^[0-9]+[^0-9\s.、]")
    return F.when((level == 2) & plain & ~text.rlike(r"^[0-9]+\.[0-9]+"), 1).otherwise(level)


def without_number(text: Column) -> Column:
    """A heading without its leading number and bold wrap."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\\textbf\{([^}]*)\}", "$1"), r"^[0-9]+(\.[0-9]+)*[\s、．.]*", ""))


def caption_text(text: Column) -> Column:
    """A caption with its number in one form: ``Figure 2: ...``."""
    out = F.regexp_replace(text, "(?i)talbe", "Table")
    out = F.regexp_replace(F.regexp_replace(out, r"^表\s*([0-9]+)", "Table $1"), r"^图\s*([0-9]+)", "Figure $1")
    return F.regexp_replace(out, r"(?i)^(Table|Figure|Fig\.)\s*([0-9]+(?:\.[0-9])?)[\s:：,，.、]*", "$1 $2: ")


def without_caption_number(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)^\s*(图|表|figure|fig\.?|table|talbe)\s*[0-9]+(\.[0-9]+)*\s*[.:：,，、]*\s*", ""))


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs compare as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x)), "")


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9_\s-]", "")), r"\s+", "-"), 1, 50)


def numeric_looking(text: Column) -> Column:
    return F.trim(text).rlike(r"^[-+±0-9.,\s%/()]*$")


def query_variants(text: Column, lengths: tuple[int, ...] = (100, 80, 60, 45, 32, 24)) -> Column:
    """Prefixes to search for, longest first, then the whole; each once."""
    cuts = F.array(*[F.when(F.length(text) >= n, F.substring(text, 1, n)) for n in lengths], text)
    return F.array_distinct(F.filter(cuts, lambda c: c.isNotNull() & (c != "")))


def position_class(y: Column, caption_y: Column) -> Column:
    """Where a float stands on its page, by the share of the height above it."""
    return F.when(y <= 0.24, "top").when(y >= 0.32, "inline").when(caption_y >= 0.55, "inline").otherwise("top")


def safe_name(text: Column) -> Column:
    return F.when(text.rlike(r"^[A-Za-z0-9_.-]+$"), text).otherwise(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"))


def alignment_name(number: Column) -> Column:
    """left, center, right or justify; else null."""
    return F.when(number == 0, "left").when(number == 1, "center").when(number == 2, "right").when(number == 3, "justify")
