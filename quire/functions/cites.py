"""Citations and bibliographies, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import braces


def marker(key: Column, mode: Column) -> Column:
    """Alphanumeric marker that carries a key through other tools."""
    return F.concat(F.lit("CITELINK"), mode, F.lower(F.hex(F.encode(key, "UTF-8"))), F.lit("END"))


def bookmark(key: Column) -> Column:
    return F.concat(F.lit("_Bib_"), F.regexp_replace(key, "[^A-Za-z0-9]", "_"))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def search_form(text: Column) -> Column:
    """Lower-cased letters and digits of any script."""
    return F.lower(F.regexp_replace(text, r"(?U)[\W_]", ""))


def surname(author: Column) -> Column:
    """Of the first author: what stands before a comma, else the last alphabetic word."""
    first = F.element_at(F.split(author, r"\s+and\s+"), 1)
    words = F.regexp_extract_all(first, F.lit("[A-Za-z]+"), F.lit(0))
    return F.when(F.contains(first, F.lit(",")), F.trim(F.split_part(first, F.lit(","), F.lit(1)))).otherwise(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))


def author_list(authors: Column, at_most: int | None = None) -> Column:
    """One, two with ``and``, more with commas; cut to ``et al.`` beyond ``at_most``."""
    n, last = F.size(authors), F.try_element_at(authors, F.lit(-1))
    whole = (
        F.when(n == 0, "").when(n <= 2, F.array_join(authors, " and "))
        .otherwise(F.concat(F.array_join(F.slice(authors, F.lit(1), n - 1), ", "), F.lit(", and "), last))
    )
    return whole if at_most is None else F.when(n > at_most, F.concat(F.array_join(F.slice(authors, 1, at_most), ", "), F.lit(", et al."))).otherwise(whole)


def split_authors(text: Column) -> Column:
    parts = F.transform(F.split(F.regexp_replace(text, r",?\s+and\s+", ", "), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda p: p != "")


def numbers(text: Column) -> Column:
    """Sorted distinct numbers of a list with ranges: a range of more than 50, or a chain, gives its ends only. Commas and semicolons part."""

    def expand(part: Column) -> Column:
        ends = F.transform(F.filter(F.transform(F.split(part, "[-–—]"), lambda x: F.trim(x)), lambda p: p.rlike("^[0-9]+$")), lambda p: p.try_cast("int"))
        a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        return F.when((F.size(ends) == 2) & (b >= a) & (b - a <= 50), F.sequence(a, F.greatest(a, F.least(b, a + 50)))).when((F.size(ends) == 2) & (b < a), F.array().cast("array<int>")).otherwise(ends)

    parts = F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def doi(text: Column) -> Column:
    """Address of the item's DOI, or null."""
    named, linked = F.trim(F.regexp_extract(text, r"\\doi\{([^}]+)\}", 1)), F.regexp_extract(text, r"https?://(?:dx\.)?doi\.org/[^\s{}\\]+", 0)
    return F.when(named.startswith("http"), named).when(named != "", F.concat(F.lit("https://doi.org/"), named)).when(linked != "", linked)


def url(text: Column) -> Column:
    """First address that is no DOI: of \\url{} first, then of the text; or null."""
    other = lambda found: F.get(F.filter(found, lambda u: ~F.contains(u, F.lit("doi.org/"))), F.lit(0))
    return F.coalesce(other(F.regexp_extract_all(text, F.lit(r"\\url\{([^}]+)\}"), F.lit(1))), other(F.regexp_extract_all(text, F.lit(r"https?://[^\s{}\\]+"), F.lit(0))))


def field(entry: Column, name: str) -> Column:
    """Value of a field in braces (without inner braces) or quotes; null if there is none."""
    found = F.regexp_extract(entry, rf'(?i)\b{name}\s*=\s*(?:\{{([^{{}}]*)\}}|"([^"]*)")', 1)
    quoted = F.regexp_extract(entry, rf'(?i)\b{name}\s*=\s*(?:\{{([^{{}}]*)\}}|"([^"]*)")', 2)
    return F.nullif(F.trim(F.concat(found, quoted)), F.lit(""))


#: Commands whose argument is a list of keys.
CITE = r"\\(?:cite|citep|citet|citealp|citealt|citeauthor|citeyear|parencite|textcite|autocite)\*?(?:\[[^\]]*\])*\{([^}]+)\}"


def cited_keys(text: Column) -> Column:
    """Keys of all citation commands, in order, each once."""
    lists = F.regexp_extract_all(text, F.lit(CITE), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(lists, lambda k: F.split(k, ","))), lambda x: F.trim(x)), lambda k: k != ""))


def style(tex: Column) -> Column:
    """Citation style of a document: link colour, then bibliography style, then class, else apa."""
    colour = F.lower(F.regexp_extract(tex, r"\\usepackage\s*\[[^\]]*citecolor\s*=\s*(\w+)[^\]]*\]\s*\{hyperref\}", 1))
    bst = F.lower(F.regexp_extract(tex, r"\\bibliographystyle\{([^}]+)\}", 1))
    cls = F.lower(F.regexp_extract(tex, r"\\documentclass(?:\[.*?\])?\{([^}]+)\}", 1))
    return (
        F.when(colour == "green", "hyperref_green").when(colour == "red", "hyperref_red").when(colour == "blue", "hyperref_default").when(colour == "black", "apa")
        .when(bst.contains("ieee"), "ieee").when(bst.contains("nature"), "nature").when(bst.contains("apa"), "apa").when(bst.contains("chicago"), "chicago").when(bst.contains("copernicus"), "copernicus")
        .when(bst.isin("plain", "unsrt", "abbrv", "plainnat"), "numbered")
        .when(cls.contains("ieee"), "ieee").when(cls.rlike("copernicus|gmd|acp"), "copernicus").when(cls.contains("nature"), "nature").otherwise("apa")
    )


def bbl_label(label: Column) -> Column:
    """An author-year label of a bibliography item, ``{Wang et~al.(2022{\\natexlab{a}})Wang, Ding, and Ma}``, as it is cited: ``Wang et al. (2022)``.

    One or two authors of the full list are named, of more the first; without a full list the short one is. A label without a year is plain text.
    """
    return braces.let(F.trim(F.translate(F.replace(braces.unwrapped(label, "natexlab"), F.lit("~"), F.lit(" ")), "{}", "")), _cited_label)


def _cited_label(plain: Column) -> Column:
    pattern = r"(?s)^(.+?)\(([0-9]{4})[a-z]?\)(.*)$"
    short, year, full = (F.trim(F.regexp_extract(plain, pattern, k)) for k in (1, 2, 3))

    def named(authors: Column) -> Column:
        return F.when(F.size(authors) == 0, short).when(F.size(authors) <= 2, F.array_join(authors, " and ")).otherwise(F.concat(F.get(authors, 0), F.lit(" et al.")))

    authors = F.filter(F.transform(F.split(full, r"\s*,\s*(?:and\s+)?|\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "")
    return F.when(year == "", plain).otherwise(F.concat(braces.let(authors, named), F.lit(" ("), year, F.lit(")")))
