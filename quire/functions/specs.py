"""Facts of document classes and templates: one table of patterns, read in one pass over the rows.

A hundred patterns over each text are Arrow-batched Python: as column expressions each one makes a string of the whole text
and tries every character of it, four times the work.

A fact is (category, key, value). A rule says how its pattern's groups become facts: ``first`` and ``all`` take group 1 of
the first or of every match, ``list`` splits group 1 of every match at commas, ``pairs`` takes key and value from groups 1
and 2, ``flag`` gives ``true`` if the pattern occurs. A rule with a scope reads only what the scope's pattern finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    category: str
    key: str  # of ``pairs``: what stands before the key that was read
    how: str
    pattern: str
    scope: str = ""


#: A group in braces, with braces nested three deep.
_BODY = r"\{((?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+)\}"
_OPTIONS = r"(\w+)\s*=\s*\{?([^,\s{}]+)"
_LENGTH = r"[0-9.]+\s*(?:pt|mm|cm|in|bp|em|ex)"
_USE = r"\\(?:usepackage|RequirePackage)"

#: Where rules with a scope look. ``free`` is what stands in no conditional.
SCOPES = {
    "maketitle": r"\\(?:long\\)?def\\@?maketitle\b[^{]*" + _BODY,
    "caption": r"\\(?:long\\)?(?:def|renewcommand)\s*\{?\\@makecaption\}?(?:#[0-9]|\[[0-9]\]|\s)*" + _BODY,
    "keywords": r"\\(?:newcommand|renewcommand|DeclareRobustCommand|def)\s*\{?\\keywords\}?(?:#[0-9]|\[[0-9]\]|\s)*" + _BODY,
    "abstract": r"\\begin\{abstract\}((?:(?!\\end\{abstract\})[\s\S])*+)",
    "figure": r"\\newenvironment\{figure\*?\}(?:\[[^\]]*\])*\s*" + _BODY,
    "conditional": r"\\if@((?:(?!\\fi\b)[\s\S])*+)",
    "geometry": r"\\(?:usepackage\[|geometry\{)([^\]}]*+)(?:\]\{geometry\}|\})",
    "hyperref": r"\\(?:usepackage\[|hypersetup\{)([^\]}]*+)(?:\]\{hyperref\}|\})",
    "captionsetup": r"\\captionsetup(?:\[\w+\])?\s*\{([^}]*)\}",
    "biblatex": r"\\usepackage\[([^\]]*+)\]\{biblatex\}",
}

#: The names that classes and templates define, and the commands that say so.
ENVIRONMENTS = [
    "acknowledgements", "acknowledgment", "dataavailability", "codeavailability", "authorcontribution", "competinginterests", "supplement", "supplementary",
    "correspondence", "introduction", "conclusions", "methods", "results", "discussion",
]
SECTIONS = [
    "section", "subsection", "subsubsection", "paragraph", "subparagraph",
]
SPECIALS = [
    "correspondence", "corresponding_author", "runningauthor", "runningtitle", "shorttitle", "authormark", "received", "accepted", "published", "revised",
    "disclosure", "fundinginfo", "funding", "supplementary", "supplement", "coverletter", "editor", "reviewer", "dedication",
]
DECLARATIONS = [
    "acknowledgements", "acknowledgment", "dataavailability", "codeavailability", "authorcontribution", "competinginterests", "fundinginfo", "supplementary",
]
AUTHORS = [
    "author", "affil", "affiliation", "correspondence", "corresponding_author", "thanks", "email", "orcid", "presentaddress",
]
TABLE_PACKAGES = [
    "booktabs", "tabularx", "longtable", "multirow", "array", "siunitx",
]
HLINES = [
    "tophline", "middlehline", "bottomhline", "toprule", "midrule", "bottomrule", "colrule", "botrule", "hline", "cline", "cmidrule",
]
FLOATS = [
    "topfraction", "bottomfraction", "textfraction", "floatpagefraction", "dbltopfraction", "dblfloatpagefraction",
]
FLOAT_COUNTERS = [
    "topnumber", "bottomnumber", "totalnumber", "dbltopnumber",
]
FLOAT_SKIPS = [
    "floatsep", "textfloatsep", "intextsep", "dblfloatsep", "dbltextfloatsep", "abovecaptionskip", "belowcaptionskip",
]
DISPLAY_SKIPS = [
    "abovedisplayskip", "belowdisplayskip", "abovedisplayshortskip", "belowdisplayshortskip", "mathindent",
]
PAGE = [
    "paperwidth", "paperheight", "textwidth", "textheight", "topmargin", "oddsidemargin", "evensidemargin", "headheight", "headsep", "footskip", "columnsep",
    "columnseprule", "marginparwidth", "marginparsep", "marginparpush",
]
FONT_DEFAULTS = [
    "rmdefault", "sfdefault", "ttdefault", "bfdefault", "itdefault", "familydefault",
]
NAMES = [
    "figurename", "tablename", "refname", "bibname", "abstractname", "contentsname", "listfigurename", "listtablename", "appendixname", "indexname",
    "proofname",
]


def _one_of(names: list[str]) -> str:
    return "(" + "|".join(names) + ")"


_DEFINED = r"\\(?:newcommand|renewcommand|DeclareRobustCommand|def)\s*\{?\\"

RULES = (
    Rule("document_class", "class_name", "first", r"\\ProvidesClass\{(\w+)\}"),
    Rule("document_class", "base_class", "first", r"\\LoadClass(?:\[[^\]]*\])?\{(\w+)\}"),
    Rule("document_class", "base_class_options", "first", r"\\LoadClass\[([^\]]+)\]"),
    Rule("document_class", "declared_options", "all", r"\\DeclareOption\{?(\w+|\*)\}?"),
    Rule("document_class", "default_options", "list", r"\\ExecuteOptions\{([^}]+)\}"),
    Rule("document_class", "name", "first", r"\\documentclass(?:\[[^\]]*\])?\{([^}]+)\}"),
    Rule("document_class", "options", "list", r"\\documentclass\[([^\]]*)\]"),
    Rule("document_class", "passed_options", "list", r"\\PassOptionsToClass\{([^}]+)\}"),
    Rule("required_packages", "package", "list", _USE + r"(?:\s*\[[^\]]*\])?\s*\{([^}]+)\}"),
    Rule("title_format", "title_args", "first", _DEFINED + r"title\}?\s*\[([0-9])\]"),
    Rule("title_format", "has_short_title", "flag", _DEFINED + r"title\}?\s*(?:\[[0-9]\])?\s*\{[^}]*(?:\\shorttitle|\[#+1\])"),
    Rule("title_format", "title_size", "first", r"\\(LARGE|Large|large)\b", "maketitle"),
    Rule("title_format", "bold", "flag", r"bfseries|\\bf\b", "maketitle"),
    Rule("title_format", "centred", "flag", r"\\(?:centering|center)", "maketitle"),
    Rule("title_format", "sans", "flag", r"\\sffamily", "maketitle"),
    Rule("title_format", "color", "first", r"\\color\{(\w+)\}", "maketitle"),
    Rule("title_format", "vspace", "all", r"\\vspace\*?\{([^}]+)\}", "maketitle"),
    Rule("author_format", "args.", "pairs", _DEFINED + _one_of(AUTHORS) + r"\}?\s*(?:\[|#)([0-9])"),
    Rule("author_format", "separator", "first", r"(\\and)\b", "maketitle"),
    Rule("author_format", "multiple_authors", "flag", r"\\author\b[\s\S]*?\\author\b"),
    Rule("author_format", "font.", "pairs", r"\\(Authfont|Affilfont)\s*\{([^}]+)\}"),
    Rule("abstract_format", "type", "first", r"\\new(environment)\{abstract\}"),
    Rule("abstract_format", "command", "flag", r"\\(?:newcommand|def)\s*\{?\\abstract\b"),
    Rule("abstract_format", "font_size", "first", r"\\(small|footnotesize)\b", "abstract"),
    Rule("abstract_format", "keywords_inside", "flag", r"\\keywords", "abstract"),
    Rule("abstract_format", "second", "flag", r"\\secabstractname|\\def\\secondabstract"),
    Rule("keywords_format", "exists", "flag", r"\\keywords\b"),
    Rule("keywords_format", "bold", "flag", r"bfseries|\\textbf", "keywords"),
    Rule("keywords_format", "label_text", "first", r"\{([^{}]*[Kk]eyword[^{}]*)\}", "keywords"),
    Rule("section_commands", "alias.", "pairs", r"\\let\s*\\" + _one_of(SECTIONS) + r"\s*=?\s*\\(\w+)"),
    Rule("section_commands", "custom", "all", r"\\(?:renewcommand|def)\s*\{?\\" + _one_of(SECTIONS) + r"\b"),
    Rule("section_commands", "startsection", "all", r"\\@startsection\s*\{" + _one_of(SECTIONS) + r"\}"),
    Rule("section_commands", "titleformat.", "pairs", r"\\titleformat\*?\{\\(\w+)\}(?:\[\w+\])?" + _BODY),
    Rule("section_commands", "titlespacing.", "pairs", r"\\titlespacing\*?\{\\(\w+)\}((?:\{[^}]*\}){3})"),
    Rule("special_envs", "environment", "all", r"\\newenvironment\{" + _one_of(ENVIRONMENTS) + r"\}"),
    Rule("special_envs", "command", "all", r"\\(?:def\s*|newcommand\{?)\\" + _one_of(ENVIRONMENTS) + r"\b"),
    Rule("special_envs", "generated", "all", r"\\generateCommand\{" + _one_of(ENVIRONMENTS) + r"\}"),
    Rule("special_envs", "section_title.", "pairs", r"\\(?:def\s*|newcommand\{?)\\" + _one_of(ENVIRONMENTS) + r"\}?(?:\[[^\]]*\])*\s*\{\s*\\section\*?\{([^}]*)\}"),
    Rule("figure_format", "default_position", "first", r"\[(htbp|h|t|b|p|H)\]", "figure"),
    Rule("figure_format", "subfigure_package", "first", r"\b(subfigure|subfig|subcaption)\b"),
    Rule("figure_format", "graphics_extensions", "list", r"\\DeclareGraphicsExtensions\{([^}]+)\}"),
    Rule("figure_format", "graphics_path", "first", r"\\graphicspath\{\{?([^}]+)\}"),
    Rule("figure_format", "numbering_format", "first", r"\\def\s*\\thefigure\s*\{([^}]+)\}"),
    Rule("figure_format", "subfigure_hook", "all", r"\\g@addto@macro\s*\{?\\(subfiguresbegin|subtablesbegin|subfiguresend|subtablesend)\b"),
    Rule("table_format", "table_packages", "all", r"\b" + _one_of(TABLE_PACKAGES) + r"(?=[,}])"),
    Rule("table_format", "hline_commands", "all", r"\\" + _one_of(HLINES) + r"\b"),
    Rule("table_format", "column_format", "all", r"\\begin\{(?:tabular|tabularx|longtable)\}\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}"),
    Rule("table_format", "numbering_format", "first", r"\\def\s*\\thetable\s*\{([^}]+)\}"),
    Rule("table_format", "length.", "pairs", r"\\setlength\{\\(tabcolsep|arraycolsep|arrayrulewidth|extrarowheight|heavyrulewidth|lightrulewidth|aboverulesep|belowrulesep)\}\{([^}]+)\}"),
    Rule("table_format", "arraystretch", "first", r"\\renewcommand\{\\arraystretch\}\{([0-9.]+)\}"),
    Rule("caption_format", "separator", "first", r"([:.])\s", "caption"),
    Rule("caption_format", "bold", "flag", r"bfseries", "caption"),
    Rule("caption_format", "caption_options", "list", r"\\usepackage\[([^\]]*)\]\{caption\}"),
    Rule("caption_format", "setup.", "pairs", _OPTIONS, "captionsetup"),
    Rule("equation_format", "amsmath_options", "list", _USE + r"\[([^\]]+)\]\{amsmath\}"),
    Rule("equation_format", "numbering_format", "first", r"\\def\s*\\theequation\s*\{([^}]+)\}"),
    Rule("equation_format", "number_within", "first", r"\\numberwithin\{equation\}\{(\w+)\}"),
    Rule("equation_format", "identifier_italic", "flag", _DEFINED + r"(?:inlineidentifier|identifier|varname|variable|code|datasetname)\}?\s*(?:\[[0-9]\])?\s*\{\\(?:mathit|emph|itshape)\b"),
    Rule("equation_format", "identifier_upright", "flag", _DEFINED + r"(?:inlineidentifier|identifier|varname|variable|code|datasetname)\}?\s*(?:\[[0-9]\])?\s*\{\\(?:mathrm|textrm|textnormal|textup|upshape)\b"),
    Rule("bibliography_format", "natbib_options", "list", _USE + r"\[([^\]]*)\]\{natbib\}"),
    Rule("bibliography_format", "biblatex.", "pairs", _OPTIONS, "biblatex"),
    Rule("bibliography_format", "bib_resource", "all", r"\\addbibresource\{([^}]+)\}"),
    Rule("bibliography_format", "field_format.", "pairs", r"\\DeclareFieldFormat\{(\w+)\}\{([^}]*)"),
    Rule("bibliography_format", "style", "first", r"\\bibliographystyle\{([^}]+)\}"),
    Rule("bibliography_format", "bib_name", "first", r"\\def\s*\\bibliography(?:name)?\{([^}]+)\}"),
    Rule("bibliography_format", "bibpunct", "first", r"\\bibpunct((?:\{[^}]*\}){6})"),
    Rule("bibliography_format", "font_size", "first", r"\\(?:let|def|renewcommand)\s*\{?\\bibfont\}?\s*=?\s*\{?\\(tiny|scriptsize|footnotesize|small|normalsize|large)\b"),
    Rule("appendix_format", "environment", "flag", r"\\newenvironment\{appendix\}"),
    Rule("appendix_format", "command", "flag", r"\\appendix\b"),
    Rule("appendix_format", "alphabetic", "flag", r"\\def\s*\\the(?:appendix|section)\s*\{[^}]*\\Alph"),
    Rule("numbering", "reset.", "pairs", r"\\@addtoreset\{(\w+)\}\{(\w+)\}", "free"),
    Rule("numbering", "conditional_reset.", "pairs", r"\\@addtoreset\{(\w+)\}\{(\w+)\}", "conditional"),
    Rule("numbering", "within.", "pairs", r"\\numberwithin\{(\w+)\}\{(\w+)\}"),
    Rule("numbering", "depth.", "pairs", r"\\(?:setcounter\{|c@)?(secnumdepth|tocdepth)\}?\s*[={]?\s*([0-9]+)"),
    Rule("template_specific", "args.", "pairs", r"\\(?:newcommand|renewcommand)\{?\\" + _one_of(SPECIALS) + r"\}?\s*\[([0-9])\]"),
    Rule("template_specific", "command", "all", _DEFINED + _one_of(SPECIALS) + r"\b"),
    Rule("template_specific", "required_declarations", "all", r"\\(?:newenvironment\{|newcommand\{?\\|def\s*\\)" + _one_of(DECLARATIONS) + r"\b"),
    # what only full classes say
    Rule("page_layout", "", "pairs", r"\\(?:setlength\{\\)?" + _one_of(PAGE) + r"\}?\s*[={]?\s*(" + _LENGTH + ")"),
    Rule("page_layout", "geometry.", "pairs", _OPTIONS, "geometry"),
    Rule("page_layout", "dimexpr.", "pairs", r"\\" + _one_of(PAGE) + r"\\dimexpr\s*([^%]+?)\\relax"),
    Rule("page_layout", "bleed", "first", r"\\bleed\s*(" + _LENGTH + ")"),
    Rule("page_layout", "columns", "first", r"\\(twocolumn|onecolumn)\b"),
    Rule("fonts", "font.", "pairs", r"\\set(main|sans|mono|math)font\s*(?:\[[^\]]*\])?\s*\{([^}]+)\}"),
    Rule("fonts", "family.", "pairs", r"\\newfontfamily\s*\{?\\(\w+)\}?\s*(?:\[[^\]]*\])?\s*\{([^}]+)\}"),
    Rule("fonts", "default.", "pairs", r"\\(?:renewcommand\{?\\|def\\)" + _one_of(FONT_DEFAULTS) + r"\}?\s*\{([^}]+)\}"),
    Rule("fonts", "size.", "pairs", r"\\@setfontsize\s*\\(\w+)\s*((?:\{[^}]*\}){2})"),
    Rule("spacing", "length.", "pairs", r"\\setlength\{\\(parskip|parindent|baselineskip|lineskip|itemsep|labelsep|leftmargin|rightmargin|listparindent|topsep|marginparsep)\}\{([^}]+)\}"),
    Rule("spacing", "stretch", "first", r"\\(?:setstretch|linespread|renewcommand\{?\\baselinestretch\}?|def\\baselinestretch)\s*\{([0-9.]+)\}"),
    Rule("spacing", "line_spacing", "first", r"\\(doublespacing|onehalfspacing|singlespacing)\b"),
    Rule("spacing", "bottom", "first", r"\\(flushbottom|raggedbottom)\b"),
    Rule("spacing", "mode", "all", r"\\(frenchspacing|sloppy)\b"),
    Rule("floats", "fraction.", "pairs", r"\\(?:renewcommand\{?|def)\\" + _one_of(FLOATS) + r"\}?\s*\{([^}]+)\}"),
    Rule("floats", "counter.", "pairs", r"\\setcounter\{" + _one_of(FLOAT_COUNTERS) + r"\}\{([0-9]+)\}"),
    Rule("floats", "skip.", "pairs", r"\\(?:setlength\{\\)?" + _one_of(FLOAT_SKIPS) + r"\}?\s*[={]?\s*(" + _LENGTH + ")"),
    Rule("math", "skip.", "pairs", r"\\(?:setlength\{?\\)?" + _one_of(DISPLAY_SKIPS) + r"\}?\s*[={]?\s*(" + _LENGTH + ")"),
    Rule("footnotes", "format", "first", r"\\(?:renewcommand\{?|def)\s*\\thefootnote\}?\s*\{([^}]+)\}"),
    Rule("header_footer", "pagestyle", "first", r"\\pagestyle\{(\w+)\}"),
    Rule("header_footer", "head.", "pairs", r"\\fancyhead\[([^\]]+)\]\{([^}]*)\}"),
    Rule("header_footer", "foot.", "pairs", r"\\fancyfoot\[([^\]]+)\]\{([^}]*)\}"),
    Rule("header_footer", "rule.", "pairs", r"\\renewcommand\{\\(headrulewidth|footrulewidth)\}\{([^}]+)\}"),
    Rule("header_footer", "style", "all", r"\\def\\ps@(\w+)"),
    Rule("colors", "define.", "pairs", r"\\definecolor\{(\w+)\}((?:\{[^}]*\}){2})"),
    Rule("lists", "label.", "pairs", r"\\(?:def\\|renewcommand\{?\\)(label(?:item|enum)i{1,3}v?|theenumi{1,3}v?)\}?\s*\{([^}]+)\}"),
    Rule("lists", "setlist", "all", r"\\setlist(?:\[[^\]]*\])?\s*\{([^}]+)\}"),
    Rule("hyperref", "", "pairs", _OPTIONS, "hyperref"),
    Rule("theorems", "style", "first", r"\\theoremstyle\{(\w+)\}"),
    Rule("theorems", "theorem.", "pairs", r"\\newtheorem\*?\{(\w+)\}(?:\[\w+\])?\{([^}]+)\}"),
    Rule("algorithms", "package", "first", _USE + r"(?:\[[^\]]*\])?\{(algorithm2e|algorithmic|algorithmicx|algpseudocode|algorithm)\}"),
    Rule("algorithms", "floatstyle", "first", r"\\floatstyle\{([^}]+)\}"),
    Rule("cleveref", "name.", "pairs", r"\\[cC]refname\{(\w+)\}((?:\{[^}]+\}){2})"),
    Rule("cleveref", "options", "list", _USE + r"\[([^\]]+)\]\{cleveref\}"),
    Rule("dates", "label.", "pairs", r"\\def\\(received|revised|accepted|published)(?:#1)?\s*\{([^}]*)"),
    Rule("names", "", "pairs", r"\\(?:renewcommand\{?|def)\s*\\" + _one_of(NAMES) + r"\}?\s*\{([^}]+)\}"),
    Rule("doi", "format.", "pairs", r"\\(?:newcommand|def|DeclareRobustCommand)\s*\{?\\(doi|doiurl|urlprefix|url)\}?(?:\[[0-9]\]|#1)?\s*\{([^}]*)"),
    Rule("margins", "reversed", "flag", r"\\reversemarginpar\b"),
    Rule("margins", "marginnote", "flag", _USE + r"(?:\[[^\]]*\])?\{marginnote\}"),
)


_FACTS = "array<struct<category:string,key:string,value:string>>"
#: Texts whose facts become one Arrow array, so that a batch's aren't all held as Python's strings.
_AT_ONCE = 500


def _compiled(pattern: str) -> re.Pattern:
    r"""As Spark's own searches read it: ``\w`` and ``\s`` know ASCII only, ``\b`` any letters and digits."""
    return re.compile(re.sub(r"\\(.)", lambda m: r"(?u:\b)" if m[1] == "b" else m[0], pattern), re.ASCII)


@cache
def _by_scope(rules: tuple[Rule, ...]) -> list[tuple[str, list[tuple[Rule, re.Pattern]]]]:
    return [(scope, [(r, _compiled(r.pattern)) for r in rules if r.scope == scope]) for scope in dict.fromkeys(r.scope for r in rules)]


@cache
def _scope(scope: str) -> re.Pattern:
    return _compiled(SCOPES[scope])


def _scoped(text: str, scope: str) -> str:
    """The parts of a text that rules of a scope look at."""
    if scope == "free":
        return _scope("conditional").sub("", text)
    return "\n".join(_scope(scope).findall(text)) if scope else text


def _found(text: str, rule: Rule, pattern: re.Pattern) -> Iterable[tuple[str, str]]:
    """The rule's (key, value) facts in the text of its scope."""
    if rule.how == "flag":
        return [(rule.key, "true")] if pattern.search(text) else []
    if rule.how == "first":
        m = pattern.search(text)
        return [(rule.key, m.groups("")[0])] if m else []
    read = [m.groups("") for m in pattern.finditer(text)]
    if rule.how == "pairs":
        return [(rule.key + key, value) for key, value, *_ in read]
    read = [m[0] for m in read]
    return [(rule.key, v) for v in dict.fromkeys(read)] if rule.how == "all" else [(rule.key, v) for r in read for v in r.split(",") if v.strip(" ")]


def _facts_of(texts: pa.Array, rules: tuple[Rule, ...]) -> pa.Array:
    offsets, categories, keys, read, scopes = [0], [], [], [], _by_scope(rules)
    for text in texts.to_pylist():
        for scope, of in scopes if text else ():
            if part := _scoped(text, scope):
                for rule, pattern in of:
                    for key, value in _found(part, rule, pattern):
                        categories.append(rule.category)
                        keys.append(key)
                        read.append(value.strip(" "))
        offsets.append(len(read))
    columns = [pa.array(c, pa.string()) for c in (categories, keys, read)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["category", "key", "value"]))


def facts(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All facts of a class or template, as array<struct<category, key, value>>; none of a null text. Each scope's part of a text is worked out once.

    Bytes that aren't UTF-8 count as U+FFFD, as in Spark's own searches.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_facts_of(texts.slice(k, _AT_ONCE), rules) for k in range(0, max(len(texts), 1), _AT_ONCE)])

    return F.arrow_udf(run, _FACTS)(F.make_valid_utf8(text))


def values(found: Column, category: str, key: str) -> Column:
    """Values of one key in an array of facts, in order."""
    return F.transform(F.filter(found, lambda f: (f["category"] == category) & (f["key"] == key)), lambda f: f["value"])


#: What a template's folder may hold besides, and what marks its sample documents.
_KINDS = [
    "cls", "sty", "bst", "cfg",
]
_SAMPLE = "template|sample|example"
_LEFT_OUT = [
    "zip", "docx", "pdf", "log", "aux", "bbl", "blg", "fdb_latexmk", "fls", "4ct", "4tc", "out", "tmp", "xref", "gz", "tar", "dvi", "ps", "xdv",
]


def file_kind(path: Column) -> Column:
    """cls, sty, bst, cfg, tex (sample documents only) or other, by the name of a file; null for products of a run."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    suffix = F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)
    return F.when(suffix.isin(*_KINDS), suffix).when((suffix == "tex") & name.rlike(_SAMPLE), "tex").when(~suffix.isin(*_LEFT_OUT), "other")
