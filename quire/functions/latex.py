"""LaTeX text: escaping, scripts, chemistry, clean-up and formula comparison, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are written as LaTeX in running text.
UNICODE_TEXT = {
    "₂": "$_{2}$", "₃": "$_{3}$", "₄": "$_{4}$", "₁": "$_{1}$", "⁰": "$^{0}$", "²": "$^{2}$", "³": "$^{3}$",
    "λ": r"$\lambda$", "δ": r"$\delta$", "α": r"$\alpha$", "β": r"$\beta$", "γ": r"$\gamma$", "μ": r"$\mu$",
    "σ": r"$\sigma$", "θ": r"$\theta$", "φ": r"$\phi$", "°": r"$^{\circ}$", "×": r"$\times$",
    "≤": r"$\leq$", "≥": r"$\geq$", "±": r"$\pm$", "≈": r"$\approx$",
}
# The same inside a formula.
UNICODE_MATH = {"₂": "_{2}", "₃": "_{3}", "₁": "_{1}", "⁰": "^{0}", "²": "^{2}", "³": "^{3}", "λ": r"\lambda", "δ": r"\delta", "×": r"\times", "°": r"\circ"}
# Characters that text must escape.
ESCAPES = {"\\": r"\textbackslash{}", "%": r"\%", "_": r"\_", "&": r"\&", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
# Characters with a Unicode subscript or superscript, position by position.
SUB_FROM, SUB_TO = "0123456789aehiklmnoprstx+-", "₀₁₂₃₄₅₆₇₈₉ₐₑₕᵢₖₗₘₙₒₚᵣₛₜₓ₊₋"
SUP_FROM, SUP_TO = "0123456789abcdefghijklmnoprstuvwxyz+-", "⁰¹²³⁴⁵⁶⁷⁸⁹ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛᵂˣʸᶻ⁺⁻"
# Prefixes that take a subscript, and names that are no compounds.
CHEM_PREFIXES = ("CO", "XCO", "H", "O", "N", "C", "S", "P", "Fe", "Ca", "Na", "K", "Mg", "Al", "Si", "Cl", "Ti", "Mn", "Zn", "Cu", "Pb", "NO", "SO", "CH", "NH", "OH", "HO", "NaCl", "H2")
CHEM_NAMES = ("OCO", "GCAS", "GOSAT", "TCCON", "MODIS", "MOPITT", "CAMS", "CMIP", "Net", "GRACED", "GFED", "BEPS", "FLUX")


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def rewritten(text: Column, *rules: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after the other; replacements are in Java's form."""
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), rules, text)


def unicode_to_latex(text: Column) -> Column:
    return replaced(text, *UNICODE_TEXT.items())


def unicode_to_math(text: Column) -> Column:
    return replaced(text, *UNICODE_MATH.items())


def identifier_digits(text: Column) -> Column:
    """Takes subscripts back where they stand inside an identifier: ``CO$_{2}$_flag`` -> ``CO2_flag``."""
    return F.regexp_replace(text, r"([A-Za-z][A-Za-z0-9_]*)(?:\$_\{(\d{1,2})\}\$|\\textsubscript\{(\d{1,2})\}|_\{(\d{1,2})\})(?=[A-Za-z_])", "$1$2$3$4")


def chemical_prefixes() -> tuple[str, ...]:
    """Prefixes that take subscripts: none that begins a listed name, or that a listed name begins."""
    return tuple(p for p in CHEM_PREFIXES if not any(n.startswith(p) or p.startswith(n) for n in CHEM_NAMES))


def chemistry(text: Column) -> Column:
    """Subscripts the number of known compounds: ``CO2`` -> ``CO$_{2}$``. A text without a digit after a letter, and without subscripts, stays."""
    known = "|".join(sorted(chemical_prefixes(), key=len, reverse=True))
    made = identifier_digits(F.regexp_replace(text, rf"(?<![0-9A-Za-z_])({known})(\d{{1,2}})(?![0-9A-Za-z_])", r"$1\$_{$2}\$"))
    return F.when(text.rlike(r"[A-Za-z][0-9]|[_t]\{"), made).otherwise(text)


def escape(text: Column) -> Column:
    """Every special character escaped once; null counts as empty. Those that take a backslash go by one replacement, runs are for texts with others."""
    own = F.coalesce(text, F.lit(""))
    return F.when(own.rlike(r"[\\~^]"), _escape_runs(own)).otherwise(F.regexp_replace(own, r"([%_&#${}])", r"\\$1"))


def _escape_runs(text: Column) -> Column:
    mapped = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])
    runs = F.regexp_extract_all(text, F.lit(r"[^\\%_&#${}~^]++|[\\%_&#${}~^]"), F.lit(0))
    return F.array_join(F.transform(runs, lambda c: F.coalesce(F.element_at(mapped, c), c)), "")


def subscript(text: Column) -> Column:
    return F.translate(text, SUB_FROM, SUB_TO)


def superscript(text: Column) -> Column:
    return F.translate(text, SUP_FROM, SUP_TO)


def scripts_to_unicode(text: Column) -> Column:
    """Single-run scripts, for digits: ``$_{2}$`` -> ``₂``, ``$^3$`` -> ``³``."""
    out = text
    for d in "0123456789":
        out = replaced(out, (f"$_{{{d}}}$", SUB_TO[int(d)]), (f"$_{d}$", SUB_TO[int(d)]), (f"$^{{{d}}}$", SUP_TO[int(d)]), (f"$^{d}$", SUP_TO[int(d)]), (f"\\textsubscript{{{d}}}", SUB_TO[int(d)]))
    return out


def plain(text: Column) -> Column:
    """Commands dropped, their contents kept."""
    out = rewritten(scripts_to_unicode(text), (r"\\textbf\{([^}]+)\}", "$1"), (r"\\textit\{([^}]+)\}", "$1"), (r"\\emph\{([^}]+)\}", "$1"), (r"\\underline\{([^}]+)\}", "$1"), (r"\\[A-Za-z0-9_]+\{([^}]*)\}", "$1"), (r"[${}\\]", ""))
    return F.trim(out)


def run_to_latex(text: Column, bold: Column, italic: Column, script: Column, underline: Column) -> Column:
    """A formatted run: escaped, then chemistry, then wrapped inside out. script: sub, super or null."""
    out = chemistry(escape(text))
    out = F.when(bold, F.concat(F.lit(r"\textbf{"), out, F.lit("}"))).otherwise(out)
    out = F.when(italic, F.concat(F.lit(r"\textit{"), out, F.lit("}"))).otherwise(out)
    out = F.when(script == "super", F.concat(F.lit(r"\textsuperscript{"), out, F.lit("}"))).when(script == "sub", F.concat(F.lit(r"\textsubscript{"), out, F.lit("}"))).otherwise(out)
    return F.when(underline, F.concat(F.lit(r"\underline{"), out, F.lit("}"))).otherwise(out)


# The colour, and the themes, by which editors show a citation's number.
CITE_COLOUR, CITE_THEMES = "EE0000", ("hyperlink", "accent1", "accent2")


def styled_run(text: Column, bold: Column, italic: Column, script: Column, underline: Column, strike: Column, colour: Column, theme: Column, colour_commands: Column) -> Column:
    """A run as an editor formats it. One in the colour or theme of citations is a citation of the numbers in it, nothing if it has none.

    In any other, each character is escaped or written as LaTeX in one pass, so neither spoils the other's braces; then compounds get
    their subscripts. Outside in: strike, underline, the colour's command (``colour_commands``, by colour), script, bold, italic.
    """
    cites = F.coalesce(colour == CITE_COLOUR, F.lit(False)) | F.coalesce(theme.isin(*CITE_THEMES), F.lit(False))
    numbers = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    cited = F.when(F.size(numbers) > 0, F.concat(F.lit("\\citep{"), F.array_join(numbers, ","), F.lit("}"))).otherwise("")
    mapped = F.create_map(*[F.lit(x) for pair in (ESCAPES | UNICODE_TEXT).items() for x in pair])
    plain = chemistry(F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.coalesce(F.element_at(mapped, c), c)), ""))
    wrapped = lambda on, command, inside: F.when(F.coalesce(on, F.lit(False)), F.concat(command, F.lit("{"), inside, F.lit("}"))).otherwise(inside)
    role = F.element_at(colour_commands, colour)
    out = wrapped(bold, F.lit("\\textbf"), wrapped(italic, F.lit("\\textit"), F.when(cites, cited).otherwise(plain)))
    out = wrapped(script == "sub", F.lit("\\textsubscript"), wrapped(script == "super", F.lit("\\textsuperscript"), out))
    return wrapped(strike, F.lit("\\sout"), wrapped(underline, F.lit("\\underline"), wrapped(role.isNotNull() & ~cites, role, out)))


def balanced(text: Column, start: Column) -> Column:
    """Content of the brace at ``start`` (1-based) up to its match, or to the end if it has none."""
    chars = F.split(F.substring(text, start, F.length(text)), "")

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        closes = ~acc["done"] & (c == "}") & (depth == 0)
        keep = ~acc["done"] & ~closes & (acc["n"] > 0)
        return F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), (acc["done"] | closes).alias("done"), F.concat(acc["out"], F.when(keep, c).otherwise("")).alias("out"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"), F.lit("").alias("out"))
    return F.aggregate(chars, zero, step, lambda acc: acc["out"])


def without_comments(text: Column) -> Column:
    """Lines cut at a % that no odd run of backslashes escapes."""
    return F.regexp_replace(text, r"(?m)(?<!\\)((?:\\\\)*)%.*$", "$1")


def formula_normalised(f: Column) -> Column:
    """Formula without spacing, with one name for each command."""
    out = rewritten(f, (r"\s+", ""))
    out = replaced(out, ("−", "-"), (r"\left", ""), (r"\right", ""))
    out = rewritten(out, (r"\\[,;!]", ""), (r"\\quad", ""))
    return replaced(out, (r"\mathrm", r"\rm"), (r"\mathbf", r"\bf"), (r"\boldsymbol", r"\bs"), (r"\mathit", r"\it"), (r"\overline", r"\bar"))


def formula_bare(f: Column) -> Column:
    return F.translate(formula_normalised(f), "{}", "")


def formula_match(a: Column, b: Column) -> Column:
    """exact, normalised, semantic or different."""
    return (
        F.when(F.trim(a) == F.trim(b), "exact").when(formula_normalised(a) == formula_normalised(b), "normalised")
        .when(formula_bare(a) == formula_bare(b), "semantic").otherwise("different")
    )


def equation_number(label: Column) -> Column:
    """``eq2-1`` -> ``(2-1)``, ``eq3`` -> ``(3)``, anything else in parentheses."""
    pattern = r"eq(\d+)[-.]?(\d+)?"
    a, b = F.regexp_extract(label, pattern, 1), F.regexp_extract(label, pattern, 2)
    return F.when(a == "", F.concat(F.lit("("), label, F.lit(")"))).when(b == "", F.concat(F.lit("("), a, F.lit(")"))).otherwise(F.concat(F.lit("("), a, F.lit("-"), b, F.lit(")")))


def equation_label(section: Column, number: Column) -> Column:
    return F.when(section > 0, F.concat(F.lit("eq"), section, F.lit("-"), number)).otherwise(F.concat(F.lit("eq"), number))


# Point sizes by name, for a base of 10 pt.
SIZES = {"tiny": 5.0, "scriptsize": 7.0, "footnotesize": 8.0, "small": 9.0, "normalsize": 10.0, "large": 10.95, "Large": 11.49, "LARGE": 12.0, "huge": 14.4, "Huge": 17.28}
# Commands that set weight and shape, the first found counts.
WEIGHTS = {"bfseries": "bold", "textbf": "bold", "bf": "bold", "mdseries": "normal", "textmd": "normal"}
SHAPES = {"itshape": "italic", "textit": "italic", "it": "italic", "slshape": "slanted", "textsl": "slanted", "upshape": "normal", "textup": "normal", "scshape": "smallcaps", "textsc": "smallcaps"}


def _first_command(text: Column, table: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for name, value in reversed(table.items()):
        out = F.when(text.rlike(rf"\\{name}\b"), F.lit(value)).otherwise(out)
    return out


def size_pt(text: Column) -> Column:
    """Explicit \\fontsize, else the largest named size."""
    explicit = F.regexp_extract(text, r"\\fontsize\{([0-9.]+)\}", 1)
    return F.when(explicit != "", explicit.try_cast("double")).otherwise(_first_command(text, dict(sorted(SIZES.items(), key=lambda x: -x[1])), None))


def weight(text: Column) -> Column:
    return _first_command(text, WEIGHTS, "normal")


def shape(text: Column) -> Column:
    return _first_command(text, SHAPES, "normal")


def alignment(text: Column) -> Column:
    return _first_command(text, {"centering": "center", "raggedright": "left", "raggedleft": "right"}, None)


def bbl_plain(text: Column) -> Column:
    """A bibliography item as plain text: links, fields and commands dropped, eight layers of braces peeled."""
    accents = [(mark + body, to) for mark, letters in ACCENTS.items() for letter, to in letters.items() for body in (f"{{{letter}}}", letter)]
    out = rewritten(text, (r"\\href\{[^}]*\}\{([^}]*)\}", "$1"), (r"\\doi\{[^}]*\}", " "), (r"\\url\{[^}]*\}", " "), (r"\\newblock\s*", " "), (r"\\natexlab\{([^}]*)\}", "$1"))
    out = replaced(out, *sorted(accents, key=lambda a: -len(a[0])))
    out = rewritten(out, *[(rf"\\{c}\{{([^{{}}]*)\}}", "$1") for c in ("emph", "textbf", "textit", "textrm", "text", "mathrm")])
    out = replaced(out, ("~", " "), ("---", "—"), ("--", "–"), ("``", '"'), ("''", '"'), (r"\&", "&"), (r"\$", "$"), (r"\%", "%"), (r"\#", "#"), (r"\_", "_"))
    out = rewritten(out, (r"\\bibinfo\{[^}]*\}\{([^{}]*)\}", "$1"), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " "))
    return F.trim(rewritten(out, *[(r"\{([^{}]*)\}", "$1")] * 8, (r"\s+", " ")))


# Accent commands and the letters that they change.
ACCENTS = {
    r"\'": {"a": "á", "e": "é", "i": "í", "o": "ó", "u": "ú", "A": "Á", "E": "É", "I": "Í", "O": "Ó", "U": "Ú"},
    r"\`": {"a": "à", "e": "è", "i": "ì", "o": "ò", "u": "ù"},
    r"\"": {"a": "ä", "e": "ë", "i": "ï", "o": "ö", "u": "ü"},
    r"\~": {"n": "ñ"}, r"\c": {"c": "ç", "C": "Ç"},
}
