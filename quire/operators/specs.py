"""Documents against the facts of their template: one row for each thing checked, and a summary by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import specs as S
from ..functions.units import UNIT_MM

_CHECK = "array<struct<category:string,status:string,item:string>>"


def _row(category: str, status: str | Column, item: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(category).alias("category"), lit(status).alias("status"), lit(item).alias("item"))


def _when(condition: Column, *rows: Column) -> Column:
    return F.when(condition, F.array(*rows)).otherwise(F.array().cast(_CHECK))


def _need(category: str, has: Column, item: str, missing: str = "issues") -> Column:
    return F.array(_row(category, F.when(has, "pass").otherwise(missing), item))


def _each(category: str, wanted: Column, present: Column, missing: str | None) -> Column:
    """A row for each wanted name: pass, or ``missing`` (None: no row)."""
    rows = F.transform(wanted, lambda w: _row(category, F.when(F.array_contains(present, w), "pass").otherwise(F.lit(missing)), w))
    return F.filter(rows, lambda r: r["status"].isNotNull())


def template_code(spec: Column) -> Column:
    """The skeleton of a document that follows a template's facts: class, packages, front matter, sections, statements, bibliography.

    What a template doesn't say is left out, save what every document has. Its own names for sections and statements are used.
    """
    of = lambda category, key: F.array_distinct(S.values(spec, category, key))
    one = lambda category, key: F.get(of(category, key), 0)
    has = lambda category, *keys: F.exists(spec, lambda f: (f["category"] == category) & f["key"].isin(*keys))
    put = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    some = lambda condition, line: F.when(condition, F.array(line if isinstance(line, Column) else F.lit(line))).otherwise(F.array().cast("array<string>"))
    options, packages = of("document_class", "default_options"), of("required_packages", "package")
    aliases = F.transform(F.filter(spec, lambda f: (f["category"] == "section_commands") & f["key"].startswith("alias.")), lambda f: f["value"])
    own = F.array_distinct(F.concat(aliases, of("special_envs", "command"), of("special_envs", "generated")))
    known = lambda name, otherwise: F.array(F.when(F.array_contains(own, name), f"\\{name}").otherwise(otherwise))
    statements = lambda names: F.filter(names, lambda n: ~n.isin("introduction", "conclusions"))
    style = one("bibliography_format", "style")
    lines = F.concat(
        F.array(put("\\documentclass", F.when(F.size(options) > 0, put("[", F.array_join(options, ","), "]")).otherwise(""), "{", F.coalesce(one("document_class", "class_name"), one("document_class", "name"), F.lit("article")), "}")),
        F.transform(packages, lambda p: put("\\usepackage{", p, "}")), F.array(F.lit("\\begin{document}")),
        F.array(F.when(has("title_format", "has_short_title") | (one("title_format", "title_args") == "2"), "\\title[Short title]{Title}").otherwise("\\title{Title}")), F.array(F.lit("\\author{Author}")), F.array(F.lit("\\maketitle")),
        some(has("abstract_format", "type"), "\\begin{abstract}\nAbstract\n\\end{abstract}"), some(has("abstract_format", "command") & ~has("abstract_format", "type"), "\\abstract{Abstract}"),
        some(has("keywords_format", "exists"), "\\keywords{Keywords}"), known("introduction", "\\section{Introduction}"), known("conclusions", "\\section{Conclusions}"), some(has("appendix_format", "environment", "command"), "\\appendix"),
        F.transform(statements(of("special_envs", "environment")), lambda e: put("\\begin{", e, "}\n\\end{", e, "}")),
        F.transform(F.filter(statements(own), lambda c: ~F.array_contains(of("special_envs", "environment"), c) & ~F.array_contains(aliases, c)), lambda c: put("\\", c, "{}")),
        F.when(style.isNotNull(), F.array(put("\\bibliographystyle{", style, "}"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("\\bibliography{references}"), F.lit("\\end{document}")),
    )
    return F.array_join(lines, "\n")


#: A definition of a length, and a term of what it is defined as: sign, factor, and a unit or another length.
_DEFINES = r"\\(?:setlength|def)\s*\{?\s*\\([A-Za-z@]+)\s*\}?\s*\{([^{}]*)\}"
_TERM = r"([+-]?)\s*([0-9]*\.?[0-9]*)\s*(?:(pt|mm|cm|in|bp|dd|cc)\b|\\([A-Za-z@]+))"


def length_terms(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, name, factor, refers, mm): the terms of every length that code defines, the last definition of a name in full.

    A term is a number times a unit, or times another length by name: ``210mm+2\\bleed``. A factor that isn't told is one.
    """
    all_of = lambda t, pattern, names: F.arrays_zip(*[F.regexp_extract_all(t, F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate(names, 1)])
    found = docs.select(*keys, F.posexplode(all_of(F.col(text), _DEFINES, ("name", "body"))).alias("__quire_at", "d"))
    last = found.groupBy(*keys, F.col("d.name").alias("name")).agg(F.max_by("d.body", "__quire_at").alias("body"))
    body = F.regexp_replace("body", r"\\(?:dimexpr|relax)(?![A-Za-z@])", "")
    terms = last.select(*keys, "name", F.explode(all_of(body, _TERM, ("sign", "number", "unit", "refers"))).alias("t"))
    units = F.create_map(*[F.lit(x) for pair in UNIT_MM.items() for x in pair])
    factor = F.when(F.col("t.number") == "", 1.0).otherwise(F.col("t.number").try_cast("double")) * F.when(F.col("t.sign") == "-", -1).otherwise(1)
    return terms.select(*keys, "name", factor.alias("factor"), F.nullif("t.refers", F.lit("")).alias("refers"), F.when(F.col("t.unit") != "", F.element_at(units, F.col("t.unit"))).alias("mm"))


def checks(t: Column, spec: Column) -> Column:
    """What a document's code ``t`` does or fails to do of its template's facts: array<struct<category, status, item>>."""
    extract = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    of = lambda category, key: S.values(spec, category, key)
    one = lambda category, key: F.get(of(category, key), 0)
    any_of = lambda category: F.exists(spec, lambda f: f["category"] == category)
    packages = F.transform(F.flatten(F.transform(extract(r"\\usepackage(?:\s*\[[^\]]*\])?\s*\{([^}]+)\}"), lambda p: F.split(p, ","))), lambda p: F.trim(p))
    options = F.transform(F.split(F.coalesce(F.get(extract(r"\\documentclass\[([^\]]*)\]"), 0), F.lit("")), ","), lambda o: F.trim(o))
    name = F.get(extract(r"\\documentclass(?:\[[^\]]*\])?\{(\w+)\}"), 0)
    commands, environments = extract(r"\\([A-Za-z_@]+)"), extract(r"\\begin\{([^}]+)\}")
    command, environment, package = (lambda a: lambda n: F.array_contains(a, n))(commands), (lambda n: F.array_contains(environments, n)), (lambda n: F.array_contains(packages, n))
    expected = one("document_class", "class_name")
    own = of("required_packages", "package")
    short = F.exists(spec, lambda f: (f["category"] == "title_format") & f["key"].isin("has_short_title", "title_args"))
    positions = extract(r"\\begin\{figure\}\[([^\]]*)\]")
    place = F.coalesce(one("figure_format", "default_position"), F.lit("htbp"))
    folder = one("figure_format", "graphics_path")
    sub = one("figure_format", "subfigure_package")
    style, wanted = F.get(extract(r"\\bibliographystyle\{([^}]+)\}"), 0), one("bibliography_format", "style")
    spacing, separator = one("spacing", "line_spacing"), one("caption_format", "separator")
    by_biblatex = F.exists(spec, lambda f: f["key"].startswith("biblatex."))
    alias = F.transform(F.filter(spec, lambda f: (f["category"] == "section_commands") & f["key"].startswith("alias.")), lambda f: F.struct(F.substring(f["key"], F.lit(7), F.length(f["key"])).alias("a"), f["value"].alias("b")))
    formats = of("table_format", "column_format")
    no_rules = (F.size(formats) > 0) & ~F.exists(formats, lambda c: c.contains("|"))
    declared = F.array_union(commands, environments)
    rows = [
        F.when(name.isNull(), F.array(_row("document_class", "issues", "documentclass"))).otherwise(F.array(_row("document_class", F.when(expected.isNotNull() & (expected != name), "issues").otherwise("pass"), name))),
        F.when(name.isNotNull(), F.filter(_each("document_class", of("document_class", "default_options"), options, "warnings"), lambda r: r["status"] != "pass")).otherwise(F.array().cast(_CHECK)),
        _when(package("geometry") & (F.size(own) > 0), _row("required_packages", "issues", "geometry")),
        F.when(~command("title"), F.array(_row("title_format", "issues", "title"))).otherwise(F.array(_row("title_format", F.when(short & ~t.rlike(r"\\title\s*\[[^\]]*\]\s*\{"), "warnings").otherwise("pass"), "title"))),
        _need("author_format", command("author") | command("Author"), "author"),
        F.when(F.exists(spec, lambda f: (f["category"] == "abstract_format") & (f["key"] == "command")), _need("abstract_format", t.rlike(r"\\abstract\s*\{"), "abstract")).otherwise(_need("abstract_format", environment("abstract"), "abstract")),
        F.when(any_of("keywords_format"), _need("keywords_format", t.rlike(r"\\keywords\s*\{") | environment("keywords"), "keywords", "warnings")).otherwise(F.array().cast(_CHECK)),
        F.transform(F.filter(alias, lambda x: F.array_contains(commands, x["a"]) | F.array_contains(commands, x["b"])), lambda x: _row("section_commands", "pass", F.when(F.array_contains(commands, x["a"]), x["a"]).otherwise(x["b"]))),
        _each("special_envs", of("special_envs", "environment"), environments, "warnings"),
        _each("special_envs", F.array_union(of("special_envs", "command"), of("special_envs", "generated")), commands, "warnings"),
        F.transform(F.filter(positions, lambda p: ~p.contains(place) & ~p.contains("H")), lambda p: _row("figure_format", "warnings", p)),
        F.when(environment("figure") & folder.isNotNull(), F.transform(F.filter(extract(r"\\includegraphics[^{]*\{([^}]+)\}"), lambda p: ~p.startswith(folder)), lambda p: _row("figure_format", "warnings", p))).otherwise(F.array().cast(_CHECK)),
        _when(environment("figure") & sub.isNotNull() & ~F.array_contains(own, sub) & ~t.contains(sub), _row("figure_format", "warnings", sub)),
        _when(environment("figure"), _row("figure_format", "pass", "figure")),
        _when(environment("table") & no_rules & t.rlike(r"\\begin\{tabular\}\{[^}]*\|"), _row("table_format", "warnings", "vertical_rules")),
        F.when(environment("table"), F.filter(_each("table_format", F.array_except(of("table_format", "table_packages"), own), packages, "warnings"), lambda r: r["status"] != "pass")).otherwise(F.array().cast(_CHECK)),
        _when(environment("table") | environment("tikzpicture"), _row("table_format", "pass", "table")),
        F.when(separator.isNotNull(), _need("caption_format", t.rlike(r"separator="), "separator", "warnings")).otherwise(F.array().cast(_CHECK)),
        _when((environment("equation") | environment("gather") | environment("align")) & ~package("amsmath"), _row("equation_format", "warnings", "amsmath")),
        _when(one("equation_format", "number_within").isNotNull() & ~t.rlike(r"\\numberwithin\{equation\}"), _row("equation_format", "pass", "number_within")),
        F.when(style.isNull(), F.array(_row("bibliography_format", "issues", "bibliographystyle"))).otherwise(F.array(_row("bibliography_format", F.when(wanted.isNotNull() & (style != wanted), "warnings").otherwise("pass"), style))),
        _when(~command("bibliography") & ~by_biblatex, _row("bibliography_format", "issues", "bibliography")),
        _when(by_biblatex & ~package("biblatex"), _row("bibliography_format", "warnings", "biblatex")),
        _when(any_of("appendix_format") & (command("appendix") | environment("appendix")), _row("appendix_format", "pass", "appendix")),
        _each("template_specific", of("template_specific", "required_declarations"), declared, "warnings"),
        _need("template_specific", command("maketitle"), "maketitle"),
        _when(package("geometry"), _row("page_layout", "issues", "geometry")),
        F.transform(F.filter(F.array(F.lit("textwidth"), F.lit("textheight")), lambda n: t.rlike(r"\\setlength") & F.array_contains(extract(r"\\setlength\{?\\(\w+)"), n)), lambda n: _row("page_layout", "warnings", n)),
        F.when(spacing.isNotNull() & (spacing != "singlespacing"), F.array(_row("paragraph_format", F.when(F.array_contains(commands, spacing) & package("setspace"), "pass").otherwise("warnings"), "line_spacing")))
        .otherwise(_when(command("onehalfspacing") | command("doublespacing"), _row("paragraph_format", "issues", "line_spacing"))),
        _when(F.size(F.filter(commands, lambda c: c == "noindent")) > 5, _row("paragraph_format", "warnings", "noindent")),
        _when(t.rlike("[\u4e00-\u9fff]") & ~package("ctex"), _row("paragraph_format", "issues", "ctex")),
    ]
    return F.flatten(F.array(*[r.cast(_CHECK) for r in rows]))


def check(docs: DataFrame, templates: DataFrame, keys: list[str], template: str, text: str, code: str) -> DataFrame:
    """(keys, category, status, item): documents' ``text`` against ``code`` of the template that they name.

    The facts of a template are read once, before the one join; all checks are columns over its row. A document whose
    template is unknown is checked against no facts, and a null text is an empty one.
    """
    known = templates.select(F.col(template).alias("__quire_t"), S.facts(F.col(code)).alias("__quire_facts"))
    both = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__quire_text"), F.col(template).alias("__quire_of")).join(known, F.col("__quire_of") == F.col("__quire_t"), "left")
    spec = F.coalesce("__quire_facts", F.array().cast("array<struct<category:string,key:string,value:string>>"))
    return both.select(*keys, F.explode(checks(F.col("__quire_text"), spec)).alias("__quire_c")).select(*keys, "__quire_c.category", "__quire_c.status", "__quire_c.item")


def summary(checked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pass, warnings, issues, status): counts by status, PASS without issues, else FAIL."""
    count = {s: F.count_if(F.col("status") == s) for s in ("pass", "warnings", "issues")}
    counted = checked.groupBy(*keys).agg(*[n.alias(s) for s, n in count.items()])
    return counted.withColumn("status", F.when(F.col("issues") == 0, "PASS").otherwise("FAIL"))
