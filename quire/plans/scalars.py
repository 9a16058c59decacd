"""Scalar functions over markup that is built from the columns of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cites as C
from ..functions import fixes as R
from ..functions import latex as L
from ..functions import text as X
from ..functions import units as U
from .registry import query, table


def scalar(name: str, given: dict[str, str], made: Callable[[], dict[str, Column]], sql: dict[str, str], source: str = "documents", key: str = "doc_id") -> None:
    """Registers what ``made`` gives (when the query runs, for a Column needs a session) over the columns ``given``, whose SQL both engines read; ``sql`` gives the same columns in DuckDB's SQL."""
    text = f"with s as (select {key}, {', '.join(f'{e} as {c}' for c, e in given.items())} from {source}) select {key}, {', '.join(f'{e} as {c}' for c, e in sql.items())} from s"

    @query(name, text)
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, *[F.expr(e).alias(c) for c, e in given.items()]).select(key, *[e.alias(c) for c, e in made().items()])


def c(name: str) -> Column:
    return F.col(name)


def nested(text: str, *pairs: tuple[str, str]) -> str:
    """DuckDB's literal replacements."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for old, new in pairs:
        text = f"replace({text}, {quote(old)}, {quote(new)})"
    return text


def subs(text: str, *rules: tuple[str, str]) -> str:
    """DuckDB's regular-expression replacements."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for old, new in rules:
        text = f"regexp_replace({text}, {quote(old)}, {quote(new)}, 'g')"
    return text


B = "chr(92)"
scalar("p1_heading_level", {"style": "concat(case when doc_id % 7 = 0 then 'Body' else 'Heading ' end, doc_id % 6)"}, lambda: {"level": X.heading_level(c("style"))},
       {"level": "case " + " ".join(f"when contains(style, 'Heading {k}') then {k}" for k in (1, 2, 3, 4)) + " end"})
scalar("p2_heading_level_repair", {"level": "cast(doc_id % 4 as int)", "t": "concat(doc_id % 5, case doc_id % 4 when 0 then '.' when 1 then ' ' when 2 then '、' else 'x' end, doc_id % 3, ' ', source)"}, lambda: {"level": X.repaired_level(c("level"), c("t"))},
       {"level": "case when level = 2 and (regexp_matches(t, '^[0-9]+[\\s、．.]') or regexp_matches(t, '^[0-9]+[^0-9\\s.、]')) and not regexp_matches(t, '^[0-9]+\\.[0-9]+') then 1 else level end"})
scalar("p3_alignment", {"a": "cast(doc_id % 5 as int)"}, lambda: {"alignment": X.alignment_name(c("a"))}, {"alignment": "case a when 0 then 'left' when 1 then 'center' when 2 then 'right' when 3 then 'justify' end"})
_UNI = {"t": "concat('CO', case doc_id % 3 when 0 then '₂' when 1 then '²' else '°' end, ' λ ± ', lang, ' ≤ ', doc_id % 9, '×10³')"}
scalar("p4_unicode_to_latex", _UNI, lambda: {"latex": L.unicode_to_latex(c("t")), "math": L.unicode_to_math(c("t"))}, {"latex": nested("t", *L.UNICODE_TEXT.items()), "math": nested("t", *L.UNICODE_MATH.items())})
_CHEM = {"t": "concat('XCO', doc_id % 12, ' and CH4, NaCl', doc_id % 3, '. H2O C2 CO2x (SO', doc_id % 9, ') OCO2 Net2 CO', doc_id)"}
_known = "|".join(sorted(L.chemical_prefixes(), key=len, reverse=True))
scalar("p5_chemistry", _CHEM, lambda: {"latex": L.chemistry(c("t"))}, {"latex": f"regexp_replace(regexp_replace(' ' || t || ' ', '([^0-9A-Za-z_])({_known})([0-9]{{1,2}})([^0-9A-Za-z_])', '\\1\\2$_{{\\3}}$\\4', 'g'), '^ | $', '', 'g')"})
scalar("p6_identifier_digits", {"t": f"concat('a CO$_{{', doc_id % 30, '}}$_flag b', {B}, 'textsubscript{{', doc_id % 9, '}}x c_{{', doc_id % 100, '}} d')"}, lambda: {"t": L.identifier_digits(c("t"))},
       {"t": r"regexp_replace(t, '([A-Za-z][A-Za-z0-9_]*)(?:\$_\{([0-9]{1,2})\}\$|\\textsubscript\{([0-9]{1,2})\}|_\{([0-9]{1,2})\})([A-Za-z_])', '\1\2\3\4\5', 'g')"})
_RUN = {"t": "concat(lang, case doc_id % 3 when 0 then '&50%' when 1 then '_a{b}' else '~^' end)", "b": "doc_id % 2 = 0", "i": "doc_id % 3 = 0", "sc": "case doc_id % 5 when 0 then 'sub' when 1 then 'super' end", "u": "doc_id % 7 = 0"}
_ESC = "array_to_string(list_transform(string_split(t, ''), lambda x: case x " + " ".join("when '" + k + "' then '" + v + "'" for k, v in L.ESCAPES.items()) + " else x end), '')"
scalar("p7_run_to_latex", _RUN, lambda: {"latex": L.run_to_latex(c("t"), c("b"), c("i"), c("sc"), c("u"))},
       {"latex": rf"concat(case when u then '\underline{{' else '' end, case sc when 'super' then '\textsuperscript{{' when 'sub' then '\textsubscript{{' else '' end, case when i then '\textit{{' else '' end, case when b then '\textbf{{' else '' end, {_ESC}, case when b then '}}' else '' end, case when i then '}}' else '' end, case when sc is not null then '}}' else '' end, case when u then '}}' else '' end)"})
scalar("p8_escape", {"t": f"concat('A~B^2', {B}, 'C_{{', doc_id % 5, '}}&#%$ ', lang)"}, lambda: {"latex": L.escape(c("t"))}, {"latex": _ESC})
_tr = lambda a, b: f"translate(t, '{a}', '{b}')"
scalar("p9_scripts", {"t": "concat('a', doc_id, '+x-', lang)"}, lambda: {"sub": L.subscript(c("t")), "sup": L.superscript(c("t"))}, {"sub": _tr(L.SUB_FROM, L.SUB_TO), "sup": _tr(L.SUP_FROM, L.SUP_TO)})
_DIGITS = [x for k in range(10) for x in ((f"$_{{{k}}}$", L.SUB_TO[k]), (f"$_{k}$", L.SUB_TO[k]), (f"$^{{{k}}}$", L.SUP_TO[k]), (f"$^{k}$", L.SUP_TO[k]), (f"\\textsubscript{{{k}}}", L.SUB_TO[k]))]
scalar("p10_plain_text", {"t": f"concat(' CO$_', doc_id % 4, '$ ', {B}, 'textbf{{', lang, '}} m$^{{', doc_id % 9, '}}$ ', {B}, 'emph{{', source, '}} ', {B}, 'foo{{x}} {{y}}')"}, lambda: {"t": L.plain(c("t"))},
       {"t": "trim(" + subs(nested("t", *_DIGITS), (r"\\textbf\{([^}]+)\}", r"\1"), (r"\\textit\{([^}]+)\}", r"\1"), (r"\\emph\{([^}]+)\}", r"\1"), (r"\\underline\{([^}]+)\}", r"\1"), (r"\\[A-Za-z0-9_]+\{([^}]*)\}", r"\1"), (r"[${}\\]", "")) + ")"})
scalar("p11_balanced_braces", {"t": "concat('x{a', case when doc_id % 2 = 0 then '{b}' else '' end, lang, '}{c} tail', case when doc_id % 3 = 0 then '}' else '' end)"}, lambda: {"inner": L.balanced(c("t"), F.lit(2))},
       {"inner": "case when doc_id % 2 = 0 then regexp_extract(t, '^x\\{([^{}]*\\{[^{}]*\\}[^{}]*)\\}', 1) else regexp_extract(t, '^x\\{([^{}]*)\\}', 1) end"})
_KEY = {"k": "concat(source, '-', doc_id, ' é')", "m": "case when doc_id % 2 = 0 then 'P' else 'T' end"}
scalar("p12_citation_marker", _KEY, lambda: {"marker": C.marker(c("k"), c("m"))}, {"marker": "concat('CITELINK', m, lower(hex(encode(k))), 'END')"})
scalar("p13_bookmark", _KEY, lambda: {"bookmark": C.bookmark(c("k"))}, {"bookmark": "concat('_Bib_', regexp_replace(k, '[^A-Za-z0-9]', '_', 'g'))"})
_LINE = {"t": "substring(text, 1, 200)"}
scalar("p14_norm_text", {"t": "text"}, lambda: {"t": C.normalised(c("t"))}, {"t": "trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'))"})
scalar("p15_search_form", {"t": "text"}, lambda: {"t": C.search_form(c("t"))}, {"t": r"lower(regexp_replace(t, '[^\pL\pM\p{Nd}\p{Nl}\p{Pc}]|_', '', 'g'))"})
_AUTH = {"t": "concat(case doc_id % 4 when 0 then 'Smith, A.' when 1 then 'Anna Berg' when 2 then 'de la Cruz' else '1234' end, case when doc_id % 3 = 0 then ' and Doe, B.' else '' end)"}
scalar("p16_first_surname", _AUTH, lambda: {"surname": C.surname(c("t"))},
       {"surname": "case when contains(regexp_replace(t, '\\s+and\\s+.*$', ''), ',') then trim(split_part(regexp_replace(t, '\\s+and\\s+.*$', ''), ',', 1)) else coalesce(regexp_extract_all(regexp_replace(t, '\\s+and\\s+.*$', ''), '[A-Za-z]+')[-1], '') end"})
_NAMES = {"t": "case doc_id % 5 when 0 then 'Wang' when 1 then 'Wang and Ma' when 2 then 'Wang, Ding, and Ma' when 3 then 'Baker, Basu, Lee, and van der Woude' else '' end"}
_split = "list_filter(list_transform(string_split(regexp_replace(t, ',?\\s+and\\s+', ', ', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')"
_join = f"case when len({_split}) <= 2 then array_to_string({_split}, ' and ') else concat(array_to_string({_split}[1:len({_split})-1], ', '), ', and ', {_split}[-1]) end"
scalar("p17_author_list", _NAMES, lambda: {"authors": C.author_list(C.split_authors(c("t"))), "short": C.author_list(C.split_authors(c("t")), 2)},
       {"authors": _join, "short": f"case when len({_split}) > 2 then concat(array_to_string({_split}[1:2], ', '), ', et al.') else {_join} end"})
scalar("p18_number_list", {"t": "concat(doc_id % 10, ', ', doc_id % 10 + 2, '-', doc_id % 10 + 5, ';', doc_id % 4, '–', doc_id % 90, case when doc_id % 3 = 0 then ', 22-23-24' else ', x' end)"}, lambda: {"numbers": F.array_join(C.numbers(c("t")).cast("array<string>"), ",")},
       {"numbers": """array_to_string(list_sort(list_distinct(flatten(list_transform(list_filter(list_transform(regexp_split_to_array(t, '[,;]'), lambda p: trim(p)), lambda p: p <> ''),
          lambda p: case when len(regexp_extract_all(p, '[0-9]+')) = 2 then case when cast(regexp_extract_all(p, '[0-9]+')[2] as int) - cast(regexp_extract_all(p, '[0-9]+')[1] as int) > 50 then list_transform(regexp_extract_all(p, '[0-9]+'), lambda x: cast(x as bigint)) else range(cast(regexp_extract_all(p, '[0-9]+')[1] as bigint), cast(regexp_extract_all(p, '[0-9]+')[2] as bigint) + 1) end
               else list_transform(regexp_extract_all(p, '[0-9]+'), lambda x: cast(x as bigint)) end)))), ',')"""})
_CAP = {"t": "concat(case doc_id % 5 when 0 then 'Figure ' when 1 then '表 ' when 2 then 'Talbe' when 3 then '图' else 'fig. ' end, doc_id % 9, '.', doc_id % 4, case when doc_id % 2 = 0 then ': ' else ' ' end, lang)"}
scalar("p19_caption", _CAP, lambda: {"caption": X.caption_text(c("t")), "bare": X.without_caption_number(c("t"))},
       {"caption": "regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)talbe', 'Table', 'g'), '^表\\s*([0-9]+)', 'Table \\1'), '^图\\s*([0-9]+)', 'Figure \\1'), '(?i)^(Table|Figure|Fig\\.)\\s*([0-9]+(?:\\.[0-9])?)[\\s:：,，.、]*', '\\1 \\2: ')",
        "bare": "trim(regexp_replace(t, '(?i)^\\s*(图|表|figure|fig\\.?|table|talbe)\\s*[0-9]+(\\.[0-9]+)*\\s*[.:：,，、]*\\s*', ''))"})
scalar("p20_heading_number", {"t": f"concat(case when doc_id % 2 = 0 then concat({B}, 'textbf{{') else '' end, doc_id % 5, case when doc_id % 3 = 0 then '.2' else '' end, '、', source, case when doc_id % 2 = 0 then '}}' else '' end)"}, lambda: {"t": X.without_number(c("t"))},
       {"t": "trim(regexp_replace(regexp_replace(t, '\\\\textbf\\{([^}]*)\\}', '\\1', 'g'), '^[0-9]+(\\.[0-9]+)*[\\s、．.]*', ''))"})
_REF = {"t": f"concat({B}, 'newblock Title. ', case doc_id % 4 when 0 then concat({B}, 'doi{{10.1/', doc_id, '}}') when 1 then concat('https://dx.doi.org/10.2/', doc_id) when 2 then concat({B}, 'url{{http://h.org/', doc_id, '}}') else 'none' end, ' see http://x.net/', doc_id % 5)"}
scalar("p21_doi_and_url", _REF, lambda: {"doi": C.doi(c("t")), "url": C.url(c("t"))},
       {"doi": r"case when regexp_extract(t, '\\doi\{([^}]+)\}', 1) <> '' then concat('https://doi.org/', regexp_extract(t, '\\doi\{([^}]+)\}', 1)) when regexp_matches(t, 'https?://(?:dx\.)?doi\.org/[^\s{}\\]+') then regexp_extract(t, 'https?://(?:dx\.)?doi\.org/[^\s{}\\]+') end",
        "url": r"coalesce(list_filter(regexp_extract_all(t, '\\url\{([^}]+)\}', 1), lambda u: not contains(u, 'doi.org/'))[1], list_filter(regexp_extract_all(t, 'https?://[^\s{}\\]+'), lambda u: not contains(u, 'doi.org/'))[1])"})
_acc = sorted([(m + b, to) for m, ls in L.ACCENTS.items() for a, to in ls.items() for b in ("{" + a + "}", a)], key=lambda a: -len(a[0]))
_bbl = subs("t", (r"\\href\{[^}]*\}\{([^}]*)\}", r"\1"), (r"\\doi\{[^}]*\}", " "), (r"\\url\{[^}]*\}", " "), (r"\\newblock\s*", " "), (r"\\natexlab\{([^}]*)\}", r"\1"))
_bbl = subs(nested(_bbl, *_acc), *[(rf"\\{x}\{{([^{{}}]*)\}}", r"\1") for x in ("emph", "textbf", "textit", "textrm", "text", "mathrm")])
_bbl = subs(nested(_bbl, ("~", " "), ("---", "—"), ("--", "–"), ("``", '"'), ("''", '"'), (r"\&", "&"), (r"\$", "$"), (r"\%", "%"), (r"\#", "#"), (r"\_", "_")), (r"\\bibinfo\{[^}]*\}\{([^{}]*)\}", r"\1"), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " "), *[(r"\{([^{}]*)\}", r"\1")] * 8, (r"\s+", " "))
scalar("p22_bbl_plain_text", {"t": f"concat('Garc', {B}, '''{{i}}a, J.~{{{{A}}}} and M', {B}, '\"uller: ', {B}, 'emph{{', source, '}}, ', {B}, 'bibinfo{{year}}{{', doc_id % 30 + 1990, '}}, 1--', doc_id % 9, ' {{', lang, '}}')"}, lambda: {"t": L.bbl_plain(c("t"))}, {"t": f"trim({_bbl})"})
_ENTRY = {"t": "concat('@article{k', doc_id, ', author = {Smith, A.}, year = \"', doc_id % 30 + 1990, '\", title={', source, '}}')"}
scalar("p23_field_value", _ENTRY, lambda: {"author": C.field(c("t"), "author"), "year": C.field(c("t"), "year"), "title": C.field(c("t"), "title"), "doi": C.field(c("t"), "doi")},
       {"author": "regexp_extract(t, 'author = \\{([^{}]*)\\}', 1)", "year": "regexp_extract(t, 'year = \"([^\"]*)\"', 1)", "title": "regexp_extract(t, 'title=\\{([^{}]*)\\}', 1)", "doi": "cast(null as varchar)"})
scalar("p24_natural_key", {"t": "concat('Fig', doc_id % 120, 'b', doc_id % 7, '.PNG')"}, lambda: {"k": X.natural_key(c("t"))}, {"k": "array_to_string(list_transform(regexp_extract_all(lower(t), '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]') then lpad(x, 20, '0') else x end), '')"})
scalar("p26_units", {"pt": "cast(p_size as double) / 20.0"}, lambda: {"eighths": U.border_eighths(c("pt")), "back_pt": U.border_pt(U.border_eighths(c("pt"))), "twips": U.cm_to_twips(c("pt"))},
       {"eighths": "case when pt >= 1.0 then 8 when pt >= 0.7 then 6 else 4 end", "back_pt": "case when pt >= 1.0 then cast(1.2 as double) else cast(0.4 as double) end", "twips": "cast(round_even(pt * 567, 0) as bigint)"}, "part", "p_partkey")
scalar("p27_length_mm", {"t": "concat(p_size, '.5 ', case p_size % 5 when 0 then 'mm' when 1 then 'cm' when 2 then 'pt' when 3 then 'in' else 'parsec' end)"}, lambda: {"mm": U.length_mm(c("t"))},
       {"mm": "round(cast(regexp_extract(t, '^([0-9.]+)', 1) as double) * case cast(regexp_extract(t, '^([0-9]+)', 1) as int) % 5 when 0 then 1.0 when 1 then 10.0 when 2 then 0.3515 when 3 then 25.4 end, 6)"}, "part", "p_partkey")
scalar("p28_dimension_mm", {"t": "concat(p_size, 'mm - ', p_size % 7, '.5cm+2in')"}, lambda: {"mm": U.dimension_mm(c("t"))},
       {"mm": "round(cast(regexp_extract(t, '^([0-9]+)mm', 1) as double) - cast(regexp_extract(t, '([0-9.]+)cm', 1) as double) * 10 + 50.8, 6)"}, "part", "p_partkey")
_STY = {"t": f"concat(case doc_id % 4 when 0 then concat({B}, 'Large') when 1 then concat({B}, 'small') when 2 then concat({B}, 'fontsize{{11.5}}{{13}}') else '' end, case doc_id % 3 when 0 then concat({B}, 'bfseries ') when 1 then concat({B}, 'itshape ') else concat({B}, 'centering ') end, lang)"}
_case = lambda table, end: "case " + " ".join(rf"when regexp_matches(t, '\\{k}\b') then {v if isinstance(v, float) else repr(v)}" for k, v in table.items()) + f" {end} end"
scalar("p29_style_commands", _STY, lambda: {"size_pt": L.size_pt(c("t")), "weight": L.weight(c("t")), "shape": L.shape(c("t")), "alignment": L.alignment(c("t"))},
       {"size_pt": r"case when regexp_matches(t, '\\fontsize') then cast(regexp_extract(t, '\\fontsize\{([0-9.]+)\}', 1) as double) else cast(" + _case(dict(sorted(L.SIZES.items(), key=lambda x: -x[1])), "") + " as double) end",
        "weight": _case(L.WEIGHTS, "else 'normal'"), "shape": _case(L.SHAPES, "else 'normal'"), "alignment": _case({"centering": "center", "raggedright": "left", "raggedleft": "right"}, "")})
scalar("p31_line_capacity", {"w": "p_retailprice / 10 - 95"}, lambda: {"capacity": F.round(U.line_capacity(c("w")), 4)}, {"capacity": "round(case when w > 0 then greatest(32.0, w / 2.35) end, 4)"}, "part", "p_partkey")
scalar("p33_strip_comments", {"t": f"concat('a', doc_id % 3, {B}, '% b % cut ', lang)"}, lambda: {"t": L.without_comments(c("t"))}, {"t": r"regexp_replace(t, '([^\\])%.*$', '\1')"})
_PAIR = {"a": f"case doc_id % 5 when 0 then 'a+b' when 1 then 'a + b' when 2 then concat({B}, 'overline{{x}}') when 3 then 'x_{{2}}' else 'x' end", "b": f"case doc_id % 5 when 0 then 'a+b' when 1 then 'a+b' when 2 then concat({B}, 'bar{{x}}') when 3 then 'x_2' else 'y' end"}
scalar("p39_formula_match", _PAIR, lambda: {"level": L.formula_match(c("a"), c("b"))}, {"level": "case doc_id % 5 when 0 then 'exact' when 1 then 'normalised' when 2 then 'normalised' when 3 then 'semantic' else 'different' end"})
scalar("p40_equation_number", {"t": "concat(case when doc_id % 4 = 0 then 'fig' else 'eq' end, doc_id % 6, case when doc_id % 2 = 0 then concat('-', doc_id % 3) else '' end)"}, lambda: {"n": L.equation_number(c("t"))},
       {"n": "case when not regexp_matches(t, 'eq[0-9]+') then concat('(', t, ')') else concat('(', regexp_replace(t, '^eq', ''), ')') end"})
scalar("p41_equation_label", {"s": "cast(doc_id % 3 as int)", "n": "cast(doc_id % 50 as int)"}, lambda: {"label": L.equation_label(c("s"), c("n"))}, {"label": "case when s > 0 then concat('eq', s, '-', n) else concat('eq', n) end"})
_TEX = {"t": f"concat({B}, 'documentclass', case doc_id % 3 when 0 then '[a4]{{IEEEtran}}' when 1 then '{{acp}}' else '{{article}}' end, case doc_id % 5 when 0 then concat({B}, 'usepackage[x=1,citecolor=green]{{hyperref}}') when 1 then concat({B}, 'bibliographystyle{{plain}}') when 2 then concat({B}, 'bibliographystyle{{apacite}}') else '' end)"}
scalar("p42_citation_style", _TEX, lambda: {"style": C.style(c("t"))}, {"style": "case doc_id % 5 when 0 then 'hyperref_green' when 1 then 'numbered' when 2 then 'apa' else case doc_id % 3 when 0 then 'ieee' when 1 then 'copernicus' else 'apa' end end"})
scalar("p44_query_variants", {"t": "substring(text, 1, cast(20 + doc_id % 120 as int))"}, lambda: {"variants": F.array_join(X.query_variants(c("t")), "|")},
       {"variants": "array_to_string(list_transform(list_filter([{'n': 100, 'o': 1}, {'n': 80, 'o': 2}, {'n': 60, 'o': 3}, {'n': 45, 'o': 4}, {'n': 32, 'o': 5}, {'n': 24, 'o': 6}, {'n': 1000000, 'o': 7}], lambda z: z.o = 7 and not list_contains([100, 80, 60, 45, 32, 24], length(t)) or z.o < 7 and length(t) >= z.n), lambda z: substring(t, 1, z.n)), '|')"})
_FIG = {"w": "cast(p_size * 4 as double)", "h": "cast(p_size % 17 * 9 + 5 as double)"}
scalar("p45_figure_fit", _FIG, lambda: {"full_width": c("w") > F.lit(85.0) * 1.02, "height_mm": F.round(F.greatest(F.lit(20.0), F.least(c("h") * F.least(F.lit(1.0), F.lit(177.0) / c("w")), F.lit(240.0) * F.when(c("w") > 86.7, 0.82).otherwise(0.60) - 18)), 6)},
       {"full_width": "w > 85.0 * 1.02", "height_mm": "round(greatest(20.0, least(h * least(1.0, 177.0 / w), 240.0 * case when w > 86.7 then 0.82 else 0.60 end - 18)), 6)"}, "part", "p_partkey")
scalar("p48_numeric_looking", {"t": "case doc_id % 4 when 0 then ' 1,234.5 ± 2 %' when 1 then '' when 2 then lang else '(3/4)' end"}, lambda: {"numeric": X.numeric_looking(c("t"))}, {"numeric": "regexp_matches(trim(t), '^[-+±0-9.,\\s%/()]*$')"})
_META = {"t": "text"}
scalar("p52_base64_round_trip", _META, lambda: {"size": F.length(F.regexp_replace(F.base64(F.encode("t", "UTF-8")), r"\s", "")), "same": F.decode(F.unbase64(F.base64(F.encode("t", "UTF-8"))), "UTF-8") == c("t")}, {"size": "length(to_base64(encode(t)))", "same": "decode(from_base64(to_base64(encode(t)))) = t"})
scalar("p53_slug", {"t": "concat(lang, ' A (', doc_id, '): ', source, ' - and a long tail of words that goes on')"}, lambda: {"slug": X.slug(c("t"))}, {"slug": "substring(regexp_replace(trim(regexp_replace(t, '[^A-Za-z0-9_\\s-]', '', 'g')), '\\s+', '-', 'g'), 1, 50)"})
scalar("p54_safe_name", {"t": "concat(source, case when doc_id % 2 = 0 then '.bib' else ' (copy)é.bib' end)"}, lambda: {"name": X.safe_name(c("t"))}, {"name": "case when regexp_matches(t, '^[A-Za-z0-9_.-]+$') then t else regexp_replace(t, '[^A-Za-z0-9_.-]+', '_', 'g') end"})
scalar("p55_author_emails", {"t": "text"}, lambda: {"emails": F.array_join(F.array_distinct(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"), F.lit(0))), ",")},
       {"emails": "array_to_string(list_transform(list_filter(list_transform(range(1, len(regexp_extract_all(t, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+')) + 1), lambda i: {'i': i, 'e': regexp_extract_all(t, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+')[i]}), lambda z: list_position(regexp_extract_all(t, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+'), z.e) = z.i), lambda z: z.e), ',')"})
_PREP = (  # code before and after; @ is the document's language
    (r"\vspace*{2mm}@\clearpage  \label{fig:@} \begin{strip}x\end{strip}", "@ [fig-@] x"), (r"\dataavailability{Data availability. See {the {site}} @}", "\\section{Data Availability}\nSee {the {site}} @\n"),
    (r"\competinginterests{利益冲突：none}", "\\section{Competing Interests}\nnone\n"), ("\\introduction\na\n\\conclusions b", "\\section{Introduction}\na\n\\section{Conclusions} b"),
    (r"\begin{acknowledgements}@\end{acknowledgements}", r"\begin{acknowledgment}@\end{acknowledgment}"), (r"\Author[1][a@b]{Ann}{Lee} \Author{Bo}{}", r"\author{Ann Lee} \author{Bo}"),
    ("\\affil[1]{Uni}\n\\affil{Lab}", "% \\affil[1]{Uni}\n% \\affil{Lab}"), ("\\runningtitle{@}\n\\noappendix\nx \\received{y}", "% \\runningtitle{@}\n% \\noappendix\nx \\received{y}"), (r"a\vadjust {b}c", "ac"), ("a\n\\centerline{\\includegraphics[width=1cm,draft]{empty}\nb", "a\n\nb"),
)
_REPAIRED = (
    (r"$ ^{1}\mathrm{Uni @} $ and $^{2}\mathrm{ Lab}$", r"\textsuperscript{1} Uni @ and \textsuperscript{2} Lab"), (r"CO2 XCO2 OCO2 CO2x CO$_2$ CO$\_\{2\}$", r"CO$_2$ XCO$_2$ OCO-2 CO2x CO$_2$ CO$_2$"), (r"see https://x.org/@) \url{http://y}", r"see \url{https://x.org/@}) \url{http://y}"),
    ("a\n\n\n\n\nb", "a\n\n\nb"), (r"\textbf{x}\citep{a}\citep{b}\citep{@} (\citep{d})", r"\textbf{x}\citep{a,b,@} \citep{d}"), ("((Gui et al., 2024)) ((x))", "(Gui et al., 2024) ((x))"), (r"\caption{Figure 2. The @} \caption{表 1.2：b}", r"\caption{The @} \caption{b}"),
    (r"\mathrm{+\lambda} \mathrm{abc} \mathrm{a_{x=1}} \mathrm{\delta}", r"+\lambda \mathrm{abc} a_{x=1} \delta"), ("CO₂ @₁ ₃", r"CO\textsubscript{2} @\textsubscript{1} ₃"),
    (r"\usepackage{unicode-math}\begin{document}@", "\\usepackage{unicode-math}\\ExplSyntaxOn\n\\cs_set_eq:NN \\__um_scanprime_collect:N \\use_none:n\n\\ExplSyntaxOff\n\\begin{document}@"),
)


def _cases(name: str, cases: tuple, f) -> None:
    """Registers f over a case for each document, beside what must come out."""
    n, quoted = len(cases), lambda t: "'" + t.replace("'", "''") + "'"

    @query(name, f"select doc_id, replace(case doc_id % {n} " + " ".join(f"when {k} then {quoted(after)}" for k, (_, after) in enumerate(cases)) + " end, '@', lang) as t from documents")
    def run(spark, sf_dir):
        text = F.element_at(F.array(*[F.lit(before) for before, _ in cases]), (F.col("doc_id") % n + 1).cast("int"))
        return table(spark, sf_dir, "documents").select("doc_id", f(F.replace(text, F.lit("@"), F.col("lang"))).alias("t"))


_cases("p56_pandoc_prep", _PREP, R.for_converter)
_cases("p34_post_fixes", _REPAIRED, R.repaired)


@query("p43_position_class", "select l_orderkey, l_linenumber, count(*) as n, min(case when l_discount * 5 <= 0.24 then 'top' when l_discount * 5 >= 0.32 then 'inline' when l_tax * 10 >= 0.55 then 'inline' else 'top' end) as place from lineitem group by all")
def p43_position_class(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.position_class(F.col("l_discount") * 5, F.col("l_tax") * 10).alias("place"))
    return t.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("place").alias("place"))
