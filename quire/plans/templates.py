"""Facts of templates, documents checked against them, and the files of a template."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import specs as S
from ..operators import specs as C
from .registry import query, spread, table

#: Parts of a class, each with the facts that it states. A template holds two in three of them; @@ is a number of its own.
PARTS = (
    (r"\ProvidesClass{c@@}\LoadClass[twoside]{article}\DeclareOption{draft}\DeclareOption*{x}\ExecuteOptions{a4, final}\PassOptionsToClass{b5}{article}",
     {"document_class": [("class_name", "c@@"), ("base_class", "article"), ("base_class_options", "twoside"), ("declared_options", "draft"), ("declared_options", "*"), ("default_options", "a4"), ("default_options", "final"), ("passed_options", "b5")]}),
    (r"\documentclass[11pt,a4]{cls@@}", {"document_class": [("name", "cls@@"), ("options", "11pt"), ("options", "a4")]}),
    (r"\RequirePackage[numbers,sort]{natbib}\usepackage{booktabs,multirow}\usepackage[fleqn]{amsmath}",
     {"required_packages": [("package", p) for p in ("natbib", "booktabs", "multirow", "amsmath")], "table_format": [("table_packages", "booktabs"), ("table_packages", "multirow")], "bibliography_format": [("natbib_options", "numbers"), ("natbib_options", "sort")], "equation_format": [("amsmath_options", "fleqn")]}),
    (r"\long\def\@maketitle{\vspace*{2mm}{\centering\LARGE\bfseries\sffamily\color{blue}T \and U}}",
     {"title_format": [("title_size", "LARGE"), ("bold", "true"), ("centred", "true"), ("sans", "true"), ("color", "blue"), ("vspace", "2mm")], "author_format": [("separator", r"\and")]}),
    (r"\newcommand{\title}[2]{\shorttitle{#1}}\newcommand{\affil}[1]{x}\def\email#1{x}\author{A}\author{B}\renewcommand\Authfont{\small}\Affilfont{\it}",
     {"title_format": [("title_args", "2"), ("has_short_title", "true")], "author_format": [("args.affil", "1"), ("args.email", "1"), ("multiple_authors", "true"), ("font.Authfont", r"\small"), ("font.Affilfont", r"\it")]}),
    (r"\newenvironment{abstract}{a}{b}\begin{abstract}\small x \keywords{y}\end{abstract}\secabstractname",
     {"abstract_format": [("type", "environment"), ("font_size", "small"), ("keywords_inside", "true"), ("second", "true")], "keywords_format": [("exists", "true")]}),
    (r"\newcommand{\keywords}[1]{\textbf{Keywords: }#1}", {"keywords_format": [("exists", "true"), ("bold", "true"), ("label_text", "Keywords:")]}),
    (r"\let\subsection=\introduction \renewcommand{\paragraph}{x}\@startsection{section}{1}\titleformat{\section}{\bfseries}\titlespacing{\section}{0pt}{2pt}{3pt}",
     {"section_commands": [("alias.subsection", "introduction"), ("custom", "paragraph"), ("startsection", "section"), ("titleformat.section", r"\bfseries"), ("titlespacing.section", "{0pt}{2pt}{3pt}")]}),
    (r"\newenvironment{dataavailability}{x}{y}\def\acknowledgements{\section{Thanks}}\generateCommand{conclusions}",
     {"special_envs": [("environment", "dataavailability"), ("command", "acknowledgements"), ("generated", "conclusions"), ("section_title.acknowledgements", "Thanks")], "template_specific": [("required_declarations", "dataavailability"), ("required_declarations", "acknowledgements")]}),
    (r"\newenvironment{figure}{\@float[htbp]}{x}\usepackage{subfig}\DeclareGraphicsExtensions{.pdf,.png}\graphicspath{{figs/}}\def\thefigure{F\arabic}\g@addto@macro\subfiguresbegin{x}",
     {"figure_format": [("default_position", "htbp"), ("subfigure_package", "subfig"), ("graphics_extensions", ".pdf"), ("graphics_extensions", ".png"), ("graphics_path", "figs/"), ("numbering_format", r"F\arabic"), ("subfigure_hook", "subfiguresbegin")], "required_packages": [("package", "subfig")]}),
    (r"\begin{tabular}{lc|r}\hline\toprule\end{tabular}\def\thetable{T@@}\setlength{\tabcolsep}{4pt}\renewcommand{\arraystretch}{1.2}",
     {"table_format": [("hline_commands", "hline"), ("hline_commands", "toprule"), ("column_format", "lc|r"), ("numbering_format", "T@@"), ("length.tabcolsep", "4pt"), ("arraystretch", "1.2")]}),
    (r"\long\def\@makecaption#1#2{{\bfseries #1: }#2}\usepackage[labelfont=bf,skip=4pt]{caption}\captionsetup{font=small, margin=2mm}",
     {"caption_format": [("separator", ":"), ("bold", "true"), ("caption_options", "labelfont=bf"), ("caption_options", "skip=4pt"), ("setup.font", "small"), ("setup.margin", "2mm")], "required_packages": [("package", "caption")]}),
    (r"\def\theequation{E\arabic}\numberwithin{equation}{section}\newcommand{\varname}[1]{\mathit{#1}}",
     {"equation_format": [("numbering_format", r"E\arabic"), ("number_within", "section"), ("identifier_italic", "true")], "numbering": [("within.equation", "section")]}),
    (r"\usepackage[style=apa, sorting=nyt]{biblatex}\addbibresource{r@@.bib}\DeclareFieldFormat{doi}{D}\bibliographystyle{plain}\bibpunct{(}{)}{;}{a}{,}{,}\let\bibfont\small \def\bibliography{x}",
     {"bibliography_format": [("biblatex.style", "apa"), ("biblatex.sorting", "nyt"), ("bib_resource", "r@@.bib"), ("field_format.doi", "D"), ("style", "plain"), ("bibpunct", "{(}{)}{;}{a}{,}{,}"), ("font_size", "small"), ("bib_name", "x")], "required_packages": [("package", "biblatex")]}),
    (r"\newenvironment{appendix}{a}{b}\appendix \def\thesection{\Alph{section}}", {"appendix_format": [("environment", "true"), ("command", "true"), ("alphabetic", "true")]}),
    (r"\if@stage@final\@addtoreset{figure}{section}\fi \@addtoreset{table}{chapter}\setcounter{secnumdepth}{3}\c@tocdepth=2",
     {"numbering": [("conditional_reset.figure", "section"), ("reset.table", "chapter"), ("depth.secnumdepth", "3"), ("depth.tocdepth", "2")]}),
    (r"\newcommand{\runningtitle}[1]{x}\def\received{Received: }", {"template_specific": [("args.runningtitle", "1"), ("command", "runningtitle"), ("command", "received")], "dates": [("label.received", "Received:")]}),
    (r"\textwidth 180mm\setlength{\columnsep}{7mm}\geometry{margin=2cm, top=3cm}\bleed 3mm \twocolumn",
     {"page_layout": [("textwidth", "180mm"), ("columnsep", "7mm"), ("geometry.margin", "2cm"), ("geometry.top", "3cm"), ("bleed", "3mm"), ("columns", "twocolumn")]}),
    (r"\setmainfont[Ligatures=TeX]{Times}\newfontfamily\cjk{Song}\renewcommand{\rmdefault}{ptm}\@setfontsize\small{9}{11}",
     {"fonts": [("font.main", "Times"), ("family.cjk", "Song"), ("default.rmdefault", "ptm"), ("size.small", "{9}{11}")]}),
    (r"\setlength{\parindent}{1em}\linespread{1.5}\onehalfspacing \raggedbottom \frenchspacing \sloppy",
     {"spacing": [("length.parindent", "1em"), ("stretch", "1.5"), ("line_spacing", "onehalfspacing"), ("bottom", "raggedbottom"), ("mode", "frenchspacing"), ("mode", "sloppy")]}),
    (r"\renewcommand{\topfraction}{.8}\setcounter{topnumber}{3}\floatsep 4pt \setlength{\abovedisplayskip}{5pt}\renewcommand{\thefootnote}{\alph}",
     {"floats": [("fraction.topfraction", ".8"), ("counter.topnumber", "3"), ("skip.floatsep", "4pt")], "math": [("skip.abovedisplayskip", "5pt")], "footnotes": [("format", r"\alph")]}),
    (r"\pagestyle{fancy}\fancyhead[LE]{T}\fancyfoot[C]{P}\renewcommand{\headrulewidth}{0pt}\def\ps@plain{x}\definecolor{ink}{rgb}{0,0,1}",
     {"header_footer": [("pagestyle", "fancy"), ("head.LE", "T"), ("foot.C", "P"), ("rule.headrulewidth", "0pt"), ("style", "plain")], "colors": [("define.ink", "{rgb}{0,0,1}")]}),
    (r"\def\labelitemi{--}\setlist{nosep}\hypersetup{colorlinks=true, citecolor=blue}\theoremstyle{plain}\newtheorem{lemma}{Lemma}",
     {"lists": [("label.labelitemi", "--"), ("setlist", "nosep")], "hyperref": [("colorlinks", "true"), ("citecolor", "blue")], "theorems": [("style", "plain"), ("theorem.lemma", "Lemma")]}),
    (r"\RequirePackage[ruled]{algorithm2e}\floatstyle{ruled}\crefname{fig}{Fig}{Figs}\usepackage[capitalise]{cleveref}\renewcommand{\figurename}{Fig. @@}\newcommand{\doi}[1]{D}\reversemarginpar\usepackage{marginnote}",
     {"algorithms": [("package", "algorithm2e"), ("floatstyle", "ruled")], "cleveref": [("name.fig", "{Fig}{Figs}"), ("options", "capitalise")], "names": [("figurename", "Fig. @@")], "doi": [("format.doi", "D")], "margins": [("reversed", "true"), ("marginnote", "true")], "required_packages": [("package", "algorithm2e"), ("package", "cleveref"), ("package", "marginnote")]}),
)
_ROWS = ", ".join(f"({k}, '{category}', '{key}', '{value}')" for k, (_, stated) in enumerate(PARTS) for category, facts in stated.items() for key, value in facts)


@query("p58_spec_facts", f"select distinct doc_id, category, key, replace(value, '@@', cast(doc_id % 90 as varchar)) as value from documents, (values {_ROWS}) v(k, category, key, value) where (doc_id + k) % 3 <> 0")
def p58_p59_s17(spark, sf_dir):
    """Facts of a class for each document, against what the parts that it is made of are known to state."""
    parts = F.concat(*[F.when((F.col("doc_id") + k) % 3 != 0, F.lit(part + "\n")).otherwise("") for k, (part, _) in enumerate(PARTS)])
    t = spread(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", F.replace(parts, F.lit("@@"), (F.col("doc_id") % 90).cast("string")).alias("t"))
    return t.select("doc_id", F.explode(S.facts(F.col("t"))).alias("f")).select("doc_id", "f.category", "f.key", "f.value")


#: The template of nation n, and a document's code: parts with the condition under which they stand there.
_TEMPLATE = (
    (r"\ProvidesClass{cls##}\ExecuteOptions{final,a4}\RequirePackage{natbib}\newenvironment{acknowledgements}{x}{y}\def\conclusions{\section{C}}\bibliographystyle{plain}\numberwithin{equation}{section}", "true"),
    (r"\newcommand{\title}[2]{x}\keywords ", "n % 2 = 0"), (r"\let\subsection=\introduction ", "n % 5 = 0"), (r"\begin{longtable}{lcc}", "n % 7 = 0"), (r"\appendix \onehalfspacing ", "n % 3 = 1"),
)
_CODE = (
    (r"\documentclass[final]{cls##}", "n % 11 <> 0"), (r"\usepackage[margin=1in]{geometry}", "n % 4 = 0"), (r"\title{T}", "n % 3 <> 0"), (r"\title[s]{T}", "n % 3 = 0"), (r"\author{A}", "n % 5 <> 0"),
    (r"\begin{abstract}x\end{abstract}", "n % 2 = 0"), (r"\keywords{k}", "n % 7 = 0"), (r"\begin{acknowledgements}t\end{acknowledgements}", "n % 6 = 0"), (r"\conclusions c", "n % 9 <> 0"), (r"\introduction i", "n % 4 = 2"),
    (r"\begin{figure}[t]\includegraphics{f.png}\end{figure}", "n % 8 = 0"), (r"\begin{table}\begin{tabular}{|l|}x\end{tabular}\end{table}", "n % 7 <> 3"), (r"\begin{equation}e\end{equation}", "n % 10 = 0"), (r"\usepackage{setspace}\onehalfspacing ", "n % 4 = 1"),
    (r"\bibliographystyle{plain}", "n % 13 <> 0 and n % 2 = 1"), (r"\bibliographystyle{apa}", "n % 13 <> 0 and n % 2 = 0"), (r"\bibliography{r}", "n % 17 <> 0"), (r"\maketitle ", "n % 19 <> 0"), (r"\appendix ", "n % 21 <> 0"), ("中", "n % 12 = 0"),
)
#: category, item, when there is such a row, when it is pass, and what it is otherwise: n is the document, t its template if that is known.
_WANTED = (
    ("document_class", "documentclass", "n % 11 = 0", "false", "issues"), ("document_class", "cls", "n % 11 <> 0", "t is null or t % 4 = n % 4", "issues"), ("document_class", "a4", "n % 11 <> 0 and t is not null", "false", "warnings"),
    ("required_packages", "geometry", "n % 4 = 0 and t is not null", "false", "issues"), ("title_format", "title", "true", "t is null or t % 2 <> 0 or n % 3 = 0", "warnings"), ("author_format", "author", "true", "n % 5 <> 0", "issues"),
    ("abstract_format", "abstract", "true", "n % 2 = 0", "issues"), ("keywords_format", "keywords", "t % 2 = 0", "n % 7 = 0", "warnings"), ("section_commands", "introduction", "t % 5 = 0 and n % 4 = 2", "true", ""),
    ("special_envs", "acknowledgements", "t is not null", "n % 6 = 0", "warnings"), ("special_envs", "conclusions", "t is not null", "n % 9 <> 0", "warnings"), ("figure_format", "t", "n % 8 = 0", "false", "warnings"), ("figure_format", "figure", "n % 8 = 0", "true", ""),
    ("table_format", "vertical_rules", "t % 7 = 0 and n % 7 <> 3", "false", "warnings"), ("table_format", "longtable", "t % 7 = 0 and n % 7 <> 3", "false", "warnings"), ("table_format", "table", "n % 7 <> 3", "true", ""),
    ("equation_format", "amsmath", "n % 10 = 0", "false", "warnings"), ("equation_format", "number_within", "t is not null", "true", ""),
    ("bibliography_format", "bibliographystyle", "n % 13 = 0", "false", "issues"), ("bibliography_format", "plain", "n % 13 <> 0 and n % 2 = 1", "true", ""), ("bibliography_format", "apa", "n % 13 <> 0 and n % 2 = 0", "t is null", "warnings"),
    ("bibliography_format", "bibliography", "n % 17 = 0", "false", "issues"), ("appendix_format", "appendix", "t % 3 = 1 and n % 21 <> 0", "true", ""), ("template_specific", "acknowledgements", "t is not null", "n % 6 = 0", "warnings"), ("template_specific", "maketitle", "true", "n % 19 <> 0", "issues"),
    ("page_layout", "geometry", "n % 4 = 0", "false", "issues"), ("paragraph_format", "line_spacing", "t % 3 = 1", "n % 4 = 1", "warnings"), ("paragraph_format", "line_spacing", "coalesce(t % 3, 0) <> 1 and n % 4 = 1", "false", "issues"), ("paragraph_format", "ctex", "n % 12 = 0", "false", "issues"),
)
_CHECKED = "with d as (select doc_id, doc_id as n, case when doc_id % 30 < 25 then doc_id % 30 end as t from documents), c as (" + " union all ".join(
    f"select doc_id, '{category}' as category, case when {good} then 'pass' else '{bad}' end as status, {"concat('cls', n % 4)" if item == "cls" else f"'{item}'"} as item from d where {row}" for category, item, row, good, bad in _WANTED) + ")"


def _code(parts: tuple, n: str):
    n_ = lambda condition: F.expr(condition.replace("n %", f"{n} %"))
    return F.replace(F.concat(*[F.when(n_(condition), F.lit(part)).otherwise("") for part, condition in parts]), F.lit("##"), (F.col(n) % 4).cast("string"))


def _checked(spark, sf_dir):
    templates = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("template"), _code(_TEMPLATE, "n_nationkey").alias("code"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 30).alias("template"), _code(_CODE, "doc_id").alias("text"))
    return C.check(docs, templates, ["doc_id"], "template", "text", "code")


@query("j14_spec_checks", _CHECKED + " select * from c")
def j14(spark, sf_dir):
    """Documents against their templates' facts; five in thirty name a template that there isn't."""
    return _checked(spark, sf_dir)


@query("g17_check_summary", _CHECKED + """ select doc_id, count(*) filter (where status = 'pass') as "pass", count(*) filter (where status = 'warnings') as warnings, count(*) filter (where status = 'issues') as issues, case when count(*) filter (where status = 'issues') = 0 then 'PASS' else 'FAIL' end as status from c group by doc_id""")
def g17(spark, sf_dir):
    return C.summary(_checked(spark, sf_dir), ["doc_id"])


_FILES = ("a/journal.CLS", "a/x.sty", "x.bst", "my-Sample.tex", "body.tex", "y.cfg", "z.log", "readme", "pic.tar.gz", ".bib")
_FILE_KINDS = ("cls", "sty", "bst", "tex", "other", "cfg", None, "other", None, "other")


@query("s18_template_files", "select * from (select doc_id, case doc_id % 10 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(_FILE_KINDS) if v) + " end as kind from documents) where kind is not null")
def s18(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", S.file_kind(F.concat_ws("/", F.col("lang"), name)).alias("kind")).filter("kind is not null")


_SKELETON = (
    "'~documentclass[final,a4]{cls', n % 4, '}', nl, '~usepackage{natbib}', nl, '~begin{document}', nl, case when n % 2 = 0 then '~title[Short title]{Title}' else '~title{Title}' end, nl, '~author{Author}', nl, '~maketitle', nl, "
    "case when n % 2 = 0 then concat('~keywords{Keywords}', nl) else '' end, case when n % 5 = 0 then '~introduction' else '~section{Introduction}' end, nl, '~conclusions', nl, case when n % 3 = 1 then concat('~appendix', nl) else '' end, "
    "'~begin{acknowledgements}', nl, '~end{acknowledgements}', nl, '~bibliographystyle{plain}', nl, '~bibliography{references}', nl, '~end{document}'"
)


@query("k11_template_code", f"select n as n_nationkey, replace(concat({_SKELETON}), '~', chr(92)) as code from (select n_nationkey as n, chr(10) as nl from nation)")
def k11(spark, sf_dir):
    """The skeleton of a document for each nation's template, from the facts that its class states."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", _code(_TEMPLATE, "n_nationkey").alias("code"))
    return t.select("n_nationkey", S.facts(F.col("code")).alias("spec")).select("n_nationkey", C.template_code(F.col("spec")).alias("code"))
