"""Personal data: pattern spans, then information-theoretic sanitisation, with built-in functions only.

Base spans are the protected entities. Co-occurrence over the corpus estimates how strongly a term reveals an entity:
with N documents, an entity c in n_c of them, a term t in n_t, and both in n_ct,

    PMI(c; t) = log2(N * n_ct / (n_c * n_t))        IC(c) = log2(N / n_c)

A term whose PMI reaches ``disclosure`` of the entity's information discloses the entity, and every occurrence of it in
the documents that hold the entity becomes a span of kind ``term``. Terms are runs of letters, marks and digits of
the whole text outside its entities, without regard to case. All counts are of documents (copies count), over all of
them. ``support`` asks that a pair be seen together in so many distinct texts; at 1, a term that stands nowhere but
with an entity reveals it, be it once. Sanitising generalises entities to their kind, terms with a digit to
``[NUMBER]`` and capitalised terms to ``[NAME]``, and removes other terms.

Entities that stand in just the same texts have the same figures with every term, and so have such terms with every
entity; so classes of them are paired, not their members, and a long list of addresses and names makes one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, sent_if_small, table, text_or_empty, written
from .spans import count_kind, find_all, find_spans, joined, masked, no_spans

#: Share of an entity's information that a term may not reveal.
DISCLOSURE = 0.8
#: Distinct texts in which a term must stand with the entity.
SUPPORT = 1

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_TERM = r"[\p{L}\p{M}\p{N}]++"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the digit string passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, 1).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add, lambda acc: acc % 10 == 0)


#: kind, pattern, condition on the text that any kept match implies, condition a match must pass.
BASE = (
    ("email", _EMAIL, lambda t: F.instr(t, "@") > 0, None),
    ("ip", _IP, lambda t: t.rlike(_IP), lambda v: v.rlike("^" + r"\.".join([_BYTE] * 4) + "$")),
    ("card", _CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda v: F.when(F.length(_digits(v)).between(13, 19), luhn(_digits(v))).otherwise(False)),
    ("phone", _PHONE, lambda t: F.instr(t, "+") > 0, lambda v: F.length(_digits(v)).between(9, 15)),
)


def base_spans(text: Column) -> Column:
    """Base spans by kind as listed, then start."""
    return find_all(text, *[(kind, k, pattern, probe(text), keep) for k, (kind, pattern, probe, keep) in enumerate(BASE)])


def _entity(b: Column) -> Column:
    return F.concat_ws(":", b["kind"], F.lower(b["value"]))


def _texts(column: str) -> list[Column]:
    """Aggregates that tell the set of texts of a group: their number, and two sums of their hashes."""
    return [F.count("*").alias("texts"), F.sum("copies").alias("docs"), F.bit_xor(F.xxhash64(column)).alias("h1"), F.bit_xor(F.xxhash64(column, F.lit(1))).alias("h2")]


def scan(docs: DataFrame) -> DataFrame:
    """Written: ``docs``' base spans and text id, with the text of those that have any; null texts count as empty."""
    text = text_or_empty()
    own = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("__quire_text_id"), base_spans(text).alias("__quire_base"), text.alias("text"))
    return written(own.withColumn("text", F.when(F.size("__quire_base") > 0, F.col("text"))), "pii-base")


def term_spans(docs: DataFrame, scanned: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(__quire_text_id, __quire_terms): the disclosing terms of each text that has any, as spans by start. ``scanned``: from ``scan(docs)``."""
    n = scanned.count()
    private = scanned.filter("text is not null").groupBy("__quire_text_id").agg(F.count("*").alias("copies"), F.any_value("text").alias("text"), F.any_value("__quire_base").alias("__quire_base"))
    clear = masked(F.col("text"), F.col("__quire_base"), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))
    # Written with a short number for each text, which the joins below go by.
    private = written(private.select("__quire_text_id", "copies", "__quire_base", clear.alias("clear"), F.monotonically_increasing_id().alias("id")), "pii-private")

    held = private.select("id", "copies", F.explode(F.array_distinct(F.transform("__quire_base", _entity))).alias("entity"))
    entities = held.groupBy("entity").agg(*_texts("id")).filter(F.col("texts") >= support).select("entity", F.col("docs").alias("n_c"), F.xxhash64("docs", "texts", "h1", "h2").alias("c"))
    by_entity = written(held.join(entities, "entity").select("id", "copies", "c", "n_c").distinct(), "pii-entities")
    most = by_entity.agg(F.max("n_c")).first()[0] or 0

    each = lambda text: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))
    here = private.select("id", "copies", F.explode(each(F.col("clear"))).alias("term"))
    spread = docs.select(F.explode(each(text_or_empty())).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    # A pair has n_ct of n_c at most, so a term that is too common for the most common entity is out before pairs are made.
    rare = F.pow(F.lit(most / max(n, 1)), F.lit(1 - disclosure)) * F.col("n_t") <= F.lit(most * (1 + 1e-9))
    terms = here.groupBy("term").agg(*_texts("id")).filter(F.col("texts") >= support).join(spread.filter(rare), "term")
    terms = written(terms.select("term", "n_t", F.xxhash64("n_t", "texts", "h1", "h2").alias("t")), "pii-terms")
    by_term = here.join(sent_if_small(terms), "term").select("id", "t", "n_t").distinct()
    least = F.pow(F.col("n_c") / F.lit(float(max(n, 1))), F.lit(1 - disclosure)) * F.col("n_t")
    both = written(by_entity.join(by_term, "id").filter(least <= F.col("n_c") * (1 + 1e-9)).select("id", "copies", "c", "t", "n_c", "n_t"), "pii-pairs")
    pmi = F.log2(F.lit(float(n)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    told = (
        both.groupBy("c", "t", "n_c", "n_t").agg(F.sum("copies").alias("n_ct"), F.count("*").alias("texts")).filter(F.col("texts") >= support)
        .filter((pmi > 0) & (pmi >= F.lit(disclosure) * F.log2(F.lit(float(n)) / F.col("n_c")) - F.lit(1e-9))).select("c", "t")
    )
    classes = both.join(told, ["c", "t"], "left_semi").select("id", "t").distinct()
    # Terms of the texts that have any of those classes, with their classes, and where they stand.
    words = private.join(sent_if_small(written(classes.select("id").distinct(), "pii-hit")), "id", "left_semi").select("id", F.explode(find_spans(F.col("clear"), "term", len(BASE), _TERM)).alias("w"))
    words = words.select("id", F.lower("w.value").alias("term"), F.struct("w.start", "w.end", "w.value", "w.at", "w.stop").alias("w"))
    hit = words.join(sent_if_small(terms).select("term", "t"), "term").join(classes, ["id", "t"], "left_semi")
    spans = hit.groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    whole = F.transform("w", lambda s: F.struct(F.lit("term").alias("kind"), F.lit(len(BASE)).alias("rank"), *[s[c].alias(c) for c in ("start", "end", "value", "at", "stop")]))
    out = written(spans.join(private.select("id", "__quire_text_id"), "id").select("__quire_text_id", whole.alias("__quire_terms")), "pii-disclosing")
    discard(private, both, terms, by_entity)
    return sent_if_small(out)


def find(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with __quire_base (entities by pattern) and __quire_terms (disclosing terms). Null texts count as empty; rows are kept as they are."""
    told = term_spans(docs, scan(docs), disclosure, support)
    found = docs.withColumn("__quire_text_id", F.unhex(F.sha2(text_or_empty(), 256))).withColumn("__quire_base", base_spans(text_or_empty()))
    return found.join(told, "__quire_text_id", "left").withColumn("__quire_terms", F.coalesce("__quire_terms", no_spans()))


def _label(s: Column) -> Column:
    entity = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    term = F.when(s["value"].rlike(r"\p{N}"), F.lit("[NUMBER]")).when(s["value"].rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit(""))
    return F.when(s["kind"] == "term", term).otherwise(entity)


def sanitise(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with entities generalised to ``[KIND]`` and disclosing terms generalised or removed. Null texts stay null; n_chars follows the text."""
    columns = docs.columns
    out = find(docs, **parameters).withColumn("text", masked(F.col("text"), F.concat("__quire_base", "__quire_terms"), _label))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base patterns, and all spans (base, then disclosing terms)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = scan(docs)
    return keyed.join(term_spans(docs, keyed), "__quire_text_id", "left").select(
        "doc_id",
        *[count_kind(F.col("__quire_base"), kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(joined(F.col("__quire_base")), 256).alias("base_sha256"),
        joined(F.concat("__quire_base", F.coalesce("__quire_terms", no_spans()))).alias("spans"),
    )
