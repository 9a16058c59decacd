"""Secret scanning over an incremental blob ledger, with built-in functions only.

Every distinct text is a blob, addressed by its SHA-256, whatever versions of whatever paths hold it. The ledger
has a row for each (blob, rule version) that has been scanned, with its findings. A scan looks only at pairs
that the ledger lacks, appends them, and joins the findings back to every path that holds the blob. A history is
scanned commit by commit; what a commit repeats from those before it isn't scanned again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keep_until_exit, sent_if_small, shared_dir, table, text_or_empty, written
from .spans import count_kind, find_all, joined, masked

#: Raised whenever a rule below changes, so that blobs are scanned anew.
RULE_VERSION = 1

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
#: kind, pattern, condition a match must pass. A lookbehind with a possessive run finds the same maximal runs in one pass.
BASE = (
    ("assign", _ASSIGN, lambda v: F.length(F.regexp_extract(v, _ASSIGN, 1)) >= 8),
    ("access", r"AKIA[A-Z0-9]++", lambda v: F.length(v) >= 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", None),
)
#: Published token formats beyond the base rules.
EXTRA = (
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", None),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", None),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", None),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", None),
)
#: Parts, by doc_id, in which the query feeds the corpus to the ledger, as commits.
COMMITS = 2

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,at:int,stop:int>>"
_LEDGER = f"blob binary, spans {_SPANS}"


def spans(text: Column, rules=BASE + EXTRA) -> Column:
    """All spans by start, then kind in the order of the rules, without the secrets themselves."""
    found = find_all(text, *[(kind, k, pattern, None, keep) for k, (kind, pattern, keep) in enumerate(rules)])
    return F.array_sort(F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "at", "stop")])))


def _blob() -> Column:
    return F.unhex(F.sha2(text_or_empty(), 256))


def _read(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(_LEDGER).parquet(path) if there else spark.range(0).select(F.lit(None).cast("binary").alias("blob"), F.lit(None).cast(_SPANS).alias("spans"))


def scanned(spark: SparkSession, path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """(blob): every blob that has been scanned under this rule version, once."""
    return _read(spark, f"{path}/rules={rule_version}/found=true").select("blob").unionByName(_read(spark, f"{path}/rules={rule_version}/found=false").select("blob")).distinct()


def found(spark: SparkSession, path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """(blob, spans): the blobs with findings, once, even if two scans at a time appended the same one."""
    return _read(spark, f"{path}/rules={rule_version}/found=true").dropDuplicates(["blob"])


def scan(docs: DataFrame, path: str, rule_version: int = RULE_VERSION) -> None:
    """Scans the blobs of ``docs`` (text; null counts as empty) that the ledger lacks for this rule version, and appends them.

    Only blobs that stand in several rows are shuffled, once map-side combined; what the ledger knows is left out
    by a narrow table of the blobs of ``docs`` that are known or repeated.
    """
    spark = docs.sparkSession
    blobs = docs.select(_blob().alias("blob"), text_or_empty().alias("text"))
    known = scanned(spark, path, rule_version).withColumn("known", F.lit(True))
    special = blobs.groupBy("blob").agg(F.count("*").alias("n")).join(known, "blob", "left").filter((F.col("n") > 1) | F.col("known"))
    special = written(special.select(F.col("blob").alias("own"), F.coalesce("known", F.lit(False)).alias("known")), "secrets-special")
    marked = blobs.join(sent_if_small(special), F.col("blob") == F.col("own"), "left")
    once = marked.filter("own is null").select("blob", "text")
    several = marked.filter("not known").select("blob", "text").dropDuplicates(["blob"])
    new = once.unionByName(several).select("blob", spans(F.col("text")).alias("spans"))
    new.withColumn("found", F.size("spans") > 0).write.mode("append").partitionBy("found").parquet(f"{path}/rules={rule_version}")
    discard(special)


def scan_history(versions: DataFrame, commit: str, commits: int, path: str, rule_version: int = RULE_VERSION) -> None:
    """Scans the commits 0 to ``commits`` - 1 of ``versions`` (text, and the number of a commit in a column) one after the other."""
    for k in range(commits):
        scan(versions.filter(F.col(commit) == k), path, rule_version)


def findings(docs: DataFrame, path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """``docs`` with __quire_spans: the spans of each text, by start, from a ledger that has its blob.

    Rows are kept as they are, repeated ones too; a text without findings has an empty list.
    """
    spark = docs.sparkSession
    right = found(spark, path, rule_version).select(F.col("blob").alias("__quire_blob"), F.col("spans").alias("__quire_spans"))
    right = sent_if_small(right, f"{path}/rules={rule_version}/found=true")
    out = docs.withColumn("__quire_own", _blob()).join(right, F.col("__quire_own") == F.col("__quire_blob"), "left").drop("__quire_own", "__quire_blob")
    return out.withColumn("__quire_spans", F.coalesce("__quire_spans", F.array().cast(_SPANS)))


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET:kind]`` and n_chars, if there, brought up to date. Null texts stay null.

    path: a ledger to go on with; otherwise a new one.
    """
    spark, columns = docs.sparkSession, docs.columns
    path = path or keep_until_exit(spark, shared_dir(spark, "ledger"))
    scan(docs, path)
    out = findings(docs, path)
    secret = F.transform("__quire_spans", lambda s: F.struct(*[s[c].alias(c) for c in ("at", "stop", "start", "end", "rank", "kind")], F.lit("").alias("value")))
    out = out.withColumn("text", masked(F.col("text"), secret, lambda s: F.concat(F.lit("[SECRET:"), s["kind"], F.lit("]"))))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base rules, and all spans, further formats among them.

    The documents come to the ledger in COMMITS parts by doc_id; a text that an earlier part had isn't scanned again.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / COMMITS for k in range(1, COMMITS)], 1000)).first()[0] or []))
    commit = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    path = keep_until_exit(spark, shared_dir(spark, "ledger"))
    scan_history(docs.withColumn("commit", commit), "commit", len(cuts) + 1, path)
    out = findings(docs, path)
    base = F.filter("__quire_spans", lambda s: s["rank"] < len(BASE))
    return out.select(
        "doc_id",
        *[count_kind(base, kind).alias(f"n_{kind}") for kind, _, _ in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("__quire_spans")).alias("spans"),
    )
