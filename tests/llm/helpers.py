import hashlib

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty, repeated rows, ties, long text without spaces, code points beyond the basic plane.
ODD_TEXTS = [None, "", " ", "\n\t", "a", "same text here", "same text here", "x" * 30_000, "7" * 5_000, "a." * 4_000, "word " * 3_000, "\U0001f600 \U0001f600 é ß", "(" * 2_000]


def odd_docs(spark, more=()):
    rows = [(i, t, None if i % 3 == 0 else "en", None, None if t is None else len(t)) for i, t in enumerate([*ODD_TEXTS, *more])]
    rows += [(None, "no id at all", None, None, None), rows[5], rows[5]]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def sf_dir_of(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
