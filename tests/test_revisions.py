"""Keyed state over a stream that stops and goes on from its checkpoint, against a loop over the same batches."""

import datetime

from quire.streaming import revisions as R
from quire.streaming.documents import incoming

DAY = datetime.datetime(2024, 1, 1)


def rows_of(batch):
    return [(doc, version, DAY + datetime.timedelta(minutes=minute), text) for doc, version, minute, text in batch]


def test_latest_versions_after_a_restart(spark, tmp_path):
    batches = [
        [(1, 1, 0, "a"), (2, 5, 1, "x"), (1, 3, 2, "c"), (None, 1, 2, "no id"), (3, None, 2, "no version")], [(1, 2, 5, "b"), (2, 6, 6, "x"), (4, 1, 6, None)], [(1, 4, 9, "d"), (2, 6, 9, "y"), (4, 2, 9, "")], [(1, 4, 12, "d"), (5, 1, 12, "new")],
    ]
    old = spark.conf.get(R.PROVIDER[0])
    spark.conf.set(*R.PROVIDER)
    try:
        where, seen = tmp_path / "in", {}
        for k, batch in enumerate(batches):  # each run ends and the next goes on from the checkpoint
            spark.createDataFrame(rows_of(batch), R.REVISIONS).coalesce(1).write.mode("append").parquet(f"file://{where}")
            stream = R.latest_versions(incoming(spark, f"file://{where}", R.REVISIONS))
            query = stream.writeStream.format("parquet").outputMode("append").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
            assert query.awaitTermination(120) and query.exception() is None
        got = sorted((r.doc_id, r.version, r.status, r.text or "") for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    finally:
        spark.conf.set(R.PROVIDER[0], old)
    want = []
    for batch in batches:
        for doc, version, _, text in sorted((r for r in batch if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1])):
            held = seen.get(doc)
            status = "new" if held is None else "late" if version <= held[0] else "same" if held[1] == (text or "") else "revised"
            want.append((doc, version, status, text or ""))
            if status != "late":
                seen[doc] = (version, text or "")
    assert got == sorted(want) and {s for _, _, s, _ in want} == {"new", "revised", "same", "late"}


def test_once_within_the_watermark(spark, tmp_path):
    where = tmp_path / "in"
    for batch in ([(1, 1, 0, "a"), (1, 1, 1, "again"), (2, 1, 1, "b")], [(1, 1, 3, "again"), (1, 2, 4, "c")]):
        spark.createDataFrame(rows_of(batch), R.REVISIONS).coalesce(1).write.mode("append").parquet(f"file://{where}")
        query = R.once(incoming(spark, f"file://{where}", R.REVISIONS)).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
    assert sorted((r.doc_id, r.version) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(1, 1), (1, 2), (2, 1)]
