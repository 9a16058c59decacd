"""Documents that come again: the latest version of each counts, older ones that come late are told as such.

State is keyed by document and holds a version and a digest, not the text. An event-time timer lets a document's state go once nothing
has come for ``keep``; a version that comes after that starts anew, as it must in any bounded state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

REVISIONS = "doc_id long, version long, ts timestamp, text string"
STATE = StructType([StructField("version", LongType()), StructField("digest", StringType())])
OUT = StructType([StructField("doc_id", LongType()), StructField("version", LongType()), StructField("status", StringType()), StructField("text", StringType())])
#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Latest(StatefulProcessor):
    """For each row ``new`` (the first of its document), ``revised`` (a higher version with another text), ``same`` (a higher version with the same text) or ``late`` (no higher version).

    Rows of a document that come together are taken by version, so a batch tells the same whatever their order.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        held = self.latest.get() if self.latest.exists() else None
        own = pd.concat(list(rows)).sort_values(["version", "digest"], kind="stable")
        out = []
        for version, digest, text in zip(own["version"], own["digest"], own["text"]):
            version = int(version)
            if held is not None and version <= held[0]:
                out.append((key[0], version, "late", text))
                continue
            out.append((key[0], version, "new" if held is None else "same" if held[1] == digest else "revised", text))
            held = (version, digest)
        self.latest.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(timers.getCurrentWatermarkInMs(), int(own["ms"].max())) + self.keep_ms)
        yield pd.DataFrame(out, columns=OUT.names)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        self.latest.clear()
        yield pd.DataFrame([], columns=OUT.names)

    def close(self) -> None:
        pass


def latest_versions(revisions: DataFrame, late: str = "1 day", keep_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """(doc_id, version, status, text) of every row of a stream of (doc_id, version, ts, text); rows without an id or a version go.

    ``late`` is the watermark's delay; older rows are dropped by Spark. The session must use the state store of ``PROVIDER``.
    """
    known = revisions.filter("doc_id is not null and version is not null").withWatermark("ts", late)
    rows = known.select("doc_id", "version", "ts", (F.unix_millis(F.col("ts"))).alias("ms"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    return rows.groupBy("doc_id").transformWithStateInPandas(Latest(keep_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def once(revisions: DataFrame, late: str = "1 day") -> DataFrame:
    """The first row of each (doc_id, version) of a stream; what comes again within the watermark's delay is dropped, and its state with time."""
    return revisions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "version"])
