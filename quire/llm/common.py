"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without these characters: space, and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local master,
    where driver and executors are one process, falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/quire-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    keep_until_exit(spark, path)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


#: Bytes of Parquet up to which a written table is sent to every executor; beyond, Spark joins by shuffle (or as it sees fit).
SENT_BYTES = 8 * 1024 * 1024


def sent_if_small(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df``, from ``written`` or of the files under ``path``, marked for broadcast if these are no larger than SENT_BYTES."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path or df._quire_path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return F.broadcast(df) if not files.exists(where) or files.getContentSummary(where).getLength() <= SENT_BYTES else df


_FOLDERS: dict[str, SparkSession] = {}


def keep_until_exit(spark: SparkSession, path: str) -> str:
    """Marks a folder of the shared one as scratch: it goes when the driver's program ends, unless ``remove`` took it before."""
    _FOLDERS[path] = spark
    return path


def discard(*frames: DataFrame) -> None:
    """Removes the files of frames that ``written`` gave and that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df._quire_path)


def remove(spark: SparkSession, path: str) -> None:
    _FOLDERS.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_FOLDERS.items()):
        if spark.sparkContext._jsc is not None:  # the session still runs
            remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


class Shared:
    """Whole small files in the shared folder, read and written from Python on any node.

    ``file:`` paths are opened as they are (the folder is mounted everywhere); other schemes go through
    pyarrow's file systems. A file appears under its name only when it is complete, so a task that is run
    again, or twice at once, leaves the same file.
    """

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        if "://" not in root or root.startswith("file:"):
            self.fs, self.base = pyarrow.fs.LocalFileSystem(), re.sub("^file:/*", "/", self.root)
        else:
            self.fs, self.base = pyarrow.fs.FileSystem.from_uri(self.root)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, name: str, parts) -> int:
        """Writes the byte strings of ``parts`` one after the other; gives their total length."""
        final, size = self.path(name), 0
        self.fs.create_dir(final.rpartition("/")[0], recursive=True)
        draft = f"{final}.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(draft) as out:
            for part in parts:
                out.write(part)
                size += len(part)
        self.fs.move(draft, final)
        return size

    def open(self, name: str):
        return self.fs.open_input_file(self.path(name))

    def get(self, name: str) -> bytes | None:
        """The file's bytes, or None if there is no such file."""
        if self.fs.get_file_info(self.path(name)).type != pyarrow.fs.FileType.File:
            return None
        with self.open(name) as f:
            return f.read()

    def remove_dir(self, name: str) -> None:
        if self.fs.get_file_info(self.path(name)).type == pyarrow.fs.FileType.Directory:
            self.fs.delete_dir(self.path(name))


def drop_dead_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files that no DataFrame in use refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
