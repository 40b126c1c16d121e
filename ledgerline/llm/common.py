"""What the operators share: table reading, work tables in the cluster's shared folder, and spans of memory."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one if Spark is local.

    On a cluster a folder of the driver's machine would take each executor's work tables to another disk, so that is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="ledgerline-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Workspace:
    """Work tables of one operator call, written as Parquet below the shared folder.

    A written table cuts lineage like checkpoint() does and survives the loss of any executor. drop() removes a table
    that later steps no longer read; the others go when the session ends.

    single_files: on a local folder, each task makes one file a table and nothing beside it, for on every file made there
    Hadoop starts a process (chmod), which holds the executor's memory a second time until it runs. The checksums of such
    tables are those in Parquet's pages, and reads verify them.
    """

    def __init__(self, spark: SparkSession, name: str, single_files: bool = False):
        self.spark = spark
        self.single_files = single_files
        self.root = f"{shared_dir(spark)}/ledgerline-{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = self._jpath(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _jpath(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def write(self, df: DataFrame, label: str, by: str | None = None, batch_rows: int | None = None) -> DataFrame:
        """The table as written; by: a column of few values, by which its files are apart and reads skip the others.

        batch_rows: at most so many rows at once go to Python; whole texts take memory there and in the executor.
        """
        path = f"{self.root}/{self._n}-{label}"
        self._n += 1
        out, read = df.write.option("compression", "zstd"), self.spark.read
        if self.single_files:
            out = out.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
            if self.spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl") is None:
                out = out.option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true")
            out = out.option("parquet.page.write-checksum.enabled", "true")
            read = read.option("parquet.page.verify-checksum.enabled", "true")
        confs = {}
        if by is not None:
            # one open file for each value instead of a sort before writing
            out = out.partitionBy(by)
            confs["spark.sql.maxConcurrentOutputFileWriters"] = "16"
        if batch_rows is not None:
            confs["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
        before = {k: self.spark.conf.get(k) for k in confs}
        for k, v in confs.items():
            self.spark.conf.set(k, v)
        try:
            out.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = read.schema(df.schema).parquet(path)
        out._ledgerline_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = getattr(df, "_ledgerline_path", None)
            if path:
                p = self._jpath(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop_part(self, df: DataFrame, by: str, value: int) -> None:
        """Removes the rows of one value of a table written by that column; later reads must leave that value out."""
        p = self._jpath(f"{df._ledgerline_path}/{by}={value}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps now; they go by garbage collection only."""
        gc.collect()
        self.spark._jvm.System.gc()


def by_bytes(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about limit characters each, so that numpy work stays within memory."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t is not None else 0
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def trimmed(run):
    """A mapInArrow function that gives its freed memory back at the end of a task; reused workers would keep it."""

    def whole(batches):
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole
