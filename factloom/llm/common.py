"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: \x20 and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only on a single machine, where the master is local, a folder under /tmp is used and set if there is no such
    setting; on a cluster that raises an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written in the shared folder, to cut lineage and to keep what is used more than once.

    They live on shared storage, so a lost executor takes none of them along. drop() deletes a table that nothing reads
    any more, close() all of them. What a lazy result still reads has to stay until it is written: the folder is deleted
    when the driver's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)

    def keep(self, df: DataFrame, codec: str = "snappy", text_rows: int | None = None, sieve: bool = False) -> DataFrame:
        """Writes a table and gives it back as read. With `text_rows`, batches for Python have so many rows at most."""
        return self.keep_all([df], codec, text_rows, sieve)

    def keep_all(self, parts: Iterable[DataFrame], codec: str = "snappy", text_rows: int | None = None, sieve: bool = False) -> DataFrame:
        """Writes tables of one schema, one after the other, and gives them back as one table; only one has shuffle files at a time."""
        self.made = getattr(self, "made", 0) + 1
        path = f"{self.root}/{self.made}"
        for df in parts:
            self.write(df, path, codec, text_rows, sieve)
            schema = df.schema
        kept = self.spark.read.schema(schema).parquet(path)
        self.paths[id(kept)] = path
        self._held = getattr(self, "_held", []) + [kept]
        return kept

    def write(self, df: DataFrame, path: str, codec: str = "snappy", text_rows: int | None = None, sieve: bool = False) -> None:
        """Writes a table, beside what is there; the shuffle files of this one execution go as soon as it has ended. With `sieve`, joins use Bloom filters (see `having`)."""
        conf, own = self.spark.conf, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
        if text_rows:
            own["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(text_rows)
        if sieve:
            own |= {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in (("enabled", "true"), ("applicationSideScanSizeThreshold", "0"), ("creationSideThreshold", str(MOST_BYTES)))}
        before = {k: conf.get(k, None) for k in own}
        for k, v in own.items():
            conf.set(k, v)
        try:
            df.write.mode("append").option("compression", codec).parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v) if v is not None else conf.unset(k)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.paths.pop(id(df))
            jvm = self.spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def held(self) -> list[DataFrame]:
        """The tables that haven't been dropped."""
        return [df for df in getattr(self, "_held", []) if id(df) in self.paths]

    def only(self, *tables: DataFrame) -> None:
        """Deletes all tables but these, which are all that results still read."""
        held = {id(df) for df in tables}
        jvm = self.spark.sparkContext._jvm
        for key in [k for k in self.paths if k not in held]:
            place = jvm.org.apache.hadoop.fs.Path(self.paths.pop(key))
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def close(self) -> None:
        """Deletes all tables, once nothing reads them any more."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.clear()

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of finished steps, which it does when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system, where the C library can do so."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: No table of more bytes than this, by Spark's estimate from the sizes of its files, is broadcast.
MOST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized_join(big: DataFrame, small: DataFrame, on, how: str, rows: int, bound: int) -> DataFrame:
    """A join that broadcasts the small side only when its counted rows and its estimated bytes are within their bounds; else Spark shuffles."""
    fits = rows <= bound and estimated_bytes(small) <= MOST_BYTES
    return big.join(F.broadcast(small) if fits else small, on, how)


def having(table: DataFrame, ids: DataFrame, on: str, rows: int, bound: int) -> DataFrame:
    """The rows of a table whose key, which isn't negative, is among ids (a kept table of so many rows).

    Where ids are too many to be broadcast, a result that is kept with `sieve` shuffles few other rows: Spark makes a Bloom
    filter of a side that has a condition, which the one on the key is for.
    """
    return sized_join(table, ids.filter(F.col(on) >= 0), on, "left_semi", rows, bound)
