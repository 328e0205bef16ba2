"""A run over many claims that can be stopped and started again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.results import batch_report

OUTCOME = ["claim_id", "status", "verdict", "seconds", "errors"]


def outcomes(records: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """claim_id, status, verdict, seconds, errors: a row for each record, of status `error` where verify gives none for it.

    verify: records -> claim_id, verdict, seconds, error; a claim that it fails on has an error or no row. A failed
    record is a row of its own, never the result of another one.
    """
    found = verify(records).select("claim_id", F.col("verdict").cast("string").alias("verdict"), F.col("seconds").cast("double").alias("seconds"), F.col("error").cast("string").alias("error")).dropDuplicates(["claim_id"])
    met = records.select("claim_id").join(found.withColumn("there", F.lit(True)), "claim_id", "left")
    error = F.when(F.col("there").isNull(), "no result").otherwise(F.col("error"))
    fine = error.isNull()
    return met.select("claim_id", F.when(fine, "ok").otherwise("error").alias("status"), F.when(fine, F.col("verdict")).alias("verdict"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.when(fine, F.array().cast("array<string>")).otherwise(F.array(error)).alias("errors"))


class Batch:
    """Takes streamed records into a table of outcomes, each claim once.

    Each micro-batch writes its outcomes in a folder of its own number and overwrites it when it is repeated, so a
    stream that fails and is started again gives the same table. Claims that earlier batches hold are left out, as are
    repeats within a batch.
    """

    def __init__(self, path: str, verify: Callable[[DataFrame], DataFrame]):
        self.path, self.verify = path.rstrip("/"), verify

    def table(self, spark, before: int | None = None) -> DataFrame | None:
        """The outcomes so far, of batches with smaller numbers than `before`; None without any."""
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(place) or not any(x.getPath().getName().startswith("batch=") for x in fs.listStatus(place)):
            return None
        rows = spark.read.schema("claim_id string, status string, verdict string, seconds double, errors array<string>, batch long").parquet(self.path)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def take(self, records: DataFrame, number: int) -> None:
        """One micro-batch."""
        rows = records.withColumn("claim_id", F.col("claim_id").cast("string")).dropDuplicates(["claim_id"])
        if (old := self.table(records.sparkSession, number)) is not None:
            rows = rows.join(old.select("claim_id"), "claim_id", "left_anti")
        outcomes(rows, self.verify).select(*OUTCOME).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def run(self, stream: DataFrame, checkpoint: str):
        """Starts over what is there of a stream, from where its checkpoint stands; ends when that is done."""
        query = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def report(self, spark) -> DataFrame | None:
        """The running report: counts of ended, failed and judged claims, and the time taken."""
        rows = self.table(spark)
        return None if rows is None else batch_report(rows)
