"""Incremental jobs as streams. Each can be run over what is there with trigger(availableNow=True) and then gives what
its batch twin gives; state is keyed, so it is spread over the executors and survives them in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tsunagi.sources.staging import new_folder


def read(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file; the schema is that of what is there now."""
    there = spark.read.parquet(path)
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rpartition("/")
    if there.inputFiles()[:1] and there.inputFiles()[0].endswith(f"/{name}"):
        return stream.option("pathGlobFilter", name).parquet(folder)  # a stream needs a folder
    return stream.parquet(path)


def usage_by_month(requests: DataFrame, ts: str) -> DataFrame:
    return requests.groupBy(F.date_format(ts, "yyyy-MM").alias("year_month")).agg(F.count(F.lit(1)).alias("request_count"))


def step_progress(log: DataFrame) -> DataFrame:
    return log.groupBy("job_id", "step").agg(F.max("done").alias("done"), F.max("total").alias("total"), F.max("ts").alias("updated_at"))


def daily_counts(rows: DataFrame, ts: str, late: str | None = None) -> DataFrame:
    """Rows by Tokyo day, which begins at 15:00 UTC. With `late` a day is closed when nothing that is less late can come
    any more, and later rows are dropped; without it all rows count, in whatever order they come."""
    day = F.window(ts, "1 day", "1 day", "15 hours")
    rows = rows.withWatermark(ts, late) if late else rows
    return rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("total")).select(F.to_date(F.from_utc_timestamp(F.col("day.start"), "Asia/Tokyo")).alias("day"), "total")


def drain(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs `stream` over all that is there and returns the last state of its result. The folder takes the checkpoint
    and the results, so a run that broke off goes on where it was."""
    out = f"{folder}/result"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    query: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return stream.sparkSession.read.option("basePath", out).parquet(f"{out}/*").drop("n")


def newest_of_each(states: DataFrame, keys: list[str]) -> DataFrame:
    """The last state that an update-mode stream gave of each key."""
    rest = [c for c in states.columns if c not in (*keys, "batch")]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return new_folder(spark)
