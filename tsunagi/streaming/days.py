"""Daily counts of rows that come late: a day is given once, when nothing can come for it any more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsunagi.streaming.polls import daily_counts


def close_days(rows: DataFrame, ts: str, late: str, folder: str) -> DataFrame:
    """Runs a stream over what is there and returns the days (day, total) that are closed: those that end `late` before
    the newest row seen. Rows for a day that was closed before they came are dropped. What a day's state needs is one
    count, and closed days leave it. A batch that is run again overwrites what it had written."""
    out = f"{folder}/days"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/n={number}")

    stream = daily_counts(rows, ts, late).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    stream.trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return rows.sparkSession.read.option("basePath", out).parquet(f"{out}/*").drop("n")


def with_late(days: DataFrame, rows: DataFrame, ts: str) -> DataFrame:
    """Closed days with n_late: how many of all `rows` (what the stream was fed with) came too late for them."""
    day = F.to_date(F.from_utc_timestamp(F.col(ts), "Asia/Tokyo"))
    came = rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("came"))
    return days.join(came, "day").select("day", "total", (F.col("came") - F.col("total")).alias("n_late"))
