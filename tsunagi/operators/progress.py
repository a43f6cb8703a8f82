"""Job logs: how far each job is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_log(events: DataFrame) -> DataFrame:
    """Log rows from the generic events: a job for each user and day, a step for each event type."""
    job = F.concat(F.lit("job-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    k = F.from_json("props", "k int")["k"]
    return events.select("event_id", "ts", job.alias("job_id"), F.col("event_type").alias("step"), k.alias("done"), (k + F.col("event_id") % 50).cast("int").alias("total"), F.when(k % 10 == 0, "finished").when(k % 10 == 1, "failed").otherwise("running").alias("status"))


def steps(log: DataFrame) -> DataFrame:
    """The state of each step of each job; max_by and max are partial, so a long log shrinks before the shuffle."""
    return log.groupBy("job_id", "step").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max("done").alias("done"), F.max("total").alias("total"), F.count_if(F.col("status") == "failed").alias("n_failed"),
    )


def percent(done: Column, total: Column, status: Column) -> Column:
    return F.when(status == "finished", 100.0).when(F.coalesce(total, F.lit(0)) <= 0, 0.0).otherwise(F.bround(F.least(F.lit(100.0), F.lit(100.0) * done / total), 1))


def overall(log: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Percent of each job: its steps' percents by their weights, over the steps that it has."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("step")]
    of = steps(log).withColumn("percent", percent(F.col("done"), F.col("total"), F.col("status"))).withColumn("weight", weight)
    return of.groupBy("job_id").agg(F.bround(F.sum(F.col("percent") * F.col("weight")) / F.sum("weight"), 4).alias("percent"), F.count(F.lit(1)).alias("n_steps"), F.max("updated_at").alias("updated_at"))


def latest_unfinished(log: DataFrame) -> DataFrame:
    """The job that began last of those without an end after their beginning."""
    jobs = log.groupBy("job_id").agg(F.min("ts").alias("started_at"), F.max(F.when(F.col("status") == "finished", F.col("ts"))).alias("finished_at"))
    return jobs.filter("finished_at is null or finished_at < started_at").orderBy(F.col("started_at").desc(), "job_id").limit(1).select("job_id", "started_at")


def last_errors(log: DataFrame, after: str) -> DataFrame:
    """The last failed row of each job after a moment."""
    found = log.filter((F.col("status") == "failed") & (F.col("ts") > F.lit(after).cast("timestamp")))
    return found.groupBy("job_id").agg(F.max_by(F.struct("event_id", "step"), F.struct("ts", "event_id")).alias("x")).select("job_id", "x.event_id", "x.step")


def running_share(log: DataFrame) -> DataFrame:
    """Each step's share of the rows of its job."""
    counts = log.groupBy("job_id", "step").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("job_id")), 6))
