"""Queries on what comes from outside: answers of a model in batches, tables of several generations, kept cores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsunagi.functions.core_body import core_body, refreshed_cores
from tsunagi.operators import answers as A
from tsunagi.plans.entities import _spec
from tsunagi.sources import contracts as C
from tsunagi.sources.binding import Domain, split_list
from tsunagi.sources.staging import new_folder, staged


def f45_batch_results(d: Domain):
    """Batches of ten requests; items name the request, or its place, or something unknown, come twice, or not at all."""
    key = F.col("talent_id")
    rows = d.talents.select(F.floor(key / 10).alias("batch_id"), (key % 10 + 1).cast("int").alias("place"), F.concat(F.lit("m"), key.cast("string")).alias("mail_id"), (key % 6).alias("kind"))
    item = lambda member, value, name: F.to_json(F.struct(value.alias(member), F.lit(name).alias("name"), F.col("place").alias("score")))
    mail = F.col("mail_id")
    said = (
        F.when(F.col("kind") == 1, item("mail_id", mail, "A")).when(F.col("kind") == 2, item("id", F.concat(F.lit(" "), mail), "B")).when(F.col("kind") == 3, item("mail_id", F.col("place"), "C"))
        .when(F.col("kind") == 4, item("id", F.concat(F.lit("x"), mail), "D")).when(F.col("kind") == 5, F.concat(item("id", mail, "old"), F.lit(", 7, "), item("mail_id", mail, "new")))
    )
    listed = rows.withColumn("said", said).groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), ",\n").alias("items"))
    shapes = F.when(F.col("batch_id") % 4 == 0, F.concat(F.lit("["), "items", F.lit("]"))).when(F.col("batch_id") % 4 == 1, F.concat(F.lit('```json\n{"items": ['), "items", F.lit("]}\n```"))).when(F.col("batch_id") % 4 == 2, F.concat(F.lit("Here it is: ["), "items", F.lit("] as asked."))).otherwise("no answer")
    return A.batch_results(rows.drop("kind"), listed.select("batch_id", shapes.alias("answer")), {"name": "string", "score": "int"}).select("mail_id", "answered", "name", "score")


def s01_generations(d: Domain):
    """Talents of two generations of files: the older lacks what was added later and has a narrower key."""
    folder = new_folder(d.spark)
    rows = d.talents.withColumn("skills", split_list("skills"))
    rows.filter("talent_id % 3 = 0").drop(*C.ADDED["talents"]).withColumn("talent_id", F.col("talent_id").cast("int")).write.parquet(f"{folder}/old")
    rows.filter("talent_id % 3 > 0").write.parquet(f"{folder}/new")
    return C.load(d.spark, "talents", f"{folder}/old", f"{folder}/new").select("talent_id", "display_name", F.array_join("skills", ",").alias("skills"), "is_foreign_national", "commerce_flow", "summary")


def f48_refreshed(d: Domain):
    """Cores that are kept are taken over, stale ones are made once; a second run makes none."""
    cache = F.concat(F.when(F.col("project_id") % 3 == 0, "[[core:v2]]\n").otherwise("[[core:v3]]\n"), F.when(F.col("project_id") % 4 == 0, "short").otherwise(F.col("spec")))
    mails = _spec(d).select("project_id", F.when(F.col("project_id") % 5 > 0, cache).alias("cache"), F.concat(F.lit("いつもお世話になっております。\n"), "spec", F.lit("\n以上\n")).alias("mail"))
    make = lambda rows: rows.withColumn("core", core_body(F.col("mail"), F.array().cast("array<string>")))
    first = staged(refreshed_cores(mails, "v3", make))
    again = refreshed_cores(first.select("project_id", "cache", "mail"), "v3", make)
    return first.select("project_id", "core", F.col("made").alias("made_first")).join(again.select("project_id", F.col("made").alias("made_again"), F.substring("cache", 1, 12).alias("cache")), "project_id")


QUERIES = {
    f45_batch_results: """WITH r AS (SELECT talent_id, CAST(talent_id % 10 + 1 AS INT) AS place, talent_id % 6 AS k, CAST(floor(talent_id / 10) AS BIGINT) % 4 = 3 AS silent FROM talents)
        SELECT 'm' || talent_id AS mail_id, NOT silent AND k NOT IN (0, 4) AS answered, CASE WHEN NOT silent THEN CASE k WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 5 THEN 'new' END END AS name, CASE WHEN NOT silent AND k NOT IN (0, 4) THEN place END AS score FROM r""",
    s01_generations: "SELECT talent_id, display_name, skills, CASE WHEN talent_id % 3 > 0 THEN is_foreign_national END AS is_foreign_national, CASE WHEN talent_id % 3 > 0 THEN commerce_flow END AS commerce_flow, CASE WHEN talent_id % 3 > 0 THEN summary END AS summary FROM talents",
    f48_refreshed: """SELECT project_id, 'ーーー案件情報ーーー' || chr(10) || '----------' || chr(10) || '【案件名】：' || title || chr(10) || '■内容' || chr(10) || '・夜間処理の調査と改修、関係者との調整を含む長い仕事 ' || (project_id % 13) || chr(10) || '【場所】品川' AS core,
        NOT (project_id % 3 <> 0 AND project_id % 4 <> 0 AND project_id % 5 > 0) AS made_first, false AS made_again, '[[core:v3]]' || chr(10) AS cache FROM projects""",
}
