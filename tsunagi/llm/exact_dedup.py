"""Exact dedup by a content sort.

Rows are range-partitioned by sampled splitters over the leading characters and a hash of the text, sorted inside
each partition by the whole text, and rows that stand next to each other with the same whole text form a group.
The splitters hold some dozens of bytes, however long the texts are, so the driver's sample stays small.

A group of very many copies is spread over several ranges by a salt; the sums of its parts, one row each, are put
together afterwards. Which hashes need a salt follows from a grouped count. With `SPREAD` at most that many hashes
are hot, so they can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: A text is hot if it has more than 1/SPREAD of all rows; so there are at most SPREAD hot texts.
SPREAD = 20_000
#: Groups of at most so many rows are never split.
LEAST_HOT = 256
#: Characters of the text that lead the splitters.
HEAD = 24


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "max") -> DataFrame:
    """One row per row of `docs`: the id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after `normalise` (a function of a Column; None: unchanged). The row with the
    largest id stays (`keep="min"`: the smallest). A null text counts as empty, so nulls and empty texts are one
    group. Of repeated rows with the same id exactly one stays; a null id stays only if the group has no other.
    An empty table gives an empty result; extra columns are ignored, whatever their names.
    """
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    best, order = (F.max, lambda c: F.col(c).desc_nulls_last()) if keep == "max" else (F.min, lambda c: F.col(c).asc_nulls_last())
    rows = docs.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).alias("body"))
    rows = rows.select("id", "body", F.substring("body", 1, HEAD).alias("head"), F.xxhash64("body").alias("mark"))
    limit = max(LEAST_HOT, docs.count() // SPREAD)
    hot = rows.groupBy("mark").count().filter(F.col("count") > limit).select("mark", F.ceil(F.col("count") / limit).alias("parts"))
    rows = rows.join(F.broadcast(hot), "mark", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", F.lit(7)), "parts"), F.lit(-1)))

    group = Window.partitionBy("head", "mark", "salt", "body")
    sorted_rows = (
        rows.repartitionByRange("head", "mark", "salt")
        .withColumn("place", F.row_number().over(group.orderBy(order("id"))))
        .withColumn("n", F.count(F.lit(1)).over(group))
        .withColumn("best", best("id").over(group))
        .select("id", "mark", "salt", "place", "n", "best", F.sha2("body", 256).alias("digest"))
    )
    parts = sorted_rows.filter("salt >= 0 and place = 1").groupBy("mark", "digest").agg(F.sum("n").alias("all_n"), best("best").alias("all_best"), F.min("salt").alias("first_salt"))
    whole = sorted_rows.join(F.broadcast(parts), ["mark", "digest"], "left").select(
        "id", "place", "salt", "first_salt", "digest", F.coalesce("all_n", "n").alias("n"), F.coalesce("all_best", "best").alias("best")
    )
    lone = F.col("best").isNull() & (F.col("salt") == F.coalesce("first_salt", "salt"))  # one of a group without ids, in its first part
    return whole.select(
        F.col("id").alias(id_col),
        F.col("best").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("place") == 1) & (F.coalesce(F.col("id") == F.col("best"), F.lit(False)) | lone)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
