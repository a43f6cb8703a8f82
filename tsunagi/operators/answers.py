"""Answers of a model to batches of requests, matched to the requests that they are for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsunagi.functions import text as T

# Fences around an answer, where an answer stands in other text, members that hold a list and an id.
FENCE_START, FENCE_END, ANSWER_IN_TEXT = r"^```(?:json)?\s*", r"\s*```$", r"(?s)[\[{].*[\]}]"
ITEMS, IDS = "$.items", ("$.mail_id", "$.id")
# End of fixed values.


def parsed(answer: Column) -> Column:
    """The JSON of an answer as a variant: in a fence, plain, or from the first bracket to the last; NULL if there is none."""
    bare = F.regexp_replace(F.regexp_replace(T.strip(F.coalesce(answer, F.lit(""))), FENCE_START, ""), FENCE_END, "")
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, f"({ANSWER_IN_TEXT})", 1)))


def _is(kind: str, variant: Column) -> Column:
    return F.schema_of_variant(variant).startswith(kind)


def answer_items(answers: DataFrame) -> DataFrame:
    """batch_id, at and item (a variant): the objects that each answer (batch_id, answer) lists, plain or as `items`."""
    v = answers.select("batch_id", parsed(F.col("answer")).alias("v"))
    listed = F.when(_is("ARRAY", F.col("v")), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", ITEMS, "array<variant>"))
    return v.select("batch_id", F.posexplode(listed).alias("at", "item")).filter(_is("OBJECT", F.col("item")))


def batch_results(requests: DataFrame, answers: DataFrame, fields: dict[str, str]) -> DataFrame:
    """batch_id, place, mail_id, answered and the `fields` (name to type) of every request (batch_id, place from 1,
    mail_id). An item is for the request whose id it names; if it names none of its batch, but a number, for the request
    at that place. Of several items for one request the last counts. Items that name nothing known are dropped, and
    requests without an item are left to a fallback: not answered, with no fields."""
    named = F.coalesce(*[F.try_variant_get("item", path, "string") for path in IDS])
    items = answer_items(answers).withColumn("named", T.strip(named)).filter("named is not null")
    known = requests.select("batch_id", F.col("mail_id").alias("named"), F.col("place").alias("by_id"))
    placed = requests.select("batch_id", F.col("place").alias("number"), F.col("place").alias("by_place"))
    number = F.when(F.col("named").rlike(r"^[+-]?[0-9]+$"), F.col("named").try_cast("int"))
    found = items.join(known, ["batch_id", "named"], "left").withColumn("number", F.when(F.col("by_id").isNull(), number)).join(placed, ["batch_id", "number"], "left")
    found = found.withColumn("place", F.coalesce("by_id", "by_place")).filter("place is not null")
    last = found.withColumn("turn", F.row_number().over(Window.partitionBy("batch_id", "place").orderBy(F.col("at").desc()))).filter("turn = 1")
    values = last.select("batch_id", "place", F.lit(True).alias("answered"), *[F.try_variant_get("item", f"$.{c}", kind).alias(c) for c, kind in fields.items()])
    return requests.join(values, ["batch_id", "place"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
