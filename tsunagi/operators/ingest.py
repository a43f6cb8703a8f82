"""Mails as they come in: which are new, what becomes of them, and how companies and entities are recognised again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsunagi.functions import text as T


def new_mails(incoming: DataFrame, emails: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Incoming mails that are not known yet; failed ones count as unknown when they are to be retried."""
    known = emails.filter("status <> 'failed'") if retry_failed else emails
    return incoming.join(known.select("email_id"), "email_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at", "status")) -> DataFrame:
    """`old` with the rows of `new` put in by key: the last of several new rows wins, and it sets also to NULL what it
    has as NULL; only `keep` stays as it was. `new` has the columns of `old` and an order column `seq`."""
    rest = [c for c in old.columns if c != key]
    last = new.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("n"))
    both = old.select(key, F.struct(*rest).alias("o")).join(last, key, "full_outer")
    pick = lambda c: F.when(F.col("n").isNull() | (F.col("o").isNotNull() & F.lit(c in keep)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(key, *[pick(c) for c in rest])


def next_status(has_data: Column, needs_review: Column) -> Column:
    return F.when(~has_data, "failed").when(needs_review, "needs_review").otherwise("summarized")


def business_matches(incoming: DataFrame, existing: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Incoming rows with the id of the newest existing row of the same business key; a blank first part matches
    nothing. Keys are made once a side, and one existing row a key is left before the join."""
    keyed = lambda df: df.select("*", *[T.business_key(F.col(k)).alias(f"key_{i}") for i, k in enumerate(keys)]).filter("key_0 <> ''")
    names = [f"key_{i}" for i in range(len(keys))]
    newest = keyed(existing).groupBy(*names).agg(F.max_by(id_col, F.struct("updated_at", id_col)).alias(f"existing_{id_col}"))
    return keyed(incoming).join(newest, names)


def resolve_companies(mails: DataFrame, companies: DataFrame) -> DataFrame:
    """mail_id and company_id of mails (mail_id, domain, name): by domain, or else by name, or else a new company, whose
    key is its domain or name. The same for all mails of a batch, whatever their order."""
    by_domain = companies.filter("domain <> ''").groupBy("domain").agg(F.min("company_id").alias("by_domain"))
    by_name = companies.groupBy(T.business_key(F.col("name")).alias("name_key")).agg(F.min("company_id").alias("by_name")).filter("name_key <> ''")
    found = mails.withColumn("name_key", T.business_key(F.col("name"))).join(by_domain, "domain", "left").join(by_name, "name_key", "left")
    new_key = F.coalesce("domain", F.nullif("name_key", F.lit("")))
    return found.select("mail_id", F.coalesce("by_domain", "by_name").alias("company_id"), F.when(F.coalesce("by_domain", "by_name").isNull(), new_key).alias("new_company"))


UNCATEGORIZED = "未分類"


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    """Rows with `key`, the spelling of `name` without case, width and separators; each different name is spelled once."""
    keys = rows.select(name).distinct().select(name, T.skill_key(F.col(name)).alias("key")).filter("key <> ''")
    return rows.join(keys, name)


def conform_skills(items: DataFrame, skills: DataFrame) -> DataFrame:
    """Skills of mails (owner, at, raw) in the master's spelling. Unknown ones join the master in the spelling that
    comes first, by owner and place; each owner's list keeps its order and loses repeats."""
    keyed = _keyed(items, "raw")
    master = _keyed(skills, "name").groupBy("key").agg(F.min("name").alias("official"))
    first = keyed.groupBy("key").agg(F.min_by("raw", F.struct("owner", "at")).alias("spelling"))
    named = keyed.join(first.join(master, "key", "left").select("key", F.coalesce("official", T.strip(F.col("spelling"))).alias("skill")), "key")
    lists = named.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("at", "skill"))).alias("x"))
    return lists.select("owner", F.array_join(F.array_distinct(F.col("x.skill")), ",").alias("skills"))


def new_skills(items: DataFrame, skills: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows that join the master: skill_id, name, name_key and category_id (that of the category for what has none, NULL
    if there is no such category) of the skills of mails that the master does not know, in the spelling that comes first."""
    unknown = _keyed(items, "raw").join(_keyed(skills, "name").select("key"), "key", "left_anti")
    first = unknown.groupBy("key").agg(F.min_by("raw", F.struct("owner", "at")).alias("name"))
    home = categories.filter(F.col("name") == UNCATEGORIZED).agg(F.min("category_id").alias("category_id"))  # one row
    return first.crossJoin(F.broadcast(home)).select(F.xxhash64("key").alias("skill_id"), T.strip(F.col("name")).alias("name"), F.col("key").alias("name_key"), "category_id")


def moved_to_uncategorized(skills: DataFrame, categories: DataFrame, category_id: int) -> DataFrame:
    """The master after the skills of a category have gone to the category for what has none; nothing changes if it is
    that one."""
    home = categories.filter(F.col("name") == UNCATEGORIZED).agg(F.min("category_id").alias("home"))  # one row
    return skills.crossJoin(F.broadcast(home)).withColumn("category_id", F.when(F.col("category_id") == category_id, F.col("home")).otherwise(F.col("category_id"))).drop("home")


def pending(listed: DataFrame, emails: DataFrame, cap: int = 1000) -> DataFrame:
    """Listed mails that are not ingested, by label, and whether the listing was cut off."""
    left = new_mails(listed, emails).groupBy("label").agg(F.count(F.lit(1)).alias("n_pending"))
    return listed.groupBy("label").agg(F.count(F.lit(1)).alias("n_listed")).join(left, "label", "left").select("label", "n_listed", F.coalesce("n_pending", F.lit(0)).alias("n_pending"), (F.col("n_listed") >= cap).alias("capped"))
