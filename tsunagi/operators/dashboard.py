"""Dashboard figures. Days are Tokyo days; the moment that counts as now is always a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsunagi.operators.matching import deciding_matches

# Days of the periods that can be chosen.
PERIODS = {"week": 7, "month": 30, "half_year": 182, "year": 365}
TOP_COMPANIES, OTHER, UNKNOWN = 8, "その他", "不明"
# End of fixed values.


def tokyo_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Tokyo"))


def period(end: str, days: int) -> tuple[Column, Column]:
    last = F.to_date(F.lit(end))
    return F.date_sub(last, days - 1), last


def in_period(df: DataFrame, ts: str, end: str, days: int) -> DataFrame:
    """Rows of the period. The bounds are moments, so that they can be pushed down to the scan."""
    first, last = period(end, days)
    return df.filter((F.col(ts) >= F.to_utc_timestamp(first.cast("timestamp"), "Asia/Tokyo")) & (F.col(ts) < F.to_utc_timestamp(F.date_add(last, 1).cast("timestamp"), "Asia/Tokyo")))


def with_proposed(emails: DataFrame, talents: DataFrame, projects: DataFrame) -> DataFrame:
    """Mails with `proposed`: whether the talent or project that came with them was ever offered."""
    t = talents.distinct().withColumn("t", F.lit(True))
    p = projects.distinct().withColumn("p", F.lit(True))
    flags = emails.join(t, "talent_id", "left").join(p, "project_id", "left")
    return flags.withColumn("proposed", F.when(F.col("email_type") == "talent", F.coalesce("t", F.lit(False))).when(F.col("email_type") == "project", F.coalesce("p", F.lit(False))).otherwise(False)).drop("t", "p")


def daily(emails: DataFrame, end: str, days: int) -> DataFrame:
    """A row for every day of the period, also those without mails."""
    first, last = period(end, days)
    calendar = emails.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    kind = lambda k: F.col("email_type") == k
    counts = in_period(emails, "created_at", end, days).groupBy(tokyo_day(F.col("created_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind("talent")).alias("talents"), F.count_if(kind("project")).alias("projects"), F.count_if(~kind("talent") & ~kind("project")).alias("others"),
        F.count_if(kind("talent") & F.col("proposed")).alias("talents_proposed"), F.count_if(kind("project") & F.col("proposed")).alias("projects_proposed"),
    )
    names = counts.columns[1:]
    return calendar.join(counts, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * part / whole, 1))


def totals(days: DataFrame) -> DataFrame:
    sums = days.agg(*[F.sum(c).alias(c) for c in days.columns if c != "day"])
    return sums.withColumn("talent_rate", percent(F.col("talents_proposed"), F.col("talents"))).withColumn("project_rate", percent(F.col("projects_proposed"), F.col("projects")))


def proposals_per_day(messages: DataFrame, end: str, days: int) -> DataFrame:
    found = in_period(messages.filter("status = 'sent'"), "sent_at", end, days)
    return found.groupBy(tokyo_day(F.col("sent_at")).alias("day")).agg(F.count_if(F.col("kind") == "talent_proposal").alias("talent_proposals"), F.count_if(F.col("kind") == "project_proposal").alias("project_proposals"))


def with_entity_company(emails: DataFrame, talents: DataFrame, projects: DataFrame) -> DataFrame:
    """Mails with the company of the talent or project that came with them."""
    t = talents.select("talent_id", F.col("introducer_company_id").alias("t"))
    p = projects.select("project_id", F.col("distributor_company_id").alias("p"))
    company = F.when(F.col("email_type") == "talent", F.col("t")).when(F.col("email_type") == "project", F.col("p"))
    return emails.join(t, "talent_id", "left").join(p, "project_id", "left").withColumn("company_id", company).drop("t", "p")


def companies_ranking(emails: DataFrame, companies: DataFrame, top: int = TOP_COMPANIES) -> DataFrame:
    """Mails (with_entity_company) by company, the largest by name and the rest as one; an id without a company is a row
    of its own, and so are mails without one. The largest are found by a limit, the rest is what they leave of the sums."""
    counts = emails.filter(F.col("email_type").isin("talent", "project")).groupBy("company_id").agg(
        F.count_if(F.col("email_type") == "talent").alias("talents"), F.count_if(F.col("email_type") == "project").alias("projects"), F.count(F.lit(1)).alias("total")
    )
    best = counts.orderBy(F.col("total").desc(), F.col("company_id").asc_nulls_last()).limit(top)
    place = F.row_number().over(Window.orderBy(F.col("total").desc(), F.col("company_id").asc_nulls_last()))
    named = best.withColumn("place", place).join(companies.select("company_id", "name"), "company_id", "left")
    largest = named.select("place", F.coalesce("name", F.lit(UNKNOWN)).alias("company"), "talents", "projects", "total")
    sums = ("talents", "projects", "total")
    rest = counts.agg(*[F.sum(c).alias(c) for c in sums]).crossJoin(best.agg(*[F.sum(c).alias(f"best_{c}") for c in sums]))  # one row each
    rest = rest.select(F.lit(top + 1).alias("place"), F.lit(OTHER).alias("company"), *[(F.col(c) - F.col(f"best_{c}")).alias(c) for c in sums]).filter("total > 0")
    return largest.unionByName(rest)


def funnel(entities: DataFrame, matches: DataFrame, proposed: DataFrame, replied: DataFrame) -> DataFrame:
    """How many of the period's entities (kind, id) got to each stage; each stage is among those of the one before.
    `matches` are of one run, with kind, id and score; `replied` has kind, id and ok."""
    able = matches.filter("score > 0").select("kind", "id").distinct().withColumn("able", F.lit(True))
    flags = entities.distinct().join(able, ["kind", "id"], "left").join(proposed.distinct().withColumn("sent", F.lit(True)), ["kind", "id"], "left").join(replied.withColumn("answered", F.lit(True)), ["kind", "id"], "left")
    sent, answered = F.col("able") & F.col("sent"), F.col("able") & F.col("sent") & F.col("answered")
    return flags.agg(F.count(F.lit(1)).alias("ingested"), F.count_if("able").alias("proposable"), F.count_if(sent).alias("proposed"), F.count_if(answered).alias("replied"), F.count_if(answered & F.col("ok")).alias("ok"))


def constraint_loss(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """The period's entities (kind, id) without a match of any points, by the strongest reason; those without a match
    or a reason are the last group."""
    rank = F.when(F.col("hard_reject") == "foreign_nationality", 0).when(F.col("hard_reject") == "commerce_flow", 1).otherwise(9)
    judged = matches.groupBy("kind", "id").agg(F.max("score").alias("best"), F.min(rank).alias("reason"))
    lost = entities.distinct().join(judged, ["kind", "id"], "left").filter("best is null or best <= 0")
    names = F.when(F.col("reason") == 0, "foreign_nationality").when(F.col("reason") == 1, "commerce_flow").otherwise("other_zero")
    return lost.groupBy("kind", names.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def funnel_sets(entities: DataFrame, matches: DataFrame, proposed: DataFrame) -> DataFrame:
    """The funnel by set algebra: kind, id and stage of every entity, the furthest of its sets."""
    positive = matches.filter("score > 0").select("kind", "id").distinct()  # before it is moved
    able = entities.select("kind", "id").intersect(positive)
    sent = able.intersect(proposed.select("kind", "id"))
    named = lambda df, stage: df.withColumn("stage", F.lit(stage))
    return named(sent, "proposed").unionByName(named(able.exceptAll(sent), "proposable")).unionByName(named(entities.select("kind", "id").distinct().exceptAll(able), "ingested"))


def deciding(entities: DataFrame, matches: DataFrame | Callable, talents: DataFrame, projects: DataFrame) -> DataFrame:
    """entity_matches of `entities` (kind, id) alone, as many as tell which of them have a match of any points, and all of
    those that have none. `matches` is as for deciding_matches; `talents` and `projects` have the ids of either side."""
    found = None
    for kind, key, others in (("talent", "talent_id", projects.select("project_id")), ("project", "project_id", talents.select("talent_id"))):
        ids = entities.filter(F.col("kind") == kind).select(F.col("id").alias(key))
        rows = deciding_matches(ids, matches, key, others, F.col("score") > 0)
        part = rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "score", "hard_reject")
        found = part if found is None else found.unionByName(part)
    return found


def entity_matches(matches: DataFrame) -> DataFrame:
    """Matches seen from either side: kind, id, score, hard_reject."""
    sides = F.array(F.struct(F.lit("talent").alias("kind"), F.col("talent_id").alias("id")), F.struct(F.lit("project").alias("kind"), F.col("project_id").alias("id")))
    return matches.select(F.explode(sides).alias("side"), "score", "hard_reject").select("side.*", "score", "hard_reject")


def monthly(events: DataFrame, ts: str, limit: int) -> DataFrame:
    """Requests by UTC month, and whether they are over the limit."""
    return events.groupBy(F.date_format(ts, "yyyy-MM").alias("year_month")).agg(F.count(F.lit(1)).alias("request_count")).withColumn("over_limit", F.col("request_count") >= limit)
