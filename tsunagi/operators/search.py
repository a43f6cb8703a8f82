"""Searches and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsunagi.sources.binding import split_list


#: Where a project's words are looked for.
PROJECT_TEXTS = ("title", "project_code", "location", "work_style", "working_hours", "settlement_range", "summary", "company_name", "required_skills")


def has_words(keyword: str, *columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns)).contains(keyword.strip().lower())


def filter_rate(value: Column) -> Column:
    """A rate in units of ten thousand yen for comparison, rounded half up."""
    return F.when(value >= 10000, F.floor(value / 10000 + 0.5)).otherwise(value)


def has_skills(skills: Column, selected: list[str]) -> Column:
    """Every selected skill is part of some skill, as it is written."""

    def some(one: str) -> Column:
        return F.exists(skills, lambda s: s.contains(one))

    return reduce(Column.__and__, map(some, selected), F.lit(True))


def search_talents(talents: DataFrame, keyword: str = "", skills: list[str] = (), low: int | None = None, high: int | None = None, proposed: str = "", ok: str = "", sheet: bool | None = None) -> DataFrame:
    """A talent without a rate passes any range. `proposed` and `ok` ("yes" or "no") ask for the columns n_proposed and
    n_ok of an enriched list, `sheet` for has_sheet."""
    rate = filter_rate(F.col("desired_rate"))
    found = has_words(keyword, "display_name", "affiliation", "source_company_name", "summary", "skills") & has_skills(split_list("skills"), list(skills))
    if low is not None:
        found = found & (rate.isNull() | (rate >= low))
    if high is not None:
        found = found & (rate.isNull() | (rate <= high))
    return talents.filter(found & _counted(proposed, ok)).filter(F.lit(True) if sheet is None else F.col("has_sheet") == sheet)


def _counted(proposed: str, ok: str) -> Column:
    found = F.lit(True)
    for choice, column in ((proposed, "n_proposed"), (ok, "n_ok")):
        if choice:
            found = found & ((F.col(column) > 0) == (choice == "yes"))
    return found


def search_projects(projects: DataFrame, keyword: str = "", skills: list[str] = (), low: int | None = None, high: int | None = None, nationality: str | None = None, proposed: str = "", ok: str = "") -> DataFrame:
    """Rate ranges overlap; nationality is "ok", "ng" or "unknown". Words are looked for in all that a project says and in
    its distributor's name (company_name, of an enriched list), skills in those that are required."""
    low_rate = filter_rate(F.col("rate_min"))
    top = F.coalesce(filter_rate(F.col("rate_max")), low_rate)
    found = has_words(keyword, *PROJECT_TEXTS) & has_skills(split_list("required_skills"), list(skills))
    if low is not None:
        found = found & (top.isNull() | (top >= low))
    if high is not None:
        found = found & (low_rate.isNull() | (low_rate <= high))
    if nationality:
        refused = F.col("foreign_nationality_ng")
        found = found & {"ng": F.coalesce(refused, F.lit(False)), "ok": F.coalesce(~refused, F.lit(False)), "unknown": refused.isNull()}[nationality]
    return projects.filter(found & _counted(proposed, ok))


def search_companies(companies: DataFrame, contacts: DataFrame, query: str, limit: int = 300) -> DataFrame:
    found = F.lit(False)
    for column in ("name", "domain", "default_email"):
        found = found | F.coalesce(F.col(column).ilike(f"%{query}%"), F.lit(False))
    counts = contacts.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_contacts"))
    return companies.filter(found).join(counts, "company_id", "left").withColumn("n_contacts", F.coalesce("n_contacts", F.lit(0))).orderBy("name", "company_id").limit(limit)


def search_contacts(contacts: DataFrame, companies: DataFrame, query: str, company_id: int | None = None, limit: int = 500) -> DataFrame:
    """Contacts of all companies or of one."""
    contacts = contacts if company_id is None else contacts.filter(F.col("company_id") == company_id)
    named = contacts.join(companies.select("company_id", F.col("name").alias("company_name")), "company_id")
    found = F.col("name").ilike(f"%{query}%") | F.col("email").ilike(f"%{query}%") | F.col("company_name").ilike(f"%{query}%")
    return named.filter(found).orderBy("name", "contact_id").limit(limit)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a list; a number beyond the last page gives the last one."""
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)


def latest_sheet(sheets: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("talent_id").orderBy(F.col("created_at").desc(), F.col("sheet_id").desc()))
    return sheets.filter("access_status = 'ok'").withColumn("place", place).filter("place = 1").drop("place")


def with_sheet_flag(talents: DataFrame, sheets: DataFrame) -> DataFrame:
    there = sheets.filter("access_status = 'ok'").select("talent_id").distinct().withColumn("has_sheet", F.lit(True))
    return talents.join(there, "talent_id", "left").withColumn("has_sheet", F.coalesce("has_sheet", F.lit(False)))


def newest_mails(emails: DataFrame, talents: DataFrame, projects: DataFrame, limit: int = 200) -> DataFrame:
    """The newest mails, and which talent or project came with them; the limit comes before the joins."""
    best = emails.select("email_id", "email_type", "created_at").orderBy(F.col("created_at").desc(), "email_id").limit(limit)
    return best.join(talents.select("email_id", "talent_id"), "email_id", "left").join(projects.select("email_id", "project_id"), "email_id", "left")


def attachment_plan(sheets: DataFrame, budget: int = 20 * 1024 * 1024) -> DataFrame:
    """Whether a talent's files go along as files, or as links as they are too large together; and what tells files of
    one name apart."""
    size = F.sum("size_bytes").over(Window.partitionBy("talent_id"))
    number = F.row_number().over(Window.partitionBy("talent_id", "filename").orderBy("sheet_id"))
    ok = sheets.filter("access_status = 'ok'").withColumn("as_file", size <= budget).withColumn("number", number)
    return ok.withColumn("suffix", F.when(F.col("number") == 1, "").otherwise(F.concat(F.lit("_"), F.col("number").cast("string")))).drop("number")
