"""The ingest of mails as a stream: each micro-batch extracts talents and projects and puts mails and entities into their
tables. Repeats of a mail within a time are dropped by state that a watermark bounds; older ones are told by the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsunagi.functions import text as T
from tsunagi.operators import extraction as E
from tsunagi.operators.ingest import next_status
from tsunagi.sources.keyed import KeyedTable, Numbers
from tsunagi.sources.staging import staged

#: What a mail has when it comes in; `arrived_at` is when its file did.
MAIL = "gmail_message_id string, kind string, received_at timestamp, subject string, body string, from_header string"
#: By kind: how entities are extracted, and what tells that two mails mean the same one.
KINDS = {"talent": (E.extract_talents, ("display_name", "source_company_name", "nearest_station")), "project": (E.extract_projects, ("title", "source_company_name"))}
#: The fields of an entity.
FIELDS = {
    "talent": "display_name string, affiliation string, age int, gender string, experience_years int, desired_rate int, available_from string, work_style string, nearest_station string, is_foreign_national boolean, commerce_flow string, skills array<string>, source_company_name string, contact_name string, summary string",
    "project": "title string, required_skills array<string>, preferred_skills array<string>, rate_min int, rate_max int, location string, work_style string, working_hours string, start_date string, settlement_range string, interview_count int, headcount int, foreign_nationality_ng boolean, commerce_flow_limit string, source_company_name string, contact_name string, summary string",
}
#: Batches after which the tables are put together anew.
COMPACT_EVERY = 20
_MAILS = "gmail_message_id string, kind string, received_at timestamp, subject string, body string, from_header string, status string, created_at timestamp, updated_at timestamp"


def read_mails(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of mails from a folder of Parquet files, with the time at which each file came."""
    rows = spark.readStream.schema(MAIL).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("arrived_at"))


def without_repeats(mails: DataFrame, within: str) -> DataFrame:
    """Each mail once for as long as `within`. Time is that of arrival, by which files are read, so none is late; a mail
    whose content has changed since is another one, as one that could not be read may come again."""
    content = F.xxhash64("kind", "subject", "body", "from_header")
    return mails.withColumn("content", content).withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(["gmail_message_id", "content"])


def _blank() -> Column:
    filled = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) != ""
    return ~(filled("subject") | filled("body"))


def _extracted(fresh: DataFrame, kind: str) -> DataFrame:
    """What the readable mails of one kind say, one row a mail (mail_id)."""
    mails = fresh.filter((F.col("kind") == kind) & ~_blank())
    return KINDS[kind][0](mails.select(F.col("gmail_message_id").alias("mail_id"), "subject", "body", "from_header"))


def _entities(found: DataFrame, fresh: DataFrame, kind: str, known: DataFrame) -> DataFrame:
    """What the mails of a batch change among the entities of one kind. Of mails that mean the same entity the newest
    sets all fields, also to nothing; the entity keeps its id and the time at which it was first seen. A mail that is
    older than what the entity was last set by changes nothing, so the order in which mails come does not matter."""
    names = KINDS[kind][1]
    keys = [f"key_{i}" for i in range(len(names))]
    rows = found.join(fresh.select(F.col("gmail_message_id").alias("mail_id"), "received_at", "arrived_at"), "mail_id")
    rows = rows.withColumns({k: T.business_key(F.col(n)) for k, n in zip(keys, names, strict=True)})
    rows = rows.withColumn("key_0", F.when(F.col("key_0") == "", F.concat(F.lit("mail "), "mail_id")).otherwise(F.col("key_0")))  # a blank name matches nothing
    rows = rows.withColumn("status", E.entity_status(F.col("needs_review"), kind)).withColumn("updated_at", F.col("arrived_at"))
    fields = [c for c in found.columns if c not in ("mail_id", "needs_review")]
    last = F.max_by(F.struct(*fields, "status", "mail_id", "received_at", "updated_at"), F.struct("received_at", "mail_id"))
    newest = rows.groupBy(*keys).agg(last.alias("x"), F.min("arrived_at").alias("seen"))
    old = known.select(*keys, F.col("entity_id").alias("old_id"), F.col("created_at").alias("old_created"), F.struct("received_at", "mail_id").alias("set_by"))
    both = newest.join(old, keys, "left").filter("set_by is null or struct(x.received_at, x.mail_id) >= set_by")
    return both.select(*keys, F.coalesce("old_id", F.xxhash64(F.lit(kind), *keys)).alias("entity_id"), F.least("old_created", "seen").alias("created_at"), "x.*")


def changes(mails: DataFrame, emails: DataFrame, talents: DataFrame, projects: DataFrame) -> dict[str, DataFrame]:
    """What `mails` (MAIL and arrived_at) change, by table, given the tables before. Mails that are known are left out,
    but for failed ones. Of several versions of a mail one that can be read goes first, then the newest. A mail without
    any text has failed; one whose entity someone must look at says so."""
    fresh = mails.join(emails.filter("status <> 'failed'").select("gmail_message_id"), "gmail_message_id", "left_anti")
    columns = ("kind", "received_at", "subject", "body", "from_header", "arrived_at")
    order = F.struct(~_blank(), "received_at", "arrived_at", F.xxhash64("kind", "subject", "body", "from_header"))
    fresh = staged(fresh.groupBy("gmail_message_id").agg(F.max_by(F.struct(*columns), order).alias("x")).select("gmail_message_id", "x.*"))
    found = {kind: staged(_extracted(fresh, kind)) for kind in KINDS}
    reviews = [df.select(F.col("mail_id").alias("gmail_message_id"), "needs_review") for df in found.values()]
    old = emails.select("gmail_message_id", F.col("created_at").alias("old_created"))
    rows = fresh.join(reviews[0].unionByName(reviews[1]), "gmail_message_id", "left").join(old, "gmail_message_id", "left")
    status = next_status(F.col("needs_review").isNotNull(), F.col("needs_review"))
    changed = rows.select(*columns[:-1], "gmail_message_id", status.alias("status"), F.coalesce("old_created", "arrived_at").alias("created_at"), F.col("arrived_at").alias("updated_at"))
    return {"emails": changed, "talents": _entities(found["talent"], fresh, "talent", talents), "projects": _entities(found["project"], fresh, "project", projects)}


def no_entities(spark: SparkSession, kind: str) -> DataFrame:
    """An empty table of entities of one kind: its keys, its id and times, its fields, and which mail set them."""
    keys = ", ".join(f"key_{i} string" for i in range(len(KINDS[kind][1])))
    return spark.createDataFrame([], f"{keys}, entity_id long, created_at timestamp, {FIELDS[kind]}, status string, mail_id string, received_at timestamp, updated_at timestamp")


class MailTables:
    """Mails, talents and projects under one folder, changed together: a batch counts when all three have its changes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.emails = KeyedTable(f"{folder}/emails", ["gmail_message_id"], spark.createDataFrame([], _MAILS))
        self.talents = KeyedTable(f"{folder}/talents", ["key_0", "key_1", "key_2"], no_entities(spark, "talent"))
        self.projects = KeyedTable(f"{folder}/projects", ["key_0", "key_1"], no_entities(spark, "project"))
        self.done = Numbers(spark, f"{folder}/done")

    def all(self) -> dict[str, KeyedTable]:
        return {"emails": self.emails, "talents": self.talents, "projects": self.projects}

    def absorb(self, batch: DataFrame, number: int) -> None:
        found = changes(batch, *(t.before(number) for t in self.all().values()))
        for name, table in self.all().items():
            table.put(number, found[name])
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            for table in self.all().values():
                table.compact(number)
        self.done.add(number)

    def now(self) -> dict[str, DataFrame]:
        """The three tables after the last whole batch."""
        newest = self.done.newest()
        return {name: table.before(0 if newest is None else newest + 1) for name, table in self.all().items()}


def ingest_mails(mails: DataFrame, folder: str, within: str = "7 days") -> dict[str, DataFrame]:
    """Runs a stream of mails (read_mails) over what is there and returns the tables. The folder takes them and the
    checkpoint; a run that broke off goes on where it was, and ends with the same tables."""
    tables = MailTables(mails.sparkSession, f"{folder}/tables")
    query = without_repeats(mails, within).drop("content").writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(tables.absorb).start()
    query.awaitTermination()
    return tables.now()
