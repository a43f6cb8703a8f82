"""How far each pipeline job is, from the rows of its log: what its steps say, totals, the last error, and the time that is left.

A log row has job_id, ts, seq (tells rows of one moment apart), event, level, error_code, error_message, message,
duration_ms and `extra`, an object as JSON text, whose members differ by event; it is parsed once, as a variant, and read
by path. Everything is grouped and windowed by job, so a log of many jobs is spread by job; a job's own rows are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Steps with their labels, weights and seconds; what a feed's step is; shares of the parts of an ingest step.
STEPS = {
    "ingest_talent": ("人材メール取込", 0.18, 600), "ingest_project": ("案件メール取込", 0.18, 600), "ingest_skill_sheets": ("スキルシート取込", 0.04, 120), "cleanup": ("古い取込データ削除", 0.05, 30),
    "match": ("ルール採点", 0.35, 300), "ai_judge": ("AI判定", 0.05, 180), "reply_sync": ("返信同期", 0.15, 60), "ingest": ("メール取込・AI要約", 0.40, 900),
}
OTHER_WEIGHT, OTHER_SECONDS = 0.1, 120
FEEDS = {"talent": "ingest_talent", "project": "ingest_project"}
INGEST_STEPS, HIDDEN_STEPS = ("ingest_talent", "ingest_project"), ("ai_judge",)
DEFAULT_STEPS = ("ingest_talent", "ingest_project", "cleanup", "reply_sync", "match")
INGEST_SHARES = {"list": 0.05, "fetch": 0.15, "ai": 0.55, "persist": 0.25}
STARTED, STEP_STARTED, STEP_FINISHED, FINISHED = "batch.pipeline.started", "batch.pipeline.step_started", "batch.pipeline.step_finished", "batch.pipeline.finished"
JOB_FAILED, CANCELLED = "batch.job.failed", "batch.job.cancelled"
TARGETS, FETCHED, JUDGED, INGESTED = "gmail_ingest.label_targets", "gmail_ingest.fetch_progress", "gmail_ingest.ai_progress", "gmail_ingest.finished"
MESSAGES = ("gmail_ingest.message_fetched", "gmail_ingest.message_ingested")
SHEETS = ("gmail_ingest.skill_sheets_started", "gmail_ingest.skill_sheet_progress", "gmail_ingest.skill_sheets_finished")
STATES = {
    "ingest_cleanup.started": ("cleanup", "running"), "ingest_cleanup.skipped": ("cleanup", "completed"), "ingest_cleanup.finished": ("cleanup", "completed"), "matching.rule_score.started": ("match", "running"),
    "matching.rule_score.finished": ("match", "completed"), "matching.ai_judge.started": ("ai_judge", "running"), "matching.ai_judge.finished": ("ai_judge", "completed"), "outreach.reply_sync.started": ("reply_sync", "running"),
    "outreach.reply_sync.finished": ("reply_sync", "completed"),
}
STEP_ERROR, FAILED_TEXT, STOPPED_TEXT = "ERR-0030", "で失敗しました", "処理が停止されました"
# End of fixed values.

def _of(step: Column, at: int, other: object) -> Column:
    table = F.create_map(*[F.lit(x) for name, values in STEPS.items() for x in (name, values[at])])
    return F.coalesce(F.try_element_at(table, step), F.lit(other) if not isinstance(other, Column) else other)


def _whole(path: str) -> Column:
    return F.try_variant_get("payload", f"$.{path}", "long")


def _text(path: str) -> Column:
    return F.try_variant_get("payload", f"$.{path}", "string")


def read_log(log: DataFrame) -> DataFrame:
    """The log's rows with their payload, which is null where `extra` is no JSON."""
    return log.withColumn("payload", F.try_parse_json("extra"))


def _last(value: Column, where: Column) -> Column:
    """The value of the last row where it is there and `where` holds."""
    return F.max_by(value, F.when(where & value.isNotNull(), F.struct("ts", "seq")))


def _step_failed() -> Column:
    return (F.col("event") == STEP_FINISHED) & F.coalesce(_whole("exit_code") != 0, _text("exit_code").isNotNull())


def job_totals(log: DataFrame) -> DataFrame:
    """One row a job: started_at, updated_at, status, mails that were ingested, skipped, failed and looked at, and the
    last error. A finished feed tells a count of its own, and mails after it count on top: those of the whole job without
    those so far, as a frame over the rows that follow would be summed anew for each row; the greatest of what the ends tell
    holds."""
    event, rows = F.col("event"), read_log(log).filter("job_id is not null")
    one = event.isin(*MESSAGES).cast("long")
    so_far = Window.partitionBy("job_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda frame: F.coalesce(F.sum("one").over(frame), F.lit(0))
    rows = rows.withColumn("one", one).withColumn("to_come", count(Window.partitionBy("job_id")) - count(so_far))
    told = F.when(event == INGESTED, F.coalesce(_whole("ingested"), F.lit(0)) + F.col("to_come"))
    end, state = _text("status"), F.lit(None).cast("string")
    status = (
        F.when(event == STARTED, "running").when(_step_failed() | (event == CANCELLED) | ((event == JOB_FAILED) & (F.col("level") == "ERROR")), "failed")
        .when(event == FINISHED, F.when(end == "ok", "completed").otherwise("failed")).otherwise(state)
    )
    of_job = (event == JOB_FAILED) & (F.col("level") == "ERROR")
    code = F.when(_step_failed(), F.coalesce("error_code", F.lit(STEP_ERROR))).when(of_job, F.col("error_code"))
    failed_step = lambda step: F.concat(_of(step, 0, step), F.lit(FAILED_TEXT))
    stopped = (event == CANCELLED) | ((event == FINISHED) & (end == "cancelled"))
    message = F.when(_step_failed(), F.coalesce("error_message", failed_step(_text("step")))).when(of_job, F.coalesce("error_message", "message")).when(stopped, STOPPED_TEXT)
    at_end = F.when((event == FINISHED) & ~F.coalesce(end.isin("ok", "cancelled"), F.lit(False)), failed_step(_text("failed_step")))
    total = lambda c: F.coalesce(F.sum(F.when(event == INGESTED, _whole(c))), F.lit(0)).alias(c)
    return rows.groupBy("job_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.coalesce(_last(status, F.lit(True)), F.lit("running")).alias("status"),
        F.greatest(F.sum("one"), F.coalesce(F.max(told), F.lit(0))).alias("ingested"), total("skipped"), total("failed"),
        F.sum(F.when(event == TARGETS, F.greatest(_whole("targets"), F.lit(0)))).alias("total_messages"),
        _last(code, F.lit(True)).alias("error_code"), F.coalesce(_last(message, F.lit(True)), _last(at_end, F.lit(True))).alias("error_message"),
    )


def step_states(log: DataFrame) -> DataFrame:
    """One row a job and step that its log names: status, started_at, finished_at, duration_ms, and how many mails were
    listed, fetched, judged and stored of how many. Rows that name no feed belong to the step that began last before."""
    event = F.col("event")
    so_far = Window.partitionBy("job_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    began = F.last(F.when(event == STEP_STARTED, _text("step")), ignorenulls=True).over(so_far)
    rows = read_log(log).filter("job_id is not null").withColumn("began", began)
    feed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FEEDS.items() for x in pair]), _text("label_type")), "began", F.lit("ingest"))
    spread = lambda step: F.when(step == "ingest", F.array(*[F.lit(s) for s in INGEST_STEPS])).otherwise(F.array(step))
    state = F.create_map(*[F.lit(x) for name, (step, _) in STATES.items() for x in (name, step)])
    status = F.create_map(*[F.lit(x) for name, (_, value) in STATES.items() for x in (name, value)])
    marks = event.isin(TARGETS, FETCHED, JUDGED, *MESSAGES)
    steps = (
        F.when(event.isin(STEP_STARTED, STEP_FINISHED) & _text("step").isNotNull(), spread(_text("step"))).when(marks, F.array(feed))
        .when(event.isin(*SHEETS), F.array(F.lit("ingest_skill_sheets"))).when(event.isin(*STATES), F.array(state[event]))
    )
    rows = rows.withColumn("step", F.explode(steps))
    set_to = F.when(event == STEP_STARTED, "running").when(event == STEP_FINISHED, F.when(_step_failed(), "failed").otherwise("completed")).otherwise(F.try_element_at(status, event))
    most = lambda path, *events: F.coalesce(F.greatest(F.max(F.when(event.isin(*events), _whole(path))), F.lit(0)), F.lit(0))
    return rows.groupBy("job_id", "step").agg(
        F.coalesce(_last(set_to, F.lit(True)), F.when(F.bool_or(marks), "running"), F.lit("pending")).alias("status"),
        F.coalesce(_last(F.col("ts"), event == STEP_STARTED), F.min(F.when(marks, F.col("ts")))).alias("started_at"), _last(F.col("ts"), event == STEP_FINISHED).alias("finished_at"),
        _last(F.col("duration_ms"), event == STEP_FINISHED).alias("duration_ms"), most("listed", TARGETS).alias("listed"), most("targets", TARGETS).alias("targets"),
        most("done", FETCHED).alias("fetch_done"), most("total", FETCHED).alias("fetch_total"), most("done", JUDGED).alias("ai_done"), most("total", JUDGED).alias("ai_total"),
        F.count_if(event.isin(*MESSAGES)).alias("persist_done"), most("done", *SHEETS[1:]).alias("sheet_done"), most("total", *SHEETS).alias("sheet_total"),
    )


def planned_steps(log: DataFrame) -> DataFrame:
    """job_id, place and step of the steps that a job is to take, as its last start tells; an ingest is two, judging is
    not shown, and a job that does not tell takes the usual ones."""
    named = F.try_variant_get("payload", "$.steps", "array<string>")
    told = read_log(log).filter("job_id is not null").groupBy("job_id").agg(_last(named, F.col("event") == STARTED).alias("named"))
    shown = F.flatten(F.transform("named", lambda s: F.when(s == "ingest", F.array(*[F.lit(x) for x in INGEST_STEPS])).otherwise(F.array(s))))
    shown = F.array_distinct(F.filter(shown, lambda s: ~s.isin(*HIDDEN_STEPS)))
    usual = F.array(*[F.lit(s) for s in DEFAULT_STEPS])
    return told.select("job_id", F.posexplode(F.when(F.size("named") > 0, shown).otherwise(usual)).alias("place", "step"))


def measured_seconds(log: DataFrame, least: int = 3) -> DataFrame:
    """step and seconds: the median of how long a step took in the jobs that finished it, where there are `least`."""
    done = step_states(log).filter("status = 'completed' and duration_ms is not null")
    return done.groupBy("step").agg(F.expr("percentile(duration_ms, 0.5) / 1000").cast("int").alias("seconds"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")


def _elapsed(now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros("started_at")) / 1_000_000))


def _percent(now: Column) -> Column:
    """Percent of one step."""
    c = F.col
    part = lambda done, of: F.least(F.lit(1.0), done / F.greatest(F.lit(1), of))
    some = lambda *columns: F.coalesce(*[F.when(x > 0, x) for x in columns[:-1]], columns[-1])
    total = some(c("targets"), c("fetch_total"), c("listed"))  # what is to be stored is what is to be looked at
    fetch_total = some(c("fetch_total"), total)
    ai_total, persist_total = some(c("ai_total"), c("fetch_done"), fetch_total), some(c("targets"), total)
    share = INGEST_SHARES
    parts = (
        F.lit(share["list"]) * F.when((c("listed") > 0) | (c("targets") > 0), 1.0).otherwise(0.0) + F.lit(share["fetch"]) * part(c("fetch_done"), fetch_total)
        + F.lit(share["ai"]) * part(c("ai_done"), ai_total) + F.lit(share["persist"]) * part(c("persist_done"), persist_total)
    )
    between = lambda low, high, x: F.greatest(F.lit(low), F.least(F.lit(high), F.bround(x * 100).cast("int")))
    ingest = (
        F.when(c("status") == "pending", 0).when(c("sheet_total") > 0, between(1, 99, part(c("sheet_done"), c("sheet_total"))))
        .when((total <= 0) & (c("status") == "running"), 5).otherwise(between(1, 99, parts))
    )
    elapsed = _elapsed(now)
    generic = F.when(c("status") != "running", 0).when(c("started_at").isNull() | (elapsed <= 0), 5).otherwise(between(5, 95, F.least(F.lit(0.95), elapsed / F.greatest(F.lit(1), c("seconds")))))
    of = F.when(c("step").startswith("ingest_") | (c("step") == "ingest"), ingest).otherwise(generic)
    return F.when(c("status") == "completed", 100).when(c("status") == "failed", F.least(of, F.lit(99))).otherwise(of)


def step_progress(log: DataFrame, now: Column, seconds: DataFrame | None = None) -> DataFrame:
    """One row a job and planned step: place, step, status, percent, weight (of all steps of the job 1) and eta_seconds.
    A step that has not begun takes its usual time, one that runs goes on as it went; `seconds` (step, seconds, as
    measured_seconds gives) are the usual times where the fixed ones are not to hold; a few rows."""
    states = step_states(log)
    usual = _of(F.col("step"), 2, OTHER_SECONDS)
    planned = planned_steps(log).join(states, ["job_id", "step"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    planned = planned.fillna(0, [c for c, kind in states.dtypes if kind == "bigint" and c != "duration_ms"])
    if seconds is None:
        planned = planned.withColumn("seconds", usual)
    else:
        planned = planned.join(F.broadcast(seconds), "step", "left").withColumn("seconds", F.coalesce("seconds", usual))  # a row a step
    weight = _of(F.col("step"), 1, OTHER_WEIGHT)
    rows = planned.withColumn("percent", _percent(now)).withColumn("weight", weight / F.sum(weight).over(Window.partitionBy("job_id")))
    elapsed = _elapsed(now)
    whole = F.floor(elapsed * 100 / F.col("percent"))
    eta = (
        F.when(F.col("status") == "completed", 0).when((F.col("status") == "pending") | F.col("started_at").isNull(), F.col("seconds")).when(F.col("percent") >= 100, 0)
        .when(F.col("percent") > 0, F.greatest(F.lit(0), whole - elapsed)).otherwise(F.greatest(F.lit(0), F.col("seconds") - elapsed))
    )
    return rows.select("job_id", "place", "step", "status", "percent", "weight", eta.cast("long").alias("eta_seconds"))


def job_progress(log: DataFrame, now: Column, seconds: DataFrame | None = None) -> DataFrame:
    """One row a job: job_totals, percent, current_step (the place of the first that runs, from 1), eta_seconds and eta_text
    of a job that runs. A running job's time left is that of the steps that run or have not begun."""
    from tsunagi.operators.settings import eta_text

    left = F.col("status").isin("pending", "running")
    steps = step_progress(log, now, seconds).groupBy("job_id").agg(
        F.sum(F.col("weight") * F.col("percent") / 100).alias("share"), F.sum(F.when(left, F.col("eta_seconds")).otherwise(0)).alias("left"),
        F.min(F.when(F.col("status") == "running", F.col("place") + 1)).alias("runs"), F.count(F.lit(1)).alias("n_steps"),
    )
    both = job_totals(log).join(steps, "job_id")
    done, running = F.col("status") == "completed", F.col("status") == "running"
    eta = F.when(running, F.col("left")).when(done, F.lit(0).cast("long"))
    percent = F.when(done, 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.bround(F.col("share"), 10) * 100).cast("int"))))
    current = F.coalesce("runs", F.when(done, F.col("n_steps")).otherwise(F.least(F.col("n_steps"), F.lit(1).cast("long")))).cast("int")
    return both.select(*[c for c in both.columns if c not in ("share", "left", "runs", "n_steps")], percent.cast("int").alias("percent"), current.alias("current_step"), eta.alias("eta_seconds"), F.when(running, eta_text(eta)).when(done, "完了").alias("eta_text"))
