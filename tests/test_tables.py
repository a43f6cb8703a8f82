"""Contracts of tables, deletes that cascade, keyed tables, answers in batches, skills that join the master."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tsunagi.operators import answers as A
from tsunagi.operators import cascade as X
from tsunagi.operators import ingest as I
from tsunagi.operators import pipeline as P
from tsunagi.operators import search as Q
from tsunagi.sources import contracts as C
from tsunagi.sources.keyed import KeyedTable


def test_contract(spark, tmp_path):
    whole = spark.createDataFrame([(1, 2, "A", None, 60, None, None, None, ["Java"], "active", None, True, None, None)], C.contract("talents"))
    older = whole.drop(*C.ADDED["talents"]).withColumn("talent_id", F.lit(2)).withColumn("extra", F.lit("x"))
    whole.write.parquet(str(tmp_path / "new"))
    older.write.parquet(str(tmp_path / "old"))
    both = C.load(spark, "talents", str(tmp_path / "old"), str(tmp_path / "new"))
    assert both.dtypes == whole.dtypes
    assert {(r["talent_id"], r["is_foreign_national"]) for r in both.collect()} == {(1, True), (2, None)}
    with pytest.raises(C.ContractError, match="desired_rate is string, not int; status is missing"):
        C.conform(whole.withColumn("desired_rate", F.lit("60")).drop("status"), "talents")
    with pytest.raises(C.ContractError, match="skills is string"):
        C.conform(whole.withColumn("skills", F.lit("Java")), "talents")


def tables(spark):
    frame = spark.createDataFrame
    return {
        "emails": frame([(1, 7), (2, 8), (3, None)], "email_id long, source_company_id long"), "talents": frame([(10, 1, 7), (11, 2, None)], "talent_id long, email_id long, introducer_company_id long"),
        "projects": frame([(20, 3, 7)], "project_id long, email_id long, distributor_company_id long"), "sheets": frame([(30, 10), (31, 11)], "sheet_id long, talent_id long"),
        "matches": frame([(40, 10, 20), (41, 11, 20)], "match_id long, talent_id long, project_id long"), "hidden": frame([(10, 20), (11, 20)], "talent_id long, project_id long"),
        "message_talents": frame([(52, 10), (53, 10), (53, 11)], "message_id long, talent_id long"),
        "messages": frame([(50, "talent_proposal", 10, None, None), (51, "talent_proposal", None, 40, None), (52, "project_proposal", None, None, 20), (53, "project_proposal", None, None, 20), (54, "project_proposal", None, None, 20)], "message_id long, kind string, talent_id long, match_id long, project_id long"),
        "replies": frame([(60, 50), (61, 52), (62, 54)], "reply_id long, message_id long"), "companies": frame([(7,), (8,)], "company_id long"), "contacts": frame([(70, 7)], "contact_id long, company_id long"), "other": frame([(1,)], "x long"),
    }


def keys(left):
    return {name: sorted(tuple(r)[0] for r in df.collect()) for name, df in left.items()}


def test_deleting_a_talent_takes_its_mail_and_all_that_hangs_on_it(spark):
    t = tables(spark)
    got = keys(X.after_delete(t, {"talents": spark.createDataFrame([(10,)], "talent_id long")}, with_mails=True))
    assert got == keys(t) | {"emails": [2, 3], "talents": [11], "sheets": [31], "matches": [41], "hidden": [11], "message_talents": [53], "messages": [53, 54], "replies": [62]}
    assert keys(X.after_delete(t, {"talents": spark.createDataFrame([(10,)], "talent_id long")}))["emails"] == [1, 2, 3]


def test_deleting_mails_projects_and_companies(spark):
    t = tables(spark)
    by_mail = keys(X.after_delete(t, {"emails": spark.createDataFrame([(3,)], "email_id long")}))
    assert by_mail["projects"] == [] and by_mail["matches"] == [] and by_mail["messages"] == [50] and by_mail["message_talents"] == [] and by_mail["talents"] == [10, 11]
    firm = X.after_delete(t, {"companies": spark.createDataFrame([(7,)], "company_id long")})
    assert keys(firm)["contacts"] == [] and {r["introducer_company_id"] for r in firm["talents"].collect()} == {None} and firm["talents"].columns == t["talents"].columns
    assert {r["source_company_id"] for r in firm["emails"].collect()} == {None, 8}


def test_a_purge_leaves_empty_tables_and_masters(spark):
    t = tables(spark)
    left = X.purged(t)
    assert {n: df.count() for n, df in left.items() if n not in ("companies", "contacts")} == {n: 0 for n in t if n not in ("companies", "contacts")}
    assert all(left[n].dtypes == t[n].dtypes for n in t) and left["contacts"].count() == 1
    assert keys(X.purged(t, ("replies",))) == keys(t) | {"replies": []}


def test_keyed_table(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    table = KeyedTable(str(tmp_path / "t"), ["k"], frame((1, "a"), (2, "b")))
    table.put(0, frame((2, None), (3, "c")))
    table.put(1, frame((3, "d")))
    table.put(1, frame((1, "e")))  # run again: it overwrites what it had written
    at = lambda n: {r["k"]: r["v"] for r in KeyedTable(str(tmp_path / "t"), ["k"], frame((9, "x"))).before(n).collect()}
    want = [{1: "a", 2: "b"}, {1: "a", 2: None, 3: "c"}, {1: "e", 2: None, 3: "c"}]
    assert [at(n) for n in range(3)] == want
    table.compact(1)
    table.put(2, frame((2, "z")))
    assert [at(n) for n in range(3)] == want and at(3) == {1: "e", 2: "z", 3: "c"}


def test_batch_results(spark):
    requests = spark.createDataFrame([("b", i + 1, m) for i, m in enumerate(["a1", "a2", "7", "a4", "a5"])] + [("c", 1, "a1"), ("d", 1, "x")], "batch_id string, place int, mail_id string")
    text = 'Sure:\n```json\n{"items": [{"mail_id": "a1", "n": 1}, {"id": 2, "n": 2}, {"mail_id": " 7 ", "n": 3}, {"id": "9", "n": 4}, {"id": "zz"}, {"n": 5}, 8, {"mail_id": "a1", "n": 6}, {"mail_id": null, "id": "a4", "n": 7}]}\n```'
    answers = spark.createDataFrame([("b", text), ("c", "[broken"), ("d", '[{"mail_id": 1, "n": "9"}]')], "batch_id string, answer string")
    got = {(r["batch_id"], r["mail_id"]): r["n"] if r["answered"] else "fallback" for r in A.batch_results(requests, answers, {"n": "int"}).collect()}
    assert got == {("b", "a1"): 6, ("b", "a2"): 2, ("b", "7"): 3, ("b", "a4"): 7, ("b", "a5"): "fallback", ("c", "a1"): "fallback", ("d", "x"): 9}


def test_skills_join_the_master_once(spark):
    items = spark.createDataFrame([(1, 0, "Ｊａｖａ"), (1, 1, "java"), (1, 2, " New_Skill "), (2, 0, "new skill"), (2, 1, "ＡＷＳ"), (3, 0, " ")], "owner long, at int, raw string")
    master = spark.createDataFrame([("Java", 1), ("AWS", 2)], "name string, category_id int")
    categories = spark.createDataFrame([(1, "Lang"), (2, "Cloud"), (9, I.UNCATEGORIZED)], "category_id int, name string")
    assert {r["owner"]: r["skills"] for r in I.conform_skills(items, master).collect()} == {1: "Java,New_Skill", 2: "New_Skill,AWS"}
    assert [tuple(r) for r in I.new_skills(items, master, categories).select("name", "name_key", "category_id").collect()] == [("New_Skill", "new skill", 9)]
    assert {tuple(r) for r in I.moved_to_uncategorized(master, categories, 2).select("name", "category_id").collect()} == {("Java", 1), ("AWS", 9)}
    assert {tuple(r) for r in I.moved_to_uncategorized(master, categories, 9).select("name", "category_id").collect()} == {("Java", 1), ("AWS", 2)}


def test_searches_see_what_the_list_shows(spark):
    rows = [(1, "A", "X-1", "Tokyo", None, "9:00", "140h", "text", "Firm", "Java,Go", "Rust", 600000, 749999, None), (2, "B", None, None, None, None, None, None, None, "JavaScript", "Java", None, None, True)]
    projects = spark.createDataFrame(rows, "project_id int, title string, project_code string, location string, work_style string, working_hours string, settlement_range string, summary string, company_name string, required_skills string, preferred_skills string, rate_min int, rate_max int, foreign_nationality_ng boolean")
    ids = lambda *a, **k: [r["project_id"] for r in Q.search_projects(projects, *a, **k).orderBy("project_id").collect()]
    assert [ids(w) for w in ("x-1", "TOKYO", "9:00", "140h", "firm", "rust")] == [[1], [1], [1], [1], [1], []]
    assert ids("", ["Java"]) == [1, 2] and ids("", ["java"]) == [] and ids("", ["Rust"]) == []
    assert ids("", [], 75) == [1, 2] and ids("", [], 76) == [2] and ids("", [], None, 59) == [2] and ids("", nationality="ng") == [2]


LOG = "job_id string, ts timestamp, seq long, event string, level string, error_code string, error_message string, message string, duration_ms long, extra string"


def job(spark, name, *events):
    from datetime import datetime, timedelta

    start = datetime(2026, 8, 28, 7)
    rows = [(name, start + timedelta(seconds=at), n, event, more.get("level", "INFO"), more.get("code"), more.get("error"), more.get("message"), more.get("ms"), extra) for n, (at, event, extra, *rest) in enumerate(events) for more in [rest[0] if rest else {}]]
    return spark.createDataFrame(rows, LOG)


def test_progress_of_a_running_job(spark):
    feed = '{"label_type": "talent", "done": %d, "total": 4}'
    log = job(spark, "j", (0, P.STARTED, '{"steps": ["ingest_talent", "ingest_project", "cleanup", "match", "reply_sync"]}'), (1, P.STEP_STARTED, '{"step": "ingest_talent"}'), (5, P.TARGETS, '{"label_type": "talent", "source_label": "x", "targets": 4, "listed": 4}'),
        (8, P.FETCHED, feed % 4), (12, P.JUDGED, feed % 2), (20, P.MESSAGES[0], '{"label_type": "talent"}'))
    now = F.lit("2026-08-28 07:01:01").cast("timestamp")
    steps = {r["step"]: r for r in P.step_progress(log, now).collect()}
    assert len(steps) == 5 and steps["ingest_talent"]["status"] == "running" and steps["match"]["status"] == "pending"
    assert steps["ingest_talent"]["percent"] == 54 and steps["ingest_talent"]["eta_seconds"] == 60 * 100 // 54 - 60
    whole = P.job_progress(log, now).first()
    assert (whole["status"], whole["ingested"], whole["total_messages"], whole["current_step"]) == ("running", 1, 4, 1)
    assert whole["percent"] == 11 and whole["eta_seconds"] == 51 + 600 + 30 + 300 + 60 and whole["eta_text"] == "約17分"


def test_progress_of_finished_and_stopped_jobs(spark):
    done = job(spark, "done", (0, P.STARTED, '{"steps": ["ingest", "cleanup", "ai_judge"]}'), (1, P.STEP_STARTED, '{"step": "ingest"}'), (9, P.INGESTED, '{"ingested": 5, "skipped": 2, "failed": 1}'), (10, P.MESSAGES[1], "{}"), (300, P.FINISHED, '{"status": "ok"}'))
    stopped = job(spark, "stopped", (0, P.STARTED, "broken"), (1, P.STEP_FINISHED, '{"step": "match", "exit_code": 1}'), (60, P.FINISHED, '{"status": "cancelled"}'))
    lost = job(spark, "lost", (0, P.STARTED, "{}"), (1, P.JOB_FAILED, "{}", {"level": "ERROR", "code": "E1", "message": "boom"}), (2, P.FINISHED, '{"status": "error", "failed_step": "match"}'))
    log = done.unionByName(stopped).unionByName(lost)
    got = {r["job_id"]: r for r in P.job_progress(log, F.lit("2026-08-29").cast("timestamp")).collect()}
    assert (got["done"]["status"], got["done"]["percent"], got["done"]["eta_text"], got["done"]["ingested"], got["done"]["skipped"]) == ("completed", 100, "完了", 6, 2)
    assert (got["stopped"]["status"], got["stopped"]["error_code"], got["stopped"]["error_message"], got["stopped"]["eta_seconds"]) == ("failed", "ERR-0030", "処理が停止されました", None)
    assert (got["lost"]["error_code"], got["lost"]["error_message"]) == ("E1", "boom")
    assert [r["step"] for r in P.planned_steps(log).filter("job_id = 'done'").orderBy("place").collect()] == ["ingest_talent", "ingest_project", "cleanup"]


def test_job_totals_sum_no_frame_anew_for_each_row(spark):
    from tsunagi.operators import pipeline
    from tsunagi.sources.binding import Domain

    found = pipeline.job_totals(Domain(spark, "/root/testdata/sf0.001").pipeline_log)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RowFrame, 1, unboundedfollowing$())" not in plan and "unboundedpreceding$(), currentrow$()" in plan
