"""Samples of the rules, with the results that they must have."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsunagi.functions import scoring as S
from tsunagi.functions import text as T
from tsunagi.operators import dashboard, ingest, matching, outreach, retention
from tsunagi.operators.best import best_pairs


def one(spark, column, **values):
    kinds = {k: "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "string" for k, v in values.items()}
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("desired", "low", "high", "points"), [(65, 60, 70, 30), (73, 60, 70, 23), (78, 60, 70, 15), (82, 60, 70, 0), (50, 60, 70, 27), (None, 60, 70, 17), (65, 70, 60, 30), (65, None, None, 17)])
def test_rate(spark, desired, low, high, points):
    df = spark.createDataFrame([(desired, low, high)], "d int, l int, h int")
    assert df.select(S.rate_points(F.col("d"), F.col("l"), F.col("h"))).first()[0] == points


@pytest.mark.parametrize(("score", "band"), [(95, "90-100"), (83, "80-89"), (5, "0-9"), (100, "90-100"), (0, "0-9")])
def test_band(spark, score, band):
    assert one(spark, S.score_band(F.col("s")), s=score) == band


@pytest.mark.parametrize(("raw", "skill"), [("js", "javascript"), ("Spring", "spring boot"), ("Ｊａｖａ", "java"), ("Node.js", "node"), ("SQL_Server", "sql server"), ("Vue.js", "vue.js"), ("　k8s ", "kubernetes")])
def test_skills_have_one_spelling(spark, raw, skill):
    assert one(spark, T.normalize_skill(F.col("s")), s=raw) == skill


@pytest.mark.parametrize(("raw", "refused"), [("外国籍不可", True), ("外国籍ＮＧ", True), ("国籍 ：日本", True), ("外国籍可", False), ("不問", False), ("相談", None), ("", None)])
def test_nationality(spark, raw, refused):
    assert one(spark, T.refuses_foreign(F.col("s")), s=raw) is refused


@pytest.mark.parametrize(("body", "number", "judged"), [
    ("【1】この件は進めさせてください。\n【2】こちらは辞退とさせてください", 1, "ok"), ("【1】この件は進めさせてください。\n【2】こちらは辞退とさせてください", 2, "ng"),
    ("今回は辞退とさせてください。", 1, "ng"), ("【2】前向きに", 1, "unknown"), ("前向きですが見送りとさせてください", 1, "ng"), ("確認します", 1, "unknown"), ("", 1, "unknown"),
])
def test_replies(spark, body, number, judged):
    assert one(spark, T.judge_item(F.col("b"), F.col("n")), b=body, n=number) == judged


@pytest.mark.parametrize(("raw", "key"), [("  北  綾瀬駅  ", "北 綾瀬駅"), ("ABC", "abc"), ("   ", ""), ("a　b", "a b")])
def test_business_key(spark, raw, key):
    assert one(spark, T.business_key(F.col("s")), s=raw) == key


@pytest.mark.parametrize(("setting", "days"), [("30", 30), ('"45"', 45), ('"invalid"', 7), ("-3", 0), ('{"days":14}', 14), ("true", 7), ("false", 7), ('{"value": {"days": "3"}}', 3), ('{"ingest_data_retention_days": 9, "x": 1}', 9), ('{"x": 1}', 7), ('{"value": true, "days": 2}', 7), ("null", 7), ("", 7), ("3.7", 3)])
def test_retention_days(spark, setting, days):
    assert one(spark, retention.retention_days(F.col("s"), 7), s=setting) == days


def test_bracket_fields_keep_the_last_value(spark):
    fields = one(spark, T.bracket_fields(F.col("b")), b="【氏名】：山田太郎\n【単価】 65万円\n【氏名】ST\n本文")
    assert fields == {"氏名": "ST", "単価": "65万円"}


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"] * 1 + ["c", "d", "e"], ["a"])], "have array<string>, wanted array<string>, hits array<string>")
    assert df.select(S.skill_points(F.size("hits"), F.size("wanted"), F.size("have"), 30)).first()[0] == 8  # 7.5


def test_retry_counts_failed_mails_as_new(spark):
    emails = spark.createDataFrame([(1, "summarized"), (2, "failed"), (3, "needs_review")], "email_id long, status string")
    incoming = spark.range(1, 5).withColumnRenamed("id", "email_id")
    assert {r[0] for r in ingest.new_mails(incoming, emails).collect()} == {2, 4}
    assert {r[0] for r in ingest.new_mails(incoming, emails, retry_failed=False).collect()} == {4}


def test_upsert_overwrites_with_null_and_keeps_what_it_must(spark):
    schema = "id long, name string, status string, created_at string"
    old = spark.createDataFrame([(1, "a", "old", "t1"), (2, "b", "old", "t2")], schema)
    new = spark.createDataFrame([(1, "x", "new", "t8", 1), (1, None, "new", "t9", 2), (3, "c", "new", "t9", 1)], schema + ", seq int")
    assert sorted(ingest.upsert(old, new, "id").collect()) == [(1, None, "old", "t1"), (2, "b", "old", "t2"), (3, "c", "new", "t9")]


def test_only_later_or_manual_replies_are_valid(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    emails = spark.createDataFrame([(7, "m7")], "email_id long, gmail_message_id string")
    messages = spark.createDataFrame([(1, "g1", t(5), 7, "sent", "th"), (2, "g2", None, None, "sent", "th")], "message_id long, gmail_message_id string, sent_at timestamp, in_reply_to_email_id long, status string, thread_id string")
    replies = spark.createDataFrame(
        [(1, 1, "r1", t(4), "ok", "auto"), (2, 1, "r2", t(6), "ng", "auto"), (3, 1, "g1", t(7), "ok", "auto"), (4, 1, "r4", t(1), "ok", "manual"), (5, 2, "r5", t(1), "ok", "auto"),
         (6, 1, "m7", t(8), "ok", "auto"), (7, 1, "manual:x", t(2), "ok", "auto"), (8, 1, None, t(5), "ok", "auto"), (9, 1, "r9", None, "ok", "auto")],
        "reply_id long, message_id long, gmail_message_id string, received_at timestamp, judgment string, judgment_source string",
    )
    valid = outreach.valid_replies(replies, messages, emails)
    assert {r["reply_id"] for r in valid.collect()} == {2, 4, 5, 7, 9}
    assert {(r["message_id"], r["reply_id"]) for r in outreach.latest_reply(valid).collect()} == {(1, 9), (2, 5)}
    assert {r["reply_id"] for r in outreach.stale_replies(replies, messages, emails).collect()} == {1, 3, 6, 8}


def test_a_stage_of_the_funnel_is_among_the_one_before(spark):
    rows = lambda schema, *x: spark.createDataFrame(list(x), schema)
    ids = rows("kind string, id long", ("talent", 1), ("talent", 2), ("project", 1), ("talent", 3))
    matches = rows("kind string, id long, score int, hard_reject string", ("talent", 1, 0, "foreign_nationality"), ("talent", 2, 50, None), ("talent", 2, 0, None))
    sent = rows("kind string, id long", ("talent", 1), ("talent", 2), ("project", 1))
    replied = rows("kind string, id long, ok boolean", ("talent", 1, True), ("talent", 2, False))
    assert tuple(dashboard.funnel(ids, matches, sent, replied).first()) == (4, 1, 1, 1, 0)
    assert {tuple(r) for r in dashboard.constraint_loss(ids, matches).collect()} == {("talent", "foreign_nationality", 1), ("talent", "other_zero", 1), ("project", "other_zero", 1)}
    assert {tuple(r) for r in dashboard.funnel_sets(ids, matches, sent).collect()} == {("talent", 2, "proposed"), ("talent", 1, "ingested"), ("talent", 3, "ingested"), ("project", 1, "ingested")}


def test_scores_expand_phrases_widths_and_summaries(spark, monkeypatch):
    talents = spark.createDataFrame([(1, "Ｊａｖａ,Java開発の経験5年", None, 65, "8月～", "常駐可", None), (2, "", "詳細設計以降の工程を自走できます。", 65, None, None, True)],
        "talent_id long, skills string, summary string, desired_rate int, available_from string, work_style string, is_foreign_national boolean")
    projects = spark.createDataFrame([(1, "Java", "", 60, 70, "8月～長期", "週3日出社", None), (2, "基本設計以降のご経験", "JavaScript", 60, 70, None, None, False)],
        "project_id long, required_skills string, preferred_skills string, rate_min int, rate_max int, start_date string, work_style string, foreign_nationality_ng boolean")
    want = {(1, 1): 30, (1, 2): 0, (2, 1): 0, (2, 2): 26}  # six of seven phases
    for bits in (matching.BITS, 0):
        monkeypatch.setattr(matching, "BITS", bits)
        assert {(r["talent_id"], r["project_id"]): r["skill_required"] for r in matching.scored(talents, projects).collect()} == want
    best = best_pairs(talents, projects, 1).pairs.collect()
    assert [(r["talent_id"], r["project_id"], r["skill_hits"]) for r in best] == [(1, 1, "java")]


def test_blocks_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "BROADCAST_PROJECTS", 3)
    talents, projects = spark.range(7).withColumnRenamed("id", "talent_id"), spark.range(10).withColumnRenamed("id", "project_id")
    pairs = matching.all_pairs(talents, projects)
    assert pairs.count() == pairs.distinct().count() == 70


def test_targets_are_the_best_that_are_left(spark):
    matches = spark.createDataFrame([(i, i, 1, 100 - i) for i in range(10)], "match_id long, talent_id long, project_id long, score int")
    refused = spark.createDataFrame([(0,), (2,)], "match_id long")
    marked = matching.without_refused(matches, refused)
    assert {r["match_id"] for r in marked.filter("score = 0").collect()} == {0, 2}
    assert [r["match_id"] for r in matching.judge_targets(marked, 3).orderBy("place").collect()] == [1, 3, 4]


def test_links_and_other_kinds_name_entities_too(spark):
    messages = spark.createDataFrame([(1, "talent_proposal", 1, 5, None, "sent"), (2, "project_proposal", None, 6, None, "sent"), (3, "project_proposal", None, 7, None, "draft")],
        "message_id long, kind string, talent_id long, project_id long, match_id long, status string")
    links = spark.createDataFrame([(2, 2, None), (3, 3, None)], "message_id long, talent_id long, match_id long")
    ids = lambda found: [{r[0] for r in df.collect()} for df in found]
    assert ids(outreach.proposed_entities(messages)) == [{1}, {6}]
    assert ids(outreach.proposed_entities(messages, links)) == [{1, 2}, {5, 6}]


def test_dashboard_queries_count_linked_talents_as_their_sql_does(spark):
    """A domain in which a talent is offered by a link alone, and a project by a talent proposal alone."""
    import types

    from tsunagi.plans import service

    messages = spark.createDataFrame([(1, "talent_proposal", 1, 5, None, "sent"), (2, "project_proposal", None, 6, None, "sent")],
        "message_id long, kind string, talent_id long, project_id long, match_id long, status string")
    links = spark.createDataFrame([(2, 2, None)], "message_id long, talent_id long, match_id long")
    emails = spark.createDataFrame([(i, k, t, p, dt.datetime(2024, 3, 1)) for i, (k, t, p) in enumerate([("talent", 1, 9), ("talent", 2, 9), ("talent", 3, 9), ("project", 9, 5), ("project", 9, 6), ("project", 9, 7)])],
        "email_id long, email_type string, talent_id long, project_id long, created_at timestamp")
    found = service.a03_totals(types.SimpleNamespace(messages=messages, message_talents=links, emails=emails)).first()
    assert (found["talents_proposed"], found["projects_proposed"]) == (2, 2)
