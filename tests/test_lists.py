"""Display groupings, which have no SQL, beside what they must give; and keywords, item numbers and commerce flows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tsunagi.operators import companies as C
from tsunagi.operators import lists as L
from tsunagi.operators import proposals as P
from tsunagi.operators import replies as J
from tsunagi.operators import settings as S


def brute_groups(skills, catalog):
    left, out = list(skills), {}
    for label, options in catalog:
        for option in options:
            hit = next((s for s in left if s in option or option in s), None)
            if hit is not None:
                left.remove(hit)
                out.setdefault(label, []).append(hit)
    return out | ({"その他": left} if left else {})


def test_skills_by_catalog(spark):
    catalog = [("Lang", ["Java", "Go"]), ("Cloud", ["AWS", "GCP"]), ("Empty", ["X9"])]
    lists = {1: ["Go言語", "Java", "JavaScript", "AWS S3"], 2: [], 3: ["Java", "Java"], 4: ["zzz"]}
    frame = spark.createDataFrame([(label, options, i) for i, (label, options) in enumerate(catalog)], "label string, options array<string>, sort_order int")
    got = {}
    for r in L.by_catalog(spark.createDataFrame(list(lists.items()), "id int, skills array<string>"), frame).collect():
        got.setdefault(r["id"], {})[r["label"]] = r["items"]
    assert got == {i: g for i, s in lists.items() if (g := brute_groups(s, catalog))}


def test_display_matches_go_both_ways(spark):
    skills = spark.createDataFrame([(1, 0, "Java開発"), (1, 1, "COBOL"), (2, 0, "React Native")], "id int, at int, skill string")
    wanted = spark.createDataFrame([(1, "java"), (1, "詳細設計"), (3, "x")], "id int, wanted string")
    assert {(r["id"], r["skill"]): r["matched"] for r in L.display_matches(skills, wanted).collect()} == {(1, "Java開発"): True, (1, "COBOL"): False, (2, "React Native"): False}


@pytest.mark.parametrize(("own", "company", "affiliation", "flow", "want"), [
    ("株式会社Kanana", "株式会社Kanana", "正社員", None, "プロパー"), ("株式会社Kanana", "A", "正社員", None, "一社先正社員"), ("株式会社Kanana", "A", "フリーランス", "一社先", "二社先フリーランス"),
    ("株式会社Kanana", "A", "フリーランス", None, "一社先フリーランス"), ("", "A", "正社員", "一社先", "一社先"), ("K", "A", None, "三社先", "4社先"), ("K", "A", "正社員", "２社先", "三社先正社員"), ("Ｋ　A", "kＡ", "正社員", None, "プロパー"), ("K", "A", "ＢＰ（x）", "１社先", "二社先BP"),
])
def test_proposal_flow(spark, own, company, affiliation, flow, want):
    df = spark.createDataFrame([(own, company, affiliation, flow)], "o string, c string, a string, f string")
    assert P.proposal_flows(df, F.col("o"), "c", "a", "f").select("flow").first()[0] == want


def test_item_numbers(spark):
    body = "ご提案です\n【1】Java案件（東京）\n  詳細\n【 2 】 COBOL\n【1】PHP案件"
    df = spark.createDataFrame([(body, "PHP案件 大阪"), (body, "COBOL"), (body, ""), (None, "x"), (body, "Java案件（東京）")], "b string, t string")
    assert [r[0] for r in df.select(J.item_number(F.col("b"), F.col("t"))).collect()] == [1, 2, None, None, None]


def test_companies_do_not_depend_on_the_order_of_mails(spark):
    known = spark.createDataFrame([(1, "A", "introducer", "a.com", None), (2, "b.com", "distributor", "b.com", "x@b.com"), (3, "C", "both", "", "c@c.com")], "company_id long, name string, kind string, domain string, default_email string")
    rows = [(1, "distributor", None, "A.com", "u@a.com", 5), (2, "introducer", "B corp", "b.com", None, 2), (3, "introducer", "C", "c.com", "n@c.com", 3), (4, "introducer", "New", "new.com", "q@new.com", 4), (5, "distributor", "Newer", "new.com", None, 6), (6, "introducer", None, None, None, 7)]
    for order in (rows, rows[::-1]):
        mails = spark.createDataFrame(order, "mail_id long, kind string, name string, domain string, email string, seq long")
        got = {r["domain"]: (r["name"], r["kind"], r["default_email"]) for r in C.upsert_companies(mails, known).collect()}
        assert got == {"a.com": ("A", "both", "u@a.com"), "b.com": ("B corp", "both", "x@b.com"), "c.com": ("C", "both", "c@c.com"), "new.com": ("New", "both", "q@new.com")}


def test_texts_of_times(spark):
    df = spark.createDataFrame([(0,), (20,), (150,), (3600,), (5400,)], "s int")
    assert [r[0] for r in df.select(S.eta_text(F.col("s"))).collect()] == ["まもなく完了", "約1分", "約2分", "約1時間", "約1時間30分"]
