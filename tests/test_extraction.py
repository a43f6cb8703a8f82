"""Talents and projects from mails as people write them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tsunagi.functions import extract as X
from tsunagi.operators import extraction as E

PROJECT = """
株式会社みなも ご担当者様
お世話になっております。
ーーーーーーー案件情報ーーーーーーー
【案件名】：物流会社向け在庫管理の改修
【作業期間】：9月～長期
【作業場所】：品川（基本フルリモート）
【作業形態】：基本フルリモート
【単　価】：650,000円～75万円
【面談回数】：1回
【人数】：2名
【外国籍】：不可
【商　流】：一社先まで
【作業内容】：
・在庫管理システムの改修
・夜間処理の調査
【必要スキル】：
・Javaでの実務経験3年以上
・PostgreSQLでの開発経験
【尚可】AWS、TypeScript
ーーーーーーーーーーーーーー
以上、よろしくお願い致します。
株式会社なぎさ　Nagisa
担当：森
"""
TALENT = """
株式会社みなも　様

◆【要員】◆ JAVA ◆
【名　前】KY　フリーランス(なぎさ所属)
【年　齢】31歳
【性　別】男性
【最寄駅】中野駅
【稼動日】10月～
【単　金】70～75万円　※相談可
【国　籍】日本国籍

【スキル】実務経験：6.5年
　　　　　Java、Spring Boot

【備　考】結合試験以降を一人で進められます。
---------------------------------------------------------------------
以上、宜しくお願い致します。
株式会社なぎさ　Nagisa
担当：森
"""


@pytest.fixture(scope="module")
def mails(spark):
    rows = [(1, "【注力】在庫管理", PROJECT, '"株式会社しぶき" <a@b.com>'), (2, "件名だけ", "", None), (3, None, None, None), (4, "x", "【案件名】A\n【必要スキル】要確認\n【案件名】B", "Taro <t@x.com>")]
    return spark.createDataFrame(rows, "mail_id long, subject string, body string, from_header string")


def test_projects(mails):
    found = {r["mail_id"]: r.asDict() for r in E.extract_projects(mails).collect()}
    p = found[1]
    assert (p["title"], p["location"], p["work_style"], p["start_date"]) == ("物流会社向け在庫管理の改修", "品川（基本フルリモート）", "基本フルリモート", "9月～長期")
    assert (p["rate_min"], p["rate_max"], p["interview_count"], p["headcount"]) == (65, 75, 1, 2)
    assert p["required_skills"] == ["Java", "PostgreSQL"] and p["preferred_skills"] == ["AWS", "TypeScript"]
    assert p["foreign_nationality_ng"] is True and p["commerce_flow_limit"] == "一社先まで"
    assert p["summary"] == "・在庫管理システムの改修\n・夜間処理の調査"
    assert p["source_company_name"] == "株式会社しぶき" and p["contact_name"] == "森" and p["needs_review"] is False
    assert (found[2]["title"], found[2]["needs_review"], found[2]["required_skills"]) == ("件名だけ", True, [])
    assert found[3]["title"] == "案件名未設定" and found[3]["needs_review"]
    assert found[4]["title"] == "B" and found[4]["contact_name"] == "Taro" and found[4]["required_skills"] == []


def test_talents(spark):
    rows = [(1, "◆【要員】◆ JAVA", TALENT, None), (2, "人材", "\n【氏　名】：山川\n【所　属】：フリーランス\n【稼　働】：即日\n【スキル】：Java / Spring\n", None),
            (3, "人材", "\n【営業コメント】リーダーもできます。\n【自己PR】AWSの構築もできます。\n", None)]
    found = {r["mail_id"]: r.asDict() for r in E.extract_talents(spark.createDataFrame(rows, "mail_id long, subject string, body string, from_header string")).collect()}
    t = found[1]
    assert (t["display_name"], t["affiliation"], t["age"], t["gender"], t["nearest_station"]) == ("KY", "フリーランス(なぎさ所属)", 31, "男性", "中野駅")
    assert (t["experience_years"], t["desired_rate"], t["available_from"], t["is_foreign_national"]) == (6, 70, "10月～", False)
    assert t["summary"] == "結合試験以降を一人で進められます。" and t["source_company_name"] == "株式会社なぎさ" and t["contact_name"] == "森"
    assert t["skills"] == ["Java", "Spring Boot", "結合試験", "システム試験", "リリース"] and not t["needs_review"]
    assert (found[2]["display_name"], found[2]["affiliation"], found[2]["available_from"], found[2]["summary"], found[2]["needs_review"]) == ("山川", "フリーランス", "即日", None, True)
    assert found[3]["summary"] == "リーダーもできます。\n\nAWSの構築もできます。" and found[3]["skills"] == ["AWS"]


def test_an_external_extraction_goes_first_where_it_says_something(spark, mails):
    external = spark.createDataFrame([(1, "別の題", "", ["COBOL"], False)], "mail_id long, title string, location string, required_skills array<string>, foreign_nationality_ng boolean")
    p = {r["mail_id"]: r for r in E.finish_projects(external, mails).collect()}
    assert (p[1]["title"], p[1]["location"], p[1]["required_skills"], p[1]["foreign_nationality_ng"]) == ("別の題", "品川（基本フルリモート）", ["Java", "PostgreSQL"], True)
    assert p[4]["title"] == "B"


def test_model_answers(spark):
    rows = [('{"ai_score": 7, "reason": "a"}',), ('```json\n{"ai_score": 8}\n```',), ("no",), (None,), ('x {"ai_score": "9"} y',)]
    found = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.model_answer(F.col("t"), "ai_score string, reason string")["ai_score"].try_cast("int")).collect()]
    assert found == [7, 8, None, None, 9]


def test_three_texts_of_html(spark):
    html = "<style>p{}</style><p>A</p><div>B&nbsp;&amp;</div><br/>C<li>D</li>"
    df = spark.createDataFrame([(html, "plain"), (" ", "plain"), (None, None)], "h string, p string")
    assert [r[0] for r in df.select(E.list_text(F.col("h"), F.col("p"))).collect()] == ["A\nB&nbsp;&amp;\nCD", "plain", ""]
    assert df.select(E.rules_text(F.col("h"))).first()[0].split() == ["A", "B", "&", "C", "D"]


SPEC = "【案件名】：在庫管理の改修\n【場所】：品川\n■内容\n・夜間処理の調査と改修、関係者との調整を含む"
NOISY = f"株式会社みなも ご担当者様\nいつもお世話になっております。\nなぎさの森です。\n下記にて案件情報をお送りいたします。\n\nーーー案件情報ーーー\n----------\n{SPEC}\n\n----------\n以上\n森　太郎\n電話番号：03-0000-0000\n■□■□"


def test_core_of_a_mail(spark):
    from tsunagi.functions import core_body as C

    one = lambda c, *texts: [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(c).collect()]
    t = F.col("t")
    assert one(C.spec_block(C.plain_text(t)), NOISY, "■案件名\nx", "", None) == [f"ーーー案件情報ーーー\n----------\n{SPEC}", None, None, None]
    said = "株式会社みなも\nお世話になっております。\n条件は応相談です、長い説明がここに続きます。\nよろしくお願いします\nx"
    assert one(C.trimmed_lines(t, F.array(F.lit("みなも"))), said, "", "よろしくお願い", "みなも 御中\n\n【場所】東京\n　みなも　\n続き") == ["条件は応相談です、長い説明がここに続きます。", "", "", "【場所】東京\n　みなも\n続き"]
    assert one(C.is_substantial(t), SPEC + "。" * 20, "【案件詳細】\n" + "x" * 200, "短い", None, "y" * 120, "y" * 119) == [True, False, False, False, True, False]
    ends = [SPEC + end for end in ("\n" + "-" * 8 + "\n\n【単価】70", "\n" + "-" * 8 + "\n森", "\n森　太郎\n090-1234-5678\nx", "\n株式会社みなも\n営業 森", "\n" + "_" * 8 + "\nhttps://x.com", "\nhttps://x.com\ny", "\n株式会社みなも\n続き")]
    cores = one(C.core_body(t, F.array(F.lit("別"))), *ends)
    assert [c[len(SPEC):] for c in cores] == ["\n" + "-" * 8 + "\n\n【単価】70", "", "", "", "", "", "\n株式会社みなも\n続き"]
    df = spark.createDataFrame([(NOISY, ["株式会社みなも"]), (None, None), ("", [])], "m string, n array<string>")
    assert [r[0] for r in df.select(C.core_body(F.col("m"), F.col("n"))).collect()] == [f"ーーー案件情報ーーー\n----------\n{SPEC}", "", ""]
    caches = [(f"[[core:v3]]\n{SPEC}" + "。" * 20,), (f"[[core:v2]]\n{SPEC}" + "。" * 20,), ("[[core:v3]]\nshort",), (None,)]
    assert [r[0] is not None for r in spark.createDataFrame(caches, "c string").select(C.cached_core(F.col("c"), "v3")).collect()] == [True, False, False, False]


def test_open_references_stay_where_closed_ones_are_asked_for(spark):
    from tsunagi.operators import mail

    df = spark.createDataFrame([("<p>a &ampB &amp; &#39;c&#39; &copyd & e&nbsp;f</p>",)], "h string")
    assert df.select(mail.html_text(F.col("h"), closed=True)).first()[0] == "a &ampB & 'c' &copyd & e f"
    assert df.select(mail.html_text(F.col("h"))).first()[0] == "a &B & 'c' ©d & e f"


def test_mails_of_one_file_are_dealt_out(spark, tmp_path):
    rows = [(i, "s", f"【氏　名】A{i}\n【ス キ ル】\n・Java\n●推薦コメント：{i}番\n【備考】よい", None) for i in range(40)]
    spark.createDataFrame(rows, "mail_id long, subject string, body string, from_header string").coalesce(1).write.parquet(str(tmp_path / "mails"))
    mails = spark.read.parquet(str(tmp_path / "mails"))
    assert mails.rdd.getNumPartitions() == 1 and len(E._read(mails).inputFiles()) > 1
    found = {r["mail_id"]: r for r in E.talent_rules(mails).collect()}
    assert len(found) == 40 and found[7]["display_name"] == "A7" and found[7]["skills"][0] == "Java" and found[7]["summary"] == "7番\n\nよい"
