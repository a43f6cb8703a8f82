"""Queries on what mails become: entities, companies, judged replies, texts of proposals, lists and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsunagi.functions import text as T
from tsunagi.functions.core_body import DIRTY, cached_core, core_body, is_substantial, is_whole_mail
from tsunagi.operators import companies as C
from tsunagi.operators import extraction as E
from tsunagi.operators import lists as L
from tsunagi.operators import matching as M
from tsunagi.operators import outreach as O
from tsunagi.operators import proposals as P
from tsunagi.operators import replies as J
from tsunagi.operators import retention as R
from tsunagi.operators import settings as S
from tsunagi.plans.outreach import _NEWEST, _PER_MATCH, _PER_PAIR, _VALID
from tsunagi.plans.pairs import LATEST
from tsunagi.plans.service import NOW
from tsunagi.sources.binding import Domain, split_list

_NONE = "CAST(NULL AS VARCHAR)"


def _text(name: str):
    return F.col(name).cast("string")


def _project_mails(d: Domain):
    """Mails that spell projects out, some with spaces in keys, amounts in yen, other names of fields, or none at all."""
    body = F.concat_ws(
        "\n", F.lit("お世話になっております。"), F.when(F.col("project_id") % 7 > 0, F.concat(F.lit("【案件名】："), "title")), F.concat(F.lit("【勤 務 地】 place "), (F.col("project_id") % 9).cast("string")),
        F.when(F.col("rate_min").isNotNull(), F.concat(F.lit("【単　価】"), F.format_number(F.col("rate_min") * 10000, 0), F.lit("円～"), F.coalesce(_text("rate_max"), F.lit("")), F.lit("万円"))),
        F.when(F.col("project_id") % 3 > 0, F.concat(F.lit("【必須スキル】\n・"), F.regexp_replace(F.nullif("required_skills", F.lit("")), ",", "\n・"))), F.concat(F.lit("【外国籍】"), F.when(F.col("foreign_nationality_ng"), "不可").when(~F.col("foreign_nationality_ng"), "可")),
        F.lit("【商流】：貴社一社先まで\n【業務内容】\nwork on it\n・と保守\nーーーーー\n以上、よろしくお願いします"),
    )
    return d.projects.select(F.col("project_id").alias("mail_id"), F.concat(F.lit(" subject "), _text("project_id")).alias("subject"), body.alias("body"), F.concat(F.lit("Taro "), _text("project_id"), F.lit(" <t@x.com>")).alias("from_header"))


def _talent_mails(d: Domain):
    body = F.concat_ws(
        "\n", F.concat(F.lit("【名　前】"), "display_name", F.lit("　"), F.when(F.col("affiliation").isin("正社員", "フリーランス"), F.col("affiliation")).otherwise("")), F.concat(F.lit("【年齢】"), (20 + F.col("talent_id") % 40).cast("string"), F.lit("歳")),
        F.lit("【性 別】男"), F.concat(F.lit("【単金】"), _text("desired_rate"), F.lit("～90万円")), F.concat(F.lit("【稼働】：\n"), F.nullif("available_from", F.lit(""))), F.concat(F.lit("【最寄駅】"), "nearest_station"),
        F.concat(F.lit("【国籍】"), F.when(F.col("is_foreign_national"), "外国籍").when(~F.col("is_foreign_national"), "日本国籍").otherwise("？")), F.when(F.col("talent_id") % 4 > 0, F.lit("【備考】\n一人で進められます。")), F.lit("以上、よろしく"),
    )
    return d.talents.select(F.col("talent_id").alias("mail_id"), F.lit("talent").alias("subject"), body.alias("body"), F.lit(None).cast("string").alias("from_header"))


def f41_extract_projects(d: Domain):
    return E.extract_projects(_project_mails(d)).select("mail_id", "title", "location", "rate_min", "rate_max", F.array_join("required_skills", ",").alias("skills"), "foreign_nationality_ng", "commerce_flow_limit", "contact_name", "summary", "needs_review")


def f42_extract_talents(d: Domain):
    return E.extract_talents(_talent_mails(d)).select("mail_id", "display_name", "affiliation", "age", "gender", "desired_rate", "available_from", "nearest_station", "is_foreign_national", "summary", "needs_review")


def f43_finished_projects(d: Domain):
    external = d.projects.select(F.col("project_id").alias("mail_id"), F.when(F.col("project_id") % 2 == 0, F.concat(F.lit("given "), _text("project_id"))).alias("title"), F.lit("").alias("location"), F.lit(False).alias("foreign_nationality_ng"))
    return E.finish_projects(external, _project_mails(d)).select("mail_id", "title", "location", "foreign_nationality_ng", E.entity_status(F.col("needs_review"), "project").alias("status"))


def f34_list_texts(d: Domain):
    return d.base("pages").select("page_id", F.sha2(E.list_text(F.col("html"), F.lit("plain")), 256).alias("list_sha256"), F.sha2(E.rules_text(F.coalesce("html", F.lit(""))), 256).alias("rules_sha256"))



def _company_mails(d: Domain):
    """Mails of known domains, known names, and of companies that are new."""
    n = F.col("email_id")
    domain = F.when(n % 4 == 0, F.concat(F.lit("new"), (n % 30).cast("string"), F.lit(".example.com"))).when(n % 4 == 1, F.lit(None).cast("string")).otherwise(F.element_at(F.split("from_address", "@"), 2))
    mails = d.emails.join(d.companies.select(F.col("company_id").alias("source_company_id"), F.col("name").alias("known_name"), F.col("domain").alias("known_domain")), "source_company_id", "left")
    return mails.select(
        n.alias("mail_id"), F.when(n % 2 == 0, "introducer").otherwise("distributor").alias("kind"), F.when(n % 4 == 1, F.col("known_name")).when(n % 4 == 2, F.concat(F.lit(" Firm "), (n % 9).cast("string"))).alias("name"),
        F.when(n % 4 == 3, F.upper("known_domain")).when(n % 4 == 0, F.regexp_replace(domain, ">", "")).alias("domain"), F.concat(F.lit("U"), (n % 50).cast("string"), F.lit("@x.example.com")).alias("email"), n.alias("seq"),
    )


_MAILS = """mails AS (SELECT email_id AS mail_id, email_id AS seq, CASE WHEN email_id % 2 = 0 THEN 'introducer' ELSE 'distributor' END AS kind,
        CASE email_id % 4 WHEN 1 THEN c.name WHEN 2 THEN 'Firm ' || (email_id % 9) END AS name, nullif(CASE email_id % 4 WHEN 3 THEN c.domain WHEN 0 THEN 'new' || (email_id % 30) || '.example.com' END, '') AS domain, 'u' || (email_id % 50) || '@x.example.com' AS email
        FROM emails LEFT JOIN companies c ON c.company_id = source_company_id),
    linked AS (SELECT m.*, CASE WHEN m.name IS NULL THEN coalesce(m.domain, 'x.example.com') ELSE m.name END AS n FROM mails m),
    keyed AS (SELECT l.*, coalesce((SELECT min(company_id) FROM companies c WHERE c.domain <> '' AND c.domain = l.domain), (SELECT min(company_id) FROM companies c WHERE c.name = l.n)) AS known FROM linked l),
    grouped AS (SELECT coalesce(CAST(known AS VARCHAR), coalesce(domain, n)) AS k, any_value(known) AS known, arg_min(n, seq) AS n, arg_min(domain, seq) AS domain, arg_min(email, seq) AS email, bool_or(kind = 'introducer') AS i, bool_or(kind = 'distributor') AS d FROM keyed GROUP BY 1),
    after AS (SELECT CASE WHEN c.company_id IS NULL THEN g.n WHEN coalesce(c.name, '') = '' OR c.name = c.domain THEN coalesce(g.n, c.name) ELSE c.name END AS name,
        CASE WHEN (coalesce(c.kind IN ('introducer', 'both'), false) OR coalesce(i, false)) AND (coalesce(c.kind IN ('distributor', 'both'), false) OR coalesce(d, false)) THEN 'both' WHEN coalesce(c.kind IN ('introducer', 'both'), false) OR coalesce(i, false) THEN 'introducer' ELSE 'distributor' END AS kind,
        coalesce(nullif(c.domain, ''), g.domain) AS domain, coalesce(nullif(c.default_email, ''), g.email) AS default_email FROM companies c FULL JOIN grouped g ON g.known = c.company_id)"""


def f25_upserted_companies(d: Domain):
    return C.upsert_companies(_company_mails(d), d.companies).drop("company_id")


def f26_upserted_contacts(d: Domain):
    mails = d.emails.select(F.col("email_id").alias("mail_id"), (F.col("email_id") % 25).alias("company_id"), F.when(F.col("email_id") % 3 == 0, F.concat(F.lit(" N"), _text("email_id"))).alias("name"),
        F.concat(F.lit("USER"), (F.col("email_id") % 300).cast("string"), F.lit("@mail"), (F.col("email_id") % 300 % 7).cast("string"), F.lit(".example.com")).alias("email"), "from_address", F.col("email_id").alias("seq")).withColumnRenamed("from_address", "from_header")
    return C.upsert_contacts(mails, d.contacts).drop("contact_id")


def f27_relinked_talents(d: Domain):
    links = d.emails.select("email_id", (F.col("email_id") % 30).alias("company_id"))
    return C.relink(d.talents, links, d.companies, "introducer_company_id").select("talent_id", "introducer_company_id", "source_company_name")


def f33_company_keys(d: Domain):
    name = F.concat(F.lit("株式会社 "), F.initcap("name"), F.lit("　"), F.col("company_id").cast("string"))
    return d.companies.select("company_id", C.company_key(name).alias("key"), F.array_join(C.name_variants(name), "|").alias("variants"))


def j07_backfilled(d: Domain):
    return C.backfilled_names(d.projects, d.companies).select("project_id", "source_company_name")


def j13_source_party(d: Domain):
    mails = d.emails.withColumn("from_address", F.concat(F.lit(" USER"), (F.col("email_id") % 150).cast("string"), F.lit("@mail"), (F.col("email_id") % 150 % 7).cast("string"), F.lit(".example.com")))
    return C.source_party(mails, d.companies, d.contacts, F.when(F.col("email_id") % 2 == 0, " fallback "))


def j17_project_matches(d: Domain):
    incoming = d.projects.select((F.col("project_id") + 5_000_000).alias("incoming_id"), F.upper("title").alias("title"), F.when(F.col("source_company_name") == "", F.concat(F.lit(" "), F.lit("nation "), _text("distributor_company_id"))).otherwise(F.col("source_company_name")).alias("source_company_name"))
    return C.project_matches(incoming, d.projects, d.companies.withColumn("name", F.concat(F.lit("NATION  "), _text("company_id"))))


def f49_keywords(d: Domain):
    setting = F.concat(F.lit(" 前向き, "), F.col("key"), F.lit("\nOK\n,ok"))
    return d.settings.select("key", F.array_join(J.with_builtin(J.keywords(setting), T.OK_WORDS), "|").alias("words"))


def f52_item_numbers(d: Domain):
    titles = J.item_titles(d.messages, d.message_talents, d.talents, d.projects)
    return d.messages.join(titles, "message_id").select("message_id", "item_title", J.item_number(F.col("body_text"), F.col("item_title")).alias("number"))


def _judged(d: Domain):
    # replies with a mail of their own; one mail may come as several of them
    mails = d.replies.filter("gmail_message_id like 'r%'").select("message_id", F.col("gmail_message_id").alias("mail_id"), F.col("body_text").alias("body"), "reply_id")
    external = mails.filter("reply_id % 10 = 1").select("message_id", "mail_id", F.when(F.col("reply_id") % 20 == 1, " OK ").when(F.col("reply_id") % 30 == 11, "見送り").otherwise("?").alias("answer"))
    return J.judge_replies(d.messages, J.item_titles(d.messages, d.message_talents, d.talents, d.projects), mails.drop("reply_id").distinct(), external.distinct(), *(F.array(*[F.lit(w) for w in words]) for words in (T.OK_WORDS, T.NG_WORDS)))


def f54_rejudged(d: Domain):
    return J.rejudged(d.replies, _judged(d)).select("reply_id", "judgment")


def f56_set_by_hand(d: Domain):
    chosen = O.sent(d.messages).groupBy("thread_id").agg(F.min("message_id").alias("message_id")).select("message_id", F.lit("ok").alias("judgment"))
    return J.set_by_hand(chosen, d.messages, d.replies, d.emails, F.lit(NOW).cast("timestamp")).select("message_id", "gmail_message_id", "judgment", "judgment_source")


def f18_proposal_flows(d: Domain):
    return P.proposal_flows(d.talents, F.lit("Company 7"), "source_company_name", "affiliation", "commerce_flow").select("talent_id", "flow")


def f19_labels(d: Domain):
    depth = F.when(F.col("project_id") % 6 < 5, F.col("project_id") % 6).cast("int")
    return d.projects.select("project_id", P.limit_label(F.when(F.col("project_id") % 4 == 0, " x "), depth).alias("limit_label"), P.reject_label(F.when(F.col("foreign_nationality_ng"), "foreign_nationality")).alias("reject_label"), P.nationality_label(F.col("foreign_nationality_ng")).alias("nationality"))


def f30_proposal_cc(d: Domain):
    header = F.array(F.concat(F.lit(" <A"), (F.col("email_id") % 5).cast("string"), F.lit("@x.com>")), F.lit("none"), F.lit("b@x.com"))
    body = F.concat(F.lit("本文\nCC: c@x.com, a"), (F.col("email_id") % 3).cast("string"), F.lit("@x.com\n\nz@x.com"))
    return d.emails.select("email_id", F.array_join(P.proposal_cc(header, body, F.array(F.lit("B@X.com"), F.lit(""))), ",").alias("cc"))


def f31_file_names(d: Domain):
    mime = F.when(F.col("sheet_id") % 4 == 1, "application/pdf").when(F.col("sheet_id") % 4 == 2, "application/vnd.ms-excel")
    name = F.when(F.col("sheet_id") % 4 == 0, F.concat(F.lit("経 歴:"), "filename")).when(F.col("sheet_id") % 4 == 3, "photo")
    return d.sheets.select("sheet_id", P.stored_name(F.lit(" A/B  c. "), F.col("talent_id"), name, mime).alias("stored"), P.attachment_name(F.lit("x"), P.extension(name, mime), (F.col("sheet_id") % 3).cast("int")).alias("attached"), P.is_sheet(name, mime).alias("is_sheet"), P.folder_name(F.lit(None).cast("string")).alias("folder"))


def s11_sheet_rows(d: Domain):
    files = d.sheets.select("talent_id", F.col("sheet_id").alias("attachment_id"), F.when(F.col("sheet_id") % 2 == 0, F.col("filename")).otherwise("photo.png").alias("filename"), F.lit(None).cast("string").alias("mime"))
    link = F.concat(F.lit("see https://docs.google.com/spreadsheets/d/ab_"), (F.col("talent_id") % 50).cast("string"), F.lit("/edit"))
    known = d.sheets.filter("sheet_id % 5 = 0").select("talent_id", F.col("sheet_id").cast("string").alias("source"))
    return P.sheet_rows(d.talents, files, d.talents.select("talent_id", link.alias("body_text"), link.alias("body_html")), known)


def f59_project_bodies(d: Domain):
    """One body a talent: its best matches of the latest run."""
    best = M.matches_of_latest(d.matches, d.match_runs).select("talent_id", "project_id", "score").join(d.projects, "project_id").withColumns({"required_skills": split_list("required_skills"), "core_body": F.when(F.col("project_id") % 5 == 0, " core "), "recommendation_points": F.lit(None).cast("string"), "working_hours": F.lit(" "), "settlement_range": F.lit("140-180"), "commerce_flow_limit": F.lit(None).cast("string"), "interview_count": (F.col("project_id") % 3).cast("int"), "summary": F.lit(None).cast("string")})
    parties = d.talents.select("talent_id", F.col("source_company_name").alias("company_name"), F.lit("").alias("contact_name"))
    return P.proposal_bodies(best, "talent_id", "{{company_name}} {{contact_name}}様 ", [F.col("score").desc(), F.col("project_id")], P.project_item(F.col("number"), 2), parties)


def f59_talent_bodies(d: Domain):
    """One body a project: the talents of its matches of the latest run, with what was said of them."""
    best = M.matches_of_latest(d.matches, d.match_runs).select("talent_id", "project_id", "score", "recommendation_points").join(d.talents.withColumn("skills", split_list("skills")), "talent_id")
    parties = d.projects.select("project_id", F.col("source_company_name").alias("company_name"), F.lit(None).cast("string").alias("contact_name"))
    return P.proposal_bodies(best, "project_id", "{{company_name}} {{contact_name}}様\n{{items}}\n以上", [F.col("score").desc(), F.col("talent_id")], P.talent_item(F.col("number")), parties)


def f60_subjects(d: Domain):
    subject = F.when(F.col("email_id") % 3 == 0, "RE: x").when(F.col("email_id") % 3 == 1, "")
    mail = F.when(F.col("email_id") % 5 == 0, "manual-1").otherwise(F.col("gmail_message_id"))
    return d.emails.select("email_id", P.reply_subject(subject, F.when(F.col("email_id") % 2 == 0, "title")).alias("subject"), P.cannot_reply(F.col("email_id"), mail, F.when(F.col("email_id") % 7 > 0, F.col("thread_key"))).alias("warning"))


def f64_sheet_texts(d: Domain):
    texts = d.base("documents").select("doc_id", "text")
    return texts.select("doc_id", F.sha2(F.coalesce(P.trimmed(F.col("text"), 6000), F.lit("-")), 256).alias("prompt_sha256"), P.needs_extraction(F.when(F.col("doc_id") % 3 == 0, "failed").when(F.col("doc_id") % 3 == 1, "ok"), F.when(F.col("doc_id") % 4 > 0, F.lit("x"))).alias("needed"))


def _good():
    return F.when(F.col("score") > 80, "Good Fit")


def _judgment(side: str):
    return F.regexp_extract(F.coalesce(f"status_{side}", F.lit("")), "^reply_(.*)$", 1)


def _project_rows(d: Domain, named: DataFrame):
    """Matches of the latest run that are in `named`, with their status."""
    found = O.pair_status(M.matches_of_latest(named, d.match_runs), d.messages, d.message_talents, d.replies, d.emails, few=True)
    return found.withColumns({"judgment_project": _judgment("project"), "judgment_talent": _judgment("talent"), "reason": _good()})


def p04_project_matches(d: Domain):
    """Talents are filtered first, then their matches, and only what is left is told how the project's side stands."""
    from tsunagi.operators import search as Q
    from tsunagi.sources.staging import staged

    people = Q.with_sheet_flag(d.talents, d.sheets).select("talent_id", "display_name", "affiliation", "source_company_name", "summary", "skills", "desired_rate", "has_sheet")
    people = L.project_match_filter(people.withColumn("reason", F.lit(None).cast("string")), "", ["Java"], 45, 80, with_sheet=True).drop("reason")
    people = staged(L.with_own_words(people, "good fit"))
    rows = M.matches_of_latest(d.matches_among(people), d.match_runs).select(*M.PAIR, "match_id", "score", _good().alias("reason"))
    found = L.project_match_filter(rows.join(people.hint("shuffle_hash"), "talent_id"), "good fit").select(*M.PAIR, "match_id", "score")
    told = O.project_status(found, d.messages, d.message_talents, O.latest_reply(O.valid_replies(d.replies, d.messages, d.emails)))
    return told.filter(L.side_proposed(F.col("status_project"), "no") & L.side_ok(_judgment("project"), "no")).select("match_id", "score")


def p05_talent_matches(d: Domain):
    """Matches that were proposed to a project: only those that a sent proposal names can be, so no others are made."""
    work = d.projects.select("project_id", "title", F.lit("Tokyo").alias("location"), "source_company_name", "required_skills", "rate_min", "rate_max")
    named = d.matches_named(O.latest_per_match(d.messages))
    return L.talent_match_filter(_project_rows(d, named).join(work, "project_id"), " TOKYO", ["Docker"], 60, 75, "yes", "no").select("match_id", "status_talent")


def t04_sorted_matches(d: Domain):
    """The first places of three orders, as the numbers that they have there."""
    from pyspark.sql import Window

    made = lambda t=None, p=None: M.matches_of_latest(d.matches_among(t, p), d.match_runs)
    people = d.talents.select("talent_id", F.nullif(F.trim("affiliation"), F.lit("")).alias("affiliation"))
    orders = (("ai_score", L.list_order("ai_score", True, True), None), ("rate_min", L.list_order("rate_min"), d.projects.select("project_id", "rate_min")), ("affiliation", L.list_order("affiliation", True), people))
    found = None
    for name, order, ids in orders:
        best = made().select("match_id", name).orderBy(order, "match_id").limit(200) if ids is None else M.first_places(made, ids, name, order, 200)
        top = best.select("match_id", F.lit(name).alias("sorted_by"), F.row_number().over(Window.orderBy(order, "match_id")).alias("place"))  # of 200 rows
        found = top if found is None else found.unionByName(top)
    return found


def j20_talent_list(d: Domain):
    stats = O.talent_statistics(d.messages, d.matches, d.replies, d.emails)
    return L.enriched_talents(d.talents, stats, d.sheets, d.companies, d.emails).select("talent_id", "company_name", "has_sheet", "n_proposed", "n_ok", "received_at")


def j22_skill_list(d: Domain):
    return L.skill_list(d.skills, d.categories)


def a13_skill_catalog(d: Domain):
    return L.skill_catalog(d.skills, d.categories).select("category_id", "label", "sort_order", F.array_join("options", ",").alias("options"), "n_skills")


def f62_display_matches(d: Domain):
    skills = d.talents.select(F.col("talent_id").alias("id"), F.posexplode(split_list("skills")).alias("at", "skill"))
    wanted = d.projects.select((F.col("project_id") % 50).alias("id"), F.explode(split_list("required_skills")).alias("wanted")).distinct()
    found = L.display_matches(skills, wanted)
    return found.groupBy("id").agg(F.count_if("matched").alias("n_matched"), F.count_if(~F.col("matched")).alias("n_others"))


def f62_by_catalog(d: Domain):
    catalog = d.skills.groupBy("category_id").agg(F.array_sort(F.collect_list("name")).alias("options")).join(d.categories, "category_id").select("options", F.col("name").alias("label"), "sort_order")
    lists = d.companies.select(F.col("company_id").alias("id"), F.array("name", F.lit("XYZ"), F.concat("name", F.lit(" 2"))).alias("skills"))
    return L.by_catalog(lists, catalog).select("id", "label", F.array_join("items", ",").alias("items"))


def s06_settings(d: Domain):
    found = S.with_settings(d.companies.select("company_id"), d.settings)
    return found.select("company_id", F.coalesce(F.col("settings")[F.concat(F.lit("key-"), (F.col("company_id") * 2).cast("string"))], F.lit("none")).alias("value"))


def s07_bounded(d: Domain):
    return d.settings.select("key", S.bounded(F.col("value"), S.SCORE_MIN).alias("score_min"), S.bounded(F.col("value"), S.TOP_N).alias("top_n"), R.retention_days(F.col("value"), 7).alias("days"))


def s09_appended_run(d: Domain):
    """The pairs of a new run, written beside those of older runs by run, and read back."""
    from tsunagi.sources.staging import new_folder

    folder = new_folder(d.spark)
    columns = ["run_id", "talent_id", "project_id", "score"]
    d.matches.select(columns).write.partitionBy("run_id").parquet(folder)
    M.rescored(d.talents, d.projects, d.matches).select(F.lit(99).cast("long").alias("run_id"), *columns[1:]).write.mode("append").partitionBy("run_id").parquet(folder)
    return d.spark.read.schema("talent_id long, project_id long, score int, run_id long").parquet(folder).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def s05_job_log(d: Domain):
    """Events as lines of JSON, of which some are broken, read as a job log."""
    from tsunagi.sources.staging import new_folder

    folder = new_folder(d.spark)
    line = F.to_json(F.struct(F.col("ts").alias("timestamp"), F.lit("INFO").alias("level"), F.col("event_type").alias("event"), _text("user_id").alias("job_id"), F.col("event_id").alias("duration_ms")))
    d.base("events").select(F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(line)).write.text(folder)
    return S.job_log(d.spark, folder).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("ms"))


def p10_manual_mails(d: Domain):
    entries = d.talents.select(F.col("talent_id").alias("entry_id"), F.lit("talent").alias("kind"), F.when(F.col("talent_id") % 3 > 0, F.concat(F.lit(" "), "display_name")).alias("title"), F.when(F.col("talent_id") % 2 == 0, " ").otherwise(F.col("summary")).alias("body"), F.when(F.col("talent_id") % 4 == 0, " A@x.Com").when(F.col("talent_id") % 4 == 1, "broken").alias("sender"))
    return S.manual_mails(entries, F.lit(NOW).cast("timestamp")).select("entry_id", "gmail_message_id", "from_address", "subject", "body_text", "plausible")


def j19_commute(d: Domain):
    pairs = d.talents.select("talent_id", F.regexp_replace("nearest_station", " ", "　").alias("origin"), F.when(F.col("talent_id") % 6 > 0, F.concat(F.lit("Client "), (F.col("talent_id") % 15).cast("string"))).alias("destination"))
    return S.commute(pairs, d.commute_cache).groupBy("talent_id").agg(F.max("minutes").alias("minutes"), F.max("status").alias("status"))


def f39_places(d: Domain):
    return d.talents.select("talent_id", S.place_key(F.col("nearest_station")).alias("key"), S.address_query(F.col("nearest_station"), True).alias("query"), S.duration_seconds(F.concat(_text("talent_id"), F.when(F.col("talent_id") % 2 == 0, "s").otherwise("m"))).alias("seconds"))


def f13_judge_answers(d: Domain):
    answer = F.when(F.col("match_id") % 4 == 0, F.concat(F.lit('```json\n{"ai_score": '), (F.col("score") + 30).cast("string"), F.lit(', "reason": " fits "}\n```'))).when(F.col("match_id") % 4 == 1, '{"ai_score": "x", "recommendation_points": "p"}').when(F.col("match_id") % 4 == 2, "no answer")
    rows = M.matches_of_latest(d.matches, d.match_runs).join(d.talents.select("talent_id", split_list("skills").alias("have")), "talent_id").join(d.projects.select("project_id", split_list("required_skills").alias("wanted")), "project_id")
    return S.judge_answers(rows.withColumn("answer", answer)).select("match_id", "ai_score", "reason")


def f63_texts(d: Domain):
    return d.projects.select("project_id", L.filter_rate(F.col("rate_min") * 1500).cast("int").alias("rate"), S.eta_text(F.col("project_id") * 37 - 50).alias("eta"))


def _spec(d: Domain):
    fields = F.concat(F.lit("【案件名】："), "title", F.lit("\n■内容\n・夜間処理の調査と改修、関係者との調整を含む長い仕事 "), (F.col("project_id") % 13).cast("string"), F.lit("\n【場所】品川"))
    return d.projects.withColumn("spec", F.concat(F.lit("ーーー案件情報ーーー\n----------\n"), fields))


def f46_core_bodies(d: Domain):
    greeting = F.concat(F.lit("株式会社みなも ご担当者様\nいつもお世話になっております。\n下記にて案件情報をお送りいたします。\n\n"), F.when(F.col("project_id") % 2 == 0, "★注目\n").otherwise(""))
    mails = _spec(d).select("project_id", F.concat(greeting, "spec", F.when(F.col("project_id") % 3 == 0, "\n\n----------\n").otherwise("\n"), F.lit("以上\n森　太郎\n電話番号：03-0000-0000\n■□■□")).alias("mail"))
    return mails.select("project_id", core_body(F.col("mail"), F.array(F.lit("株式会社みなも"))).alias("core"))


def f47_body_flags(d: Domain):
    """Which texts of pages still look like whole mails, and which have no fields and too little text; every second one is
    made of fields."""
    text = E.list_text(F.col("html"), F.lit(None).cast("string"))
    fields = F.concat(F.lit("【場所】"), F.col("url"), F.lit("\n■単価 "), F.repeat(F.lit("x"), F.col("page_id").cast("int") % 60), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("\n◆"), F.lit("y"))).otherwise(""))
    text = F.when(F.col("page_id") % 2 == 0, fields).otherwise(text)
    return d.base("pages").select("page_id", is_whole_mail(text).alias("whole_mail"), (~is_substantial(text)).alias("empty"))


def f48_cached_cores(d: Domain):
    cache = F.concat(F.when(F.col("project_id") % 3 == 0, "[[core:v2]]\n").otherwise("[[core:v3]]\n"), F.when(F.col("project_id") % 4 == 0, "short").otherwise(F.col("spec")))
    return _spec(d).select("project_id", cached_core(cache, "v3").isNotNull().alias("fresh"))


_JUDGE = """CASE WHEN seg IS NOT NULL THEN CASE WHEN seg LIKE '%辞退%' OR seg LIKE '%見送り%' THEN 'ng' WHEN seg LIKE '%前向き%' OR seg LIKE '%進めさせて%' THEN 'ok' ELSE 'unknown' END
    WHEN e IN (0, 1) THEN 'unknown' WHEN e = 2 THEN 'ok' WHEN e = 5 THEN 'ng' ELSE 'unknown' END"""
_ITEMS = """items AS (SELECT message_id, CASE WHEN kind = 'talent_proposal' THEN p.title ELSE (SELECT t.display_name FROM talents t WHERE t.talent_id = l.t) END AS item_title,
        CASE WHEN kind = 'talent_proposal' AND p.title IS NOT NULL AND body_text NOT LIKE 'Please%' THEN CASE WHEN body_text LIKE '【1】Other%' THEN 2 ELSE 1 END END AS number
        FROM messages m LEFT JOIN projects p USING (project_id) LEFT JOIN (SELECT message_id, min(talent_id) AS t FROM message_talents GROUP BY 1) l USING (message_id))"""
_LIST = "coalesce(html, '')"
for _p, _w in ((r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", ""), (r"(?i)<br\s*/?>|</p\s*>", "\n"), (r"(?s)<[^>]+>", ""), (r"\n{3,}", "\n\n"), (r"^[\s　]+|[\s　]+$", "")):
    _LIST = f"regexp_replace({_LIST}, '{_p}', '{_w}', 'g')"
_RULES = "html"
for _p, _w in ((r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", " "), (r"(?i)<br\s*/?>|</p\s*>|</div\s*>", "\n"), (r"<[^>]+>", " ")):
    _RULES = f"regexp_replace({_RULES}, '{_p}', '{_w}', 'g')"
for _p, _w in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#12288;", "　")):
    _RULES = f"replace({_RULES}, '{_p}', '{_w}')"
for _p, _w in ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^[\s　]+|[\s　]+$", "")):
    _RULES = f"regexp_replace({_RULES}, '{_p}', '{_w}', 'g')"
_STATUS = f"""{_PER_MATCH}, {_PER_PAIR}, {_VALID}, {_NEWEST.format('valid')},
    st AS (SELECT m.*, CASE WHEN t.message_id IS NOT NULL THEN coalesce('reply_' || a.judgment, 'talent_sent') END AS status_talent, CASE WHEN p.message_id IS NOT NULL THEN coalesce('reply_' || b.judgment, 'project_sent') END AS status_project
        FROM (SELECT * FROM matches WHERE run_id = {LATEST}) m LEFT JOIN (SELECT match_id, message_id FROM per_match) t USING (match_id)
        LEFT JOIN (SELECT project_id, talent_id, message_id FROM per_pair) p ON p.project_id = m.project_id AND p.talent_id = m.talent_id LEFT JOIN answers a ON a.message_id = t.message_id LEFT JOIN answers b ON b.message_id = p.message_id)"""

QUERIES = {
    f41_extract_projects: """WITH s AS (SELECT project_id, unnest(string_split(required_skills, ',')) AS raw, unnest(range(len(string_split(required_skills, ',')))) AS i FROM projects WHERE project_id % 3 > 0 AND required_skills <> ''),
        x AS (SELECT project_id, t, min(i * 10 + k) AS i FROM s, LATERAL (SELECT unnest(CASE raw WHEN 'k8s' THEN ['Kubernetes'] WHEN 'Ｊａｖａ' THEN ['Java'] WHEN 'Java開発の経験5年' THEN ['Java'] WHEN '結合試験以降のご経験' THEN ['結合試験', 'システム試験', 'リリース'] ELSE [raw] END) AS t, unnest([0, 1, 2]) AS k) WHERE t IS NOT NULL GROUP BY ALL),
        l AS (SELECT project_id, string_agg(t, ',' ORDER BY i) AS skills FROM x GROUP BY 1)
        SELECT project_id AS mail_id, CASE WHEN project_id % 7 > 0 THEN title ELSE 'subject ' || project_id END AS title, 'place ' || (project_id % 9) AS location, rate_min, CASE WHEN rate_min IS NOT NULL THEN coalesce(rate_max, rate_min) END AS rate_max, coalesce(skills, '') AS skills,
        foreign_nationality_ng, '貴社一社先まで' AS commerce_flow_limit, 'Taro ' || project_id AS contact_name, 'work on it' || chr(10) || '・と保守' AS summary, skills IS NULL AS needs_review FROM projects LEFT JOIN l USING (project_id)""",
    f42_extract_talents: """SELECT talent_id AS mail_id, display_name, CASE WHEN affiliation IN ('正社員', 'フリーランス') THEN affiliation END AS affiliation, CAST(20 + talent_id % 40 AS INT) AS age, '男性' AS gender, desired_rate, nullif(available_from, '') AS available_from,
        nearest_station, is_foreign_national, CASE WHEN talent_id % 4 > 0 THEN '一人で進められます。' END AS summary, talent_id % 4 = 0 AS needs_review FROM talents""",
    f43_finished_projects: """SELECT project_id AS mail_id, CASE WHEN project_id % 2 = 0 THEN 'given ' || project_id WHEN project_id % 7 > 0 THEN title ELSE 'subject ' || project_id END AS title, 'place ' || (project_id % 9) AS location,
        coalesce(foreign_nationality_ng, false) AS foreign_nationality_ng, CASE WHEN project_id % 3 > 0 AND required_skills <> '' THEN 'open' ELSE 'closed' END AS status FROM projects""",
    f34_list_texts: f"SELECT page_id, sha256(CASE WHEN {_LIST} = '' THEN 'plain' ELSE {_LIST} END) AS list_sha256, sha256(CASE WHEN html LIKE '%<%' AND html LIKE '%>%' THEN {_RULES} ELSE coalesce(html, '') END) AS rules_sha256 FROM pages",
    f25_upserted_companies: f"WITH {_MAILS} SELECT * FROM after",
    f26_upserted_contacts: """WITH m AS (SELECT email_id AS seq, email_id % 25 AS company_id, CASE WHEN email_id % 3 = 0 THEN 'N' || email_id ELSE 'User ' || talent_id END AS said, 'user' || (email_id % 300) || '@mail' || (email_id % 300 % 7) || '.example.com' AS address FROM emails),
        n AS (SELECT address, arg_max(company_id, seq) AS company_id, arg_max(said, seq) AS said FROM m GROUP BY 1)
        SELECT coalesce(n.company_id, c.company_id) AS company_id, coalesce(said, c.name) AS name, coalesce(c.email, address) AS email, said IS NOT NULL OR is_active AS is_active FROM contacts c FULL JOIN n ON address = email""",
    f27_relinked_talents: """SELECT talent_id, coalesce(c.company_id, introducer_company_id) AS introducer_company_id, coalesce(c.name, source_company_name) AS source_company_name FROM talents t
        LEFT JOIN (SELECT email_id, email_id % 30 AS k FROM emails) e USING (email_id) LEFT JOIN companies c ON c.company_id = k""",
    f33_company_keys: """WITH n AS (SELECT company_id, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || '　' || company_id AS bare FROM companies)
        SELECT company_id, lower(replace(replace(bare, ' ', ''), '　', '')) AS key, '株式会社 ' || bare || '|' || bare || '|株式会社' || bare || '|（株）' || bare || '|(株)' || bare || '|㈱' || bare AS variants FROM n""",
    j07_backfilled: "SELECT project_id, CASE WHEN source_company_name = '' THEN coalesce(c.name, '') ELSE source_company_name END AS source_company_name FROM projects LEFT JOIN companies c ON company_id = distributor_company_id",
    j13_source_party: """SELECT e.email_id, coalesce(nullif(trim(c.name), ''), CASE WHEN e.email_id % 2 = 0 THEN 'fallback' END, '（企業名なし）') AS company_name, coalesce(p.name, 'ご担当者') AS contact_name FROM emails e
        LEFT JOIN companies c ON c.company_id = e.source_company_id LEFT JOIN contacts p ON p.email = 'user' || (e.email_id % 150) || '@mail' || (e.email_id % 150 % 7) || '.example.com'""",
    j17_project_matches: "SELECT project_id + 5000000 AS incoming_id, project_id AS existing_project_id FROM projects",
    f49_keywords: f"SELECT key, '前向き|' || key || '|OK|{'|'.join(w for w in T.OK_WORDS if w != '前向き')}' AS words FROM settings",
    f52_item_numbers: f"WITH {_ITEMS} SELECT message_id, item_title, CAST(number AS INT) AS number FROM items",
    f54_rejudged: f"""WITH {_ITEMS}, r AS (SELECT r.*, number, r.reply_id % 6 AS e, CASE WHEN r.reply_id % 6 = 0 AND number = 1 THEN '辞退' WHEN r.reply_id % 6 = 0 AND number = 2 THEN '前向き' WHEN r.reply_id % 6 = 1 AND number = 2 THEN '見送り' END AS seg FROM replies r JOIN items USING (message_id)),
        j AS (SELECT reply_id, message_id, gmail_message_id, judgment_source, judgment, coalesce(CASE WHEN reply_id % 20 = 1 THEN 'ok' WHEN reply_id % 30 = 11 THEN 'ng' END, {_JUDGE}) AS new FROM r)
        SELECT reply_id, CASE WHEN judgment_source = 'auto' AND gmail_message_id LIKE 'r%' THEN new ELSE judgment END AS judgment FROM j""",
    f56_set_by_hand: f"""WITH {_VALID}, {_NEWEST.format('valid')}, c AS (SELECT thread_id, min(message_id) AS message_id FROM messages WHERE status = 'sent' GROUP BY 1), p AS (SELECT c.message_id, a.reply_id FROM c LEFT JOIN answers a USING (message_id))
        SELECT message_id, gmail_message_id, CASE WHEN reply_id IN (SELECT reply_id FROM p) THEN 'ok' ELSE judgment END AS judgment, CASE WHEN reply_id IN (SELECT reply_id FROM p) THEN 'manual' ELSE judgment_source END AS judgment_source FROM replies
        UNION ALL SELECT message_id, 'manual:' || message_id, 'ok', 'manual' FROM p WHERE reply_id IS NULL""",
    f18_proposal_flows: """SELECT talent_id, CASE WHEN lower(replace(coalesce(source_company_name, ''), ' ', '')) = 'company7' THEN 'プロパー' ELSE (CASE WHEN commerce_flow = '二社先' THEN '三社先' WHEN commerce_flow = '一社先' THEN '二社先' WHEN affiliation LIKE '一社先%' THEN '二社先' ELSE '一社先' END)
        || CASE WHEN affiliation = '正社員' THEN '正社員' WHEN affiliation LIKE '%フリーランス' THEN 'フリーランス' ELSE '' END END AS flow FROM talents""",
    f19_labels: """SELECT project_id, CASE WHEN project_id % 4 = 0 THEN 'x' ELSE CASE project_id % 6 WHEN 0 THEN 'エンド直 / 貴社まで' WHEN 1 THEN '一社先まで' WHEN 2 THEN '二社先まで' WHEN 3 THEN '三社先まで' WHEN 4 THEN '深度4まで' ELSE '制限なし / 不明' END END AS limit_label,
        CASE WHEN foreign_nationality_ng THEN '外国籍不可のため除外' END AS reject_label, CASE WHEN foreign_nationality_ng THEN '外国籍' WHEN NOT foreign_nationality_ng THEN '日本国籍' END AS nationality FROM projects""",
    f30_proposal_cc: "SELECT email_id, CASE WHEN email_id % 5 = email_id % 3 THEN 'a' || (email_id % 5) || '@x.com,c@x.com' ELSE 'a' || (email_id % 5) || '@x.com,c@x.com,a' || (email_id % 3) || '@x.com' END AS cc FROM emails",
    f31_file_names: """SELECT sheet_id, 'A_B c_' || substr(CAST(talent_id AS VARCHAR), 1, 8) || CASE sheet_id % 4 WHEN 0 THEN '_経 歴_' || replace(filename, '.xlsx', '') || '.xlsx' WHEN 1 THEN '_skill.pdf' WHEN 2 THEN '_skill.xlsx' ELSE '_photo.bin' END AS stored,
        '【x】_スキルシート' || CASE WHEN sheet_id % 3 = 2 THEN '_2' ELSE '' END || CASE sheet_id % 4 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.xlsx' ELSE '.bin' END AS attached, sheet_id % 4 <> 3 AS is_sheet, '未設定' AS folder FROM sheets""",
    s11_sheet_rows: """SELECT talent_id, 'gmail_attachment' AS source_type, CAST(sheet_id AS VARCHAR) AS source FROM sheets WHERE sheet_id % 2 = 0 AND sheet_id % 5 <> 0 AND talent_id IN (SELECT talent_id FROM talents)
        UNION ALL SELECT talent_id, 'google_sheet', 'https://docs.google.com/spreadsheets/d/ab_' || (talent_id % 50) FROM talents""",
    f59_project_bodies: f"""WITH b AS (SELECT m.talent_id, m.score, p.*, row_number() OVER (PARTITION BY m.talent_id ORDER BY score DESC, m.project_id) AS n, greatest(0, rate_min - 2) AS a, greatest(0, rate_max - 2) AS z FROM matches m JOIN projects p USING (project_id) WHERE run_id = {LATEST}),
        i AS (SELECT talent_id, n, CASE WHEN project_id % 5 = 0 THEN '【' || n || '】' || title || chr(10) || chr(10) || 'core' || chr(10) ELSE concat_ws(chr(10), '【' || n || '】' || title, '  必須スキル: ' || replace(nullif(required_skills, ''), ',', ', '),
            '  単価帯: ' || CASE WHEN rate_min IS NULL AND rate_max IS NULL THEN NULL WHEN rate_max IS NULL THEN a || '万円〜' WHEN rate_min IS NULL THEN '〜' || z || '万円' WHEN a = z THEN a || '万円' ELSE a || '〜' || z || '万円' END, '  勤務形態: ' || work_style,
            '  開始: ' || start_date, '  精算幅: 140-180', '  外国籍: ' || CASE WHEN foreign_nationality_ng THEN '不可' WHEN NOT foreign_nationality_ng THEN '可・不問' END, '  面談回数: ' || (project_id % 3) || '回') || chr(10) END AS block FROM b)
        SELECT talent_id, coalesce(nullif(any_value(c), ''), '（企業名なし）') || ' ご担当者様' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY n) AS body FROM i JOIN (SELECT talent_id, source_company_name AS c FROM talents) USING (talent_id) GROUP BY talent_id""",
    f59_talent_bodies: f"""WITH b AS (SELECT m.project_id, m.recommendation_points, t.*, row_number() OVER (PARTITION BY m.project_id ORDER BY score DESC, m.talent_id) AS n FROM matches m JOIN talents t USING (talent_id) WHERE run_id = {LATEST}),
        i AS (SELECT project_id, n, concat_ws(chr(10), '【' || n || '】' || display_name, '  スキル: ' || replace(nullif(skills, ''), ',', ', '), '  単価: ' || desired_rate || '万円', '  稼働: ' || available_from, '  国籍: ' || CASE WHEN is_foreign_national THEN '外国籍' WHEN NOT is_foreign_national THEN '日本国籍' END,
            '  商流: ' || nullif(commerce_flow, ''), '  おすすめポイント: ' || recommendation_points) || chr(10) AS block FROM b)
        SELECT project_id, coalesce(nullif(any_value(c), ''), '（企業名なし）') || ' ご担当者様' || chr(10) || string_agg(block, chr(10) ORDER BY n) || chr(10) || '以上' AS body FROM i JOIN (SELECT project_id, source_company_name AS c FROM projects) USING (project_id) GROUP BY project_id""",
    f60_subjects: """SELECT email_id, CASE WHEN email_id % 3 = 0 THEN 'RE: x' WHEN email_id % 2 = 0 THEN 'Re: title' ELSE 'Re: 案件のご提案' END AS subject, CASE WHEN email_id % 5 = 0 OR email_id % 7 = 0 THEN '手動登録の人材のため Gmail 返信送信はできません。' END AS warning FROM emails""",
    f64_sheet_texts: r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^[\s　]+|[\s　]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents)
        SELECT doc_id, sha256(coalesce(CASE WHEN length(t) <= 6000 THEN nullif(t, '') ELSE t[1:5999] || '…' END, '-')) AS prompt_sha256, doc_id % 3 <> 1 OR doc_id % 4 = 0 AS needed FROM t""",
    p04_project_matches: f"""WITH {_STATUS} SELECT match_id, score FROM st JOIN talents t USING (talent_id) WHERE score > 80 AND skills LIKE '%Java%' AND (desired_rate IS NULL OR desired_rate BETWEEN 45 AND 80) AND coalesce(status_project, 'none') = 'none'
        AND talent_id IN (SELECT talent_id FROM sheets WHERE access_status = 'ok')""",
    p05_talent_matches: f"""WITH {_STATUS} SELECT match_id, status_talent FROM st JOIN projects p USING (project_id) WHERE required_skills LIKE '%Docker%' AND status_talent IS NOT NULL AND status_talent <> 'reply_ok'
        AND (coalesce(rate_max, rate_min) IS NULL OR coalesce(rate_max, rate_min) >= 60) AND (rate_min IS NULL OR rate_min <= 75)""",
    t04_sorted_matches: f"""WITH m AS (SELECT match_id, ai_score, rate_min, nullif(trim(affiliation), '') AS affiliation FROM (SELECT * FROM matches WHERE run_id = {LATEST}) JOIN projects USING (project_id) JOIN talents USING (talent_id))
        SELECT * FROM (SELECT match_id, 'ai_score' AS sorted_by, CAST(row_number() OVER (ORDER BY ai_score DESC NULLS LAST, match_id) AS INT) AS place FROM m UNION ALL SELECT match_id, 'rate_min', row_number() OVER (ORDER BY rate_min NULLS LAST, match_id) FROM m
        UNION ALL SELECT match_id, 'affiliation', row_number() OVER (ORDER BY affiliation DESC NULLS FIRST, match_id) FROM m) WHERE place <= 200""",
    j20_talent_list: f"""WITH {_VALID}, {_NEWEST.format('valid')}, o AS (SELECT m.message_id, coalesce(m.talent_id, x.talent_id) AS talent_id, m.project_id, m.sent_at FROM messages m LEFT JOIN matches x USING (match_id) WHERE m.status = 'sent' AND kind = 'talent_proposal'),
        l AS (SELECT * FROM o WHERE talent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY talent_id, project_id ORDER BY sent_at DESC NULLS FIRST, message_id DESC) = 1), s AS (SELECT talent_id, count(*) AS total, count(*) FILTER (judgment = 'ok') AS ok FROM l LEFT JOIN answers USING (message_id) GROUP BY 1)
        SELECT t.talent_id, coalesce(nullif(trim(c.name), ''), nullif(trim(source_company_name), '')) AS company_name, t.talent_id IN (SELECT talent_id FROM sheets WHERE access_status = 'ok') AS has_sheet, coalesce(total, 0) AS n_proposed, coalesce(ok, 0) AS n_ok, e.created_at AS received_at
        FROM talents t LEFT JOIN companies c ON c.company_id = introducer_company_id LEFT JOIN s ON s.talent_id = t.talent_id LEFT JOIN emails e ON e.email_id = t.email_id""",
    j22_skill_list: "SELECT skill_id, s.name, coalesce(c.name, '未分類') AS category_name FROM skills s LEFT JOIN categories c USING (category_id)",
    a13_skill_catalog: "SELECT category_id, c.name AS label, sort_order, string_agg(s.name, ',' ORDER BY s.name) AS options, count(*) AS n_skills FROM categories c JOIN skills s USING (category_id) GROUP BY ALL",
    f46_core_bodies: """SELECT project_id, 'ーーー案件情報ーーー' || chr(10) || '----------' || chr(10) || '【案件名】：' || title || chr(10) || '■内容' || chr(10) || '・夜間処理の調査と改修、関係者との調整を含む長い仕事 ' || (project_id % 13) || chr(10) || '【場所】品川' AS core FROM projects""",
    f47_body_flags: f"""SELECT page_id, regexp_matches(t, '{DIRTY.replace('(?i)', '')}', 'i') AS whole_mail, NOT (length(trim(t)) >= 60 AND (page_id % 2 = 0 OR length(trim(t)) >= 120)) AS empty
        FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '【場所】' || url || chr(10) || '■単価 ' || repeat('x', CAST(page_id % 60 AS INT)) || CASE WHEN page_id % 4 = 0 THEN chr(10) || '◆y' ELSE '' END ELSE {_LIST} END AS t FROM pages)""",
    f48_cached_cores: "SELECT project_id, project_id % 3 <> 0 AND project_id % 4 <> 0 AS fresh FROM projects",
    f62_display_matches: None,
    f62_by_catalog: None,
    s06_settings: "SELECT company_id, coalesce(value, 'none') AS value FROM companies LEFT JOIN settings ON key = 'key-' || (company_id * 2)",
    s07_bounded: """SELECT key, CASE value WHEN '30' THEN 30 WHEN '"45"' THEN 45 WHEN '-3' THEN 0 WHEN '999' THEN 100 ELSE 50 END AS score_min, CASE value WHEN '30' THEN 20 WHEN '"45"' THEN 20 WHEN '-3' THEN 1 WHEN '999' THEN 20 ELSE 5 END AS top_n,
        CASE value WHEN '30' THEN 30 WHEN '"45"' THEN 45 WHEN '"no number"' THEN 7 WHEN '-3' THEN 0 WHEN 'true' THEN 7 WHEN '999' THEN 999 ELSE 14 END AS days FROM settings""",
    s09_appended_run: "SELECT run_id, count(*) AS n FROM matches GROUP BY 1 UNION ALL SELECT 99, (SELECT count(*) FROM talents WHERE status = 'active') * (SELECT count(*) FROM projects WHERE status = 'open')",
    s05_job_log: "SELECT event_type AS event, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ms FROM events WHERE event_id % 10 <> 0 GROUP BY 1",
    p10_manual_mails: """SELECT talent_id AS entry_id, 'manual-' || talent_id AS gmail_message_id, CASE talent_id % 4 WHEN 0 THEN 'a@x.com' WHEN 1 THEN 'broken' ELSE 'manual@local' END AS from_address, CASE WHEN talent_id % 3 > 0 THEN display_name ELSE '手動登録' END AS subject,
        CASE WHEN talent_id % 2 > 0 THEN trim(summary) END AS body_text, talent_id % 4 = 0 AS plausible FROM talents""",
    j19_commute: """SELECT talent_id, max(CASE WHEN talent_id % 6 > 0 THEN duration_minutes END) AS minutes, max(CASE WHEN talent_id % 6 = 0 THEN 'missing_place' WHEN c.provider IS NULL THEN 'unresolved' ELSE coalesce(nullif(raw_status, ''), 'cache_hit') END) AS status
        FROM talents LEFT JOIN commute_cache c ON provider = 'google_routes' AND origin_key = replace(nearest_station, ' ', '') AND destination_key = 'Client' || (talent_id % 15) AND talent_id % 6 > 0 GROUP BY 1""",
    f39_places: "SELECT talent_id, replace(nearest_station, ' ', '') AS key, nearest_station || '駅, 日本' AS query, CASE WHEN talent_id % 2 = 0 THEN CAST(talent_id AS INT) END AS seconds FROM talents",
    f13_judge_answers: f"""SELECT match_id, CASE WHEN match_id % 4 = 0 THEN CAST(least(100, score + 30) AS INT) ELSE score END AS ai_score, CASE match_id % 4 WHEN 0 THEN 'fits' WHEN 1 THEN '理由なし' ELSE 'AI 応答を JSON として解釈できなかったためルールスコアを参考値として採用しました。' END AS reason FROM matches WHERE run_id = {LATEST}""",
    f63_texts: """SELECT project_id, CAST(CASE WHEN rate_min * 1500 >= 10000 THEN floor(rate_min * 1500 / 10000.0 + 0.5) ELSE rate_min * 1500 END AS INT) AS rate, CASE WHEN s <= 0 THEN 'まもなく完了' WHEN m < 60 THEN '約' || m || '分' WHEN m % 60 = 0 THEN '約' || (m // 60) || '時間' ELSE '約' || (m // 60) || '時間' || (m % 60) || '分' END AS eta
        FROM (SELECT project_id, rate_min, s, greatest(1, CAST(round_even(s / 60, 0) AS INT)) AS m FROM (SELECT *, project_id * 37 - 50 AS s FROM projects))""",
}
