"""Mails to talents and projects: fields by rules, what an external extraction adds, and whether someone must look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsunagi.functions import extract as X
from tsunagi.functions import text as T
from tsunagi.functions.skills import expand_term
from tsunagi.sources.staging import staged


def expanded_lists(items: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and the terms that the entries (keys, at, raw) name, in order; terms that differ by case and width alone come
    once. Each different entry is expanded once, so the helper for compatibility forms sees few rows."""
    terms = items.select("raw").distinct().select("raw", F.posexplode(expand_term(F.col("raw"))).alias("place", "term"))
    spelled = terms.withColumn("same", F.lower(T.strip(T.nfkc(F.col("term"))))).filter("same <> ''")
    rows = items.join(spelled, "raw").groupBy(*keys, "same").agg(F.min(F.struct("at", "place", "term")).alias("first"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["term"]).alias(name))


def _with_expanded(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`df` with arrays of raw entries replaced by what they name, as far as it looks like skills."""
    items = None
    for c in columns:
        part = df.select(key, F.lit(c).alias("column"), F.posexplode(c).alias("at", "raw"))
        items = part if items is None else items.unionByName(part)
    wide = expanded_lists(items, [key, "column"], "terms").groupBy(key).pivot("column", columns).agg(F.first("terms"))
    none = F.array().cast("array<string>")
    return df.drop(*columns).join(wide, key, "left").withColumns({c: X.plausible_skills(F.coalesce(c, none)) for c in columns})


def _read(mails: DataFrame) -> DataFrame:
    """The mails with their fields, and the fields and body in normal letters for what is told by words. Mails are short
    and cost much, so they are dealt out to all tasks, however few files they come from."""
    mails = mails.repartition(int(mails.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mail_id")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    texts = mails.select("mail_id", blank("subject"), blank("body"), "from_header").withColumn("whole", F.concat_ws("\n", "subject", "body"))
    texts = texts.withColumns({"whole_normal": T.nfkc(F.col("whole")), "plain": T.nfkc(F.col("body"))})
    # the fields are staged, as all rules look at them
    return staged(texts.select("mail_id", "subject", "body", "from_header", "plain", X.bracket_entries(F.col("whole")).alias("f"), X.bracket_entries(F.col("whole_normal")).alias("normal")))


def _with_entries(read: DataFrame, name: str, labels: tuple[str, ...], aliases: tuple[str, ...]) -> DataFrame:
    """Raw entries of the labelled block, or else of the field. Each step is a column of its own, as the next one uses
    it more than once."""
    steps = read.withColumn("_block", X.labelled_block(F.col("body"), *labels)).withColumn("_lines", X.skill_lines(F.col("_block"))).withColumn("_field", X.listed(X.pick(F.col("f"), *aliases)))
    return steps.withColumn(name, F.when(F.size("_lines") > 0, F.col("_lines")).otherwise(F.col("_field"))).drop("_block", "_lines", "_field")


def project_rules(mails: DataFrame) -> DataFrame:
    """The fields that rules find in project mails (mail_id, subject, body, from_header); skills are raw entries."""
    f, body, subject = F.col("f"), F.col("body"), F.col("subject")
    pick = lambda *aliases: X.pick(f, *aliases)
    read = _read(mails).withColumn("rates", X.rates(pick("単金", "単価", "金額")))
    read = _with_entries(read, "required_skills", X.SKILL_LABELS, ("必要スキル", "必須スキル", "主な環境"))
    read = _with_entries(read, "preferred_skills", X.PREFERRED_LABELS, ("尚可スキル", "歓迎スキル", "尚可"))
    read = read.withColumn("work_block", X.labelled_block(body, *X.WORK_LABELS)).withColumn("work", F.coalesce("work_block", pick(*X.WORK_FIELDS)))
    read = read.withColumns({"title": F.coalesce(pick("案件名", "案件タイトル"), F.substring(T.strip(subject), 1, 255)), "location": pick("作業場所", "勤務地", "場所"), "work_style": pick("作業形態", "勤務形態", "リモート"), "start_date": pick("作業期間", "開始", "期間")})
    listed = F.when(F.size("required_skills") > 0, F.concat(F.lit("スキル: "), F.array_join(F.slice("required_skills", 1, 6), " / ")))
    parts = F.array_join(F.filter(F.array(F.nullif("title", F.lit("")), F.col("location"), F.col("work_style"), F.col("start_date"), listed), lambda p: p.isNotNull()), "。")
    refused = F.coalesce(T.refuses_foreign(X.project_nationality_text(F.col("normal")), True), T.refuses_foreign(F.col("plain"), True))
    flow_in_body = X.filled(F.substring(F.regexp_extract(body, r"(?:商流|参入)[\s　]*[:：]?[\s　]*([^\n】]{1,40})", 1), 1, 64))
    return read.select(
        "mail_id", "subject", "title", "required_skills", "preferred_skills",
        F.get("rates", F.lit(0)).alias("rate_min"), F.coalesce(F.get("rates", F.lit(1)), F.get("rates", F.lit(0))).alias("rate_max"), "location", "work_style",
        pick("勤務時間", "就業時間", "稼働時間").alias("working_hours"), "start_date", pick("精算幅", "精算", "時間幅", "清算幅").alias("settlement_range"),
        X.first_number(pick("面談回数", "面接回数", "面談数", "面接数")).alias("interview_count"), X.first_number(pick("人数", "募集人数", "必要人数", "採用人数")).alias("headcount"),
        refused.alias("foreign_nationality_ng"), F.coalesce(X.flow_text(f, ("商流", "仲介", "参入")), flow_in_body).alias("commerce_flow_limit"),
        X.sender_company(body, F.col("from_header")).alias("source_company_name"), X.contact_name(body, F.col("from_header")).alias("contact_name"),
        F.coalesce("work", F.nullif(parts, F.lit("")), T.strip(subject)).alias("summary"), "work_block",
    )


def _cut(name: str, n: int) -> Column:
    return F.substring(X.filled(F.col(name)), 1, n).alias(name)


def normal_projects(found: DataFrame) -> DataFrame:
    """Projects in their final form, and needs_review: without a title of their own, a summary or skills, or with a
    summary that looks like the whole mail."""
    df = _with_expanded(staged(found), "mail_id", ["required_skills", "preferred_skills"])
    own = F.when(F.col("summary") != X.TO_CHECK, X.filled(F.col("summary")))
    review = X.filled(F.col("title")).isNull() | own.isNull() | ((F.length(own) > 400) & own.contains("ーーー")) | (F.size("required_skills") == 0)
    return df.select(
        "mail_id", F.coalesce(_cut("title", 255), X.filled(F.substring("subject", 1, 255)), F.lit("案件名未設定")).alias("title"), "required_skills", "preferred_skills", "rate_min", "rate_max",
        _cut("location", 128), _cut("work_style", 255), _cut("working_hours", 128), _cut("start_date", 64), _cut("settlement_range", 64), "interview_count", "headcount",
        "foreign_nationality_ng", _cut("commerce_flow_limit", 64), _cut("source_company_name", 255), _cut("contact_name", 128),
        F.substring(F.coalesce(own, T.strip(F.col("subject"))), 1, 2000).alias("summary"), F.coalesce(review, F.lit(True)).alias("needs_review"),
    )


def extract_projects(mails: DataFrame) -> DataFrame:
    """One project a mail (mail_id, subject, body, from_header)."""
    return normal_projects(project_rules(mails))


def talent_rules(mails: DataFrame) -> DataFrame:
    """The fields that rules find in talent mails; skills are raw entries, the comment counts as skills too later on."""
    f, body, subject = F.col("f"), F.col("body"), F.col("subject")
    pick = lambda *aliases: X.pick(f, *aliases)
    read = _with_entries(_read(mails), "entries", X.SKILL_LABELS, ("スキル", "技術", "言語")).withColumn("summary", X.sales_comment(body))
    read = read.withColumn("raw_name", F.coalesce(pick("名前", "氏名", "お名前", "要員名", "候補者"), F.substring(T.strip(subject), 1, 128)))
    name, employed = X.name_and_affiliation(F.col("raw_name"))
    read = read.withColumn("affiliation", F.coalesce(pick("雇用形態", "契約形態", "所属", "雇用"), employed))
    years = F.transform(F.filter("entries", lambda s: s.rlike(r"実務経験[\s　]*[:：]?[\s　]*([0-9.]+)[\s　]*年")), lambda s: F.regexp_extract(s, r"実務経験[\s　]*[:：]?[\s　]*([0-9.]+)[\s　]*年", 1).try_cast("double").cast("int"))
    skills = F.filter("entries", lambda s: ~s.startswith("実務経験") & ~s.rlike("^(?:株式会社|有限会社|合同会社)"))
    foreign = F.coalesce(T.is_foreign(X.talent_nationality_text(F.col("normal")), True), T.is_foreign(F.substring("plain", 1, 2000), True))
    return read.select(
        "mail_id", "subject", name.alias("display_name"), "affiliation", X.first_number(pick("年齢")).alias("age"), X.gender(pick("性別")).alias("gender"),
        F.coalesce(X.first_number(pick("経験年数", "経験")), F.get(years, F.lit(0))).alias("experience_years"), F.get(X.rates(pick("単金", "単価", "希望単価", "金額")), F.lit(0)).alias("desired_rate"),
        pick("稼動日", "稼働日", "稼働開始", "稼動開始", "稼働可能", "稼動可能", "稼働", "稼動", "開始可能", "参画").alias("available_from"), pick("勤務形態", "勤務", "リモート", "出社").alias("work_style"),
        pick("最寄駅", "最寄", "駅", "エリア").alias("nearest_station"), foreign.alias("is_foreign_national"),
        F.coalesce(X.flow_text(f, ("商流", "所属形態", "立場")), F.substring("affiliation", 1, 64)).alias("commerce_flow"), skills.alias("skills"),
        X.sender_company(body, F.col("from_header")).alias("source_company_name"), X.contact_name(body, F.col("from_header")).alias("contact_name"), "summary",
    )


def normal_talents(found: DataFrame) -> DataFrame:
    """Talents in their final form, and needs_review: without a name, a comment or skills. What the comment names counts
    as skills too."""
    comment = F.when(F.col("summary") != X.TO_CHECK, F.col("summary"))
    df = staged(found).withColumn("summary", comment).withColumn("skills", F.concat("skills", F.when(F.col("summary").isNotNull(), F.array("summary")).otherwise(F.array().cast("array<string>"))))
    df = _with_expanded(df, "mail_id", ["skills"])
    named = X.filled(F.col("display_name"))
    review = named.isNull() | F.col("summary").isNull() | (F.size("skills") == 0)
    return df.select(
        "mail_id", F.substring(F.coalesce(named, X.filled(F.substring("subject", 1, 128)), F.lit("名称未設定")), 1, 128).alias("display_name"), _cut("affiliation", 255), "age", "gender",
        "experience_years", "desired_rate", _cut("available_from", 64), _cut("work_style", 255), _cut("nearest_station", 64), "is_foreign_national",
        F.coalesce(_cut("commerce_flow", 64), F.substring("affiliation", 1, 64)).alias("commerce_flow"), "skills", _cut("source_company_name", 255), _cut("contact_name", 128), "summary",
        F.coalesce(review, F.lit(True)).alias("needs_review"),
    )


def extract_talents(mails: DataFrame) -> DataFrame:
    """One talent a mail (mail_id, subject, body, from_header)."""
    return normal_talents(talent_rules(mails))


def merged(external: DataFrame, rules: DataFrame, overrides: tuple[str, ...]) -> DataFrame:
    """Rules with the filled values of an external extraction (mail_id and some of the columns) put first, but for
    `overrides`, where what the rules found goes first."""
    given = [c for c in external.columns if c != "mail_id"]
    renamed = external.select("mail_id", *[F.col(c).alias(f"given_{c}") for c in given])
    kinds = dict(rules.dtypes)

    def some(c: Column, kind: str) -> Column:
        return F.when(F.size(c) > 0, c) if kind.startswith("array") else F.nullif(c, F.lit("")) if kind == "string" else c

    both = lambda c: F.coalesce(*[some(F.col(x), kinds[c]) for x in ((c, f"given_{c}") if c in overrides else (f"given_{c}", c))], F.col(c)).alias(c)
    return rules.join(renamed, "mail_id", "left").select(*[both(c) if c in given else F.col(c) for c in rules.columns])


def finish_projects(external: DataFrame, mails: DataFrame) -> DataFrame:
    """Projects by an external extraction and rules; skills, nationality and the work's text are the mail's own where
    it has them."""
    rules = project_rules(mails)
    both = merged(external, rules, ("required_skills", "preferred_skills", "foreign_nationality_ng"))
    return normal_projects(both.withColumn("summary", F.coalesce("work_block", "summary")))


def finish_talents(external: DataFrame, mails: DataFrame) -> DataFrame:
    return normal_talents(merged(external, talent_rules(mails), ("summary",)))


def entity_status(needs_review: Column, kind: str) -> Column:
    """A talent or project that someone must look at does not take part yet."""
    yes, no = ("active", "inactive") if kind == "talent" else ("open", "closed")
    return F.when(F.coalesce(needs_review, F.lit(True)), no).otherwise(yes)


def list_text(html: Column, plain: Column) -> Column:
    """The text of a mail for lists: its html without tags, or the plain text."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style).*?>.*?</\1>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>|</p\s*>", "\n"), r"(?s)<[^>]+>", "")
    return F.coalesce(X.filled(F.regexp_replace(text, r"\n{3,}", "\n\n")), F.when(X.filled(plain).isNotNull(), plain), F.lit(""))


def rules_text(text: Column) -> Column:
    """The text of a mail for rules, which keep words apart where tags stood between them."""
    plain = F.regexp_replace(text, r"(?is)<(script|style).*?>.*?</\1>", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i)<br\s*/?>|</p\s*>|</div\s*>", "\n"), r"<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#12288;", "　")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    plain = T.strip(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    return F.when(text.contains("<") & text.contains(">"), plain).otherwise(text)
