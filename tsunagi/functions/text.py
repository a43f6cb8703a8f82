"""Text keys and parsers as column expressions. Classes of white space name the wide space too, which Java's \\s lacks."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
SKILL_ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "golang": "go", "springboot": "spring boot", "spring": "spring boot",
    "postgres": "postgresql", "pgsql": "postgresql", "k8s": "kubernetes", "reactjs": "react", "vuejs": "vue", "nodejs": "node", "node.js": "node",
}
FREE_MAIL = ("gmail.com", "yahoo.co.jp", "outlook.com", "hotmail.com", "icloud.com")
OK_WORDS = ("進めさせて", "進めてください", "進めてまいり", "進めます", "前向き", "よろしくお願いします", "お願いいたします", "ご提案ください", "候補として")
NG_WORDS = ("辞退", "見送り", "他決", "今回は結構", "対象外")
NATIONALITY_OPEN = ("外国籍可", "国籍不問", "外国籍ok", "外国籍不問")
NATIONALITY_CLOSED = ("外国籍不可", "外国籍ng", "外国人不可", "日本人のみ", "日本国籍のみ", "国籍:日本")
NATIONALITY_CLOSED_SHORT = ("不可", "ng", "×", "x", "日本", "日本人", "日本国籍")
NATIONALITY_OPEN_SHORT = ("可", "ok", "不問", "○", "o")
NATIONALITY_JAPANESE = r"国籍[\s　]*】?[\s　]*[:：]?[\s　]*日本"
FLOW_END, FLOW_AWAY = "エンド", "先"
JAPANESE = ("日本国籍", "日本人", "国内籍")
FOREIGN = ("外国籍", "外国人", "永住権", "就労ビザ", "ビザ")
FLOW_NO_LIMIT = ("制限なし", "不問", "商流なし", "制約なし")
FLOW_LIMITS = (
    (3, ("三社先", "3社先", "三次")), (2, ("二社先", "2社先", "二次")), (0, ("貴社まで", "貴社のみ", "弊社まで", "自社まで", "貴社プロパー")),
    (1, ("一社先", "1社先", "一次請", "一次受け", "一次まで")), (0, ("エンド直", "エンドのみ", "元請のみ", "元請けのみ", "直請", "直契約")),
)
FLOW_DEPTHS = (
    (3, ("三社先", "3社先")), (2, ("二社先", "2社先", "二次請", "二次受け")), (1, ("一社先", "1社先", "一次請", "一次受け", "一社専属")),
    (0, ("プロパー", "自社", "正社員", "社員", "専属(自社", "弊社所属")), (1, ("フリーランス", "個人事業")),
)
EMAIL = r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}"
# End of fixed values.


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(text: Column, normal: bool = False) -> Column:
    """Compatibility-normalised text, for which Spark has no built-in; `normal` texts are that already."""
    return text if normal else _nfkc(text)


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Texts with all character references decoded, of which Spark knows none."""
    return texts.map(html.unescape, na_action="ignore")


def bound(value: Column, use) -> Column:
    """`use` of a value that is made once, however often it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")


def skill_key(raw: Column, normal: bool = False) -> Column:
    """A skill's spelling without case, width and kinds of separators."""
    return F.trim(F.regexp_replace(F.lower(strip(nfkc(F.coalesce(raw, F.lit("")), normal))), r"[\s　_\-]+", " "))


def normalize_skill(raw: Column, normal: bool = False) -> Column:
    text = skill_key(raw, normal)
    aliases = F.create_map(*[F.lit(x) for pair in SKILL_ALIASES.items() for x in pair])
    return F.coalesce(aliases[F.regexp_replace(text, " ", "")], aliases[text], text)


def business_key(value: Column) -> Column:
    return strip(F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s　]+", " ")))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def refuses_foreign(raw: Column, normal: bool = False) -> Column:
    """Whether a project refuses foreign nationals: true, false, or NULL if it doesn't say."""
    text = F.lower(strip(nfkc(F.coalesce(raw, F.lit("")), normal)))
    return (
        F.when(_any(text, NATIONALITY_OPEN), False)
        .when(_any(text, NATIONALITY_CLOSED) | text.rlike(NATIONALITY_JAPANESE), True)
        .when(text.isin(*NATIONALITY_CLOSED_SHORT), True)
        .when(text.isin(*NATIONALITY_OPEN_SHORT), False)
    )


def is_foreign(raw: Column, normal: bool = False) -> Column:
    text = F.lower(strip(nfkc(F.coalesce(raw, F.lit("")), normal)))
    return F.when(_any(text, JAPANESE), False).when(_any(text, FOREIGN), True)


def _first_depth(text: Column, table) -> Column:
    depth = None
    for value, words in table:
        depth = F.when(_any(text, words), value) if depth is None else depth.when(_any(text, words), value)
    return depth


def flow_limit(raw: Column, normal: bool = False) -> Column:
    """The deepest commerce flow that a project allows, NULL for no limit."""
    text = F.lower(strip(nfkc(F.coalesce(raw, F.lit("")), normal)))
    return F.when(~_any(text, FLOW_NO_LIMIT), F.coalesce(_first_depth(text, FLOW_LIMITS), F.when(text.contains(FLOW_END) & ~text.contains(FLOW_AWAY), 0)))


def flow_depth(flow: Column, affiliation: Column, normal: bool = False) -> Column:
    text = F.lower(strip(nfkc(F.concat(F.coalesce(flow, F.lit("")), F.lit(" "), F.coalesce(affiliation, F.lit(""))), normal)))
    return _first_depth(text, FLOW_DEPTHS)


def email_address(raw: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(raw, F.lit("")), f"({EMAIL})", 1)), F.lit(""))


def email_domain(address: Column) -> Column:
    """The part after the last @; NULL for the large free mail services, which name no company."""
    domain = F.nullif(F.lower(F.trim(F.substring_index(address, "@", -1))), F.lit(""))
    return F.when(address.contains("@") & ~domain.isin(*FREE_MAIL), domain)


def contact_address(sender: Column, reply_to: Column, own: Column) -> Column:
    """The sender, or the reply address if the mail came by way of one's own domain."""
    own_way = F.coalesce(email_domain(email_address(sender)) == email_domain(email_address(own)), F.lit(False))
    return F.when(own_way & email_address(reply_to).isNotNull(), email_address(reply_to)).otherwise(email_address(sender))


def address_list(header: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(EMAIL), F.lit(0)), lambda a: F.lower(a)))


def bracket_fields(body: Column) -> Column:
    """The map of 【key】value lines of a mail; a key that comes twice keeps its last value."""
    lines = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"【([^】\n]+)】[ \t　]*[:：]?[ \t　]*([^\n]*)"), F.lit(0))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.regexp_extract(x, r"【([^】\n]+)】", 1)).alias("key"), strip(F.regexp_extract(x, r"】[ \t　]*[:：]?[ \t　]*([^\n]*)", 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def judge_text(body: Column, ok_words: tuple[str, ...] = OK_WORDS, ng_words: tuple[str, ...] = NG_WORDS) -> Column:
    """A refusal wins over a consent; neither is unknown."""
    text = F.lower(F.coalesce(body, F.lit("")))
    return F.when(_any(text, tuple(w.lower() for w in ng_words)), "ng").when(_any(text, tuple(w.lower() for w in ok_words)), "ok").otherwise("unknown")


def reply_segments(body: Column) -> Column:
    """The numbered parts of a reply, as an array of (number, part)."""
    parts = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s)【[\s　]*[0-9]+[\s　]*】.*?(?=【[\s　]*[0-9]+[\s　]*】|\z)"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"【[\s　]*([0-9]+)", 1).cast("int").alias("number"), p.alias("part")))


def judge_item(body: Column, number: Column) -> Column:
    """Judges the part of a reply that has the item's number; a numbered reply without it is unknown."""
    segments = reply_segments(body)
    own = F.element_at(F.filter(segments, lambda s: s["number"] == number), -1)["part"]
    mine = F.coalesce(F.exists(segments, lambda s: s["number"] == number), F.lit(False))
    return F.when(mine, judge_text(own)).when(F.size(segments) > 0, "unknown").otherwise(judge_text(body))


def man_yen(value: Column, markdown: int = 0) -> Column:
    """Yen of 10000 and more become units of 10000, half-even; then the markdown goes off, down to 0."""
    units = F.when(value >= 10000, F.bround(value / 10000, 0).cast("int")).otherwise(value)
    return F.greatest(units - markdown, F.lit(0))


def rate_text(low: Column, high: Column, markdown: int = 0) -> Column:
    a, b = man_yen(low, markdown).cast("string"), man_yen(high, markdown).cast("string")
    unit, to = F.lit("万円"), F.lit("〜")
    return F.when(low.isNull() & high.isNull(), F.lit(None)).when(high.isNull(), F.concat(a, unit, to)).when(low.isNull(), F.concat(to, b, unit)).when(a == b, F.concat(a, unit)).otherwise(F.concat(a, to, b, unit))
