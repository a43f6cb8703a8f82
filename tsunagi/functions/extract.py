"""What a mail spells out, as column expressions over its text: bracketed fields, labelled blocks, numbers, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsunagi.functions import text as T

# Labels, patterns and limits.
SKILL_LABELS = ("必要スキル", "必須スキル", "主な環境", "技術要素", "スキル")
PREFERRED_LABELS = ("尚可スキル", "歓迎スキル", "尚可", "あると尚可", "プラススキル", "歓迎")
WORK_LABELS = ("業務内容", "作業内容", "案件概要", "案件内容", "詳細", "内容", "概要")
WORK_FIELDS = ("業務内容", "案件概要", "概要", "作業内容", "案件内容", "詳細", "内容")
COMMENT_LABELS = ("営業コメント", "推薦コメント", "自己PR", "自己ＰＲ", "アピールポイント", "アピール", "人物像", "PR", "ＰＲ", "備考", "特記事項", "補足")
BLOCK_STOP = r"\n【|\n[ー－━═＝\-]{3,}|\n[■▼][\s　]*[^\n]{0,40}[：:]|\n以上[、,．。\s　]|\z"
SECTION_CUT = r"\n【|\n[ー－━═＝\-]{3,}|[■▼][\s　]*[^\n]{0,40}[：:]|(?:^|\n)(?:株式会社|有限会社|合同会社)|(?:^|\n)(?:TEL|FAX)[\s　]*[：:]|https?://"
JUNK_SKILL = (
    r"(?i)https?:|\bwww\.|\.(?:co\.)?jp$|株式会社|有限会社|合同会社|証券コード|事業部|営業グループ|案件紹介サイト|フリーランス向け|\b(?:TEL|FAX)\b|\d{2,4}-\d{2,4}-\d{3,4}"
    r"|^(?:稼働開始日|開始日|参画日|備考|契約形態|商流|商談回数|面談回数)|^[■▼◆].*[：:][\s　]*$"
)
CORPORATE = r"(?i)(株式会社|有限会社|合同会社|Inc|Corp|Ltd)"
COMPANY_IN_TEXT = r"((?:株式会社|有限会社|合同会社)[^\s　＝]{1,40})(?=([\s\S]{0,3}))"
CONTACT_LINES = (r"(?:担当|営業担当|連絡先)[\s　]*[:：][\s　]*([^\s　／/]{1,40})", r"担当者[\s　]*[:：][\s　]*([^\s　／/]{1,40})")
EMPLOYED = r"^(.+?)[\s　]+((?:プロパー|フリーランス|一社専属|個人事業主|正社員|契約社員|BP)[^\n]*)$"
AFFILIATED = r"^(.+?)[\s　]*[（(]([^）)]*所属[^）)]*)[）)][\s　]*$"
TO_CHECK, BLOCK_CHARS, SKILL_CHARS, MOST_SKILLS = "要確認", 2000, 40, 40
# End of fixed values.


def filled(text: Column) -> Column:
    """The text without white space at its ends, NULL if nothing is left."""
    return F.nullif(T.strip(text), F.lit(""))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[filled(t) for t in texts])


def spaceless(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s　]+", "")


def bracket_entries(text: Column) -> Column:
    """The 【key】value fields as an array of (key, value), keys without white space; fields without a value are left
    out, and a value may begin on the next line."""
    pattern = r"【[\s　]*([^】]+?)[\s　]*】[\s　]*[:：]?[\s　]*([^\n【]*)"
    part = lambda i: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(i))
    entries = F.zip_with(part(1), part(2), lambda k, v: F.struct(spaceless(k).alias("key"), T.strip(v).alias("value")))
    return F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != ""))


def pick(entries: Column, *aliases: str) -> Column:
    """The value of the first alias that is a key, or else of the first that is part of one; of a key that comes twice
    the last value counts."""
    last = lambda key: F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]
    within = lambda alias: F.get(F.filter(entries, lambda e: e["key"].contains(alias)), F.lit(0))["key"]
    return F.coalesce(*[last(F.lit(a)) for a in aliases], *[last(within(a)) for a in aliases])


def _label(label: str) -> str:
    return r"[\s　]*".join(label)


def _spelled(text: Column, label: str) -> Column:
    """Whether the text has all letters of the label, without which no pattern for it is tried."""
    return reduce(Column.__and__, [text.contains(c) for c in dict.fromkeys(label)])


def labelled_block(text: Column, *labels: str) -> Column:
    """What stands under the first 【label】 that has something under it, up to the next heading, rule or closing."""
    found = [F.when(_spelled(text, x), F.regexp_extract(text, rf"(?s)【[\s　]*{_label(x)}[^】]*】[\s　]*[:：]?[\s　]*(.*?)(?={BLOCK_STOP})", 1)) for x in labels]
    return F.substring(first_filled(*found), 1, BLOCK_CHARS)


def sales_comment(text: Column) -> Column:
    """All comments on a talent, each once, with blank lines between them."""
    parts = []
    for label in COMMENT_LABELS:
        plain = F.when(_spelled(text, label), F.regexp_extract(text, rf"(?s)(?:^|\n)[■▼◆●]?[\s　]*{_label(label)}[\s　]*[：:]+[\s　]*(.*?)(?={BLOCK_STOP})", 1))
        parts.append(F.coalesce(labelled_block(text, label), F.substring(filled(plain), 1, BLOCK_CHARS)))
    joined = F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull())), "\n\n")
    return F.nullif(F.substring(joined, 1, BLOCK_CHARS), F.lit(""))


def listed(text: Column) -> Column:
    """The entries of a list in a line of text."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,、/｜|\n・]+", -1), lambda p: F.trim(p, F.lit(" ・\t")))
    return F.filter(parts, lambda p: T.strip(p) != "")


def skill_lines(block: Column) -> Column:
    """The entries of a block of skills, without bullets and without what follows the block."""
    body = T.strip(F.regexp_replace(block, rf"(?im)\A(?!{SECTION_CUT})([\s\S]+?)(?:{SECTION_CUT})[\s\S]*\z", "$1"))
    lines = F.transform(F.split(body, r"\r\n|[\n\r]", -1), lambda x: F.regexp_replace(T.strip(x), r"^[・●◆▪\-][\s　]*", ""))
    return F.flatten(F.transform(F.filter(lines, lambda x: x != ""), listed))


def plausible_skills(skills: Column) -> Column:
    """Skills that look like skills, each once, at most MOST_SKILLS."""
    cleaned = F.transform(skills, lambda s: F.regexp_replace(s, r"^[ ・\t　]+|[ ・\t　]+$", ""))
    kept = F.filter(cleaned, lambda s: (s != "") & (s != TO_CHECK) & (F.length(s) <= SKILL_CHARS) & ~s.rlike(JUNK_SKILL))
    return F.slice(F.array_distinct(kept), 1, MOST_SKILLS)


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"[0-9]+"), F.lit(0)), lambda n: n.try_cast("bigint"))


def first_number(text: Column) -> Column:
    return F.get(numbers(text), F.lit(0)).cast("int")


def rates(text: Column) -> Column:
    """The numbers of a rate in units of ten thousand yen; amounts in yen are cut to them."""
    return F.transform(numbers(text), lambda n: F.when(n >= 10000, F.floor(n / 10000)).otherwise(n).cast("int"))


def gender(text: Column) -> Column:
    plain = F.lower(spaceless(F.coalesce(text, F.lit(""))))
    return F.when(plain.contains("女") | plain.contains("female"), "女性").when(plain.contains("男") | plain.contains("male"), "男性")


def shown_name(from_header: Column) -> Column:
    """The name before the address of a sender; NULL if there is none or it is an address itself."""
    name = F.trim(T.strip(F.regexp_extract(T.strip(F.coalesce(from_header, F.lit(""))), r"^\"?([^\"<]+)\"?[\s　]*<", 1)), F.lit("'"))
    return F.when(~name.rlike(r"^[^\s@]+@[^\s@]+$"), F.nullif(name, F.lit("")))


def sender_company(body: Column, from_header: Column) -> Column:
    """The sender's company: the shown name if it is one, or else the last company in the body that is not addressed."""
    tail = F.substring(F.coalesce(body, F.lit("")), -2000, 2000)
    part = lambda i: F.regexp_extract_all(tail, F.lit(COMPANY_IN_TEXT), F.lit(i))
    own = F.filter(F.zip_with(part(1), part(2), lambda name, after: F.struct(name.alias("name"), after.alias("after"))), lambda x: ~x["after"].rlike("^[　 ]*様"))
    in_body = F.regexp_replace(F.try_element_at(own, F.lit(-1))["name"], r"^[　 。．]+|[　 。．]+$", "")
    shown = shown_name(from_header)
    return F.substring(F.coalesce(F.when(shown.rlike(CORPORATE), shown), in_body), 1, 255)


def contact_name(body: Column, from_header: Column) -> Column:
    tail = F.substring(F.coalesce(body, F.lit("")), -2500, 2500)
    named = [F.nullif(F.regexp_replace(F.regexp_extract(tail, p, 1), r"^[　 。．様]+|[　 。．様]+$", ""), F.lit("")) for p in CONTACT_LINES]
    named = [F.when(~n.rlike("株式会社|有限会社|合同会社"), n) for n in named]
    shown = shown_name(from_header)
    return F.substring(F.coalesce(*named, F.when(~shown.rlike(CORPORATE), shown)), 1, 128)


def name_and_affiliation(raw: Column) -> tuple[Column, Column]:
    text = T.strip(raw)
    split = lambda i: F.when(text.rlike(EMPLOYED), F.regexp_extract(text, EMPLOYED, i)).when(text.rlike(AFFILIATED), F.regexp_extract(text, AFFILIATED, i))
    return F.coalesce(T.strip(split(1)), text), T.strip(split(2))


def keyed_values(entries: Column, words: tuple[str, ...], of) -> Column:
    """`of` each entry whose key (in normal letters) holds one of the words, as an array in order."""
    has = lambda e: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(e["key"]).contains(w))
    return F.transform(F.filter(entries, has), of)


NATIONALITY_KEYS = ("外国籍", "国籍", "外国人")


def project_nationality_text(entries: Column) -> Column:
    return F.array_join(keyed_values(entries, NATIONALITY_KEYS, lambda e: F.concat(F.lit(" "), e["key"], F.lit(":"), e["value"], F.lit(" "), e["key"], e["value"], F.lit(" "), e["value"])), "")


def talent_nationality_text(entries: Column) -> Column:
    return F.array_join(keyed_values(entries, NATIONALITY_KEYS, lambda e: F.concat(F.lit(" "), e["value"])), "")


def flow_text(entries: Column, keys: tuple[str, ...]) -> Column:
    return filled(F.substring(F.get(keyed_values(entries, keys, lambda e: e["value"]), F.lit(0)), 1, 64))


def model_answer(text: Column, schema: str) -> Column:
    """The object that a model answered with: plain, in a fence, or anywhere in its text; NULL if there is none."""
    inner = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.from_json(F.nullif(inner, F.lit("")), schema)
