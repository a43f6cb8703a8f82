"""Judging replies to proposals, item by item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsunagi.functions import text as T
from tsunagi.operators import outreach as O

# Answers of an external judge besides ok, ng and unknown, and the text of a status that was set by hand.
ANSWERS = {"ok": ("ok", "承諾", "前向き", "よろしく"), "ng": ("ng", "見送り", "辞退", "no"), "unknown": ("unknown",)}
SET_BY_HAND = "（手動でステータスを設定）"
# End of fixed values.


def keywords(setting: Column) -> Column:
    """The words of a setting, parted by commas and newlines."""
    words = F.transform(F.split(F.coalesce(setting, F.lit("")), r"\r\n|[,\n\r]", -1), T.strip)
    return F.filter(words, lambda w: w != "")


def with_builtin(words: Column, builtin: tuple[str, ...]) -> Column:
    """Configured words and then built-in ones, each once whatever its case."""
    every = F.concat(words, F.array(*[F.lit(w) for w in builtin]))
    return F.filter(every, lambda w, i: ~F.exists(F.slice(every, 1, i), lambda v: F.lower(v) == F.lower(w)))


def judged(body: Column, ok: Column, ng: Column) -> Column:
    """A refusal wins over a consent; neither is unknown."""
    text = F.lower(T.strip(F.coalesce(body, F.lit(""))))
    has = lambda words: F.exists(words, lambda w: text.contains(F.lower(w)))
    return F.when(text == "", "unknown").when(has(ng), "ng").when(has(ok), "ok").otherwise("unknown")


def judged_item(body: Column, number: Column, ok: Column, ng: Column) -> Column:
    """Judges the part of a reply that has the item's number; a numbered reply without it is unknown."""
    segments = T.reply_segments(body)
    own = F.try_element_at(F.filter(segments, lambda s: s["number"] == number), F.lit(-1))["part"]
    return F.when(own.isNotNull(), judged(own, ok, ng)).when(F.size(segments) > 0, "unknown").otherwise(judged(body, ok, ng))


def item_number(body: Column, title: Column) -> Column:
    """The number under which a proposal lists a title: the first whose title is the same, or holds it, or is held by it."""
    pattern = r"【[\s　]*([0-9]+)[\s　]*】[\s　]*([^\n]+)"
    part = lambda i: F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(pattern), F.lit(i))
    items = F.zip_with(part(1), part(2), lambda n, t: F.struct(n.cast("int").alias("n"), T.strip(t).alias("title")))
    # a number that comes twice keeps its first place and its last title
    last = F.transform(items, lambda x: F.struct(x["n"].alias("n"), F.try_element_at(F.filter(items, lambda y: y["n"] == x["n"]), F.lit(-1))["title"].alias("title")))
    needle = T.strip(F.coalesce(title, F.lit("")))
    fits = F.filter(last, lambda x: x["title"].contains(needle) | needle.contains(x["title"]))
    return F.when(needle != "", F.get(fits, F.lit(0))["n"])


def item_titles(messages: DataFrame, links: DataFrame, talents: DataFrame, projects: DataFrame) -> DataFrame:
    """message_id and the title under which a proposal stands in its mail: the project's, or the first talent's name."""
    first = links.groupBy("message_id").agg(F.min("talent_id").alias("linked"))
    named = messages.join(projects.select("project_id", "title"), "project_id", "left").join(first, "message_id", "left")
    named = named.join(talents.select(F.col("talent_id").alias("linked"), "display_name"), "linked", "left")
    return named.select("message_id", F.when(F.col("kind") == "talent_proposal", F.col("title")).when(F.col("kind") == "project_proposal", F.col("display_name")).alias("item_title"))


def external_judgment(answer: Column) -> Column:
    text = F.lower(T.strip(F.coalesce(answer, F.lit(""))))
    found = F.lit(None).cast("string")
    for judgment, words in ANSWERS.items():
        found = F.when(text.isin(*words), judgment).otherwise(found)
    return found


def judge_replies(messages: DataFrame, titles: DataFrame, mails: DataFrame, external: DataFrame, ok: Column, ng: Column) -> DataFrame:
    """message_id, mail_id and judgment of mails (message_id, mail_id, body) that may answer a proposal. An external
    judgment (message_id, mail_id, answer) that can be read goes first, keywords fill the gaps."""
    rows = mails.join(messages.select("message_id", "body_text"), "message_id").join(titles, "message_id", "left").join(external, ["message_id", "mail_id"], "left")
    number = item_number(F.col("body_text"), F.col("item_title"))
    return rows.select("message_id", "mail_id", F.coalesce(external_judgment(F.col("answer")), judged_item(F.col("body"), number, ok, ng)).alias("judgment"))


def rejudged(replies: DataFrame, judgments: DataFrame) -> DataFrame:
    """Replies with new judgments (message_id, mail_id, judgment); those that were set by hand stay."""
    new = judgments.groupBy("message_id", F.col("mail_id").alias("gmail_message_id")).agg(F.max("judgment").alias("new"))
    both = replies.join(new, ["message_id", "gmail_message_id"], "left")
    return both.withColumn("judgment", F.when((F.col("judgment_source") == "auto") & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("judgment"))).drop("new")


def set_by_hand(chosen: DataFrame, messages: DataFrame, replies: DataFrame, emails: DataFrame, now: Column) -> DataFrame:
    """Replies after someone set the status of proposals (chosen: message_id, judgment): the newest valid reply gets it,
    and where there is none a reply is made."""
    newest = O.latest_reply(O.valid_replies(replies, messages, emails)).select("message_id", F.col("reply_id").alias("newest"))
    picked = chosen.select("message_id", F.col("judgment").alias("new")).join(newest, "message_id", "left")
    there = replies.join(picked.filter("newest is not null").select(F.col("newest").alias("reply_id"), "new"), "reply_id", "left")
    there = there.withColumns({"judgment": F.coalesce("new", "judgment"), "judgment_source": F.when(F.col("new").isNotNull(), "manual").otherwise(F.col("judgment_source"))}).select(replies.columns)
    made = picked.filter("newest is null").select(F.xxhash64("message_id", F.lit("manual")).alias("reply_id"), "message_id", F.concat(F.lit("manual:"), F.col("message_id").cast("string")).alias("gmail_message_id"), now.alias("received_at"), F.col("new").alias("judgment"), F.lit("manual").alias("judgment_source"))
    return there.unionByName(made, allowMissingColumns=True)
