"""Streams beside their batch twins: repeats, arrivals out of order, runs that break off, and late rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tsunagi.sources.keyed import KeyedTable
from tsunagi.streaming import mail_stream as M

DAY = datetime(2024, 3, 1)


def mail(i, kind="talent", name="A B", body="", days=0, **more):
    text = f"【氏名】{name}\n【最寄駅】{more.get('station', '品川')}\n【単金】{more.get('rate', 60)}万円\n【備考】\n一人で進められます。" if kind == "talent" else f"【案件名】{name}\n【必須スキル】\n・Java\n【業務内容】\n保守"
    return (f"g{i}", kind, DAY + timedelta(days=days), more.get("subject", "s"), text if body == "" else body, "T <t@x.com>")


FIRST = [mail(1), mail(2, rate=70, days=1), mail(3, "project", "P1"), mail(4, body=None, subject=" "), mail(5, "project", "P2", body="【案件名】P2")]
SECOND = [mail(1), mail(4, name="Late", days=2), mail(6, rate=50, days=-1), mail(3, "project", "P1"), mail(7, "project", "p1 ", days=3)]
THIRD = [mail(2, rate=70, days=1), mail(4, body=None, subject=" "), mail(8, name="C", station="上野"), mail(9, "project", "P1", days=1)]


def put_files(spark, folder, *groups):
    for group in groups:
        spark.createDataFrame(group, M.MAIL).coalesce(1).write.mode("append").parquet(str(folder))


def told(tables):
    drop = ("created_at", "updated_at", "arrived_at")
    return {name: sorted(map(str, df.drop(*drop).collect())) for name, df in tables.items()}


def twin(spark, folder):
    tables = M.MailTables(spark, str(folder))
    rows = spark.createDataFrame([r for g in (FIRST, SECOND, THIRD) for r in g], M.MAIL).withColumn("arrived_at", F.lit(DAY))
    tables.absorb(rows, 0)
    return tables.now()


def test_mail_stream_equals_its_batch_twin(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "COMPACT_EVERY", 2)
    want = told(twin(spark, tmp_path / "twin"))
    assert len(want["emails"]) == 9 and len(want["talents"]) == 3 and len(want["projects"]) == 2
    put_files(spark, tmp_path / "in", FIRST, SECOND, THIRD)
    got = M.ingest_mails(M.read_mails(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"))
    assert told(got) == want
    best = {r["display_name"]: (r["desired_rate"], r["mail_id"]) for r in got["talents"].collect()}
    assert best["A B"] == (70, "g2") and "Late" in best
    status = {r["gmail_message_id"]: r["status"] for r in got["emails"].collect()}
    assert status["g4"] == "summarized" and status["g5"] == "needs_review"
    # nothing new, then one more file: it goes on where it was
    put_files(spark, tmp_path / "in", [mail(10, "project", "P3")])
    again = M.ingest_mails(M.read_mails(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"))
    assert again["projects"].count() == 3 and told(again)["talents"] == want["talents"]


def light(name, *more):
    """An extraction of names alone, as what is tested is how batches are put and not what mails say."""
    named = F.regexp_extract(F.coalesce("body", F.lit("")), "【(?:氏名|案件名)】([^\n]*)", 1).alias(name)
    return lambda mails: mails.select("mail_id", named, *[F.lit(None).cast("string").alias(c) for c in more], F.lit(False).alias("needs_review"))


@pytest.mark.parametrize("table", ["emails"])
def test_a_mail_stream_that_breaks_off_ends_the_same(spark, tmp_path, monkeypatch, table):
    keys = {"talent": ("display_name", "source_company_name", "nearest_station"), "project": ("title", "source_company_name")}
    monkeypatch.setattr(M, "KINDS", {kind: (light(*names), names) for kind, names in keys.items()})
    monkeypatch.setattr(M, "FIELDS", {kind: ", ".join(f"{c} string" for c in names) for kind, names in keys.items()})
    want = told(twin(spark, tmp_path / "twin"))
    put_files(spark, tmp_path / "in", FIRST, SECOND, THIRD)
    whole, failed = KeyedTable.put, []

    def put(self, number, rows):
        whole(self, number, rows)
        if self.folder.endswith(table) and number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost between write and commit")

    monkeypatch.setattr(KeyedTable, "put", put)
    with pytest.raises(StreamingQueryException):
        M.ingest_mails(M.read_mails(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"))
    half = M.MailTables(spark, str(tmp_path / "out" / "tables")).now()
    assert half["emails"].count() == len(FIRST)  # what the broken batch wrote is not seen
    got = M.ingest_mails(M.read_mails(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"))
    assert failed and told(got) == want
