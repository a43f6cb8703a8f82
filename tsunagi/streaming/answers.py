"""Replies to proposals where both are streams: each waits in state for the other, as long as one can still answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsunagi.sources.keyed import KeyedTable

ANSWER = "message_id long, mail_id string, received_at timestamp"
KEYS = ["message_id", "mail_id"]
#: What waits is kept on disk, with a bounded share of an executor's memory, not in its heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
}


def answers(proposals: DataFrame, mails: DataFrame, emails: DataFrame, horizon: str, late: str) -> DataFrame:
    """message_id, mail_id and received_at of mails that may answer a proposal, in whatever order the two came.

    `proposals`: message_id, thread_id, gmail_message_id, status, sent_at, created_at, in_reply_to_email_id; `mails`:
    thread_id, mail_id, received_at. A mail answers a proposal of its thread if it came after it and is neither the
    proposal itself nor the mail that it answered (`emails` tells its id). A proposal without a time of sending counts from
    when it was made. It waits for answers for `horizon`, and rows may be `late` by as much; older ones leave the state."""
    sources = emails.select(F.col("email_id").alias("in_reply_to_email_id"), F.col("gmail_message_id").alias("source_mail"))
    sent = proposals.filter("status = 'sent' and thread_id is not null and gmail_message_id is not null").join(sources, "in_reply_to_email_id", "left")
    sent = sent.select("message_id", "thread_id", "gmail_message_id", "source_mail", F.coalesce("sent_at", "created_at").alias("opened_at"))
    left, right = sent.withWatermark("opened_at", late).alias("p"), mails.withWatermark("received_at", late).alias("m")
    meets = F.expr(f"p.thread_id = m.thread_id and m.received_at > p.opened_at and m.received_at <= p.opened_at + interval {horizon}")
    found = left.join(right, meets).filter("m.mail_id <> p.gmail_message_id and not coalesce(m.mail_id = p.source_mail, false)")
    return found.select("p.message_id", "m.mail_id", "m.received_at")


def sync_answers(stream: DataFrame, replies: DataFrame, folder: str) -> DataFrame:
    """Runs `answers` over what is there; each answer that `replies` does not know is kept once. A batch that is run again
    overwrites what it had written, and a batch looks at the answers before it by key, in one table."""
    known = replies.filter("gmail_message_id is not null").select("message_id", F.col("gmail_message_id").alias("mail_id"))
    table = KeyedTable(f"{folder}/answers", KEYS, stream.sparkSession.createDataFrame([], ANSWER))

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(KEYS).join(known, KEYS, "left_anti")
        table.put(number, rows.join(table.before(number).select(*KEYS), KEYS, "left_anti"))
        if number % 20 == 19:
            table.compact(number)

    conf = stream.sparkSession.conf
    old = {name: conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        conf.set(name, value)
    try:  # a query keeps what was set when it started, and a checkpoint the kind of state that it has
        query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    finally:
        for name, value in old.items():
            conf.unset(name) if value is None else conf.set(name, value)
    query.awaitTermination()
    return table.before(1 << 30)
