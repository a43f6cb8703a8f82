"""Queries on proposals, replies and the status of pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsunagi.functions.scoring import score_band
from tsunagi.operators import lists as L
from tsunagi.operators import matching as M
from tsunagi.operators import outreach as O
from tsunagi.plans.pairs import BAND, LATEST
from tsunagi.sources.binding import Domain
from tsunagi.sources.staging import staged

_PER_MATCH = "per_match AS (SELECT * FROM messages WHERE status = 'sent' AND kind = 'talent_proposal' AND match_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY sent_at DESC NULLS FIRST, message_id DESC) = 1)"
_LINKED = "linked AS (SELECT m.message_id, m.project_id, m.sent_at, l.talent_id, l.match_id FROM messages m JOIN message_talents l ON m.message_id = l.message_id WHERE status = 'sent' AND kind = 'project_proposal')"
_PER_PAIR = f"{_LINKED}, per_pair AS (SELECT * FROM linked QUALIFY row_number() OVER (PARTITION BY project_id, talent_id ORDER BY sent_at DESC NULLS FIRST, message_id DESC) = 1)"
_VALID = """valid AS (SELECT r.* FROM replies r JOIN messages m USING (message_id) LEFT JOIN (SELECT email_id, gmail_message_id AS source_mail FROM emails) e ON e.email_id = m.in_reply_to_email_id
    WHERE judgment_source = 'manual' OR coalesce(r.gmail_message_id LIKE 'manual:%', false)
        OR (r.gmail_message_id IS DISTINCT FROM m.gmail_message_id AND (source_mail IS NULL OR r.gmail_message_id IS DISTINCT FROM source_mail) AND (m.sent_at IS NULL OR r.received_at IS NULL OR r.received_at > m.sent_at)))"""
_NEWEST = "answers AS (SELECT message_id, judgment, received_at, reply_id FROM {0} QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY received_at DESC NULLS FIRST, reply_id DESC) = 1)"
_OFFERED = f"{_LINKED}, offered AS (SELECT talent_id, project_id FROM matches WHERE match_id IN (SELECT match_id FROM messages WHERE status = 'sent' AND kind = 'talent_proposal') UNION SELECT talent_id, project_id FROM linked)"
_STATS = "count(*) AS total, count(*) FILTER (judgment IS NULL) AS no_reply, count(*) FILTER (judgment = 'ok') AS ok, count(*) FILTER (judgment = 'ng') AS ng"


def w03_latest_per_match(d: Domain):
    return O.latest_per_match(d.messages).select("match_id", "message_id", "sent_at")


def w04_latest_per_pair(d: Domain):
    return O.latest_per_pair(d.messages, d.message_talents).select("project_id", "talent_id", "message_id", "sent_at")


def w05_latest_valid_reply(d: Domain):
    return O.latest_reply(O.valid_replies(d.replies, d.messages, d.emails))


def j08_pending_pairs(d: Domain):
    matches = M.matches_of_latest(d.matches, d.match_runs)
    return matches.select("talent_id", "project_id", "match_id").join(O.offered_pairs(d.messages, d.message_talents, d.matches).hint("shuffle_hash"), ["talent_id", "project_id"], "left_anti")


def j10_proposed_flags(d: Domain):
    return O.proposed_flags(d.matches, d.messages, d.message_talents, d.hidden).select("match_id", "proposed")


def j14_candidate_replies(d: Domain):
    """Each proposal's thread has the proposal, the mail that it answered, and the mail of its order's number."""
    text = lambda c: F.col(c).cast("string")
    mails = d.emails.select(F.concat(F.lit("th"), text("email_id")).alias("thread_id"), F.explode(F.array("gmail_message_id", F.concat(F.lit("g"), text("email_id"), F.lit("-1")), F.concat(F.lit("m"), text("talent_id")))).alias("mail_id"), F.timestamp_add("DAY", F.lit(60), F.col("created_at")).alias("received_at")).distinct()
    return O.candidate_replies(mails, d.messages, d.replies, d.emails)


def j15_stale_replies(d: Domain):
    return O.stale_replies(d.replies, d.messages, d.emails).select("reply_id", "message_id")


def f57_pair_status(d: Domain):
    return O.pair_status(M.matches_of_latest(d.matches, d.match_runs), d.messages, d.message_talents, d.replies, d.emails).select("match_id", "status_talent", "status_project", "outreach_status")


def t02_run_matches(d: Domain):
    best = M.matches_of_latest(d.matches, d.match_runs).select("match_id", *M.PAIR, "score").orderBy(F.col("score").desc(), "match_id").limit(2000)
    status = O.pair_status(staged(best), d.messages, d.message_talents, d.replies, None, few=True)  # kept, so that matches are made once
    return status.join(d.talents.select("talent_id", "display_name"), "talent_id").join(d.projects.select("project_id", "title"), "project_id").select("match_id", "score", "display_name", "title", "outreach_status")


def _matches_of(d: Domain, where: str):
    status = O.pair_status(M.matches_of_latest(d.matches, d.match_runs).filter(where), d.messages, d.message_talents, d.replies, d.emails)
    rows = L.match_rows(status, d.talents, d.projects, d.companies, d.sheets)
    return rows.select("match_id", "display_name", "talent_company", "has_sheet", "title", "project_company", "score", "ai_score", "reason", "status_talent", "status_project").orderBy(F.col("score").desc(), "match_id")


def t03_talent_matches(d: Domain):
    return _matches_of(d, "talent_id = 77")


def t03_project_matches(d: Domain):
    return _matches_of(d, "project_id = 7")


def a07_talent_statistics(d: Domain):
    return O.talent_statistics(d.messages, d.matches, d.replies, d.emails)


def a08_project_statistics(d: Domain):
    return O.project_statistics(d.messages, d.message_talents, d.replies, d.emails)


def a09_ok_rate_by_band(d: Domain):
    return O.ok_rate_by_band(d.messages, d.message_talents, d.matches_named, d.replies, score_band(F.col("score")))


def a10_replied_entities(d: Domain):
    return O.replied_entities(d.messages, d.replies)


def a11_sent_counts(d: Domain):
    return d.messages.agg(F.count_if((F.col("status") == "sent") & (F.col("kind") == "talent_proposal")).alias("talent_proposals"), F.count_if((F.col("status") == "sent") & (F.col("kind") == "project_proposal")).alias("project_proposals"), F.count(F.lit(1)).alias("messages"))


def u10_display_overrides(d: Domain):
    return d.hidden.groupBy("talent_id", "project_id").agg(F.max_by("display_as", F.struct("hidden_at", "display_as")).alias("display_as"))


_MATCHES = f"""WITH {_PER_MATCH}, {_PER_PAIR}, {_VALID}, {_NEWEST.format('valid')} SELECT m.match_id, t.display_name, coalesce(nullif(trim(c.name), ''), nullif(trim(t.source_company_name), '')) AS talent_company, m.talent_id IN (SELECT talent_id FROM sheets WHERE access_status = 'ok') AS has_sheet,
    p.title, coalesce(nullif(trim(o.name), ''), nullif(trim(p.source_company_name), '')) AS project_company, m.score, m.ai_score, m.reason, CASE WHEN x.message_id IS NOT NULL THEN coalesce('reply_' || a.judgment, 'talent_sent') END AS status_talent, CASE WHEN y.message_id IS NOT NULL THEN coalesce('reply_' || b.judgment, 'project_sent') END AS status_project
    FROM (SELECT * FROM matches WHERE run_id = {LATEST} AND {{0}}) m JOIN talents t ON t.talent_id = m.talent_id JOIN projects p ON p.project_id = m.project_id LEFT JOIN companies c ON c.company_id = t.introducer_company_id LEFT JOIN companies o ON o.company_id = p.distributor_company_id
    LEFT JOIN per_match x ON x.match_id = m.match_id LEFT JOIN per_pair y ON y.project_id = m.project_id AND y.talent_id = m.talent_id LEFT JOIN answers a ON a.message_id = x.message_id LEFT JOIN answers b ON b.message_id = y.message_id"""

QUERIES = {
    w03_latest_per_match: f"WITH {_PER_MATCH} SELECT match_id, message_id, sent_at FROM per_match",
    w04_latest_per_pair: f"WITH {_PER_PAIR} SELECT project_id, talent_id, message_id, sent_at FROM per_pair",
    w05_latest_valid_reply: f"WITH {_VALID}, {_NEWEST.format('valid')} SELECT * FROM answers",
    j08_pending_pairs: f"WITH {_OFFERED} SELECT talent_id, project_id, match_id FROM matches ANTI JOIN offered USING (talent_id, project_id) WHERE run_id = {LATEST}",
    j10_proposed_flags: f"""WITH {_LINKED}, told AS (SELECT talent_id, project_id, arg_max(display_as, (hidden_at, display_as)) AS told FROM hidden GROUP BY ALL),
        o AS (SELECT talent_id, project_id FROM messages WHERE status = 'sent' AND kind = 'talent_proposal' UNION ALL SELECT talent_id, project_id FROM linked)
        SELECT match_id, CASE told WHEN 'unproposed' THEN false WHEN 'proposed' THEN true ELSE (m.talent_id, m.project_id) IN (SELECT (talent_id, project_id) FROM o) END AS proposed FROM matches m LEFT JOIN told USING (talent_id, project_id)""",
    j14_candidate_replies: """WITH x AS (SELECT DISTINCT 'th' || email_id AS thread_id, unnest([gmail_message_id, 'g' || email_id || '-1', 'm' || talent_id]) AS mail_id, created_at + INTERVAL 60 DAY AS received_at FROM emails)
        SELECT m.message_id, mail_id, received_at FROM x JOIN messages m USING (thread_id) LEFT JOIN (SELECT email_id, gmail_message_id AS source_mail FROM emails) e ON e.email_id = m.in_reply_to_email_id
        WHERE m.status = 'sent' AND m.gmail_message_id <> mail_id AND (source_mail IS NULL OR source_mail <> mail_id) AND (m.sent_at IS NULL OR received_at > m.sent_at)
            AND NOT EXISTS (FROM replies r WHERE r.message_id = m.message_id AND r.gmail_message_id = mail_id)""",
    j15_stale_replies: f"WITH {_VALID} SELECT reply_id, message_id FROM replies WHERE judgment_source = 'auto' AND reply_id NOT IN (SELECT reply_id FROM valid) AND message_id IN (SELECT message_id FROM messages WHERE status = 'sent')",
    f57_pair_status: f"""WITH {_PER_MATCH}, {_PER_PAIR}, {_VALID}, {_NEWEST.format('valid')},
        s AS (SELECT match_id, CASE WHEN t.message_id IS NOT NULL THEN coalesce('reply_' || a.judgment, 'talent_sent') END AS status_talent,
            CASE WHEN p.message_id IS NOT NULL THEN coalesce('reply_' || b.judgment, 'project_sent') END AS status_project
            FROM (SELECT * FROM matches WHERE run_id = {LATEST}) m LEFT JOIN (SELECT match_id, message_id FROM per_match) t USING (match_id)
            LEFT JOIN (SELECT project_id, talent_id, message_id FROM per_pair) p ON p.project_id = m.project_id AND p.talent_id = m.talent_id LEFT JOIN answers a ON a.message_id = t.message_id LEFT JOIN answers b ON b.message_id = p.message_id)
        SELECT *, coalesce(status_project, status_talent, 'none') AS outreach_status FROM s""",
    t02_run_matches: f"""WITH {_PER_MATCH}, {_PER_PAIR}, {_NEWEST.format('replies')}
        SELECT match_id, score, display_name, title, coalesce(CASE WHEN p.message_id IS NOT NULL THEN coalesce('reply_' || b.judgment, 'project_sent') END, CASE WHEN t.message_id IS NOT NULL THEN coalesce('reply_' || a.judgment, 'talent_sent') END, 'none') AS outreach_status
            FROM (SELECT * FROM matches WHERE run_id = {LATEST} ORDER BY score DESC, match_id LIMIT 2000) m LEFT JOIN (SELECT match_id, message_id FROM per_match) t USING (match_id)
            LEFT JOIN (SELECT project_id, talent_id, message_id FROM per_pair) p ON p.project_id = m.project_id AND p.talent_id = m.talent_id LEFT JOIN answers a ON a.message_id = t.message_id LEFT JOIN answers b ON b.message_id = p.message_id
            JOIN talents tt ON tt.talent_id = m.talent_id JOIN projects pp ON pp.project_id = m.project_id""",
    t03_talent_matches: _MATCHES.format("talent_id = 77"),
    t03_project_matches: _MATCHES.format("project_id = 7"),
    a07_talent_statistics: f"""WITH {_VALID}, {_NEWEST.format('valid')}, o AS (SELECT m.message_id, coalesce(m.talent_id, x.talent_id) AS talent_id, m.project_id, m.sent_at FROM messages m LEFT JOIN matches x USING (match_id) WHERE m.status = 'sent' AND kind = 'talent_proposal'),
        l AS (SELECT * FROM o WHERE talent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY talent_id, project_id ORDER BY sent_at DESC NULLS FIRST, message_id DESC) = 1) SELECT talent_id, {_STATS} FROM l LEFT JOIN answers USING (message_id) GROUP BY talent_id""",
    a08_project_statistics: f"WITH {_PER_PAIR}, {_VALID}, {_NEWEST.format('valid')} SELECT project_id, {_STATS} FROM per_pair LEFT JOIN answers USING (message_id) GROUP BY project_id",
    a09_ok_rate_by_band: f"""WITH {_NEWEST.format('replies')}, o AS (SELECT message_id, match_id FROM messages WHERE status = 'sent' AND kind = 'talent_proposal' UNION ALL SELECT m.message_id, l.match_id FROM messages m LEFT JOIN message_talents l USING (message_id) WHERE status = 'sent' AND kind = 'project_proposal'),
        s AS (SELECT match_id, {BAND} FROM matches), r AS (SELECT coalesce(score_band, '不明') AS band, count(*) AS n_sent, count(*) FILTER (judgment = 'ok') AS n_ok FROM o LEFT JOIN s USING (match_id) LEFT JOIN answers USING (message_id) GROUP BY 1)
        SELECT *, round_even(100.0::DOUBLE * n_ok / n_sent, 1) AS ok_rate FROM r""",
    a10_replied_entities: f"""WITH {_NEWEST.format('replies')}, ids AS (SELECT message_id, CASE kind WHEN 'talent_proposal' THEN 'talent' ELSE 'project' END AS kind, CASE kind WHEN 'talent_proposal' THEN talent_id ELSE project_id END AS id FROM messages WHERE status = 'sent')
        SELECT kind, id, bool_or(judgment = 'ok') AS ok FROM ids JOIN answers USING (message_id) WHERE id IS NOT NULL GROUP BY ALL""",
    a11_sent_counts: "SELECT count(*) FILTER (status = 'sent' AND kind = 'talent_proposal') AS talent_proposals, count(*) FILTER (status = 'sent' AND kind = 'project_proposal') AS project_proposals, count(*) AS messages FROM messages",
    u10_display_overrides: "SELECT talent_id, project_id, arg_max(display_as, (hidden_at, display_as)) AS display_as FROM hidden GROUP BY ALL",
}
