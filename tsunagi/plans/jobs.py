"""Queries on the logs of pipeline jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsunagi.operators import pipeline as P
from tsunagi.sources.binding import Domain

NOW = "2024-01-20 12:34:56"


def a17_job_totals(d: Domain):
    return P.job_totals(d.pipeline_log)


def a17_step_states(d: Domain):
    return P.step_states(d.pipeline_log)


def a18_step_progress(d: Domain):
    return P.step_progress(d.pipeline_log, F.lit(NOW).cast("timestamp")).select("job_id", "place", "step", "status", "percent", F.bround("weight", 9).alias("weight"), "eta_seconds")


def a18_job_progress(d: Domain):
    """Time left by what the steps took in the jobs that finished them."""
    return P.job_progress(d.pipeline_log, F.lit(NOW).cast("timestamp"), P.measured_seconds(d.pipeline_log)).select("job_id", "status", "percent", "current_step", "eta_seconds", "eta_text")


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _case(what: str, pairs: dict, other: str) -> str:
    return f"CASE {what} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in pairs.items()) + f" ELSE {other} END"


_LONG = "TRY_CAST(json_extract_string(j, '$.{}') AS BIGINT)".format
_ROWS = f"""raw AS (SELECT *, CASE WHEN json_valid(extra) THEN CAST(extra AS JSON) END AS j FROM pipeline_log),
    r AS (SELECT *, json_extract_string(j, '$.step') AS step_, CASE WHEN event IN {_in(P.MESSAGES)} THEN 1 ELSE 0 END AS one, event = '{P.STEP_FINISHED}' AND coalesce({_LONG('exit_code')} <> 0, json_extract_string(j, '$.exit_code') IS NOT NULL) AS bad,
        event = '{P.JOB_FAILED}' AND level = 'ERROR' AS lost, json_extract_string(j, '$.status') AS ended,
        coalesce(sum(CASE WHEN event IN {_in(P.MESSAGES)} THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS to_come,
        last_value(CASE WHEN event = '{P.STEP_STARTED}' THEN json_extract_string(j, '$.step') END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS began FROM raw)"""
_LABELS = {name: label for name, (label, _, _) in P.STEPS.items()}
_FIELDS = f"""s AS (SELECT *, CASE WHEN event = '{P.STARTED}' THEN 'running' WHEN bad OR lost OR event = '{P.CANCELLED}' THEN 'failed' WHEN event = '{P.FINISHED}' THEN CASE WHEN ended = 'ok' THEN 'completed' ELSE 'failed' END END AS to_status,
        CASE WHEN bad THEN coalesce(error_code, '{P.STEP_ERROR}') WHEN lost THEN error_code END AS code,
        CASE WHEN bad THEN coalesce(error_message, {_case('step_', _LABELS, 'step_')} || '{P.FAILED_TEXT}') WHEN lost THEN coalesce(error_message, message) WHEN event = '{P.CANCELLED}' OR (event = '{P.FINISHED}' AND ended = 'cancelled') THEN '{P.STOPPED_TEXT}' END AS told,
        CASE WHEN event = '{P.FINISHED}' AND ended NOT IN ('ok', 'cancelled') THEN {_case("json_extract_string(j, '$.failed_step')", _LABELS, "json_extract_string(j, '$.failed_step')")} || '{P.FAILED_TEXT}' END AS at_end FROM r)"""
_LAST = "arg_max({0}, (ts, seq)) FILTER ({0} IS NOT NULL)".format
_TOTALS = f"""totals AS (SELECT job_id, min(ts) AS started_at, max(ts) AS updated_at, coalesce({_LAST('to_status')}, 'running') AS status, CAST(greatest(sum(one), coalesce(max(CASE WHEN event = '{P.INGESTED}' THEN coalesce({_LONG('ingested')}, 0) + to_come END), 0)) AS BIGINT) AS ingested,
        CAST(coalesce(sum({_LONG('skipped')}) FILTER (event = '{P.INGESTED}'), 0) AS BIGINT) AS skipped, CAST(coalesce(sum({_LONG('failed')}) FILTER (event = '{P.INGESTED}'), 0) AS BIGINT) AS failed, CAST(sum(greatest({_LONG('targets')}, 0)) FILTER (event = '{P.TARGETS}') AS BIGINT) AS total_messages,
        {_LAST('code')} AS error_code, coalesce({_LAST('told')}, {_LAST('at_end')}) AS error_message FROM s GROUP BY job_id)"""
_MARKS = _in((P.TARGETS, P.FETCHED, P.JUDGED, *P.MESSAGES))
_STATES = f"""named AS (SELECT *, unnest(CASE WHEN event IN ('{P.STEP_STARTED}', '{P.STEP_FINISHED}') THEN CASE WHEN step_ = 'ingest' THEN ['ingest_talent', 'ingest_project'] WHEN step_ IS NOT NULL THEN [step_] END
        WHEN event IN {_MARKS} THEN [{_case("json_extract_string(j, '$.label_type')", P.FEEDS, "coalesce(began, 'ingest')")}] WHEN event = 'ingest_cleanup.finished' THEN ['cleanup'] WHEN event = 'matching.rule_score.started' THEN ['match'] END) AS step FROM s),
    states AS (SELECT job_id, step, coalesce(arg_max(v, (ts, seq)) FILTER (v IS NOT NULL), CASE WHEN bool_or(event IN {_MARKS}) THEN 'running' END, 'pending') AS status, coalesce(arg_max(ts, (ts, seq)) FILTER (event = '{P.STEP_STARTED}'), min(ts) FILTER (event IN {_MARKS})) AS started_at,
        arg_max(ts, (ts, seq)) FILTER (event = '{P.STEP_FINISHED}') AS finished_at, arg_max(duration_ms, (ts, seq)) FILTER (event = '{P.STEP_FINISHED}' AND duration_ms IS NOT NULL) AS duration_ms,
        coalesce(max({_LONG('listed')}) FILTER (event = '{P.TARGETS}'), 0) AS listed, coalesce(max({_LONG('targets')}) FILTER (event = '{P.TARGETS}'), 0) AS targets, coalesce(max({_LONG('done')}) FILTER (event = '{P.FETCHED}'), 0) AS fetch_done, coalesce(max({_LONG('total')}) FILTER (event = '{P.FETCHED}'), 0) AS fetch_total,
        coalesce(max({_LONG('done')}) FILTER (event = '{P.JUDGED}'), 0) AS ai_done, coalesce(max({_LONG('total')}) FILTER (event = '{P.JUDGED}'), 0) AS ai_total, CAST(sum(one) AS BIGINT) AS persist_done, CAST(0 AS BIGINT) AS sheet_done, CAST(0 AS BIGINT) AS sheet_total
        FROM (SELECT *, CASE WHEN event = '{P.STEP_STARTED}' THEN 'running' WHEN event = '{P.STEP_FINISHED}' THEN CASE WHEN bad THEN 'failed' ELSE 'completed' END WHEN event = 'ingest_cleanup.finished' THEN 'completed' WHEN event = 'matching.rule_score.started' THEN 'running' END AS v FROM named) GROUP BY ALL)"""


def _progress(seconds: str) -> str:
    """`prog`: the planned steps with percent, weight and time left; `seconds` gives a step's usual time."""
    return f"""plans AS (SELECT job_id, arg_max(json_extract_string(j, '$.steps'), (ts, seq)) FILTER (event = '{P.STARTED}' AND json_extract_string(j, '$.steps') LIKE '[%') AS p FROM r GROUP BY 1),
    planned AS (SELECT job_id, unnest(CASE WHEN p LIKE '%custom%' THEN [0, 1, 2] ELSE [0, 1, 2, 3, 4] END) AS place, unnest(CASE WHEN p LIKE '%custom%' THEN ['ingest_talent', 'match', 'custom'] WHEN p IS NOT NULL THEN ['ingest_talent', 'ingest_project', 'cleanup', 'match', 'reply_sync'] ELSE {list(P.DEFAULT_STEPS)} END) AS step FROM plans),
    f AS (SELECT p.job_id, p.place, p.step, coalesce(status, 'pending') AS status, started_at, greatest(0, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at)) / 1000000.0)) AS el, coalesce(listed, 0) AS listed, coalesce(targets, 0) AS targets, coalesce(fetch_done, 0) AS fd, coalesce(fetch_total, 0) AS ft, coalesce(ai_done, 0) AS ad,
        coalesce(ai_total, 0) AS at_, coalesce(persist_done, 0) AS pd, {seconds} AS sec, {_case('p.step', {k: v[1] for k, v in P.STEPS.items()}, '0.1')}::DOUBLE AS w FROM planned p LEFT JOIN states USING (job_id, step)),
    g AS (SELECT *, coalesce(nullif(targets, 0), nullif(ft, 0), listed) AS tot FROM f), h AS (SELECT *, coalesce(nullif(ft, 0), tot) AS ftot, coalesce(nullif(targets, 0), tot) AS ptot FROM g), k AS (SELECT *, coalesce(nullif(at_, 0), nullif(fd, 0), ftot) AS atot FROM h),
    m AS (SELECT *, 0.05::DOUBLE * CASE WHEN listed > 0 OR targets > 0 THEN 1.0::DOUBLE ELSE 0.0 END + 0.15::DOUBLE * least(1.0::DOUBLE, fd / greatest(1, ftot)) + 0.55::DOUBLE * least(1.0::DOUBLE, ad / greatest(1, atot)) + 0.25::DOUBLE * least(1.0::DOUBLE, pd / greatest(1, ptot)) AS x FROM k),
    q AS (SELECT *, CASE WHEN step LIKE 'ingest_%' THEN CASE WHEN status = 'pending' THEN 0 WHEN tot <= 0 AND status = 'running' THEN 5 ELSE greatest(1, least(99, round_even(x * 100, 0))) END
        ELSE CASE WHEN status <> 'running' THEN 0 WHEN started_at IS NULL OR el <= 0 THEN 5 ELSE greatest(5, least(95, round_even(least(0.95::DOUBLE, el / greatest(1, sec)) * 100, 0))) END END AS y FROM m),
    z AS (SELECT *, CAST(CASE status WHEN 'completed' THEN 100 WHEN 'failed' THEN least(y, 99) ELSE y END AS INT) AS percent, w / sum(w) OVER (PARTITION BY job_id) AS weight FROM q),
    prog AS (SELECT job_id, CAST(place AS INT) AS place, step, status, percent, weight, CAST(CASE WHEN status = 'completed' THEN 0 WHEN status = 'pending' OR started_at IS NULL THEN sec WHEN percent >= 100 THEN 0 WHEN percent > 0 THEN greatest(0, floor(el * 100 / percent) - el) ELSE greatest(0, sec - el) END AS BIGINT) AS eta_seconds FROM z)"""


_FIXED = _case("p.step", {k: v[2] for k, v in P.STEPS.items()}, str(P.OTHER_SECONDS))
_MEASURED = "measured AS (SELECT step, CAST(floor(quantile_cont(duration_ms, 0.5) / 1000) AS INT) AS seconds FROM states WHERE status = 'completed' AND duration_ms IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)"

QUERIES = {
    a17_job_totals: f"WITH {_ROWS}, {_FIELDS}, {_TOTALS} SELECT * FROM totals",
    a17_step_states: f"WITH {_ROWS}, {_FIELDS}, {_STATES} SELECT * FROM states",
    a18_step_progress: f"WITH {_ROWS}, {_FIELDS}, {_STATES}, {_progress(_FIXED)} SELECT job_id, place, step, status, percent, round_even(weight, 9) AS weight, eta_seconds FROM prog",
    a18_job_progress: f"""WITH {_ROWS}, {_FIELDS}, {_TOTALS}, {_STATES}, {_MEASURED}, {_progress(f"coalesce((SELECT seconds FROM measured WHERE measured.step = p.step), {_FIXED})")},
        jobs AS (SELECT job_id, sum(weight * percent / 100) AS share, CAST(sum(CASE WHEN status IN ('pending', 'running') THEN eta_seconds ELSE 0 END) AS BIGINT) AS rest, min(place + 1) FILTER (status = 'running') AS runs, count(*) AS n FROM prog GROUP BY 1),
        v AS (SELECT job_id, t.status, CASE WHEN t.status = 'completed' THEN 100 ELSE CAST(least(100, greatest(0, round_even(round_even(share, 10) * 100, 0))) AS INT) END AS percent, CAST(coalesce(runs, CASE WHEN t.status = 'completed' THEN n ELSE least(n, 1) END) AS INT) AS current_step,
            CASE t.status WHEN 'running' THEN rest WHEN 'completed' THEN 0 END AS eta_seconds, greatest(1, CAST(round_even(rest / 60, 0) AS INT)) AS mins FROM totals t JOIN jobs USING (job_id))
        SELECT job_id, status, percent, current_step, eta_seconds, CASE WHEN status = 'completed' THEN '完了' WHEN status = 'running' THEN CASE WHEN eta_seconds <= 0 THEN 'まもなく完了' WHEN mins < 60 THEN '約' || mins || '分' WHEN mins % 60 = 0 THEN '約' || (mins // 60) || '時間' ELSE '約' || (mins // 60) || '時間' || (mins % 60) || '分' END END AS eta_text FROM v""",
}
