"""Registered queries over whole requests (per-request limits, several examples per story, several replies
per example, participants without a name), their documents in parts, broken log lines, and an answerer
with a ledger."""

from __future__ import annotations

import uuid

from answer_eval.functions import prompts as P
from answer_eval.operators.grade import limited_rows
from answer_eval.operators.metrics import REPORT_COLUMNS
from answer_eval.operators.score import score
from answer_eval.plans import inputs as I
from answer_eval.plans.evaluate import evaluate
from answer_eval.session import ensure_checkpoint_dir
from answer_eval.sinks import report as K
from answer_eval.sources import problems as S
from answer_eval.sources.answers import (
    ERR_NO_KEY, ERR_NO_PARTICIPANT, ERR_NOT_JSON, decode_envelope, decode_flat, read_answer_log,
)
from answer_eval.sources.requests import parse_requests


def scratch_path(spark, name):
    """A fresh folder under the session's checkpoint dir (shared on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def q_j1_limited_rows(spark, sf):
    """Participants of all requests, each with the first problems that its limit grants."""
    people, _ = parse_requests(I.exam_requests(spark, sf))
    numbered, total = S.number_rows(S.coerce_labels(I.exam_problems(spark, sf)).select("example_id", "expected"),
                                    "example_id")
    rows = limited_rows(numbered, people.select("request_id", "position", "max_examples"), total)
    return rows.select("request_id", "position", "sample_num", "example_id", "expected")


def q_l1_request_reports(spark, sf):
    """The whole evaluation: requests with limits -> graded examples -> a report row per participant."""
    ev = evaluate(I.exam_problems(spark, sf), I.exam_requests(spark, sf), decode_flat(I.exam_answers(spark, sf)),
                  key="example_id", order_col="seq")
    return ev.report


def q_k1_participant_json(spark, sf):
    """The report of every participant of every request as a JSON row of its own."""
    return K.participant_json(q_l1_request_reports(spark, sf))


def q_k1_json_parts(spark, sf):
    """The reports of all requests as one JSON document in numbered parts."""
    return K.json_parts(q_l1_request_reports(spark, sf), ["request_id", "position"])


def q_k2_text_parts(spark, sf):
    """The reports of all requests as one text in numbered parts."""
    return K.text_parts(q_l1_request_reports(spark, sf), ["request_id", "position"])


def _log_with_broken_lines(spark, sf):
    path = scratch_path(spark, "broken-log")
    I.log_lines(spark, sf).write.text(path)
    return read_answer_log(spark, path)


def q_s2_broken_lines(spark, sf):
    """Lines of an answer log that give no reply, with their text and what is wrong with them."""
    return _log_with_broken_lines(spark, sf)[1].select("line", "error")


def q_s2_lines_beside_broken_ones(spark, sf):
    """The replies of the same log, decoded."""
    return decode_envelope(_log_with_broken_lines(spark, sf)[0]).select(
        "participant", "example_id", "reply_status", "answer", "error")


def _never_asked(prompt: str) -> str:
    raise AssertionError("the ledger holds this prompt's reply")


def q_d1_ledger(spark, sf):
    """D1 with a ledger: answered once by eight calls at a time at most, then read from the record."""
    from answer_eval.plans.catalog import rule_answerer
    prompts = S.coerce_labels(I.problems(spark, sf)).select("story_id", P.direct_prompt().alias("prompt"))
    options = {"calls_per_task": 2, "max_concurrency": 8, "timeout_s": 30, "retries": 1, "base_delay_s": 0,
               "ledger": scratch_path(spark, "d1-ledger"), "ledger_every": 500}
    score(prompts, rule_answerer, **options).write.format("noop").mode("overwrite").save()
    return score(prompts, _never_asked, **options).select("story_id", "reply_status", "answer", "error")


QUERIES = {
    "j1_limited_rows": q_j1_limited_rows,
    "l1_request_reports": q_l1_request_reports,
    "k1_participant_json": q_k1_participant_json,
    "k1_json_parts": q_k1_json_parts,
    "k2_text_parts": q_k2_text_parts,
    "s2_broken_lines": q_s2_broken_lines,
    "s2_lines_beside_broken_ones": q_s2_lines_beside_broken_ones,
    "d1_ledger": q_d1_ledger,
}


def oracles(h) -> dict[str, str]:
    """DuckDB SQL of the queries; ``h`` is the catalog, for its shared fragments."""
    people = """
SELECT s_suppkey AS request_id, CAST(p AS INTEGER) AS position,
  CASE WHEN s_suppkey % 10 = 0 THEN 'unknown' ELSE 'agent-' || CAST(s_suppkey % 7 AS VARCHAR) END AS participant,
  CASE s_suppkey % 50 WHEN 0 THEN 0 WHEN 1 THEN -4 ELSE s_suppkey % 40 + 1 END AS n
FROM supplier, unnest(CASE WHEN s_suppkey % 10 = 0 THEN [0, 1] ELSE [0] END) AS u(p)"""
    numbered = f"""
SELECT story_id AS example_id, expected, CAST(row_number() OVER (ORDER BY story_id) AS BIGINT) AS sample_num,
  count(*) OVER () AS total FROM ({h.COERCED_SQL})"""
    expected = f"""
SELECT p.request_id, p.position, p.participant, q.sample_num, q.example_id, q.expected
FROM ({people}) p JOIN ({numbered}) q
  ON q.sample_num <= CASE WHEN p.n = 0 THEN total WHEN p.n > 0 THEN p.n ELSE total + p.n END"""
    replies = f"""
SELECT 'agent-' || CAST(k AS VARCHAR) AS participant, k, story_id AS example_id, seq, answer FROM ({h.SPOKEN_SQL}),
  range(7) AS a(k), range(1, 3) AS b(seq)
UNION ALL
SELECT 'unknown', 7, story_id, seq, answer FROM ({h.SPOKEN_SQL}), range(1, 3) AS b(seq)"""
    words = ", ".join(h._lit(x) for x in I.SPOKEN)
    log = f"""
SELECT participant, example_id, CASE WHEN (example_id + k) % 10 = 7 THEN 'rpc failure' END AS error_message,
  CASE WHEN seq = 1 AND (example_id + k) % 2 = 0 THEN answer
       ELSE [{words}][(example_id + k * seq) % 8 + 1] END AS answer
FROM ({replies})
WHERE (example_id + k) % 9 <> 8 AND (seq = 1 OR example_id % 4 = 0)
QUALIFY row_number() OVER (PARTITION BY participant, example_id ORDER BY seq) = 1"""
    label = h._label_of("a.answer")
    graded = f"""
SELECT p.request_id, p.position, p.participant, p.expected,
  CASE WHEN a.example_id IS NULL THEN 'exception' WHEN a.error_message IS NOT NULL THEN 'error_response'
       WHEN {label} IS NULL THEN 'parse_error' ELSE 'ok' END AS status,
  coalesce(a.example_id IS NOT NULL
    AND lower(CASE WHEN a.error_message IS NOT NULL THEN 'Uncertain' ELSE {label} END) = lower(p.expected), false)
    AS correct
FROM ({expected}) p LEFT JOIN ({log}) a ON a.participant = p.participant AND a.example_id = p.example_id"""
    report = f"""
WITH c AS (SELECT request_id, position, participant, {h._COUNT_SQL}, {h._WIDE_SQL} FROM ({graded}) GROUP BY ALL)
SELECT request_id, position, participant AS id, {h._pct('correct', 'total')} AS score,
  {h._pct('correct', 'total')} AS accuracy, participant AS agent, participant AS agent_id,
  {h._pct('correct', 'total')} AS pass_rate, correct, total, total - correct - parse_errors AS incorrect, parse_errors,
  CAST(NULL AS DOUBLE) AS time_used, CAST(NULL AS DOUBLE) AS avg_time_per_case, total AS max_score,
  {h._WIDE_RATES_SQL}
FROM c"""
    fields = ", ".join(f"{c} := {c}" for c in REPORT_COLUMNS)
    json_parts = f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY request_id, position) AS part, count(*) OVER () AS n FROM ({report}))
SELECT part, CAST(to_json(struct_pack({fields})) AS VARCHAR) || CASE WHEN part < n THEN ',' ELSE '' END AS text FROM r
UNION ALL SELECT 0, '{{"data":[' UNION ALL SELECT max(part) + 1, ']}}' FROM r"""
    cut = lambda x: f"regexp_replace({x}, '\\n$', '')"
    text_parts = f"""
WITH t AS ({h._text_sql(report, "request_id, position, ")}),
r AS (SELECT text, row_number() OVER (ORDER BY request_id, position) AS part FROM t)
SELECT part, {cut('text')} AS text FROM r
UNION ALL SELECT 0, {cut(f"{h._lit(K.TEXT_HEADER)} || CAST(max(part) AS VARCHAR) || {h._lit(K.TEXT_AGENTS)}")} FROM r
UNION ALL SELECT max(part) + 1, {cut(h._lit(K.TEXT_FOOTER))} FROM r"""
    who = """'agent-' || CAST(doc_id % 5 AS VARCHAR)"""
    broken = f"""
SELECT CASE WHEN doc_id % 17 = 0 THEN '{{"participant":"' || {who} || '","example_id":' || CAST(doc_id AS VARCHAR)
         || ',"envelope":{{"respo'
       WHEN doc_id % 19 = 0 THEN '{{"example_id":' || CAST(doc_id AS VARCHAR) || '}}'
       WHEN doc_id % 23 = 0 THEN '{{"participant":"' || {who} || '"}}'
       ELSE 'not json ' || CAST(doc_id AS VARCHAR) END AS line,
  CASE WHEN doc_id % 17 = 0 THEN {h._lit(ERR_NOT_JSON)} WHEN doc_id % 19 = 0 THEN {h._lit(ERR_NO_PARTICIPANT)}
       WHEN doc_id % 23 = 0 THEN {h._lit(ERR_NO_KEY)} ELSE {h._lit(ERR_NOT_JSON)} END AS error
FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0 OR doc_id % 29 = 0"""
    beside = f"""
SELECT participant, story_id AS example_id, reply_status, answer, error FROM ({h.ORACLES["s3_decode_envelope"]})
WHERE NOT (story_id % 17 = 0 OR story_id % 19 = 0 OR story_id % 23 = 0 OR story_id % 29 = 0)"""
    return {
        "k1_participant_json": f"SELECT request_id, position, CAST(to_json(struct_pack({fields})) AS VARCHAR) AS json "
                               f"FROM ({report})",
        "k1_json_parts": json_parts,
        "k2_text_parts": text_parts,
        "s2_broken_lines": broken,
        "s2_lines_beside_broken_ones": beside,
        "d1_ledger": h.ORACLES["d1_score"],
        "j1_limited_rows": f"SELECT request_id, position, sample_num, example_id, expected FROM ({expected})",
        "l1_request_reports": report,
    }
