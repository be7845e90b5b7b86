"""Registered queries: one per operator of the inventory, each with a DuckDB
oracle written independently in SQL (``None`` where SQL cannot express it).

Every query reads the driver's tables (through the stand-in builders of
``plans.inputs``) in full and runs the operator through the library.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.functions import prompts as P
from answer_eval.functions import text as X
from answer_eval.operators import attempts as W
from answer_eval.operators import history as H
from answer_eval.operators import metrics as M
from answer_eval.operators.grade import expected_rows, grade, grade_inline
from answer_eval.operators.score import score
from answer_eval.plans import catalog_requests
from answer_eval.plans import inputs as I
from answer_eval.session import ensure_checkpoint_dir
from answer_eval.sinks import report as K
from answer_eval.sources import problems as S
from answer_eval.sources.answers import decode_envelope, decode_flat
from answer_eval.sources.requests import MSG_NO_PARTICIPANTS, parse_requests
from answer_eval.streaming import stateful as ST

QueryFn = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------------------
# Spark side: shared building blocks
# ---------------------------------------------------------------------------


def _problems(spark, sf):
    return S.coerce_labels(I.problems(spark, sf))


def _graded(spark, sf, mode="substring"):
    probs = _problems(spark, sf).select("story_id", "expected")
    parts = I.participants(spark, sf).select("participant")
    return grade(expected_rows(probs, parts), decode_flat(I.answers(spark, sf)), key="story_id", mode=mode)


def _timed_replies(spark, sf):
    from answer_eval.operators.grade import prepare_replies
    return prepare_replies(decode_flat(I.timed_answers(spark, sf)), key="story_id", dedupe="none")


def _file_stream(spark, sf, name):
    """A file stream over one table of the test folder: over the table's own folder, or, as the source reads
    folders only, over the test folder with a file-name filter where the table is one file.  A table's
    files are in no order of arrival, so all of them make one micro-batch."""
    stream = spark.readStream.schema(I.table(spark, sf, name).schema)
    if S.is_folder(spark, f"{sf}/{name}.parquet"):
        return stream.parquet(f"{sf}/{name}.parquet")
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _scratch(spark, name):
    """A fresh folder under the session's checkpoint dir (shared on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def rule_answerer(prompt: str) -> str:
    """A deterministic stand-in answerer for D1: the verdict follows the prompt's
    length; every fourth length class raises (an unreachable agent)."""
    k = len(prompt) % 4
    if k == 3:
        raise ValueError("answerer unavailable for this prompt")
    return ("True", "False", "Uncertain")[k]


# ---------------------------------------------------------------------------
# Spark side: one function per registered query
# ---------------------------------------------------------------------------


def q_s1_problem_scan(spark, sf):
    paths = [f"{sf}/problems_missing.parquet", f"{sf}/documents.parquet"]
    df = S.read_problems(spark, paths, fmt="parquet", schema=None, na_values=S.PANDAS_NA_VALUES)
    return df.select(F.col("doc_id").alias("story_id"), F.col("text").alias("premises"), "lang", "source", "n_chars")


def q_s1_problem_csv(spark, sf):
    """S1 over a real CSV: the problem table is written as a header CSV with the
    reference column names (hyphens, quoted multi-line premises) into the scratch
    area, then scanned through the candidate-path reader and label coercion."""
    path = _scratch(spark, "problems-csv")
    probs = I.problems(spark, sf)
    probs.select(
        "story_id", "premises", F.lit(None).cast("string").alias("premises-FOL"), "conclusion",
        F.lit(None).cast("string").alias("conclusion-FOL"), "label", F.col("story_id").alias("example_id"),
    ).write.option("header", True).option("escape", '"').csv(path)
    df = S.read_problems(spark, [f"{path}-missing", path], fmt="csv")
    return S.coerce_labels(df).select("story_id", "premises", "expected", "example_id")


def q_s2_answer_log_scan(spark, sf):
    """S2: the reply envelopes are written as a JSON-lines answer log, then scanned
    with the declared nested log schema and decoded."""
    from answer_eval.sources.answers import ENVELOPE_SCHEMA, read_answers
    path = _scratch(spark, "answer-log")
    env = I.answer_envelopes(spark, sf)
    env.select("participant", "story_id", F.from_json("envelope", ENVELOPE_SCHEMA).alias("envelope")) \
        .write.json(path)
    log = read_answers(spark, path, fmt="json")
    return decode_envelope(log).select("participant", "story_id", "reply_status", "answer", "error")


def q_t16_coerce_labels(spark, sf):
    return _problems(spark, sf).select("story_id", "expected", "conclusion")


def q_w1_sample_numbering(spark, sf):
    return S.number_samples(_problems(spark, sf).select("story_id", "expected"), "story_id")


def q_l1_first_n(spark, sf):
    return S.first_n(_problems(spark, sf).select("story_id", "expected"), 100, "story_id")


def q_l1_all_but_last(spark, sf):
    return S.first_n(_problems(spark, sf).select("story_id", "expected"), -7, "story_id")


def q_s3_decode_envelope(spark, sf):
    return decode_envelope(I.answer_envelopes(spark, sf)).select(
        "participant", "story_id", "reply_status", "answer", "error")


def q_s4_s6_request_participants(spark, sf):
    parts, _ = parse_requests(I.requests(spark, sf))
    return parts


def q_s7_request_errors(spark, sf):
    _, errors = parse_requests(I.requests(spark, sf))
    return errors


def q_t1_parse_tags(spark, sf):
    pages = I.table(spark, sf, "pages")
    # explode_outer + filter: a plain explode gets an inferred size(...) > 0 filter
    # that would run the tag scan a second time below the projection
    tags = pages.select("page_id", F.explode_outer(X.parse_tags(F.col("html"))).alias("tag", "body"))
    return tags.filter(F.col("tag").isNotNull())


def q_t2_strip(spark, sf):
    d = I.table(spark, sf, "documents")
    return d.select("doc_id", X.py_strip(F.col("text")).alias("stripped"))


def q_t3_split_formulas(spark, sf):
    d = I.table(spark, sf, "documents")
    out = d.select("doc_id", F.posexplode_outer(X.split_formulas(F.col("text"))).alias("idx", "formula"))
    return out.filter(F.col("idx").isNotNull())


def q_t4_direct_prompt(spark, sf):
    return _problems(spark, sf).select("story_id", P.direct_prompt().alias("prompt"))


def q_t5_formalise_prompt(spark, sf):
    return _problems(spark, sf).select("story_id", P.formalise_prompt().alias("prompt"))


def _exploded_messages(df, col):
    return df.select("story_id", F.posexplode(col).alias("idx", "m")).select(
        "story_id", "idx", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def q_t6_chat_messages(spark, sf):
    return _exploded_messages(_problems(spark, sf), P.chat_messages(P.direct_prompt()))


def q_t7_codegen_messages(spark, sf):
    return _exploded_messages(_problems(spark, sf), P.codegen_messages(P.direct_prompt()))


def q_t8_extract_fenced(spark, sf):
    return I.fenced_replies(spark, sf).select("doc_id", X.extract_fenced(F.col("reply")).alias("code"))


def q_t9_last_verdict_line(spark, sf):
    return I.spoken_answers(spark, sf).select("story_id", X.last_verdict_line(F.col("output")).alias("verdict"))


def q_t10_normalise_answer(spark, sf):
    return I.spoken_answers(spark, sf).select("story_id", X.normalise_answer(F.col("answer")).alias("label"))


def _numbered_expected(spark, sf):
    probs = S.number_samples(_problems(spark, sf).select("story_id", "expected"), "story_id")
    return expected_rows(probs, I.participants(spark, sf).select("participant"))


def q_j1_expected_rows(spark, sf):
    return _numbered_expected(spark, sf).select("participant", "sample_num", "story_id", "expected")


def q_l2_in_sample_order(spark, sf):
    graded = grade(_numbered_expected(spark, sf), decode_flat(I.answers(spark, sf)), key="story_id")
    return S.in_sample_order(graded).select("participant", "sample_num", "story_id", "predicted", "status")


def q_t11_t12_graded(spark, sf):
    return _graded(spark, sf).select("participant", "story_id", "expected", "predicted", "correct",
                                     "status", "error")


def q_t13_default_answer(spark, sf):
    a = I.spoken_answers(spark, sf)
    return a.select("story_id",
                    X.default_answer(F.col("answer"), "direct").alias("direct_answer"),
                    X.default_answer(F.col("answer"), "code").alias("code_answer"))


def q_t14_entailment_verdict(spark, sf):
    return W.solver_verdicts(I.solver_checks(spark, sf)).select("problem_id", "check_id", "verdict")


def q_t15_elapsed_seconds(spark, sf):
    return _timed_replies(spark, sf).select("participant", "story_id", "time")


def q_t17_error_text(spark, sf):
    a = I.attempts(spark, sf).filter(F.col("returncode") != 0)
    return a.select("problem_id", "attempt", X.error_text(F.col("stderr"), F.col("returncode")).alias("error"))


def q_t18_formats(spark, sf):
    lb = M.label_breakdown(_graded(spark, sf))
    return lb.select(
        "participant", "expected",
        X.format_percent(F.col("correct") / F.col("total")).alias("percent_text"),
        X.format_fixed(F.col("accuracy")).alias("accuracy_text"),
        X.right_align(F.col("expected"), 9).alias("label_text"),
    )


def q_a1_outcome_counts(spark, sf):
    return M.outcome_counts(_graded(spark, sf))


def q_a2_accuracy(spark, sf):
    return M.accuracy(_graded(spark, sf), participants=I.participants(spark, sf))


def q_a3_avg_time_per_case(spark, sf):
    return M.avg_time_per_case(_timed_replies(spark, sf))


def q_a4_label_breakdown(spark, sf):
    return M.label_breakdown(_graded(spark, sf))


def q_a5_label_breakdown_wide(spark, sf):
    return M.label_breakdown_wide(_graded(spark, sf))


def q_a6_report(spark, sf):
    return M.report(_graded(spark, sf), I.participants(spark, sf))


def q_a6_report_compact(spark, sf):
    return M.evaluate_report(_problems(spark, sf), I.participants(spark, sf),
                             decode_flat(I.answers(spark, sf)), key="story_id")


def q_a7_run_summary(spark, sf):
    return M.run_summary(I.answers(spark, sf))


def q_a8_total_time(spark, sf):
    return M.total_time(_timed_replies(spark, sf))


def q_a9_breakdown_with_totals(spark, sf):
    return M.label_breakdown_with_totals(_graded(spark, sf))


def q_u1_combine(spark, sf):
    a = M.outcome_counts(_graded(spark, sf, "substring")).withColumn("mode", F.lit("substring"))
    b = M.outcome_counts(_graded(spark, sf, "last_line")).withColumn("mode", F.lit("last_line"))
    return M.combine(a, b)


def q_f3_open_tasks(spark, sf):
    return H.open_tasks(I.tasks(spark, sf))


def q_j3_skip_finished(spark, sf):
    return H.skip_finished(I.task_requests(spark, sf), I.tasks(spark, sf), seq_col="seq")


def q_x2_gate_tasks_batch(spark, sf):
    return H.gate_tasks_batch(I.tasks(spark, sf))


def q_x2_gate_tasks_stream(spark, sf):
    ev = _file_stream(spark, sf, "events")
    kind = F.col("event_type")
    state = (F.when(kind == "purchase", F.lit("completed")).when(kind == "error", F.lit("failed"))
             .when(kind == "signup", F.lit("submitted")).otherwise(F.lit("working")))
    tasks = ev.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), state.alias("state"))
    out, ckpt = _scratch(spark, "x2-out"), _scratch(spark, "x2-ckpt")
    ST.run_to_table(ST.gate_tasks_stream(tasks), out, ckpt)
    return spark.read.parquet(out)


def q_w2_resolve_attempts(spark, sf):
    return W.resolve_attempts(I.attempts(spark, sf))


def q_w3_repair_messages(spark, sf):
    r = W.repair_messages(I.attempts(spark, sf))
    return r.select("problem_id", "attempt", "previous_error",
                    F.col("messages")[0]["content"].alias("system_content"),
                    F.col("messages")[1]["content"].alias("user_content"))


def q_w4_conversation_history(spark, sf):
    return H.conversation_history(I.conversations(spark, sf)).select("conv_id", "position", "role", "content")


def q_w4_conversation_prefixes(spark, sf):
    return H.conversation_prefixes(I.conversations(spark, sf))


def q_w4_messages_sent(spark, sf):
    """The whole message list of every conversation's last user turn."""
    conv = I.conversations(spark, sf)
    last = conv.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    out = H.messages_sent(H.conversation_history(conv), last)
    text = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return out.select("conv_id", "turn", F.size("messages").cast("bigint").alias("n_messages"),
                      F.array_join(text, "\n").alias("sent"))


def q_x1_conversation_stream(spark, sf):
    conv = _file_stream(spark, sf, "conversations")
    out, ckpt = _scratch(spark, "x1-out"), _scratch(spark, "x1-ckpt")
    ST.run_to_table(ST.conversation_stream(conv), out, ckpt)
    return spark.read.parquet(out).select("conv_id", "position", "role", "content")


def _scored(spark, sf):
    prompts = _problems(spark, sf).select("story_id", "expected", P.direct_prompt().alias("prompt"))
    # as many tasks as the bytes need, whatever the splits of the table
    return score(prompts.hint("rebalance"), rule_answerer, timeout_s=30, retries=1, base_delay_s=0)


def q_d1_score(spark, sf):
    return _scored(spark, sf).select("story_id", "reply_status", "answer", "error")


AGENT_PROMPT = "Agent {agent}\n" + P.DIRECT_TEMPLATE


def q_d1_scored_report(spark, sf):
    """D1 feeding the minimum slice end to end: every participant's prompt for every
    problem is answered by the answerer, and the answers are graded and reported.  The problems
    are spread by their bytes before the participants multiply them."""
    probs = _problems(spark, sf)
    parts = I.participants(spark, sf)
    expected = expected_rows(probs.select("story_id", "premises", "conclusion").hint("rebalance"),
                             parts.select("participant"), probs.count())
    prompts = expected.select("participant", "story_id",
                              P.render(AGENT_PROMPT, agent="participant", premises="premises",
                                       conclusion="conclusion").alias("prompt"))
    scored = score(prompts, rule_answerer, timeout_s=30, retries=1, base_delay_s=0)
    return M.evaluate_report(probs.select("story_id", "expected"), parts,
                             scored.drop("started_at", "ended_at"), key="story_id")


def q_k1_results_json(spark, sf):
    return K.results_json(M.report(_graded(spark, sf), I.participants(spark, sf)))


def q_k2_participant_text(spark, sf):
    return K.participant_text(M.report(_graded(spark, sf), I.participants(spark, sf)))


def q_k2_results_text(spark, sf):
    return K.results_text(M.report(_graded(spark, sf), I.participants(spark, sf)))


def q_k3_write_results(spark, sf):
    path = _scratch(spark, "k3-results")
    K.write_results(_graded(spark, sf).select("participant", "story_id", "expected", "predicted",
                                              "correct", "status"), path)
    return spark.read.parquet(path).select("participant", "story_id", "expected", "predicted",
                                           "correct", "status")


def q_k4_leaderboard(spark, sf):
    return K.leaderboard(M.report(_graded(spark, sf), I.participants(spark, sf)))


def q_bench_big_log_report(spark, sf):
    log = decode_flat(I.big_log(spark, sf).withColumn("error_message", F.lit(None).cast("string")))
    graded = grade_inline(log, key=["l_orderkey", "l_linenumber"])
    return M.report(graded)


# ---------------------------------------------------------------------------
# DuckDB oracle side
# ---------------------------------------------------------------------------

WS = "(" + "||".join(f"chr({ord(c)})" for c in X.PY_WHITESPACE) + ")"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def _render_sql(template: str, na_text: str = "nan", **slots: str) -> str:
    import re
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            out.append(_lit(template[pos:m.start()]))
        out.append(f"coalesce(CAST({slots[m.group(1)]} AS VARCHAR), {_lit(na_text)})")
        pos = m.end()
    if pos < len(template):
        out.append(_lit(template[pos:]))
    return "(" + " || ".join(out) + ")"


PROBLEMS_SQL = """
SELECT d.doc_id AS story_id, d.text AS premises,
       'Document ' || CAST(d.doc_id AS VARCHAR) || ' is of good quality.' AS conclusion,
       CASE l.quality WHEN 1 THEN 'True' WHEN 0 THEN 'False' ELSE 'Uncertain' END AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

COERCED_SQL = f"""
SELECT story_id, premises, conclusion, coalesce({_strip('label')}, 'nan') AS expected FROM ({PROBLEMS_SQL})
"""

ANSWER_ROWS_SQL = """
SELECT r.r_name AS participant, r.r_regionkey, d.doc_id AS story_id, d.text,
       (d.doc_id * 7 + r.r_regionkey * 3) % 12 AS res
FROM region r CROSS JOIN documents d WHERE (d.doc_id * 7 + r.r_regionkey * 3) % 12 <> 11
"""

_ANSWER_CASE = "CASE res " + " ".join(f"WHEN {k} THEN {_lit(v)}" for k, v in I._ANSWER_TEXTS.items()) + " END"

ANSWERS_SQL = f"""
SELECT participant, story_id, CASE WHEN res = 10 THEN 'rpc failure' END AS error_message,
       CASE WHEN res = 9 THEN '' WHEN res < 9 THEN
         text[:length(text) // 2] || chr(10) || {_ANSWER_CASE} || chr(10) || text[length(text) // 2 + 1:] END AS answer
FROM ({ANSWER_ROWS_SQL})
"""


SPOKEN_SQL = f"""
SELECT doc_id AS story_id,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE
    text[:length(text) // 2] || ' ' || [{", ".join(_lit(x) for x in I.SPOKEN)}][doc_id % 8 + 1] || ' '
    || text[length(text) // 2 + 1:] END AS answer,
  text || chr(10) || [{", ".join(_lit(x) for x in I.LINES)}][doc_id % 8 + 1]
    || CASE WHEN doc_id % 2 = 1 THEN chr(10) || text ELSE '' END AS output
FROM documents
"""


def _label_of(ans: str) -> str:
    low = f"lower({ans})"
    return (f"CASE WHEN contains({low}, 'uncertain') THEN 'Uncertain' WHEN contains({low}, 'true') THEN 'True' "
            f"WHEN contains({low}, 'false') THEN 'False' END")


def _last_line_of(ans: str) -> str:
    lines = f"list_transform(string_split({_strip(ans)}, chr(10)), lambda x: {_strip('x')})"
    return f"list_filter({lines}, lambda x: x IN ('True', 'False', 'Uncertain'))[-1]"


def _graded_sql(mode: str = "substring") -> str:
    label = _label_of("a.answer") if mode == "substring" else _last_line_of("a.answer")
    return f"""
SELECT participant, story_id, expected, predicted, status, error,
       coalesce(status IN ('ok', 'error_response') AND lower(predicted) = lower(expected), false) AS correct
FROM (
  SELECT p.participant, p.story_id, p.expected,
    CASE WHEN a.story_id IS NULL THEN 'EXCEPTION' WHEN a.error_message IS NOT NULL THEN 'Uncertain'
         WHEN a.answer IS NULL THEN 'ERROR' ELSE coalesce({label}, 'PARSE_ERROR') END AS predicted,
    CASE WHEN a.story_id IS NULL THEN 'exception' WHEN a.error_message IS NOT NULL THEN 'error_response'
         WHEN a.answer IS NULL THEN 'parse_error' WHEN {label} IS NULL THEN 'parse_error' ELSE 'ok' END AS status,
    CASE WHEN a.story_id IS NULL THEN 'No reply recorded for this sample'
         WHEN a.error_message IS NOT NULL THEN a.error_message
         WHEN a.answer IS NULL THEN 'No text in response'
         WHEN {label} IS NULL THEN 'Could not parse answer' END AS error
  FROM (SELECT r.r_name AS participant, q.story_id, q.expected
        FROM region r CROSS JOIN ({COERCED_SQL}) q) p
  LEFT JOIN ({ANSWERS_SQL}) a ON a.participant = p.participant AND a.story_id = p.story_id
) g
"""


GRADED_SQL = _graded_sql()


def _round(x: str) -> str:
    """Two decimals of a double's exact value (the printed text is rounded correctly)."""
    return f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"


def _pct(c: str, t: str) -> str:
    return f"CASE WHEN {t} > 0 THEN {_round(f'CAST({c} AS DOUBLE) / CAST({t} AS DOUBLE) * 100.0')} ELSE 0.0 END"


_COUNT_SQL = """CAST(count(*) AS BIGINT) AS total,
  CAST(count_if(correct) AS BIGINT) AS correct,
  CAST(count_if(NOT correct AND status IN ('parse_error', 'exception')) AS BIGINT) AS parse_errors"""

_WIDE_SQL = ",\n  ".join(
    f"CAST(count_if(expected = '{lab}' AND correct) AS BIGINT) AS {lab.lower()}_correct, "
    f"CAST(count_if(expected = '{lab}') AS BIGINT) AS {lab.lower()}_total"
    for lab in X.LABELS)

_WIDE_RATES_SQL = ", ".join(
    f"{p}_correct, {p}_total, {_pct(p + '_correct', p + '_total')} AS {p}_accuracy"
    for p in (lab.lower() for lab in X.LABELS))

REPORT_SQL = f"""
WITH g AS ({GRADED_SQL}),
c AS (SELECT participant, {_COUNT_SQL}, {_WIDE_SQL} FROM g GROUP BY participant),
p AS (SELECT r_name AS participant, 'region-' || CAST(r_regionkey AS VARCHAR) AS agent_id FROM region)
SELECT c.participant AS id, {_pct('correct', 'total')} AS score, {_pct('correct', 'total')} AS accuracy,
  c.participant AS agent, p.agent_id, {_pct('correct', 'total')} AS pass_rate, correct, total,
  total - correct - parse_errors AS incorrect, parse_errors,
  CAST(NULL AS DOUBLE) AS time_used, CAST(NULL AS DOUBLE) AS avg_time_per_case, total AS max_score,
  {_WIDE_RATES_SQL}
FROM c JOIN p ON c.participant = p.participant
"""

TIMED_SQL = """
SELECT 'user-' || CAST(user_id AS VARCHAR) AS participant, event_id AS story_id, ts AS started_at,
  coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS ended_at
FROM events
"""

ATTEMPTS_SQL = """
SELECT user_id AS problem_id, event_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS attempt,
  'print(' || props || ')' AS code,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS returncode,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0
    THEN 'NameError ' || props || chr(10) || coalesce(text || chr(10), '') ELSE '' END AS stderr,
  coalesce(text || chr(10), '') || CASE event_type WHEN 'view' THEN 'checking' || chr(10) || 'True'
    WHEN 'click' THEN 'False' || chr(10) || 'done' WHEN 'signup' THEN 'Uncertain'
    WHEN 'purchase' THEN 'no verdict' ELSE '' END AS stdout,
  'Problem of user ' || CAST(user_id AS VARCHAR) AS problem_text
FROM events LEFT JOIN documents ON doc_id = event_id
"""

TASKS_SQL = """
SELECT user_id AS task_id, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
    WHEN 'signup' THEN 'submitted' ELSE 'working' END AS state
FROM events
"""

REQUESTS_SQL = """
SELECT event_id AS request_id, CASE event_id % 5
  WHEN 0 THEN '{"participants":[{"name":"a' || CAST(user_id AS VARCHAR) || '","endpoint":"http://h/'
    || CAST(event_id AS VARCHAR) || '"},{"endpoint":"http://g","agent_id":"z"},{"name":"no-endpoint"}],'
    || '"config":{"max_examples":' || CAST(user_id AS VARCHAR) || '}}'
  WHEN 1 THEN '{"participants":{"r1":"http://h/' || CAST(event_id AS VARCHAR)
    || '","r2":{"endpoint":"http://g","agent_id":"q"},"r3":{"x":1},"r4":7},"config":{}}'
  WHEN 2 THEN 'Please evaluate' || chr(10) || '<white_agent_url>' || chr(10) || 'http://h/'
    || CAST(event_id AS VARCHAR) || chr(10) || '</white_agent_url>' || chr(10) || '<max_examples>'
    || CAST(user_id AS VARCHAR) || '</max_examples>'
  WHEN 3 THEN 'evaluate please' ELSE '{"participants":null}' END AS body
FROM events
"""

_TERMINAL = ", ".join(_lit(s) for s in H.TERMINAL_STATES)

CONV_HISTORY_SQL = f"""
WITH firsts AS (
  SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id),
rows AS (
  SELECT conv_id, 0 AS k, CAST(NULL AS BIGINT) AS turn, 'system' AS role, {_lit(P.DIRECT_SYSTEM)} AS content
  FROM firsts WHERE first_role <> 'system'
  UNION ALL
  SELECT conv_id, 1 AS k, turn, role, text AS content FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k, turn) - 1 AS BIGINT) AS position,
  role, content, turn
FROM rows
"""


def _messages_sql(user_expr: str, system: str) -> str:
    return f"""
SELECT story_id, 0 AS idx, 'system' AS role, {_lit(system)} AS content FROM ({COERCED_SQL})
UNION ALL
SELECT story_id, 1 AS idx, 'user' AS role, {user_expr} AS content FROM ({COERCED_SQL})
"""


_DIRECT_PROMPT_SQL = _render_sql(P.DIRECT_TEMPLATE, premises="premises", conclusion="conclusion")
_FORMALISE_PROMPT_SQL = _render_sql(P.FORMALISE_TEMPLATE, premises="premises", conclusion="conclusion")

_ENVELOPE_CASE_STATUS = """CASE WHEN res = 10 THEN 'error_response' WHEN res IN (9, 8, 7) THEN 'parse_error'
  ELSE 'ok' END"""
_ENVELOPE_CASE_ERROR = """CASE WHEN res = 10 THEN 'rpc failure' WHEN res = 9 THEN 'No text in response'
  WHEN res = 8 THEN 'Invalid result type' WHEN res = 7 THEN 'Invalid response type: status_update' END"""

_FENCED_SQL = """
SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN 'Here it is:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
  WHEN 1 THEN 'Code:' || chr(10) || '```' || chr(10) || text || chr(10) || '```'
  WHEN 2 THEN '```python' || chr(10) || '  ' || text
  WHEN 3 THEN '```' || chr(10) || 'first' || chr(10) || '```' || chr(10) || 'text' || chr(10) || '```python'
    || chr(10) || text || chr(10) || '```'
  ELSE text END AS reply
FROM documents
"""

_RULE_SQL = f"""
SELECT story_id, expected, {_DIRECT_PROMPT_SQL} AS prompt FROM ({COERCED_SQL})
"""

_REPAIR_USER_SQL = _render_sql(P.REPAIR_TEMPLATE, na_text="None", problem="c.problem_text",
                               code="p.code", error="prev_error")

ORACLES: dict[str, str | None] = {
    "s1_problem_scan": f"""
SELECT doc_id AS story_id,
  CASE WHEN text IN ({", ".join(_lit(v) for v in S.PANDAS_NA_VALUES)}) THEN NULL ELSE text END AS premises,
  CASE WHEN lang IN ({", ".join(_lit(v) for v in S.PANDAS_NA_VALUES)}) THEN NULL ELSE lang END AS lang,
  CASE WHEN source IN ({", ".join(_lit(v) for v in S.PANDAS_NA_VALUES)}) THEN NULL ELSE source END AS source,
  n_chars FROM documents""",
    "t16_coerce_labels": f"SELECT story_id, expected, conclusion FROM ({COERCED_SQL})",
    "w1_sample_numbering": f"""
SELECT story_id, expected, CAST(row_number() OVER (ORDER BY story_id) AS BIGINT) AS sample_num
FROM ({COERCED_SQL})""",
    "l1_first_n": f"SELECT story_id, expected FROM ({COERCED_SQL}) ORDER BY story_id LIMIT 100",
    "l1_all_but_last": f"""
SELECT story_id, expected FROM (
  SELECT story_id, expected, row_number() OVER (ORDER BY story_id) AS n, count(*) OVER () AS t
  FROM ({COERCED_SQL})) WHERE n <= t - 7""",
    "s3_decode_envelope": f"""
SELECT 'agent-' || CAST(story_id % 5 AS VARCHAR) AS participant, story_id, {_ENVELOPE_CASE_STATUS} AS reply_status,
  CASE WHEN res NOT IN (10, 9, 8, 7) THEN {_strip("coalesce(answer, '')")} END AS answer,
  {_ENVELOPE_CASE_ERROR} AS error
FROM (SELECT *, story_id % 12 AS res FROM ({SPOKEN_SQL}))""",
    "s4_s6_request_participants": f"""
WITH req AS ({REQUESTS_SQL}),
js AS (SELECT request_id, CAST(body AS JSON) AS j FROM req WHERE json_valid(body)),
lst AS (
  SELECT js.request_id, CAST(e.key AS INTEGER) AS position, e.value AS v, js.j
  FROM js, json_each(js.j, '$.participants') e WHERE json_type(js.j, '$.participants') = 'ARRAY'),
obj AS (
  SELECT js.request_id, e.key AS k, e.value AS v, js.j,
    CAST(row_number() OVER (PARTITION BY js.request_id ORDER BY e.key) - 1 AS INTEGER) AS position
  FROM js, json_each(js.j, '$.participants') e WHERE json_type(js.j, '$.participants') = 'OBJECT')
SELECT request_id, position, coalesce(json_extract_string(v, '$.name'), 'unknown') AS name,
  coalesce(json_extract_string(v, '$.agent_id'), json_extract_string(v, '$.name'), 'unknown') AS agent_id,
  json_extract_string(v, '$.endpoint') AS endpoint,
  coalesce(CAST(json_extract(j, '$.config.max_examples') AS BIGINT), 0) AS max_examples
FROM lst WHERE coalesce(json_extract_string(v, '$.endpoint'), '') <> ''
UNION ALL
SELECT request_id, position, k AS name,
  CASE WHEN json_type(v) = 'VARCHAR' THEN k ELSE coalesce(json_extract_string(v, '$.agent_id'), k) END,
  CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE json_extract_string(v, '$.endpoint') END,
  coalesce(CAST(json_extract(j, '$.config.max_examples') AS BIGINT), 0)
FROM obj WHERE json_type(v) IN ('VARCHAR', 'OBJECT')
UNION ALL
SELECT request_id, 0, 'agent', 'agent',
  {_strip("regexp_extract(body, '(?s)<white_agent_url>(.*?)</white_agent_url>', 1)")},
  coalesce(TRY_CAST({_strip("regexp_extract(body, '(?s)<max_examples>(.*?)</max_examples>', 1)")} AS BIGINT), 0)
FROM req WHERE NOT json_valid(body) AND regexp_matches(body, '(?s)<white_agent_url>(.*?)</white_agent_url>')""",
    "s7_request_errors": f"""
WITH req AS ({REQUESTS_SQL})
SELECT request_id, {_lit(MSG_NO_PARTICIPANTS)} AS error FROM req
WHERE (json_valid(body) AND coalesce(json_type(body, '$.participants'), 'NULL') NOT IN ('ARRAY', 'OBJECT'))
   OR (NOT json_valid(body) AND NOT regexp_matches(body, '(?s)<white_agent_url>(.*?)</white_agent_url>'))""",
    # DuckDB's regex has no backreference: the same left-to-right scan as a recursive
    # CTE over tag starts (name up to the first '>', then the first matching close).
    "t1_parse_tags": f"""
WITH RECURSIVE scan(page_id, html, pos, tag, body, mpos) AS (
  SELECT page_id, html, CAST(1 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)
  FROM pages
  UNION ALL
  SELECT page_id, html,
    CASE WHEN c > 0 THEN gt + c - 1 + length(close) ELSE lt + 1 END,
    CASE WHEN c > 0 THEN name END,
    CASE WHEN c > 0 THEN substr(html, gt + 1, c - 1) END,
    CASE WHEN c > 0 THEN lt END
  FROM (
    SELECT page_id, html, lt, gt, name, close, strpos(substr(html, gt + 1), close) AS c
    FROM (
      SELECT page_id, html, lt, gt, substr(html, lt + 1, gt - lt - 1) AS name,
        '</' || substr(html, lt + 1, gt - lt - 1) || '>' AS close
      FROM (
        SELECT page_id, html, lt, lt + strpos(substr(html, lt + 1), '>') AS gt,
          strpos(substr(html, lt + 1), '>') AS g
        FROM (SELECT page_id, html, pos + strpos(substr(html, pos), '<') - 1 AS lt,
                     strpos(substr(html, pos), '<') AS l
              FROM scan WHERE pos <= length(html))
        WHERE l > 0)
      WHERE g > 0)))
SELECT page_id, tag, arg_max({_strip('body')}, mpos) AS body FROM scan WHERE tag IS NOT NULL GROUP BY page_id, tag""",
    "t2_strip": f"SELECT doc_id, {_strip('text')} AS stripped FROM documents",
    "t3_split_formulas": f"""
SELECT doc_id, CAST(i AS INTEGER) AS idx, formula FROM (
  SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS i, unnest(l) AS formula FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}),
                               lambda x: x <> '') AS l FROM documents))""",
    "t4_direct_prompt": f"SELECT story_id, {_DIRECT_PROMPT_SQL} AS prompt FROM ({COERCED_SQL})",
    "t5_formalise_prompt": f"SELECT story_id, {_FORMALISE_PROMPT_SQL} AS prompt FROM ({COERCED_SQL})",
    "t6_chat_messages": _messages_sql(_DIRECT_PROMPT_SQL, P.DIRECT_SYSTEM),
    "t7_codegen_messages": _messages_sql(f"{_DIRECT_PROMPT_SQL} || chr(10) || chr(10) || {_lit(P.CODEGEN_SUFFIX)}",
                                         P.CODEGEN_SYSTEM),
    "t8_extract_fenced": f"""
SELECT doc_id, CASE WHEN contains(reply, '```python')
    THEN {_strip("split_part(split_part(reply, '```python', 2), '```', 1)")}
  WHEN contains(reply, '```') THEN {_strip("split_part(reply, '```', 2)")} ELSE reply END AS code
FROM ({_FENCED_SQL})""",
    "t9_last_verdict_line": f"""
SELECT story_id, coalesce({_last_line_of('output')}, 'Uncertain') AS verdict FROM ({SPOKEN_SQL})""",
    "t10_normalise_answer": f"SELECT story_id, {_label_of('answer')} AS label FROM ({SPOKEN_SQL})",
    "t11_t12_graded": f"SELECT participant, story_id, expected, predicted, correct, status, error FROM ({GRADED_SQL})",
    "t13_default_answer": f"""
SELECT story_id, CASE WHEN answer IS NULL OR answer = '' THEN 'Uncertain' ELSE answer END AS direct_answer,
  coalesce(answer, 'Uncertain') AS code_answer FROM ({SPOKEN_SQL})""",
    "t14_entailment_verdict": """
SELECT l_orderkey AS problem_id, l_linenumber AS check_id,
  CASE WHEN l_returnflag = 'A' THEN 'True' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'False'
       ELSE 'Uncertain' END AS verdict FROM lineitem""",
    "t15_elapsed_seconds": f"""
SELECT participant, story_id, (epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0 AS time FROM ({TIMED_SQL})""",
    "t17_error_text": f"""
SELECT problem_id, attempt, coalesce(nullif({_strip('stderr')}, ''),
  'Execution failed with return code ' || CAST(returncode AS VARCHAR)) AS error
FROM ({ATTEMPTS_SQL}) WHERE returncode <> 0""",
    "t18_formats": f"""
SELECT participant, expected,
  format('{{:.2f}}%', CAST(c AS DOUBLE) / CAST(t AS DOUBLE) * 100.0) AS percent_text,
  format('{{:.2f}}', {_pct('c', 't')}) AS accuracy_text,
  CASE WHEN length(expected) >= 9 THEN expected ELSE lpad(expected, 9, ' ') END AS label_text
FROM (SELECT participant, expected, count(*) AS t, count_if(correct) AS c FROM ({GRADED_SQL}) GROUP BY ALL)""",
    "a1_outcome_counts": f"""
SELECT participant, total, correct, total - correct - parse_errors AS incorrect, parse_errors
FROM (SELECT participant, {_COUNT_SQL} FROM ({GRADED_SQL}) GROUP BY participant)""",
    "a2_accuracy": f"""
SELECT participant, total, correct,
  CASE WHEN total > 0 THEN CAST(correct AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END AS accuracy
FROM (SELECT participant, CAST(count(*) AS BIGINT) AS total, CAST(count_if(correct) AS BIGINT) AS correct
      FROM ({GRADED_SQL}) GROUP BY participant)""",
    "a3_avg_time_per_case": f"""
SELECT participant, total, wall_clock_s,
  CASE WHEN total > 0 THEN wall_clock_s / total ELSE 0.0 END AS avg_time_per_case, mean_time_per_case
FROM (SELECT participant, CAST(count(*) AS BIGINT) AS total,
        (max(epoch_us(ended_at)) - min(epoch_us(started_at))) / 1000000.0 AS wall_clock_s,
        CAST(sum(epoch_us(ended_at) - epoch_us(started_at)) AS DOUBLE) / count(*) / 1000000.0 AS mean_time_per_case
      FROM ({TIMED_SQL}) GROUP BY participant)""",
    "a4_label_breakdown": f"""
SELECT participant, expected, total, correct, {_pct('correct', 'total')} AS accuracy
FROM (SELECT participant, expected, CAST(count(*) AS BIGINT) AS total, CAST(count_if(correct) AS BIGINT) AS correct
      FROM ({GRADED_SQL}) GROUP BY participant, expected)""",
    "a5_label_breakdown_wide": f"""
SELECT participant, {_WIDE_RATES_SQL} FROM (SELECT participant, {_WIDE_SQL} FROM ({GRADED_SQL}) GROUP BY participant)""",
    "a6_report": REPORT_SQL,
    "a6_report_compact": REPORT_SQL,
    "a7_run_summary": f"""
SELECT participant AS agent, CAST(count(*) AS BIGINT) AS runs, CAST(count(error_message) AS BIGINT) AS failed_runs,
  CASE WHEN min(error_message) IS NULL THEN 'Completed' ELSE 'ERROR - ' || min(error_message) END AS status
FROM ({ANSWERS_SQL}) GROUP BY participant""",
    "a8_total_time": f"""
SELECT participant, {_round('(max(epoch_us(ended_at)) - min(epoch_us(started_at))) / 1000000.0')} AS time_used
FROM ({TIMED_SQL}) GROUP BY participant""",
    "a9_breakdown_with_totals": f"""
SELECT participant, expected, CASE WHEN grouping(expected) = 1 THEN 'overall' ELSE 'label' END AS level,
  total, correct, total - correct - parse_errors AS incorrect, parse_errors, {_pct('correct', 'total')} AS accuracy
FROM (SELECT participant, expected, grouping(expected) AS g, {_COUNT_SQL} FROM ({GRADED_SQL})
      GROUP BY GROUPING SETS ((participant), (participant, expected)))""".replace(
        "CASE WHEN grouping(expected) = 1", "CASE WHEN g = 1"),
    "u1_combine": f"""
SELECT participant, total, correct, total - correct - parse_errors AS incorrect, parse_errors, 'substring' AS mode
FROM (SELECT participant, {_COUNT_SQL} FROM ({GRADED_SQL}) GROUP BY participant)
UNION ALL
SELECT participant, total, correct, total - correct - parse_errors AS incorrect, parse_errors, 'last_line' AS mode
FROM (SELECT participant, {_COUNT_SQL} FROM ({_graded_sql('last_line')}) GROUP BY participant)""",
    "f3_open_tasks": f"SELECT task_id, seq, state FROM ({TASKS_SQL}) WHERE state NOT IN ({_TERMINAL})",
    "j3_skip_finished": f"""
SELECT DISTINCT user_id AS task_id FROM events
WHERE user_id NOT IN (
  SELECT task_id FROM (SELECT task_id, arg_max(state, seq) AS state FROM ({TASKS_SQL}) GROUP BY task_id)
  WHERE state IN ({_TERMINAL}))""",
    "x2_gate_tasks_batch": f"""
SELECT task_id, seq, state FROM (
  SELECT task_id, seq, state, max(CASE WHEN state IN ({_TERMINAL}) THEN 1 ELSE 0 END) OVER (
    PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM ({TASKS_SQL})) WHERE coalesce(seen, 0) = 0""",
    "w2_resolve_attempts": f"""
WITH a AS (
  SELECT problem_id, attempt, returncode = 0 AS terminal,
    coalesce({_last_line_of('stdout')}, 'Uncertain') AS verdict
  FROM ({ATTEMPTS_SQL}) WHERE attempt BETWEEN 0 AND 3),
f AS (SELECT problem_id, attempt, verdict,
        row_number() OVER (PARTITION BY problem_id ORDER BY attempt) AS rn FROM a WHERE terminal),
n AS (SELECT problem_id, CAST(count(*) AS BIGINT) AS attempts_made FROM a GROUP BY problem_id)
SELECT n.problem_id, coalesce(f.verdict, 'Uncertain') AS answer,
  CASE WHEN f.problem_id IS NULL THEN 'exhausted' ELSE 'success' END AS resolved_by,
  CAST(f.attempt AS BIGINT) AS final_attempt, n.attempts_made
FROM n LEFT JOIN (SELECT * FROM f WHERE rn = 1) f ON n.problem_id = f.problem_id""",
    "w3_repair_messages": f"""
WITH a AS ({ATTEMPTS_SQL}),
c AS (SELECT * FROM a WHERE attempt BETWEEN 1 AND 3
      AND NOT EXISTS (SELECT 1 FROM a b WHERE b.problem_id = a.problem_id AND b.attempt < a.attempt
                      AND b.returncode = 0)),
p AS (SELECT problem_id, attempt + 1 AS attempt, code,
        coalesce(nullif({_strip('stderr')}, ''), 'Execution failed with return code ' || CAST(returncode AS VARCHAR))
          AS err FROM a),
j AS (SELECT c.problem_id, c.attempt, c.problem_text, p.code,
        coalesce(p.err, {_lit(W.MSG_PREVIOUS_FAILED)}) AS prev_error
      FROM c LEFT JOIN p ON c.problem_id = p.problem_id AND c.attempt = p.attempt)
SELECT problem_id, attempt, prev_error AS previous_error, {_lit(P.REPAIR_SYSTEM)} AS system_content,
  {_REPAIR_USER_SQL.replace('c.problem_text', 'problem_text').replace('p.code', 'code')} AS user_content
FROM j""",
    "w4_conversation_history": CONV_HISTORY_SQL,
    "w4_conversation_prefixes": f"""
SELECT conv_id, turn, position, position + 1 AS messages_sent FROM ({CONV_HISTORY_SQL}) WHERE role = 'user'""",
    "w4_messages_sent": f"""
WITH h AS ({CONV_HISTORY_SQL}),
w AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
e AS (SELECT w.conv_id, w.turn, h.position AS last FROM w JOIN h ON h.conv_id = w.conv_id AND h.turn = w.turn)
SELECT e.conv_id, e.turn, CAST(count(*) AS BIGINT) AS n_messages,
  string_agg(h.role || ':' || h.content, chr(10) ORDER BY h.position) AS sent
FROM h JOIN e ON h.conv_id = e.conv_id AND h.position <= e.last GROUP BY e.conv_id, e.turn""",
    "d1_score": f"""
SELECT story_id, CASE WHEN length(prompt) % 4 = 3 THEN 'exception' ELSE 'ok' END AS reply_status,
  CASE length(prompt) % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN 'Uncertain' END AS answer,
  CASE WHEN length(prompt) % 4 = 3 THEN 'answerer unavailable for this prompt' END AS error
FROM ({_RULE_SQL})""",
    "d1_scored_report": None,  # set below (needs the agent prompt SQL)
    "k3_write_results": f"""
SELECT participant, story_id, expected, predicted, correct, status FROM ({GRADED_SQL})""",
    "k4_leaderboard": f"SELECT id, score, accuracy FROM ({REPORT_SQL})",
    "bench_big_log_report": None,  # filled below
}

ORACLES["w4_conversation_history"] = f"SELECT conv_id, position, role, content FROM ({CONV_HISTORY_SQL})"
ORACLES["x1_conversation_stream"] = ORACLES["w4_conversation_history"]
ORACLES["j1_expected_rows"] = f"""
SELECT r.r_name AS participant, q.sample_num, q.story_id, q.expected
FROM region r CROSS JOIN (
  SELECT story_id, expected, CAST(row_number() OVER (ORDER BY story_id) AS BIGINT) AS sample_num
  FROM ({COERCED_SQL})) q"""
ORACLES["l2_in_sample_order"] = f"""
SELECT g.participant, n.sample_num, g.story_id, g.predicted, g.status
FROM ({GRADED_SQL}) g JOIN (
  SELECT story_id, CAST(row_number() OVER (ORDER BY story_id) AS BIGINT) AS sample_num FROM ({COERCED_SQL})) n
  ON g.story_id = n.story_id"""
ORACLES["s2_answer_log_scan"] = ORACLES["s3_decode_envelope"]
ORACLES["s1_problem_csv"] = f"SELECT story_id, premises, expected, story_id AS example_id FROM ({COERCED_SQL})"
ORACLES["x2_gate_tasks_stream"] = ORACLES["x2_gate_tasks_batch"]


def _bench_sql() -> str:
    log = """
SELECT 'agent-' || CAST(l_suppkey % 10 AS VARCHAR) AS participant,
  CASE l_returnflag WHEN 'A' THEN 'True' WHEN 'N' THEN 'False' ELSE 'Uncertain' END AS expected,
  CASE l_linenumber % 5 WHEN 0 THEN 'True' WHEN 1 THEN ' false ' WHEN 2 THEN 'It is uncertain'
    WHEN 3 THEN 'true or false' ELSE 'no idea' END AS answer, l_quantity AS elapsed_s
FROM lineitem"""
    label = _label_of("answer")
    graded = f"""
SELECT participant, expected, coalesce({label}, 'PARSE_ERROR') AS predicted,
  CASE WHEN {label} IS NULL THEN 'parse_error' ELSE 'ok' END AS status,
  coalesce(lower({label}) = lower(expected), false) AS correct FROM ({log})"""
    return f"""
WITH c AS (SELECT participant, {_COUNT_SQL}, {_WIDE_SQL} FROM ({graded}) GROUP BY participant)
SELECT participant AS id, {_pct('correct', 'total')} AS score, {_pct('correct', 'total')} AS accuracy,
  participant AS agent, participant AS agent_id, {_pct('correct', 'total')} AS pass_rate, correct, total,
  total - correct - parse_errors AS incorrect, parse_errors,
  CAST(NULL AS DOUBLE) AS time_used, CAST(NULL AS DOUBLE) AS avg_time_per_case, total AS max_score,
  {_WIDE_RATES_SQL}
FROM c"""


ORACLES["bench_big_log_report"] = _bench_sql()

_AGENT_PROMPT_SQL = _render_sql(AGENT_PROMPT, agent="r.r_name", premises="q.premises", conclusion="q.conclusion")
ORACLES["d1_scored_report"] = f"""
WITH g AS (
  SELECT r.r_name AS participant, q.expected, length({_AGENT_PROMPT_SQL}) % 4 AS k
  FROM region r CROSS JOIN ({COERCED_SQL}) q),
h AS (SELECT participant, expected,
        CASE k WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN 'Uncertain' ELSE 'EXCEPTION' END AS predicted,
        CASE WHEN k = 3 THEN 'exception' ELSE 'ok' END AS status FROM g),
i AS (SELECT participant, expected, status, k_ok AND lower(predicted) = lower(expected) AS correct
      FROM (SELECT *, status = 'ok' AS k_ok FROM h)),
c AS (SELECT participant, {_COUNT_SQL}, {_WIDE_SQL} FROM i GROUP BY participant),
p AS (SELECT r_name AS participant, 'region-' || CAST(r_regionkey AS VARCHAR) AS agent_id FROM region)
SELECT c.participant AS id, {_pct('correct', 'total')} AS score, {_pct('correct', 'total')} AS accuracy,
  c.participant AS agent, p.agent_id, {_pct('correct', 'total')} AS pass_rate, correct, total,
  total - correct - parse_errors AS incorrect, parse_errors,
  CAST(NULL AS DOUBLE) AS time_used, CAST(NULL AS DOUBLE) AS avg_time_per_case, total AS max_score,
  {_WIDE_RATES_SQL}
FROM c JOIN p ON c.participant = p.participant"""

def _text_sql(report: str = REPORT_SQL, lead: str = "") -> str:
    cat = []
    for lab in X.LABELS:
        q = lab.lower()
        cat.append(f"CASE WHEN {q}_total > 0 THEN '    ' || {_lit(f'{lab:>9s}')} || ': ' || CAST({q}_correct AS VARCHAR)"
                   f" || '/' || CAST({q}_total AS VARCHAR) || ' = ' || format('{{:.2f}}', {q}_accuracy)"
                   f" || '%' END")
    nl = "chr(10)"
    b = "'  • "
    ratio = "CASE WHEN total > 0 THEN CAST(correct AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END"
    secs = lambda col: f"coalesce(format('{{:.2f}}', {col}) || 's', 'n/a')"
    return f"""
SELECT {lead}id, {nl} || 'Agent: ' || agent || {nl}
  || {b}Total Cases: ' || CAST(total AS VARCHAR) || {nl}
  || {b}Correct: ' || CAST(correct AS VARCHAR) || {nl}
  || {b}Incorrect: ' || CAST(incorrect AS VARCHAR) || {nl}
  || {b}Parse Errors: ' || CAST(parse_errors AS VARCHAR) || {nl}
  || {b}Accuracy: ' || format('{{:.2f}}%', {ratio} * 100.0) || {nl}
  || {b}Per-category:' || {nl} || concat_ws({nl}, {", ".join(cat)}) || {nl}
  || {b}Avg Time/Case: ' || {secs('avg_time_per_case')} || {nl}
  || {b}Total Time: ' || {secs('time_used')} || {nl} AS text
FROM ({report})"""


ORACLES["k2_participant_text"] = _text_sql()
ORACLES["k2_results_text"] = f"""
SELECT {_lit(K.TEXT_HEADER)} || CAST(count(*) AS VARCHAR) || {_lit(K.TEXT_AGENTS)}
  || string_agg(text, '' ORDER BY id) || {_lit(K.TEXT_FOOTER)} AS text
FROM ({_text_sql()})"""

_REPORT_FIELDS = ", ".join(f"{c} := {c}" for c in M.REPORT_COLUMNS)
ORACLES["k1_results_json"] = f"""
SELECT CASE WHEN count(*) = 1 THEN CAST(to_json(first(struct_pack({_REPORT_FIELDS}))) AS VARCHAR)
  ELSE CAST(to_json(struct_pack(data := list(struct_pack({_REPORT_FIELDS}) ORDER BY id))) AS VARCHAR) END AS json
FROM ({REPORT_SQL})"""


QUERIES: dict[str, QueryFn] = {
    "s1_problem_scan": q_s1_problem_scan,
    "s1_problem_csv": q_s1_problem_csv,
    "s2_answer_log_scan": q_s2_answer_log_scan,
    "t16_coerce_labels": q_t16_coerce_labels,
    "w1_sample_numbering": q_w1_sample_numbering,
    "l1_first_n": q_l1_first_n,
    "l1_all_but_last": q_l1_all_but_last,
    "s3_decode_envelope": q_s3_decode_envelope,
    "s4_s6_request_participants": q_s4_s6_request_participants,
    "s7_request_errors": q_s7_request_errors,
    "t1_parse_tags": q_t1_parse_tags,
    "t2_strip": q_t2_strip,
    "t3_split_formulas": q_t3_split_formulas,
    "t4_direct_prompt": q_t4_direct_prompt,
    "t5_formalise_prompt": q_t5_formalise_prompt,
    "t6_chat_messages": q_t6_chat_messages,
    "t7_codegen_messages": q_t7_codegen_messages,
    "t8_extract_fenced": q_t8_extract_fenced,
    "t9_last_verdict_line": q_t9_last_verdict_line,
    "t10_normalise_answer": q_t10_normalise_answer,
    "j1_expected_rows": q_j1_expected_rows,
    "t11_t12_graded": q_t11_t12_graded,
    "l2_in_sample_order": q_l2_in_sample_order,
    "t13_default_answer": q_t13_default_answer,
    "t14_entailment_verdict": q_t14_entailment_verdict,
    "t15_elapsed_seconds": q_t15_elapsed_seconds,
    "t17_error_text": q_t17_error_text,
    "t18_formats": q_t18_formats,
    "a1_outcome_counts": q_a1_outcome_counts,
    "a2_accuracy": q_a2_accuracy,
    "a3_avg_time_per_case": q_a3_avg_time_per_case,
    "a4_label_breakdown": q_a4_label_breakdown,
    "a5_label_breakdown_wide": q_a5_label_breakdown_wide,
    "a6_report": q_a6_report,
    "a6_report_compact": q_a6_report_compact,
    "a7_run_summary": q_a7_run_summary,
    "a8_total_time": q_a8_total_time,
    "a9_breakdown_with_totals": q_a9_breakdown_with_totals,
    "u1_combine": q_u1_combine,
    "f3_open_tasks": q_f3_open_tasks,
    "j3_skip_finished": q_j3_skip_finished,
    "x2_gate_tasks_batch": q_x2_gate_tasks_batch,
    "x2_gate_tasks_stream": q_x2_gate_tasks_stream,
    "w2_resolve_attempts": q_w2_resolve_attempts,
    "w3_repair_messages": q_w3_repair_messages,
    "w4_conversation_history": q_w4_conversation_history,
    "w4_conversation_prefixes": q_w4_conversation_prefixes,
    "w4_messages_sent": q_w4_messages_sent,
    "x1_conversation_stream": q_x1_conversation_stream,
    "d1_score": q_d1_score,
    "d1_scored_report": q_d1_scored_report,
    "k1_results_json": q_k1_results_json,
    "k2_participant_text": q_k2_participant_text,
    "k2_results_text": q_k2_results_text,
    "k3_write_results": q_k3_write_results,
    "k4_leaderboard": q_k4_leaderboard,
    "bench_big_log_report": q_bench_big_log_report,
}

for _module in (catalog_requests,):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.oracles(sys.modules[__name__])


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if v is not None and k in QUERIES}
