"""End-to-end job: request -> limit -> grade -> reports, and the CLI."""

import json
import os

from pyspark.sql import functions as F

from answer_eval.operators.grade import grade
from answer_eval.plans import evaluate as EV
from answer_eval.plans.evaluate import evaluate, main
from answer_eval.sinks.report import participant_json, results_json, results_text
from answer_eval.sources.answers import decode_flat

PROBLEMS = [(i, ("True", "False", "Uncertain")[i % 3]) for i in range(1, 11)]
ANSWERS = [(p, i, None, ("True", "false", "no idea")[(i + k) % 3])
           for k, p in enumerate(["alpha", "beta"]) for i in range(1, 11)]


def _frames(spark, body):
    problems = spark.createDataFrame(PROBLEMS, "story_id long, label string")
    request = spark.createDataFrame([(0, body)], "request_id long, body string")
    answers = decode_flat(spark.createDataFrame(ANSWERS, "participant string, story_id long, "
                                                           "error_message string, answer string"))
    return problems, request, answers


def test_json_request_with_limit(spark):
    body = json.dumps({"participants": [{"name": "alpha", "endpoint": "http://a"},
                                        {"name": "beta", "agent_id": "B", "endpoint": "http://b"}],
                       "config": {"max_examples": 4}})
    ev = evaluate(*_frames(spark, body), key="story_id")
    rows = {r.id: r for r in ev.report.collect()}
    assert set(rows) == {"alpha", "beta"} and rows["beta"].agent_id == "B"
    assert rows["alpha"].total == 4 and ev.graded.count() == 8
    assert sorted({r.story_id for r in ev.graded.collect()}) == [1, 2, 3, 4]
    assert ev.errors.count() == 0


def test_tag_request_all_but_last_and_unknown_agent(spark):
    body = "<white_agent_url>http://x</white_agent_url><max_examples>-3</max_examples>"
    ev = evaluate(*_frames(spark, body), key="story_id")
    r = ev.report.first()
    # participant "agent" has no replies: every one of the first 7 problems is a parse error
    assert (r.id, r.total, r.correct, r.parse_errors) == ("agent", 7, 0, 7)


def test_request_without_participants(spark):
    ev = evaluate(*_frames(spark, "hello"), key="story_id")
    assert ev.report.count() == 0 and ev.errors.first().error.startswith("ERROR: No participants")


def test_cli_writes_all_outputs(spark, tmp_dir):
    problems = os.path.join(tmp_dir, "problems")
    spark.createDataFrame(PROBLEMS, "story_id long, label string").write.parquet(problems)
    answers = os.path.join(tmp_dir, "answers")
    env = F.to_json(F.struct(F.lit("success").alias("response_kind"), F.lit("message").alias("result_kind"),
                             F.array(F.struct(F.lit("text").alias("kind"), F.col("answer").alias("text"))).alias("parts")))
    (spark.createDataFrame(ANSWERS, "participant string, story_id long, error_message string, answer string")
     .select("participant", "story_id", F.from_json(env, "error_message string, response_kind string, "
             "result_kind string, parts array<struct<kind:string,text:string>>, elapsed_s double").alias("envelope"))
     .write.parquet(answers))
    request = os.path.join(tmp_dir, "request.txt")
    with open(request, "w") as f:
        f.write(json.dumps({"participants": {"alpha": "http://a"}}))
    out = os.path.join(tmp_dir, "out")
    main(["--problems", problems, "--problems-format", "parquet", "--answers", answers,
          "--request", request, "--out", out, "--key", "story_id"])
    assert sorted(os.listdir(out)) == ["report", "report_json", "report_text", "request_errors", "results"]
    doc = json.loads(spark.read.text(os.path.join(out, "report_json")).first()[0])
    assert doc["id"] == "alpha" and doc["total"] == 10


def test_many_requests_with_unnamed_participants(spark):
    problems = spark.createDataFrame([(k, 100 - k, ("True", "False")[k % 2]) for k in range(6)],
                                     "story_id long, example_id long, label string")
    requests = spark.createDataFrame(
        [(1, json.dumps({"participants": [{"endpoint": "http://a"}, {"endpoint": "http://b"}]})),
         (2, json.dumps({"participants": {"z": "http://z", "a": "http://a"}, "config": {"max_examples": 2}})),
         (3, "nothing")], "request_id long, body string")
    log = [(1, p, 100 - k, None, "true") for p in (0, 1) for k in range(6) if p or k < 3] + [(2, 0, 95, None, "false")]
    answers = decode_flat(spark.createDataFrame(log, "request_id long, position int, example_id long, "
                                                     "error_message string, answer string"))
    ev = evaluate(problems, requests, answers)
    rows = {(r.request_id, r.position): r for r in ev.report.collect()}
    assert {k: (r.id, r.total, r.correct, r.parse_errors) for k, r in rows.items()} == {
        (1, 0): ("unknown", 6, 2, 3), (1, 1): ("unknown", 6, 3, 0), (2, 0): ("z", 2, 1, 1), (2, 1): ("a", 2, 0, 2)}
    docs = {r.request_id: json.loads(r.json) for r in results_json(ev.report, "position", by="request_id").collect()}
    assert [d["id"] for d in docs[2]["data"]] == ["z", "a"] and len(docs[1]["data"]) == 2
    assert [r.request_id for r in ev.errors.collect()] == [3]
    assert participant_json(ev.report).count() == 4
    text = {r.request_id: r.text for r in results_text(ev.report, "position", by="request_id").collect()}
    assert text[2].index("Agent: z") < text[2].index("Agent: a")


def test_requests_that_share_a_name_are_graded_once(spark, monkeypatch):
    limits = [None, 3, -4, 0, 200, 3, -1] * 4
    requests = spark.createDataFrame(
        [(k, json.dumps({"participants": [{"name": ("alpha", "beta", "gamma")[k % 3], "endpoint": "http://a"},
                                          {"name": "beta", "endpoint": "http://b"}], "config": {"max_examples": n}}))
         for k, n in enumerate(limits)], "request_id long, body string")
    problems, _, answers = _frames(spark, "")
    asked = []
    monkeypatch.setattr(EV, "grade", lambda expected, *a, **b: asked.append(expected) or grade(expected, *a, **b))
    ev = evaluate(problems, requests, answers, key="story_id")
    assert [x.count() for x in asked] == [3 * 10]
    replies = {(p, i): text for p, i, _, text in ANSWERS}
    want = []
    for k, n in enumerate(limits):
        for place, name in enumerate((("alpha", "beta", "gamma")[k % 3], "beta")):
            for i, (story, label) in enumerate(PROBLEMS[:n] if n else PROBLEMS):
                said = replies.get((name, story), "").lower()
                want.append((k, place, name, story, i + 1, said == label.lower()))
    got = ev.graded.select("request_id", "position", "participant", "story_id", "sample_num", "correct").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {(r.request_id, r.position): r.total for r in ev.report.collect()} == \
        {(k, p): len(PROBLEMS[:n] if n else PROBLEMS) for k, n in enumerate(limits) for p in (0, 1)}
