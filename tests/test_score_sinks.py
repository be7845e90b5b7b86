"""D1 scorer and the sinks (K1-K4)."""

import json
import os
import time

from pyspark.sql import functions as F

from answer_eval.operators import metrics as M
from answer_eval.operators import score as SC
from answer_eval.operators.score import score
from answer_eval.plans import catalog
from answer_eval.sinks import report as K


def test_score_failures_never_fail_the_job(spark):
    # defined inside the test so they are shipped to the Python workers by value
    class Flaky(Exception):
        pass

    def answerer(prompt):
        if prompt == "boom":
            raise RuntimeError("agent down")
        if prompt == "slow":
            time.sleep(3)
            return "True"
        if prompt == "none":
            return None
        if prompt.startswith("flaky"):
            # fails on the first call per process, then answers
            key = "_seen_" + prompt
            if not getattr(answerer, key, False):
                setattr(answerer, key, True)
                raise Flaky("rate limited")
            return "False"
        return " True "

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["ok", "boom", "slow", "none", "flaky1"])],
                               "story_id long, prompt string")
    out = score(df, answerer, partitions=2, timeout_s=1, retries=3, base_delay_s=0, transient=(Flaky,))
    got = {r.prompt: (r.reply_status, r.answer, r.error) for r in out.collect()}
    assert got["ok"] == ("ok", "True", None)
    assert got["boom"] == ("exception", None, "agent down")
    assert got["slow"][0] == "exception" and "Timed out" in got["slow"][2]
    assert got["none"] == ("parse_error", None, "No text in response")
    assert got["flaky1"] == ("ok", "False", None)
    assert out.filter(F.col("ended_at") < F.col("started_at")).count() == 0


def test_a_call_that_never_returns_ends_with_its_timeout(spark):
    def answerer(prompt):
        if prompt.startswith("stuck"):
            import threading
            threading.Event().wait()
        return prompt

    df = spark.createDataFrame([(i, "stuck" if i % 4 == 0 else f"p{i}") for i in range(12)], "k long, prompt string")
    score(df.limit(1), lambda p: p, partitions=1).collect()          # workers are up
    t = time.time()
    out = score(df, answerer, calls_per_task=4, partitions=1, timeout_s=1, retries=1).collect()
    assert time.time() - t < 8
    assert [r.reply_status for r in sorted(out, key=lambda r: r.k)] == ["exception", "ok", "ok", "ok"] * 3


def test_empty_texts_become_the_default_label_when_asked(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    fn = lambda p: "" if p == "a" else None
    got = {m: sorted((r.prompt, r.reply_status, r.answer) for r in score(df, fn, empty_mode=m).collect())
           for m in (None, "direct", "code")}
    assert got[None] == [("a", "ok", ""), ("b", "parse_error", None)]
    assert got["direct"] == [("a", "ok", "Uncertain"), ("b", "ok", "Uncertain")]
    assert got["code"] == [("a", "ok", ""), ("b", "ok", "Uncertain")]


def test_partitions_follow_the_input(spark):
    df = spark.range(0, 64, 1, 16).selectExpr("cast(id as string) AS prompt")
    assert score(df, lambda p: p).rdd.getNumPartitions() == 16


def _report(spark):
    rows = [("a", 10, 5, 1, 4, 3, 2, 3, 2, 4, 1), ("b", 4, 1, 2, 1, 0, 1, 1, 2, 0, 1)]
    df = spark.createDataFrame(rows, "participant string, total long, correct long, parse_errors long, "
                                     "true_total long, true_correct long, false_total long, false_correct long, "
                                     "uncertain_total long, uncertain_correct long, x long")
    df = df.withColumn("agent_id", F.col("participant"))
    counts = M._with_incorrect(df)
    return M._report_from_counts(counts, "participant", has_time=False)


def test_results_json_one_and_many(spark):
    rep = _report(spark)
    many = json.loads(K.results_json(rep).first()[0])
    assert [d["id"] for d in many["data"]] == ["a", "b"]
    assert set(many["data"][0]) == set(M.REPORT_COLUMNS) and many["data"][0]["time_used"] is None
    one = json.loads(K.results_json(rep.filter("id = 'a'")).first()[0])
    assert one["id"] == "a" and one["score"] == 50.0 and one["true_accuracy"] == 75.0


def test_results_text_layout(spark):
    rep = _report(spark)
    blocks = {r.id: r.text for r in K.participant_text(rep).collect()}
    a = blocks["a"]
    assert "\nAgent: a\n" in a and "  • Accuracy: 50.00%" in a
    assert f"    {'True':>9s}: 3/4 = 75.00%" in a
    assert "Uncertain" in blocks["b"] and f"{'True':>9s}: 0/1" in blocks["b"]
    text = K.results_text(rep).first()[0]
    assert "Evaluated 2 agent(s)" in text and text.index("Agent: a") < text.index("Agent: b")


def test_leaderboard_and_write(spark, tmp_dir):
    rep = _report(spark)
    assert sorted(tuple(r) for r in K.leaderboard(rep).collect()) == [("a", 50.0, 50.0), ("b", 25.0, 25.0)]
    graded = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "participant string, story_id long, correct boolean")
    path = os.path.join(tmp_dir, "res")
    K.write_results(graded, path)
    assert {"participant=a", "participant=b"} <= set(os.listdir(path))
    assert spark.read.parquet(path).count() == 2


def _asked(folder):
    return sorted(f.split("~")[0] for f in os.listdir(folder))


def _noting(folder, seconds=0.0):
    """An answerer that leaves a file per call."""
    def answerer(prompt):
        import os
        import time
        import uuid
        open(os.path.join(folder, f"{prompt}~{uuid.uuid4().hex}"), "w").close()
        time.sleep(seconds)
        return prompt
    return answerer


def test_never_more_calls_at_once_than_the_bound(spark, tmp_dir):
    df = spark.range(40).selectExpr("id", "concat('p', id) AS prompt").repartition(13)
    out = score(df, _noting(tmp_dir, 0.05), calls_per_task=2, max_concurrency=5).collect()
    assert len(out) == 40 and {r.answer for r in out} == {f"p{i}" for i in range(40)}
    steps = sorted([(r.started_at, 1) for r in out] + [(r.ended_at, -1) for r in out])
    at, most = 0, 0
    for _, step in steps:
        at += step
        most = max(most, at)
    assert 1 < most <= 5
    assert score(df, _noting(tmp_dir), calls_per_task=9, max_concurrency=3).rdd.getNumPartitions() == 1


def test_a_ledger_is_asked_before_the_answerer(spark, tmp_dir):
    import threading
    import types
    notes, ledger = os.path.join(tmp_dir, "notes"), os.path.join(tmp_dir, "ledger")
    os.makedirs(notes)
    df = spark.range(30).selectExpr("id", "concat('p', id % 20) AS prompt", "id % 3 AS example_id")
    cols = ["id", "prompt", "example_id", "reply_status", "answer", "error"]
    first = score(df, _noting(notes), partitions=3, ledger=ledger, ledger_every=4).select(cols).collect()
    assert len(first) == 30 and len(_asked(notes)) == 30             # a call per row, not per prompt
    # a job started again, and a task that is run again, ask nothing
    again = score(df, _noting(notes), partitions=2, ledger=ledger, ledger_every=4)
    assert sorted(again.select(cols).collect()) == sorted(first) and len(_asked(notes)) == 30
    # a part of the record is lost: only that is asked again
    root = os.path.join(ledger, "replies")
    lost = sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs)[0]
    with open(lost) as f:
        n = len(f.read().splitlines())
    os.remove(lost)
    assert sorted(again.select(cols).collect()) == sorted(first) and len(_asked(notes)) == 30 + n
    assert threading and types


def test_a_bounded_ledger_is_filled_in_rounds(spark, tmp_dir, monkeypatch):
    notes, ledger = os.path.join(tmp_dir, "notes"), os.path.join(tmp_dir, "ledger")
    os.makedirs(notes)
    answerer = _noting(notes, 0.02)
    monkeypatch.setattr(SC, "SLOT_ROWS", 8)
    monkeypatch.setattr(SC, "ROUND_BYTES", 1)           # a slot a round

    df = spark.range(0, 60, 1, 3).selectExpr("id", "concat('p', id) AS prompt")
    options = {"calls_per_task": 2, "max_concurrency": 4, "ledger": ledger, "ledger_every": 3}
    cols = ["id", "prompt", "reply_status", "answer", "error"]
    out = score(df, answerer, **options)
    assert len(_asked(notes)) == 60                     # the result only reads the record
    first = out.collect()
    assert len(_asked(notes)) == 60 and {r.answer for r in first} == {f"p{i}" for i in range(60)}
    slots = [d for d in os.listdir(os.path.join(ledger, "prompts")) if "=" in d]
    assert len(slots) == 9
    # a round's calls begin after those of the round before have ended
    spans = {}
    for r in first:
        slot = (r.id // 20, r.id % 20 // 8)
        start, end = spans.get(slot, (r.started_at, r.ended_at))
        spans[slot] = min(start, r.started_at), max(end, r.ended_at)
    in_order = sorted(spans.values())
    assert len(in_order) == 9 and all(a[1] <= b[0] for a, b in zip(in_order, in_order[1:]))
    again = score(df, answerer, **options)
    want = sorted(tuple(r[c] for c in cols) for r in first)
    assert sorted(map(tuple, again.select(cols).collect())) == want and len(_asked(notes)) == 60
    # a lost part of the record is asked again by the next call only
    root = os.path.join(ledger, "replies")
    lost = sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".json"))[0]
    with open(lost) as f:
        n = len(f.read().splitlines())
    os.remove(lost)
    assert [len(x) for x in SC._rounds(SC._recorded_prompts(df, ledger), ledger, 1)] == [1]
    assert score(df, answerer, **options).count() == 60 and len(_asked(notes)) == 60 + n
    none = score(df.limit(0), answerer, **(options | {"ledger": f"{ledger}-none"}))
    assert none.count() == 0 and none.columns == out.columns


def _documents(spark, folder, n):
    docs = spark.range(0, n, 1, 4).selectExpr(
        "id AS doc_id", "concat_ws(' ', transform(sequence(1, 200), i -> md5(concat(id, ':', i)))) AS text")
    docs.write.parquet(os.path.join(folder, "documents.parquet"))
    docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality").write.parquet(os.path.join(folder, "labels.parquet"))
    spark.range(5).selectExpr("concat('R', id) AS r_name", "cast(id AS int) AS r_regionkey") \
        .write.parquet(os.path.join(folder, "region.parquet"))


def test_tasks_of_the_scorer_follow_the_bytes(spark, tmp_dir):
    _documents(spark, tmp_dir, 600)                      # about 4 MB
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        scored = catalog.q_d1_score(spark, tmp_dir)
        assert scored.count() == 600 and scored.rdd.getNumPartitions() > 16
        tasks = []
        real = catalog.score
        catalog.score = lambda df, *a, **b: tasks.append(df) or real(df, *a, **b)
        try:
            assert {r.total for r in catalog.q_d1_scored_report(spark, tmp_dir).collect()} == {600}
        finally:
            catalog.score = real
        assert tasks[0].rdd.getNumPartitions() > 16
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_documents_in_parts_read_back_as_one(spark, tmp_dir):
    for n in (0, 1, 7):
        report = M.report(spark.createDataFrame(
            [(f"p{i}", "True", "True", "ok", None, True) for i in range(n)],
            "participant string, expected string, predicted string, status string, error string, correct boolean"))
        whole = K.results_json(report).first().json if n else '{"data":[]}'
        for parts, name in ((K.json_parts(report), "json"), (K.text_parts(report), "text")):
            path = os.path.join(tmp_dir, f"{name}{n}")
            K.write_parts(parts, path)
            files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
            doc = "".join(open(os.path.join(path, f)).read() for f in files)
            if name == "json":
                assert json.loads(doc) == json.loads(whole)
                assert [r.part for r in parts.orderBy("part").collect()] == \
                    ([1] if n == 1 else list(range(n + 2)))
            elif n:
                assert doc == K.results_text(report).first().text
