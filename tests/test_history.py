"""Attempt logs, conversation history, task gates; batch = stream."""

import os

import pandas as pd

from answer_eval.operators import attempts as W
from answer_eval.operators import history as H
from answer_eval.plans import catalog
from answer_eval.streaming import stateful as ST


def test_resolve_attempts_cases(spark):
    rows = [  # problem, attempt, code, returncode, stdout, timed_out
        (1, 0, "c", 1, "", False), (1, 1, "c", 0, "x\nFalse\n", False),            # repaired -> False
        (2, 0, "c", 1, "", False), (2, 1, "c", 1, "", False), (2, 2, "c", 1, "", False),
        (2, 3, "c", 1, "", False),                                                  # exhausted
        (3, 0, "c", 0, "no verdict", False),                                        # success, default
        (4, 0, "c", 1, "", False), (4, 1, None, 0, "True", False),                  # missing output
        (5, 0, "c", 0, "True", True),                                               # timeout
        (6, 0, "c", 1, "", False), (6, 4, "c", 0, "True", False),                   # beyond max repairs
    ]
    df = spark.createDataFrame(rows, "problem_id long, attempt long, code string, returncode int, "
                                     "stdout string, timed_out boolean")
    probs = spark.createDataFrame([(i,) for i in range(1, 8)], "problem_id long")
    got = {r.problem_id: (r.answer, r.resolved_by, r.final_attempt, r.attempts_made)
           for r in W.resolve_attempts(df, probs).collect()}
    assert got == {
        1: ("False", "success", 1, 2), 2: ("Uncertain", "exhausted", None, 4),
        3: ("Uncertain", "success", 0, 1), 4: ("Uncertain", "no_output", 1, 2),
        5: ("Uncertain", "timeout", 0, 1), 6: ("Uncertain", "exhausted", None, 1),
        7: ("Uncertain", "exhausted", None, 0),
    }


def test_repair_messages(spark):
    rows = [(1, 0, "code0", 1, " Traceback x \n", "P1"), (1, 1, "code1", 2, "", "P1"), (1, 2, "c2", 0, "", "P1"),
            (2, 1, "lonely", 1, "", "P2")]
    df = spark.createDataFrame(rows, "problem_id long, attempt long, code string, returncode int, "
                                     "stderr string, problem_text string")
    got = {(r.problem_id, r.attempt): r for r in W.repair_messages(df).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    assert got[(1, 1)].previous_error == "Traceback x"
    assert got[(1, 2)].previous_error == "Execution failed with return code 2"
    assert got[(2, 1)].previous_error == "Previous code execution failed"
    user = got[(1, 1)].messages[1].content
    assert "P1" in user and "code0" in user and "Traceback x" in user
    assert got[(1, 1)].messages[0].role == "system"


def py_history(log, system):
    """Plain-Python model of the direct agent's per-context history."""
    hist = {}
    for conv, turn, role, text in sorted(log):
        msgs = hist.setdefault(conv, [])
        if not msgs and role != "system":
            msgs.append(("system", system))
        msgs.append((role, text))
    return {(c, i): m for c, msgs in hist.items() for i, m in enumerate(msgs)}


def test_conversation_history_matches_model(spark):
    log = pd.read_parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = list(log[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.position): (r.role, r.content) for r in H.conversation_history(df, "SYS").collect()}
    assert got == py_history(rows, "SYS")
    pre = H.conversation_prefixes(df, "SYS").collect()
    assert all(r.messages_sent == r.position + 1 for r in pre)


def test_conversation_stream_equals_batch(spark, tmp_dir):
    src = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{src}/conversations.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "conversations.parquet").parquet(src)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    ST.run_to_table(ST.conversation_stream(stream, "SYS"), out, ck)
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select("conv_id", "position", "role", "content").collect())
    batch = sorted(tuple(r) for r in H.conversation_history(
        spark.read.parquet(f"{src}/conversations.parquet"), "SYS").select("conv_id", "position", "role", "content").collect())
    assert streamed == batch


def test_task_gate_batch_equals_stream_and_model(spark, tmp_dir):
    rows = [(1, 1, "working"), (1, 2, "completed"), (1, 3, "working"), (2, 1, "submitted"), (2, 2, "working"),
            (3, 5, "failed"), (3, 6, "failed")]
    df = spark.createDataFrame(rows, "task_id long, seq long, state string")
    batch = sorted(tuple(r) for r in H.gate_tasks_batch(df).collect())
    assert batch == [(1, 1, "working"), (1, 2, "completed"), (2, 1, "submitted"), (2, 2, "working"), (3, 5, "failed")]
    src = os.path.join(tmp_dir, "tasks")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    ST.run_to_table(ST.gate_tasks_stream(stream), out, ck)
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("task_id", "seq", "state").collect()) == batch


def _stream(spark, batches, schema, folder, op):
    """The batches as one micro-batch each, through ``op`` into a sink; its rows."""
    import time
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(folder, "src"))
        time.sleep(1.1)         # the file source orders by modification time
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "src"))
    out = os.path.join(folder, "out")
    ST.run_to_table(op(src), out, os.path.join(folder, "ck"))
    return spark.read.parquet(out)


def test_conversations_with_ties_and_null_roles_stream_as_in_batch(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(ST, "HOLD", 3)         # most rows of a key go through its list state
    rows = [(1, 0, None, "no role"), (1, 1, "user", "a"), (2, 5, "user", "x"), (2, 5, "user", "y"), (2, 5, "system", "z"),
            (3, 0, "system", "own"), (3, 1, "user", None), (4, None, "user", "no turn"), (4, 0, "assistant", "b")]
    rows += [(7, t, ("user", "assistant")[t % 2], f"m{t}") for t in range(40, 0, -1)]
    schema = "conv_id long, turn long, role string, text string"
    cols = ["conv_id", "position", "role", "content", "turn"]
    batch = H.conversation_history(spark.createDataFrame(rows, schema), "SYS").select(cols)
    got = _stream(spark, [rows], schema, tmp_dir, lambda s: ST.conversation_stream(s, "SYS"))
    want = sorted(map(repr, batch.collect()))
    assert sorted(map(repr, got.select(cols).collect())) == want
    assert "Row(conv_id=1, position=0, role='system', content='SYS', turn=None)" in want
    pre = H.conversation_prefixes(spark.createDataFrame(rows, schema), "SYS").drop("messages_sent").collect()
    users = [(r.conv_id, r.turn, r.position) for r in batch.collect() if r.role == "user"]
    assert sorted(map(repr, map(tuple, pre))) == sorted(map(repr, users))


def test_gate_of_late_and_tied_messages_settles_to_the_batch_result(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(ST, "HOLD", 2)
    first = [(1, 4, "working"), (1, 4, "completed"), (1, 4, "submitted"), (1, 9, "failed"), (2, 7, "working"), (3, 1, "failed")]
    second = [(2, 5, "completed"), (2, 6, "working"), (1, 2, "rejected"), (1, 3, "working"), (3, 1, "working"),
              (4, None, "completed"), (4, 1, "working")]
    schema = "task_id long, seq long, state string"
    want = sorted(map(repr, H.gate_tasks_batch(spark.createDataFrame(first + second, schema)).collect()))
    got = _stream(spark, [first, second], schema, tmp_dir, ST.gate_tasks_stream)
    assert sorted(map(repr, H.gate_tasks_batch(got).collect())) == want
    # what came in order needs no settling: nothing beyond a known terminal message has passed
    rows = set(map(tuple, got.collect()))
    assert (1, 9, "failed") not in rows and (1, 3, "working") not in rows and (2, 6, "working") not in rows
    assert {(1, 4, "working"), (1, 4, "completed"), (1, 4, "submitted"), (3, 1, "working")} <= rows


def test_open_and_skip_finished(spark):
    tasks = spark.createDataFrame([(1, 1, "completed"), (1, 2, "working"), (2, 1, "failed"), (3, 1, "working")],
                                  "task_id long, seq long, state string")
    reqs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "task_id long")
    assert sorted(r.task_id for r in H.skip_finished(reqs, tasks).collect()) == [3, 4]
    assert sorted(r.task_id for r in H.skip_finished(reqs, tasks, seq_col="seq").collect()) == [1, 3, 4]
    assert H.open_tasks(tasks).count() == 2


def _three_batches(spark, tmp_dir):
    import time
    src = os.path.join(tmp_dir, "conv")
    batches = [[(1, 0, "user", "a"), (1, 1, "assistant", "b")], [(2, 0, "user", "c")], [(1, 2, "user", "d")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
            .coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # distinct modification times: the file source orders by them
    schema = "conv_id long, turn long, role string, text string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_conversation_stream_timeout_forgets_idle_history(spark, tmp_dir):
    import pytest
    out = {}
    for label, timeout in (("kept", None), ("expired", 1)):
        d = os.path.join(tmp_dir, label)
        os.makedirs(d)
        result = ST.conversation_stream(_three_batches(spark, d), "SYS", timeout_ms=timeout)
        if timeout:
            with pytest.raises(ValueError):
                ST.run_to_table(result, os.path.join(d, "x"), os.path.join(d, "xck"))
        # a continuously running query (default trigger), stopped once all 4 input
        # rows went through (with processing-time timeouts Spark keeps running
        # no-data batches, so neither availableNow nor processAllAvailable ends)
        q = (result.writeStream.format("parquet").outputMode("append")
             .option("path", os.path.join(d, "out")).option("checkpointLocation", os.path.join(d, "ck"))
             .start())
        try:
            import time
            deadline = time.time() + 90
            while time.time() < deadline:
                seen = sum(p["numInputRows"] for p in q.recentProgress)
                if seen >= 4 and q.lastProgress and q.lastProgress["numInputRows"] == 0:
                    break
                time.sleep(0.5)
        finally:
            q.stop()
        out[label] = sorted((r.conv_id, r.position, r.role, r.content)
                            for r in spark.read.parquet(os.path.join(d, "out")).collect())
    assert (1, 3, "user", "d") in out["kept"]
    # idle through the second batch: conversation 1 restarts with a new system message
    assert (1, 0, "system", "SYS") in out["expired"] and (1, 1, "user", "d") in out["expired"]
    assert out["expired"].count((1, 0, "system", "SYS")) == 2


def test_streams_over_tables_of_several_files(spark, tmp_dir):
    """Later turns may lie in a file that comes first."""
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}/{t}") for c in range(4) for t in range(6)]
    schema = "conv_id long, turn int, role string, text string"
    path = os.path.join(tmp_dir, "conversations.parquet")
    for part in ([r for r in turns if r[1] >= 3], [r for r in turns if r[1] < 3]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    got = sorted(map(tuple, catalog.q_x1_conversation_stream(spark, tmp_dir).collect()))
    assert got == sorted(map(tuple, catalog.q_w4_conversation_history(spark, tmp_dir).collect()))
    assert len(got) == 4 * 7
