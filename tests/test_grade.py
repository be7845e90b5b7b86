"""Grading and metrics against a plain-Python model of the evaluator."""

import math

import pytest
from pyspark.sql import functions as F

from answer_eval.operators import metrics as M
from answer_eval.operators import grade as G
from answer_eval.operators.grade import CELL_PAIRS, expected_rows, grade, grid, limited_rows
from answer_eval.sources.answers import decode_flat
from answer_eval.sources.problems import coerce_labels

PROBLEMS = [(1, "True"), (2, " False "), (3, "Uncertain"), (4, "true"), (5, None), (6, "Uncertain")]
PARTICIPANTS = [("alice", "A"), ("bob", "B"), ("carol", "C")]
ANSWERS = [  # participant, story, error_message, answer
    ("alice", 1, None, "both true and false"),
    ("alice", 2, None, "not uncertain: TRUE"),
    ("alice", 3, "rpc down", None),
    ("alice", 4, None, "untrue"),
    ("alice", 5, None, "FALSE\n"),
    ("alice", 6, None, "\xa0True\xa0"),
    ("bob", 1, None, ""),
    ("bob", 2, None, None),
    ("bob", 3, None, "Uncertain"),
    ("bob", 6, None, "no idea"),
    ("zed", 1, None, "True"),      # unknown participant: ignored
    ("alice", 99, None, "True"),   # unknown problem: ignored
]


def py_grade():
    """Plain-Python model: every participant x problem, reference rules."""
    ans = {(p, s): (e, a) for p, s, e, a in ANSWERS}
    out = {}
    for p, _ in PARTICIPANTS:
        for s, label in PROBLEMS:
            exp = "nan" if label is None else str(label).strip()
            if (p, s) not in ans:
                out[(p, s)] = (exp, "EXCEPTION", False, "exception")
                continue
            err, text = ans[(p, s)]
            if err is not None:
                out[(p, s)] = (exp, "Uncertain", exp.lower() == "uncertain", "error_response")
                continue
            if text is None:
                out[(p, s)] = (exp, "ERROR", False, "parse_error")
                continue
            low = text.strip().lower()
            pred = ("Uncertain" if "uncertain" in low else "True" if "true" in low
                    else "False" if "false" in low else None)
            if pred is None:
                out[(p, s)] = (exp, "PARSE_ERROR", False, "parse_error")
            else:
                out[(p, s)] = (exp, pred, pred.lower() == exp.lower(), "ok")
    return out


KEY = "story_id"           # the fixture's stories have one row each


@pytest.fixture()
def frames(spark):
    probs = coerce_labels(spark.createDataFrame(PROBLEMS, "story_id long, label string")).select("story_id", "expected")
    parts = spark.createDataFrame(PARTICIPANTS, "participant string, agent_id string")
    answers = decode_flat(spark.createDataFrame(ANSWERS, "participant string, story_id long, "
                                                          "error_message string, answer string"))
    return probs, parts, answers


def test_graded_rows_match_model(spark, frames):
    probs, parts, answers = frames
    g = grade(expected_rows(probs, parts.select("participant")), answers, KEY)
    got = {(r.participant, r.story_id): (r.expected, r.predicted, r.correct, r.status) for r in g.collect()}
    assert got == py_grade()
    times = {(r.participant, r.story_id): r.time for r in g.collect()}
    assert times[("carol", 1)] == 0.0


def test_report_invariants_and_compact_plan_agree(spark, frames):
    probs, parts, answers = frames
    g = grade(expected_rows(probs, parts.select("participant")), answers, KEY)
    full = {r.id: r.asDict() for r in M.report(g, parts).collect()}
    compact = {r.id: r.asDict() for r in M.evaluate_report(probs, parts, answers, KEY).collect()}
    assert full == compact
    model = py_grade()
    for p, agent_id in PARTICIPANTS:
        r = full[p]
        rows = [v for (pp, _), v in model.items() if pp == p]
        correct = sum(1 for v in rows if v[2])
        parse = sum(1 for v in rows if not v[2] and v[3] in ("parse_error", "exception"))
        assert (r["total"], r["correct"], r["parse_errors"]) == (len(rows), correct, parse)
        assert r["correct"] + r["incorrect"] + r["parse_errors"] == r["total"]
        assert r["score"] == r["accuracy"] == r["pass_rate"] == round(correct / len(rows) * 100, 2)
        assert r["agent_id"] == agent_id and r["max_score"] == r["total"] and r["agent"] == r["id"] == p
        assert r["true_total"] == 1 and r["false_total"] == 1 and r["uncertain_total"] == 2
    assert full["carol"]["correct"] == 0 and full["carol"]["parse_errors"] == 6


def test_label_breakdowns(spark, frames):
    probs, parts, answers = frames
    g = grade(expected_rows(probs, parts.select("participant")), answers, KEY)
    long = {(r.participant, r.expected): (r.total, r.correct) for r in M.label_breakdown(g).collect()}
    assert long[("alice", "true")] == (1, 1)      # lower-case label is its own group
    assert long[("alice", "nan")] == (1, 0)
    wide = {r.participant: r for r in M.label_breakdown_wide(g).collect()}
    assert wide["alice"]["true_total"] == 1        # 'true' is absent from the wide form
    sets = M.label_breakdown_with_totals(g).collect()
    overall = {r.participant: r.total for r in sets if r.level == "overall"}
    per_label = {}
    for r in sets:
        if r.level == "label":
            per_label[r.participant] = per_label.get(r.participant, 0) + r.total
    assert overall == per_label == {"alice": 6, "bob": 6, "carol": 6}


def test_duplicates_first_and_error(spark, frames):
    probs, parts, answers = frames
    dup = answers.unionByName(answers.filter(F.col("participant") == "bob").withColumn("answer", F.lit("True")))
    expected = expected_rows(probs, parts.select("participant"))
    for run in (lambda: grade(expected, dup, KEY), lambda: M.evaluate_report(probs, parts, dup, KEY)):
        with pytest.raises(Exception, match="duplicate reply for key"):
            run().collect()
    with pytest.raises(ValueError, match="order_col"):
        grade(expected, dup, KEY, dedupe="first")
    seq = dup.withColumn("seq", F.monotonically_increasing_id())
    assert grade(expected, seq, KEY, order_col="seq").count() == 18


def test_rows_are_graded_not_stories(spark):
    probs = spark.createDataFrame([(1, 10, "True"), (1, 11, "False"), (2, 12, "True")],
                                  "story_id long, example_id long, expected string")
    parts = spark.createDataFrame([("a", "A")], "participant string, agent_id string")
    log = decode_flat(spark.createDataFrame([("a", 1, 10, None, "true"), ("a", 1, 11, None, "false")],
                                            "participant string, story_id long, example_id long, "
                                            "error_message string, answer string"))
    g = grade(expected_rows(probs, parts.select("participant")), log.drop("story_id"))
    assert sorted((r.example_id, r.correct) for r in g.collect()) == [(10, True), (11, True), (12, False)]
    full = [tuple(r) for r in M.report(g, parts).collect()]
    assert full == [tuple(r) for r in M.evaluate_report(probs, parts, log.drop("story_id")).collect()]
    assert full[0][6:10] == (2, 3, 0, 1)
    with pytest.raises(ValueError, match="row key"):
        grade(expected_rows(probs, parts.select("participant")), log.drop("example_id"))


def test_accuracy_zero_participant_and_last_line_mode(spark, frames):
    probs, parts, answers = frames
    g = grade(expected_rows(probs, parts.select("participant")), answers, KEY)
    more = parts.unionByName(spark.createDataFrame([("dave", "D")], "participant string, agent_id string"))
    acc = {r.participant: (r.total, r.accuracy) for r in M.accuracy(g, participants=more).collect()}
    assert acc["dave"] == (0, 0.0)
    ll = grade(expected_rows(probs, parts.select("participant")), answers, KEY, mode="last_line")
    preds = {(r.participant, r.story_id): r.predicted for r in ll.collect()}
    assert preds[("bob", 3)] == "Uncertain" and preds[("alice", 1)] == "PARSE_ERROR"


def test_no_participants_gives_empty(spark, frames):
    probs, parts, _ = frames
    assert expected_rows(probs, parts.select("participant").limit(0)).count() == 0


def test_run_summary_and_combine(spark):
    runs = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "participant string, error_message string")
    s = {r.agent: r.status for r in M.run_summary(runs).collect()}
    assert s == {"a": "ERROR - x", "b": "Completed"}
    c = M.combine(runs.limit(1), runs.limit(1).withColumn("extra", F.lit(1)))
    assert c.count() == 2 and "extra" in c.columns


@pytest.mark.parametrize("n", [5, 5000])
def test_expected_rows_of_any_number_of_participants(spark, n):
    probs = spark.range(3).selectExpr("id AS example_id", "'True' AS expected")
    parts = spark.range(n).selectExpr("concat('p', id) AS participant", "named_struct('x', id, 'y', array(id)) AS info")
    rows = expected_rows(probs, parts).collect()
    assert len(rows) == 3 * n == len({(r.example_id, r.participant) for r in rows})
    assert all(r.participant == f"p{r.info.x}" for r in rows)


@pytest.mark.parametrize("left, right", [(1, 1), (10, 1), (1, 5000), (2000, 3000), (10_000_000, 10_000), (3, 10 ** 9)])
def test_cells_of_a_product_are_bounded_and_copies_few(left, right):
    rows, columns = grid(left, right)
    assert 1 <= rows <= left and 1 <= columns <= right
    assert rows * columns >= left * right / (2 * CELL_PAIRS)
    copies = left * columns + right * rows
    assert copies <= 3 * (left + right) + 4 * math.sqrt(left * right * math.ceil(left * right / CELL_PAIRS))


def test_a_product_of_many_cells_has_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(G, "CELL_PAIRS", 40)
    probs, parts = spark.range(30).select(F.col("id").alias("example_id")), spark.range(50).select(F.col("id").alias("p"))
    joined = expected_rows(probs, parts)
    assert sorted(map(tuple, joined.collect())) == [(i, p) for i in range(30) for p in range(50)]
    assert joined.select(F.spark_partition_id()).distinct().count() > 1


def test_limits_make_no_pair_beyond_them(spark, monkeypatch):
    limits = [None, 0, 1, 2, 7, 10, 11, 10 ** 12, -1, -9, -10, -11] * 3
    probs = spark.range(1, 11).selectExpr("id AS sample_num", "id * 7 AS example_id")
    people = spark.createDataFrame(list(enumerate(limits)), "who long, max_examples long")
    monkeypatch.setattr(G, "RANGE", 3)
    for cell in (4, 1 << 20):
        monkeypatch.setattr(G, "CELL_PAIRS", cell)
        got = sorted((r.who, r.sample_num, r.example_id) for r in limited_rows(probs, people, 10).collect())
        want = [(k, i, i * 7) for k, n in enumerate(limits)
                for i in (range(1, 11) if not n else range(1, 11)[:n])]
        assert got == sorted(want)


def test_fifty_small_limits_generate_their_pairs_only(spark):
    """50 requests of 2 examples on 2,000 problems: 100 rows leave the generator, none is filtered later."""
    probs = spark.range(1, 2001).selectExpr("id AS sample_num", "id AS example_id")
    people = spark.range(50).selectExpr("id AS who", "2L AS max_examples")
    out = limited_rows(probs, people, 2000)
    assert out.count() == 100
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    after_join = plan[:plan.index("Join")]
    assert "Filter" not in after_join and "Cartesian" not in plan and "sample_num" in plan


def test_rows_made_by_explode_are_not_broadcast(spark):
    probs = spark.range(1, 11).selectExpr("id AS sample_num", "id AS example_id")
    people = spark.range(24_000).selectExpr("id AS who", "id % 2 * 2 AS max_examples")     # all, or the first two
    out = limited_rows(probs, people, 10)
    assert out.count() == 12_000 * 10 + 12_000 * 2
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_long_intervals_are_few_rows(spark, monkeypatch):
    """50 requests of all but the last ten of 2,000 problems: blocks and the positions behind them, not 99,500 rows."""
    sides, meet = [], G._meet
    monkeypatch.setattr(G, "_meet", lambda left, right, keys, n: sides.append((right, n)) or meet(left, right, keys, n))
    probs = spark.range(1, 2001).selectExpr("id AS sample_num", "id AS example_id")
    people = spark.range(50).selectExpr("id AS who", "-10L AS max_examples")
    out = limited_rows(probs, people, 2000)
    assert out.count() == out.distinct().count() == 50 * 1990
    assert [right.count() for right, _ in sides] == [n for _, n in sides]
    assert sum(n for _, n in sides) == 50 * (1990 // G.RANGE + 1990 % G.RANGE)


def test_dedupe_by_order_column_on_both_plans(spark, frames):
    probs, parts, answers = frames
    first = answers.withColumn("seq", F.lit(1))
    # a later, different reply for every bob row: the earliest (seq 1) must win
    later = answers.filter(F.col("participant") == "bob").withColumn("answer", F.lit("no idea")) \
        .withColumn("reply_status", F.lit("ok")).withColumn("error", F.lit(None).cast("string")) \
        .withColumn("seq", F.lit(2))
    log = first.unionByName(later)
    g = grade(expected_rows(probs, parts.select("participant")), log, KEY, order_col="seq")
    base = grade(expected_rows(probs, parts.select("participant")), answers, KEY)
    cols = ["participant", "story_id", "predicted", "status", "correct"]
    assert sorted(tuple(r) for r in g.select(cols).collect()) == sorted(tuple(r) for r in base.select(cols).collect())
    full = {r.id: r.asDict() for r in M.report(g, parts).collect()}
    compact = {r.id: r.asDict() for r in M.evaluate_report(probs, parts, log, KEY, order_col="seq").collect()}
    assert full == compact
