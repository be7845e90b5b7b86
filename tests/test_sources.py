"""Problem scan, label coercion, numbering, first-N, envelope decoding, requests."""

import json
import os

import pytest
from pyspark.sql import functions as F

from answer_eval.sources import answers as A
from answer_eval.sources import problems as S
from answer_eval.sources.csv_records import read_csv
from answer_eval.sources.answers import decode_envelope, decode_flat
from answer_eval.sources.requests import MSG_NO_PARTICIPANTS, parse_requests

CSV = '''story_id,premises,premises-FOL,conclusion,conclusion-FOL,label,example_id
1,"All men are mortal.
Socrates is a man.","∀x (Man(x) → Mortal(x))
Man(socrates)",Socrates is mortal.,Mortal(socrates),True,10
2,"He said ""hi"".",P,Q,R, False ,11
3,x,,y,,NA,12
'''


def _write_csv(tmp_dir, text=CSV):
    path = os.path.join(tmp_dir, "problems.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_read_problems_csv_multiline_and_labels(spark, tmp_dir):
    path = _write_csv(tmp_dir)
    df = S.read_problems(spark, [os.path.join(tmp_dir, "missing.csv"), path],
                         na_values=S.PANDAS_NA_VALUES)
    rows = S.coerce_labels(df).orderBy("story_id").collect()
    assert len(rows) == 3
    assert rows[0]["premises"] == "All men are mortal.\nSocrates is a man."
    assert rows[1]["premises"] == 'He said "hi".'
    assert [r["expected"] for r in rows] == ["True", "False", "nan"]
    assert df.schema["label"].dataType.simpleString() == "string"
    assert "premises_fol" in df.columns


def test_read_problems_names_every_path(spark, tmp_dir):
    with pytest.raises(FileNotFoundError) as err:
        S.read_problems(spark, [os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "b.csv")])
    assert "a.csv" in str(err.value) and "b.csv" in str(err.value)


def test_missing_story_id_becomes_row_index(spark):
    df = spark.createDataFrame([(30, "True"), (10, "False"), (20, None)], "k int, label string")
    rows = S.coerce_labels(df, order_by="k").orderBy("k").collect()
    assert [(r["k"], r["story_id"], r["expected"]) for r in rows] == [(10, 0, "False"), (20, 1, "nan"), (30, 2, "True")]


def test_number_samples_dense_across_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 3 % 5000).alias("k"))
    rows = S.number_samples(df, "k").orderBy("k").collect()
    assert [r["sample_num"] for r in rows] == list(range(1, 5001))


@pytest.mark.parametrize("n,expect", [(None, 10), (0, 10), (5, 5), (50, 10), (-2, 8)])
def test_first_n(spark, n, expect):
    df = spark.range(10).withColumnRenamed("id", "k")
    got = [r["k"] for r in S.first_n(df, n, "k").orderBy("k").collect()]
    assert got == list(range(expect))


def test_csv_columns_are_taken_by_header_name(spark, tmp_dir):
    path = _write_csv(tmp_dir, "label,example_id,note,conclusion,premises,story_id\nTrue,7,n,c,p,1\nFalse,8,m,d,q,1\n")
    rows = S.read_problems(spark, path, file_order=True).orderBy("file_row").collect()
    assert [(r.label, r.example_id, r.note, r.conclusion, r.premises, r.story_id, r.premises_fol) for r in rows] == [
        ("True", 7, "n", "c", "p", 1, None), ("False", 8, "m", "d", "q", 1, None)]
    assert rows[0].file_path.endswith("problems.csv")
    with pytest.raises(ValueError, match="label"):
        S.read_problems(spark, _write_csv(tmp_dir, "premises,conclusion\np,c\n"))


def test_file_order_is_the_order_of_the_lines(spark, tmp_dir):
    keys = [7, 3, 9, 1, 5]
    path = _write_csv(tmp_dir, "premises,conclusion,label,example_id\n" + "".join(f"p,c,True,{k}\n" for k in keys))
    df = S.first_n(S.read_problems(spark, path, file_order=True), 3, list(S.FILE_ORDER))
    assert sorted(r.example_id for r in df.collect()) == [3, 7, 9]


def test_equal_order_keys_are_spread_and_numbered_alike(spark):
    df = spark.range(0, 4000, 1, 5).selectExpr("1 AS k", "id")
    one = {r.id: r.sample_num for r in S.number_samples(df, "k").collect()}
    two = {r.id: r.sample_num for r in S.number_samples(df.repartition(7, "id"), "k").collect()}
    assert one == two and sorted(one.values()) == list(range(1, 4001))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # else few rows are one partition
    try:
        assert S.number_samples(df, "k").groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_number_within_skewed_group(spark):
    # one group holds most rows; positions must still be dense per group
    df = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") < 2000, F.lit(0)).otherwise(F.col("id") % 7 + 1).alias("g"),
        (F.col("id") * 7919 % 3000).alias("t"))
    out = S.number_within(df, "g", "t", col_name="pos", start=0).collect()
    by = {}
    for r in out:
        by.setdefault(r["g"], []).append((r["t"], r["pos"]))
    for rows in by.values():
        rows.sort()
        assert [p for _, p in rows] == list(range(len(rows)))


def test_decode_envelope_order_of_checks(spark):
    envs = [
        {"response_kind": "error", "error_message": "boom"},
        {"response_kind": "error"},
        {"response_kind": "weird"},
        {"response_kind": "success", "result_kind": "task"},
        {"response_kind": "success", "result_kind": "message", "parts": [{"kind": "data"}]},
        {"response_kind": "success", "result_kind": "message",
         "parts": [{"kind": "data", "text": "x"}, {"kind": "text", "text": "  True \n"}, {"kind": "text", "text": "no"}]},
        {"response_kind": "success", "result_kind": "message", "parts": [{"kind": "text", "text": ""}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(envs)], "i long, envelope string")
    rows = decode_envelope(df).orderBy("i").collect()
    assert [(r.reply_status, r.answer, r.error) for r in rows] == [
        ("error_response", None, "boom"),
        ("error_response", None, "Unknown error"),
        ("parse_error", None, "Invalid response type: weird"),
        ("parse_error", None, "Invalid result type"),
        ("parse_error", None, "No text in response"),
        ("ok", "True", None),
        ("ok", "", None),
    ]


def test_decode_flat(spark):
    df = spark.createDataFrame([("e", None), (None, None), (None, " a ")], "error_message string, answer string")
    rows = decode_flat(df).collect()
    assert [(r.reply_status, r.answer, r.error) for r in rows] == [
        ("error_response", None, "e"), ("parse_error", None, "No text in response"), ("ok", "a", None)]


REQUESTS = [
    (1, '{"participants":[{"name":"a","endpoint":"http://a"},{"endpoint":"http://b"},'
        '{"name":"c","endpoint":""},{"name":"d"}],"config":{"max_examples":5}}'),
    (2, '{"participants":{"r2":{"endpoint":"http://q","agent_id":"q"},"r1":"http://p","r3":{"x":1},"r4":7}}'),
    (3, "Run it\n<white_agent_url>\n http://t \n</white_agent_url>\n<max_examples> 10 </max_examples>"),
    (4, "no tags here"),
    (5, '{"participants":null}'),
    (6, '[1, 2]'),
    (7, '{"participants":[{"endpoint":"http://x"}],"config":null}'),
    (8, "<white_agent_url>u</white_agent_url><max_examples>ten</max_examples>"),
    (9, '{"participants":[{"endpoint":"http://y"}]} trailing <white_agent_url>z</white_agent_url>'),
    (10, '{"participants":[{"endpoint":"http://1"}],"participants":[{"endpoint":"http://2"}]}'),
    (11, '{"participants":["http://x"]}'),
    (12, "<white_agent_url>w</white_agent_url><max_examples></max_examples>"),
    (13, "<white_agent_url>v</white_agent_url><max_examples>1_0</max_examples>"),
    (14, "<white_agent_url>v</white_agent_url><max_examples>1__0</max_examples>"),
    (15, '{"participants":[{"endpoint":"http://x"}]} {"b":1}'),
    (16, '{"participants":[{"endpoint":"http://x"}]},{"b":1}'),
    (17, '{"participants":[{"endpoint":"http://x"}]} <white_agent_url>u</white_agent_url> }'),
    (18, '{"participants":[{"endpoint":"http://x\\"}{"}]}'),
    (19, '{"participants":[{"endpoint":"http://deep","n":[[[[[1]]]]]}]}'),
    (20, '{"participants":[{"endpoint":"http://deep","n":[[[[[1]]]]]}]} {"z":[[[]]]}'),
]


def test_parse_requests_forms_and_errors(spark):
    df = spark.createDataFrame(REQUESTS, "request_id long, body string")
    parts, errors = parse_requests(df)
    p = sorted((r.request_id, r.position, r.name, r.agent_id, r.endpoint, r.max_examples) for r in parts.collect())
    assert p == [
        (1, 0, "a", "a", "http://a", 5),
        (1, 1, "unknown", "unknown", "http://b", 5),
        (2, 0, "r2", "q", "http://q", 0),       # in the order of the request
        (2, 1, "r1", "r1", "http://p", 0),
        (2, 2, "r3", "r3", None, 0),
        (3, 0, "agent", "agent", "http://t", 10),
        (9, 0, "agent", "agent", "z", 0),
        (10, 0, "unknown", "unknown", "http://2", 0),
        (12, 0, "agent", "agent", "w", 0),
        (13, 0, "agent", "agent", "v", 10),
        (17, 0, "agent", "agent", "u", 0),
        (18, 0, "unknown", "unknown", 'http://x"}{', 0),   # brackets inside a string
        (19, 0, "unknown", "unknown", "http://deep", 0),
    ]
    e = dict((r.request_id, r.error) for r in errors.collect())
    assert e[4] == MSG_NO_PARTICIPANTS and e[5] == MSG_NO_PARTICIPANTS
    assert set(e) == {4, 5, 6, 7, 8, 11, 14, 15, 16, 20}
    assert "not an object" in e[6] and "config" in e[7] and "integer" in e[8] and "entry" in e[11]


def test_first_n_matches_head_semantics(spark):
    import pandas as pd
    keys = [7, 3, 9, 1, 5, 8, 2, 10, 4, 6]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    pdf = pd.DataFrame({"k": sorted(keys)})
    for n in (-15, -10, -9, -1, 0, 1, 4, 10, 15):
        want = pdf.head(n)["k"].tolist() if n else pdf["k"].tolist()   # "if n:" -- 0 means all
        got = [r.k for r in S.first_n(df, n, "k").orderBy("k").collect()]
        assert got == want, n


LIMITS = [("null", 0), ("0", 0), ('""', 0), ("[]", 0), ("{}", 0), ("false", 0), ("0.0", 0), ("3", 3), ("-2", -2),
          ('"abc"', None), ('"2"', None), ("2.5", None), ("2.0", None), ("1e2", None), ("[1]", None), ('{"a":1}', None),
          ("true", None)]


def test_json_limits_are_integers_or_errors(spark):
    rows = [(k, f'{{"participants":[{{"endpoint":"e"}}],"config":{{"max_examples":{x}}}}}') for k, (x, _) in enumerate(LIMITS)]
    parts, errors = parse_requests(spark.createDataFrame(rows, "request_id long, body string"))
    assert {r.request_id: r.max_examples for r in parts.collect()} == {k: n for k, (_, n) in enumerate(LIMITS) if n is not None}
    assert {r.request_id for r in errors.collect()} == {k for k, (_, n) in enumerate(LIMITS) if n is None}


def test_bodies_with_very_long_strings(spark):
    big, esc = "x" * 1_000_000, "\\\\" * 500_000
    rows = [(1, json.dumps({"participants": [{"name": big, "endpoint": "e"}]})),
            (2, '{"participants":[{"name":"' + esc + '","endpoint":"e"}]}'),
            (3, json.dumps({"participants": [{"name": big, "endpoint": "e"}]}) + " x"), (4, "<a>" * 300_000)]
    parts, errors = parse_requests(spark.createDataFrame(rows, "request_id long, body string"))
    assert sorted((r.request_id, len(r.name)) for r in parts.collect()) == [(1, 1_000_000), (2, 500_000)]
    assert sorted(r.request_id for r in errors.collect()) == [3, 4]


def test_broken_log_lines_are_kept_with_their_text(spark, tmp_path):
    good = [json.dumps({"participant": "a", "example_id": 1, "envelope": {"response_kind": "error"}}),
            json.dumps({"participant": "b", "sample_num": 4, "more": [1], "envelope": None}),
            "  " + json.dumps({"participant": "", "story_id": 0}) + " "]
    cut = good[0][:40]
    bad = [(cut, A.ERR_NOT_JSON), ("[1, 2]", A.ERR_NOT_JSON), ('"text"', A.ERR_NOT_JSON), ("null", A.ERR_NOT_JSON),
           ('{"participant":"a","example_id":"x"}', A.ERR_NOT_JSON), ("é{}", A.ERR_NOT_JSON),
           ('{"example_id":3}', A.ERR_NO_PARTICIPANT), ('{"participant":"c"}', A.ERR_NO_KEY), ("{}", A.ERR_NO_PARTICIPANT)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(good + ["", " \t "] + [x for x, _ in bad[:4]]))
    (tmp_path / "log" / "b.json").write_text("\n".join(x for x, _ in bad[4:]) + "\n")
    answers, broken = A.read_answer_log(spark, str(tmp_path / "log"))
    assert [f.name for f in answers.schema.fields] == [f.name for f in A.ANSWER_LOG_SCHEMA.fields]
    assert sorted((r.participant, r.example_id, r.sample_num, r.story_id) for r in answers.collect()) == \
        sorted([("a", 1, None, None), ("b", None, 4, None), ("", None, None, 0)], key=repr)
    assert sorted((r.line, r.error) for r in broken.collect()) == sorted(bad)
    counts = {(r.file_path[-6:], r.error): r.lines for r in A.broken_counts(broken).collect()}
    assert counts[("a.json", A.ERR_NOT_JSON)] == 4 and sum(counts.values()) == len(bad)
    only, _ = A.read_answer_log(spark, str(tmp_path / "log"), key="example_id")
    assert only.count() == 1


def _nasty_csv(rng, n):
    fields = ["plain", "", '"quoted"', '"two\nlines"', '"a ""quote"" in\n\n""it"""', '"comma, and\r\nmore"', 'in"ner quote',
              '""', '"\n"', "é ünï", '"junk" behind', "1"]
    rows = [",".join(rng.choice(fields) for _ in range(3)) for _ in range(n)]
    return "a,b-c,d\n" + "\n".join(r for r in rows) + "\n"


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_csv_in_many_splits_reads_as_in_one(spark, tmp_path, size):
    import random
    rng = random.Random(size)
    (tmp_path / "f").mkdir()
    texts = [_nasty_csv(rng, 120), "a,b-c,d\n" + '"' + "x\n" * 90 + '",1,"end"', "a,b-c,d", 'a,b-c,d\r\n1,"2\r\n3",4\r\n\r\n5,,6']
    for k, text in enumerate(texts):
        (tmp_path / "f" / f"{k}.csv").write_text(text, newline="")
    path = str(tmp_path / "f")
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    want = sorted(map(repr, map(tuple, want.collect())))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_csv(spark, path)
        rows = df.collect()
        order = [r for r in df.orderBy("file_path", "file_row").collect() if r.file_path.endswith("0.csv")]
        splits = spark.read.text(path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(repr(tuple(r)[:3]) for r in rows) == want
    assert size > 64 or splits > 10
    one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path + "/0.csv").collect()
    assert [tuple(r)[:3] for r in order] == [tuple(r) for r in one]
    assert len({(r.file_path, r.file_row) for r in rows}) == len(rows)
