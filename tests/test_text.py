"""Column functions against small independent Python models (property checks)."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answer_eval.functions import text as X
from conftest import one_col

WS_SAMPLE = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0       　"


# What is said -> the label, row by row of the rule: "uncertain" anywhere, else "true"
# anywhere, else "false" anywhere, in any case.
ANSWERS = [
    ("both true and false", "True"), ("false, or true", "True"), ("not uncertain: TRUE", "Uncertain"),
    ("false and Uncertain", "Uncertain"), ("untrue", "True"), ("FALSE\n", "False"), ("\xa0True\xa0", "True"),
    ("unCERTain", "Uncertain"), ("falsehood", "False"), ("", None), ("no idea", None), ("tru e", None), ("uncertai", None),
]
# Output -> the verdict in its last line that is a label and nothing else.
OUTPUTS = [
    ("True\nFalse", "False"), ("True.\nTrue ", "True"), ("true", "Uncertain"), ("False\r\nTrue\r\n", "True"),
    ("", "Uncertain"), ("x\n Uncertain \n y", "Uncertain"), ("  \n  ", "Uncertain"), ("False\nTrue!", "False"),
    ("\u3000True\x1c\nno", "True"), ("TrueFalse", "Uncertain"),
]
# Reply -> the code in its fence.
FENCED = [
    ("a```python\n code \n```b", "code"), ("```\nplain\n```", "plain"), ("```python\nunclosed", "unclosed"),
    ("```a```b```c```", "a"), ("no fence ", "no fence "), ("```python x ```python y ```", "x"),
    ("``` first ``` then ```python second ```", "second"), ("```python```", ""), ("```", ""), ("", ""),
]


def scan_tags(s):
    """Tags by walking through the text: at every "<" the name up to the next ">", closed by the
    nearest "</name>" behind it; the walk goes on behind what was closed."""
    out, at = {}, 0
    while (at := s.find("<", at)) >= 0:
        end = s.find(">", at)
        if end < 0:
            break
        closing = "</" + s[at + 1:end + 1]
        stop = s.find(closing, end + 1)
        if stop < 0:
            at += 1
            continue
        out[s[at + 1:end]] = s[end + 1:stop].strip()
        at = stop + len(closing)
    return out


WORDS = ["true", "True", "FALSE", "false", "uncertain", "Uncertain", "untrue", "no", "idea", "x",
         "```", "```python", "<a>", "</a>", "<b>", "</b>", '<p class="q">', "</p>", ">", "<", "\n", "\r\n"]


def _texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(0, 8)
        parts = [rnd.choice(WORDS + list(WS_SAMPLE)) for _ in range(k)]
        out.append(rnd.choice(["", " ", "\n"]).join(parts))
    return out


def test_strip_matches_python(spark):
    values = [WS_SAMPLE + "ab c" + WS_SAMPLE, "", "   ", "​zero​", "x\x1c", "é"] + _texts(300, 1)
    got = one_col(spark, values, lambda df: X.py_strip(F.col("s")))
    assert got == [v.strip() for v in values]


def test_normalise_answers(spark):
    got = one_col(spark, [x for x, _ in ANSWERS], lambda df: X.normalise_answer(F.col("s")))
    assert got == [y for _, y in ANSWERS]


def test_normaliser_properties(spark):
    values = _texts(500, 2)
    got = one_col(spark, values, lambda df: X.normalise_answer(F.col("s")))
    for v, g in zip(values, got):
        words = {w for w in ("uncertain", "true", "false") if w in v.lower()}
        assert (g is None) == (not words)
        assert g is None or g.lower() in words
        assert ("uncertain" in words) == (g == "Uncertain")
        assert words != {"false"} or g == "False"
    # surrounding blanks and case never matter
    again = one_col(spark, [f" \t{v.upper()}\n" for v in values], lambda df: X.normalise_answer(F.col("s")))
    assert again == got


def test_last_verdict_line(spark):
    got = one_col(spark, [x for x, _ in OUTPUTS], lambda df: X.last_verdict_line(F.col("s")))
    assert got == [y for _, y in OUTPUTS]
    values = _texts(300, 3)
    # a label line put at the end decides; a line that is none changes nothing
    base = one_col(spark, values, lambda df: X.last_verdict_line(F.col("s")))
    assert one_col(spark, [v + "\n False\t" for v in values],
                   lambda df: X.last_verdict_line(F.col("s"))) == ["False"] * len(values)
    assert one_col(spark, [v + "\nnothing" for v in values], lambda df: X.last_verdict_line(F.col("s"))) == [
        "Uncertain" if b not in v else b for v, b in zip([_lines(v) for v in values], base)]


def _lines(text):
    return {line.strip() for line in text.split("\n")}


def test_extract_fenced(spark):
    got = one_col(spark, [x for x, _ in FENCED], lambda df: X.extract_fenced(F.col("s")))
    assert got == [y for _, y in FENCED]
    plain = [v for v in _texts(300, 4) if "`" not in v]
    assert one_col(spark, plain, lambda df: X.extract_fenced(F.col("s"))) == plain
    wrapped = one_col(spark, [f"see\n```python\n{v}\n```\n```other```" for v in plain],
                      lambda df: X.extract_fenced(F.col("s")))
    assert wrapped == [v.strip() for v in plain]


def test_split_formulas(spark):
    values = ["a\n\n b \n", "", None, " \n \n", "x\r\ny"]
    got = one_col(spark, values, lambda df: X.split_formulas(F.col("s")))
    assert got == [["a", "b"], [], [], [], ["x", "y"]]


def test_parse_tags_matches_python(spark):
    values = ["<a>x</a>", "<a><b>in</b></a>", "<a>1</a><a>2</a>", '<p class="x">y</p>', "<a>unclosed",
              "<a>\n multi \n</a>", "<a>b>c</a>b>", "<>e</>", "<a b>q</a b>", "<<a>>x</<a>>"] + _texts(400, 5)
    got = one_col(spark, values, lambda df: X.parse_tags(F.col("s")))
    assert [dict(g) for g in got] == [scan_tags(v) for v in values]


def test_parse_tags_whole_pages_match_python(spark):
    import pandas as pd
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")["html"].tolist()
    got = one_col(spark, pages, lambda df: X.parse_tags(F.col("s")))
    assert [dict(g) for g in got] == [scan_tags(p) for p in pages]


def test_unclosed_tags_take_linear_time(spark):
    import time
    texts = ["<a>" * 350_000, "<" * 1_000_000 + ">", "<a><b></a>" * 100_000, "</a>" * 250_000]
    one_col(spark, ["<a>x</a>"], lambda df: X.parse_tags(F.col("s")))
    t = time.time()
    got = one_col(spark, texts, lambda df: X.parse_tags(F.col("s")))
    assert [len(g) for g in got] == [0, 0, 1, 0] and time.time() - t < 20


doubles = st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.integers(-10**9, 10**9).map(lambda k: k / 1000),
                    st.integers(0, 10**13).map(lambda k: k / 1e6), st.integers(0, 10**6).map(lambda k: k / 200),
                    st.sampled_from([1.015, 2.675, 8.345, 1.145, 0.125, -0.125, 12345678901234.105]))


@settings(max_examples=15, deadline=None)
@given(st.lists(doubles, min_size=1, max_size=200))
def test_rounding_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(X.round_even("x", 2).alias("r"), X.format_fixed("x").alias("f")).collect()
    assert [r.r for r in rows] == [float(round(v, 2)) for v in values]
    assert [r.f for r, v in zip(rows, values) if abs(v) < 1e12] == [f"{v:.2f}" for v in values if abs(v) < 1e12]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2000), st.integers(1, 2000)), min_size=1, max_size=40))
def test_percent_rounding_matches_python(spark, pairs):
    pairs = [(min(c, t), t) for c, t in pairs]
    df = spark.createDataFrame(pairs, "c long, t long")
    got = [r[0] for r in df.select(X.percent_of(F.col("c"), F.col("t"))).collect()]
    assert got == [round(c / t * 100, 2) for c, t in pairs]


def test_formats(spark):
    df = spark.createDataFrame([(1, 32), (5, 32), (0, 0), (2, 3)], "c long, t long")
    rows = df.select(X.percent_of("c", "t").alias("p"),
                     X.format_percent(F.when(F.col("t") > 0, F.col("c") / F.col("t")).otherwise(0.0)).alias("f"),
                     X.right_align(F.lit("True"), 9).alias("r"),
                     X.right_align(F.lit("Uncertainty!"), 9).alias("r2")).collect()
    assert [r["p"] for r in rows] == [3.12, 15.62, 0.0, 66.67]
    assert [r["f"] for r in rows] == [f"{1/32:.2%}", f"{5/32:.2%}", f"{0.0:.2%}", f"{2/3:.2%}"]
    assert rows[0]["r"] == f"{'True':>9s}" and rows[0]["r2"] == "Uncertainty!"


def test_default_answer_and_verdicts(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "s string")
    rows = df.select(X.default_answer("s", "direct").alias("d"), X.default_answer("s", "code").alias("c")).collect()
    assert [(r.d, r.c) for r in rows] == [("Uncertain", ""), ("Uncertain", "Uncertain"), ("x", "x")]
    chk = spark.createDataFrame([("unsat", "unsat"), ("sat", "unsat"), ("sat", "sat"), ("unknown", "unsat")],
                                "n string, p string")
    assert [r[0] for r in chk.select(X.entailment_verdict("n", "p")).collect()] == \
        ["True", "False", "Uncertain", "Uncertain"]


def test_error_text_and_elapsed(spark):
    df = spark.createDataFrame([(" boom \n", 1), ("", 2), (None, 3)], "e string, rc int")
    assert [r[0] for r in df.select(X.error_text("e", "rc")).collect()] == \
        ["boom", "Execution failed with return code 2", "Execution failed with return code 3"]
    t = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS a, TIMESTAMP_NTZ'2024-01-01 00:00:01.5' AS b")
    assert t.select(X.elapsed_seconds("a", "b")).first()[0] == 1.5


def test_tag_value(spark):
    values = ["<a>x</a><b> y </b><a>z</a>", "<b>only</b>", None]
    assert one_col(spark, values, lambda df: X.tag_value(F.col("s"), "a")) == ["z", None, None]
    assert one_col(spark, values, lambda df: X.tag_value(F.col("s"), "b")) == ["y", "only", None]
