"""Stand-in inputs built from the driver's test tables.

Each builder only shapes rows of a given table into the schema an operator reads
(a problem table, an answer log, an attempt log, ...).  None of them grades,
aggregates or decodes anything: that work runs in the library's operators.  The
row counts grow with the tables (no id subsets, no caps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.operators.grade import expected_rows
from answer_eval.session import spread
from answer_eval.sources.problems import number_within


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents (premises) + labels.quality (gold) -> problem table (raw label)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    label = (F.when(F.col("quality") == 1, F.lit("True"))
             .when(F.col("quality") == 0, F.lit("False"))
             .otherwise(F.lit("Uncertain")))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("story_id"),
        F.col("text").alias("premises"),
        F.concat(F.lit("Document "), _s(F.col("doc_id")), F.lit(" is of good quality.")).alias("conclusion"),
        label.alias("label"),
    )


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region rows -> participants (name, agent_id, endpoint)."""
    region = table(spark, sf_dir, "region")
    return region.select(
        F.col("r_name").alias("participant"),
        F.concat(F.lit("region-"), _s(F.col("r_regionkey"))).alias("agent_id"),
        F.concat(F.lit("http://agents.invalid/"), _s(F.col("r_regionkey"))).alias("endpoint"),
    )


_ANSWER_TEXTS = {
    0: "True", 1: " false ", 2: "UNCERTAIN", 3: "The answer is true.",
    4: "This is False, clearly", 5: "true or false", 6: "true but uncertain",
    7: "untrue", 8: "no idea", 9: "",
}


def _answer_residue() -> Column:
    return (F.col("story_id") * 7 + F.col("r_regionkey") * 3) % 12


def _answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x region with the residue that picks each reply's shape;
    residue 11 has no reply at all (a missing answer)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("story_id"), "text")
    region = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("participant"), "r_regionkey")
    pairs = expected_rows(spread(docs), region, docs.count(), region.count())
    return pairs.withColumn("_res", _answer_residue()).filter(F.col("_res") != 11)


def _answer_text(res: Column) -> Column:
    expr = None
    for k, v in _ANSWER_TEXTS.items():
        expr = (F.when(res == k, F.lit(v)) if expr is None else expr.when(res == k, F.lit(v)))
    return expr


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat answer log: (participant, story_id, error_message, answer).  An answer is the document's whole
    text with a line spliced into its middle; residue 9 is an empty answer, 10 an error
    reply, 11 is absent."""
    rows = _answer_rows(spark, sf_dir)
    res, t, half = F.col("_res"), F.col("text"), F.floor(F.length("text") / 2).cast("int")
    spoken = F.concat(t.substr(F.lit(1), half), F.lit("\n"), _answer_text(res), F.lit("\n"),
                      t.substr(half + 1, F.length(t)))
    return rows.select(
        "participant", "story_id",
        F.when(res == 10, F.lit("rpc failure")).alias("error_message"),
        F.when(res == 9, F.lit("")).when(res < 9, spoken).alias("answer"),
    )


# What is said in the middle of a document's text, and the line behind it, by doc_id mod 8.
SPOKEN = ("TRUE", "so it is False, or", "uncertain", "untrue", "true or false", "nothing", "FALSE", "Uncertain? true")
LINES = ("True", " False ", "Uncertain\t", "true", "True.", "", "no verdict", "False\nUncertain")


def spoken_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> long answers: (story_id, answer, output).  The answer is the whole text with
    words spliced into its middle (every eleventh is NULL, every thirteenth empty); the
    output is the text with a line behind it and, for odd ids, the text once more."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i, t = F.col("doc_id"), F.col("text")
    word = F.get(F.array(*[F.lit(x) for x in SPOKEN]), (i % 8).cast("int"))
    line = F.get(F.array(*[F.lit(x) for x in LINES]), (i % 8).cast("int"))
    half = F.floor(F.length(t) / 2).cast("int")
    spoken = F.concat(t.substr(F.lit(1), half), F.lit(" "), word, F.lit(" "), t.substr(half + 1, F.length(t)))
    answer = F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, F.lit("")).otherwise(spoken)
    output = F.concat(t, F.lit("\n"), line, F.when(i % 2 == 1, F.concat(F.lit("\n"), t)).otherwise(F.lit("")))
    return d.select(i.alias("story_id"), answer.alias("answer"), output.alias("output"))


def exam_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems with three examples per story: example_id is the document's, story_id its third."""
    p = problems(spark, sf_dir)
    return p.select(F.expr("story_id div 3").alias("story_id"), F.col("story_id").alias("example_id"), "label")


def exam_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier rows -> JSON requests: a named participant, or two without names; a limit of some first
    examples, of all but the last four, or none."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request_id"))
    k = F.col("request_id")
    one = F.concat(F.lit('{"name":"agent-'), _s(k % 7), F.lit('","endpoint":"http://h/'), _s(k), F.lit('"}'))
    two = F.lit('{"endpoint":"http://a"},{"endpoint":"http://b"}')
    limit = F.when(k % 50 == 0, F.lit("null")).when(k % 50 == 1, F.lit("-4")).otherwise(_s(k % 40 + 1))
    body = F.concat(F.lit('{"participants":['), F.when(k % 10 == 0, two).otherwise(one),
                    F.lit('],"config":{"max_examples":'), limit, F.lit("}}"))
    return s.select("request_id", body.alias("body"))


def exam_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spoken answers of seven agents and of one without a name, some with a second, later reply:
    (participant, example_id, seq, error_message, answer)."""
    agents = F.array(*[F.struct(F.lit(i).alias("k"), F.lit("unknown" if i == 7 else f"agent-{i}").alias("participant"))
                       for i in range(8)])
    i, k, seq = F.col("example_id"), F.col("k"), F.col("seq")
    d = spoken_answers(spark, sf_dir).select(F.col("story_id").alias("example_id"), "answer", F.explode(agents).alias("a"))
    d = d.select("example_id", "answer", "a.*").filter((i + k) % 9 != 8) \
        .withColumn("seq", F.explode(F.when(i % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    word = F.get(F.array(*[F.lit(x) for x in SPOKEN]), ((i + k * seq) % 8).cast("int"))
    return d.select("participant", "example_id", "seq",
                    F.when((i + k) % 10 == 7, F.lit("rpc failure")).alias("error_message"),
                    F.when((seq == 1) & ((i + k) % 2 == 0), F.col("answer")).otherwise(word).alias("answer"))


def answer_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spoken answers as JSON envelopes: error objects, a non-success response
    kind, non-message results, replies without a text part, and messages whose first
    text part is the answer (after a non-text part, before a second text part)."""
    rows = spoken_answers(spark, sf_dir).withColumn("_res", F.col("story_id") % 12) \
        .withColumn("participant", F.concat(F.lit("agent-"), _s(F.col("story_id") % 5)))
    res = F.col("_res")
    text_part = F.to_json(F.struct(F.lit("text").alias("kind"), F.coalesce("answer", F.lit("")).alias("text")))
    body = (
        F.when(res == 10, F.lit('{"response_kind":"error","error_message":"rpc failure"}'))
        .when(res == 9, F.lit('{"response_kind":"success","result_kind":"message","parts":[]}'))
        .when(res == 8, F.lit('{"response_kind":"success","result_kind":"task"}'))
        .when(res == 7, F.lit('{"response_kind":"status_update"}'))
        .otherwise(F.concat(
            F.lit('{"response_kind":"success","result_kind":"message","parts":['
                  '{"kind":"data","text":null},'), text_part,
            F.lit(',{"kind":"text","text":"second part"}]}')))
    )
    return rows.select("participant", "story_id", body.alias("envelope"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes as lines of a JSON log, some of them cut off, without a participant or row, or no JSON."""
    rows = answer_envelopes(spark, sf_dir)
    i, who = F.col("story_id"), F.col("participant")
    named, numbered = F.concat(F.lit('{"participant":"'), who, F.lit('"')), F.concat(F.lit('"example_id":'), _s(i))
    line = (F.when(i % 17 == 0, F.concat(named, F.lit(","), numbered, F.lit(',"envelope":{"respo')))
            .when(i % 19 == 0, F.concat(F.lit("{"), numbered, F.lit("}")))
            .when(i % 23 == 0, F.concat(named, F.lit("}")))
            .when(i % 29 == 0, F.concat(F.lit("not json "), _s(i)))
            .otherwise(F.concat(named, F.lit(","), numbered, F.lit(',"envelope":'), F.col("envelope"), F.lit("}"))))
    return rows.select(line.alias("value"))


def _user_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a 0-based position per user in (ts, event_id) order, numbered
    skew-safely (a very active user is not one task's sort)."""
    ev = table(spark, sf_dir, "events")
    return number_within(ev, "user_id", ["ts", "event_id"], col_name="_seq", start=0)


def timed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> a timed reply log: one reply per event, participant = the user,
    started at the event, ended at that user's next event (or at once)."""
    ev = _user_sequence(spark, sf_dir)
    following = ev.select("user_id", (F.col("_seq") - 1).alias("_seq"), F.col("ts").alias("_next_ts"))
    ev = ev.join(following, ["user_id", "_seq"], "left")
    nxt = F.col("_next_ts")
    kind = F.col("event_type")
    answer = (F.when(kind == "view", F.lit("True")).when(kind == "click", F.lit("false"))
              .when(kind == "signup", F.lit("It is uncertain")).when(kind == "purchase", F.lit("no idea")))
    return ev.select(
        F.concat(F.lit("user-"), _s(F.col("user_id"))).alias("participant"),
        F.col("event_id").alias("story_id"),
        F.col("ts").alias("started_at"),
        F.coalesce(nxt, F.col("ts")).alias("ended_at"),
        F.when(kind == "error", F.lit("timeout")).alias("error_message"),
        answer.alias("answer"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> attempt log: per user (problem), events in time order are attempts
    0, 1, 2, ...; error events fail (some with stderr), others succeed with a
    program output.  The text of the document with the event's number, if there is one, stands
    before the verdict of an output and behind an error's message."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("_text"))
    ev = _user_sequence(spark, sf_dir).join(docs, "event_id", "left")
    text = F.coalesce(F.concat(F.col("_text"), F.lit("\n")), F.lit(""))
    n = F.col("_seq")
    kind = F.col("event_type")
    is_err = kind == "error"
    stdout = (F.when(kind == "view", F.concat(F.lit("checking"), F.lit("\n"), F.lit("True")))
              .when(kind == "click", F.concat(F.lit("False"), F.lit("\n"), F.lit("done")))
              .when(kind == "signup", F.lit("Uncertain"))
              .when(kind == "purchase", F.lit("no verdict"))
              .otherwise(F.lit("")))
    return ev.select(
        F.col("user_id").alias("problem_id"),
        "event_id",
        n.cast("bigint").alias("attempt"),
        F.concat(F.lit("print("), F.col("props"), F.lit(")")).alias("code"),
        F.when(is_err, 1).otherwise(0).alias("returncode"),
        F.when(is_err & (F.col("event_id") % 2 == 0), F.concat(F.lit("NameError "), F.col("props"), F.lit("\n"), text))
         .otherwise(F.lit("")).alias("stderr"),
        F.concat(text, stdout).alias("stdout"),
        F.concat(F.lit("Problem of user "), _s(F.col("user_id"))).alias("problem_text"),
    )


def solver_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> two solver outcomes per (problem, check)."""
    li = table(spark, sf_dir, "lineitem")
    neg = (F.when(F.col("l_returnflag") == "A", F.lit("unsat"))
           .when(F.col("l_returnflag") == "N", F.lit("sat")).otherwise(F.lit("unknown")))
    pos = F.when(F.col("l_linestatus") == "F", F.lit("unsat")).otherwise(F.lit("sat"))
    return li.select(F.col("l_orderkey").alias("problem_id"), F.col("l_linenumber").alias("check_id"),
                     neg.alias("neg_check"), pos.alias("pos_check"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> task state messages (task_id, seq, state)."""
    ev = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    state = (F.when(kind == "purchase", F.lit("completed")).when(kind == "error", F.lit("failed"))
             .when(kind == "signup", F.lit("submitted")).otherwise(F.lit("working")))
    return ev.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), state.alias("state"))


def task_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incoming request per distinct user (task)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id")).distinct()


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> request bodies in five shapes: JSON list form, JSON object form,
    tag form, plain text, and JSON with null participants."""
    ev = table(spark, sf_dir, "events")
    eid, uid = _s(F.col("event_id")), _s(F.col("user_id"))
    shape = F.col("event_id") % 5
    body = (
        F.when(shape == 0, F.concat(
            F.lit('{"participants":[{"name":"a'), uid, F.lit('","endpoint":"http://h/'), eid,
            F.lit('"},{"endpoint":"http://g","agent_id":"z"},{"name":"no-endpoint"}],'
                  '"config":{"max_examples":'), uid, F.lit("}}")))
        .when(shape == 1, F.concat(
            F.lit('{"participants":{"r1":"http://h/'), eid,
            F.lit('","r2":{"endpoint":"http://g","agent_id":"q"},"r3":{"x":1},"r4":7},"config":{}}')))
        .when(shape == 2, F.concat(
            F.lit("Please evaluate\n<white_agent_url>\nhttp://h/"), eid,
            F.lit("\n</white_agent_url>\n<max_examples>"), uid, F.lit("</max_examples>")))
        .when(shape == 3, F.lit("evaluate please"))
        .otherwise(F.lit('{"participants":null}'))
    )
    return ev.select(F.col("event_id").alias("request_id"), body.alias("body"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def fenced_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents wrapped in code fences of several shapes (python fence, plain
    fences, unclosed, two blocks, none)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = F.col("text")
    shape = F.col("doc_id") % 5
    reply = (
        F.when(shape == 0, F.concat(F.lit("Here it is:\n```python\n"), t, F.lit("\n```\nDone.")))
        .when(shape == 1, F.concat(F.lit("Code:\n```\n"), t, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("```python\n  "), t))
        .when(shape == 3, F.concat(F.lit("```\nfirst\n```\ntext\n```python\n"), t, F.lit("\n```")))
        .otherwise(t)
    )
    return d.select(F.col("doc_id"), reply.alias("reply"))


def big_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> a large graded-ready log: participant, sample key, gold label,
    free-text answer, recorded seconds."""
    li = table(spark, sf_dir, "lineitem")
    exp = (F.when(F.col("l_returnflag") == "A", F.lit("True"))
           .when(F.col("l_returnflag") == "N", F.lit("False")).otherwise(F.lit("Uncertain")))
    m = F.col("l_linenumber") % 5
    ans = (F.when(m == 0, F.lit("True")).when(m == 1, F.lit(" false "))
           .when(m == 2, F.lit("It is uncertain")).when(m == 3, F.lit("true or false"))
           .otherwise(F.lit("no idea")))
    return li.select(
        F.concat(F.lit("agent-"), _s(F.col("l_suppkey") % 10)).alias("participant"),
        "l_orderkey", "l_linenumber", exp.alias("expected"), ans.alias("answer"),
        F.col("l_quantity").alias("elapsed_s"),
    )
