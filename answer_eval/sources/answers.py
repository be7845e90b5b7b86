"""Answer logs (S2) and reply-envelope decoding (S3).

An answer log has one row per reply actually received: who answered (participant),
which problem row (example_id, else sample_num; story_id is carried along), and either a reply envelope (nested, or JSON text) or a
flat (error_message, answer) pair.  Decoding yields the reply columns the grader
reads: ``reply_status``, ``answer``, ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answer_eval.functions.text import (
    MSG_INVALID_RESPONSE, MSG_INVALID_RESULT, MSG_NO_TEXT, STATUS_ERROR_RESPONSE,
    STATUS_OK, STATUS_PARSE_ERROR, py_strip,
)

PART_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
])

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("error_message", T.StringType()),
    T.StructField("response_kind", T.StringType()),
    T.StructField("result_kind", T.StringType()),
    T.StructField("parts", T.ArrayType(PART_SCHEMA)),
    T.StructField("elapsed_s", T.DoubleType()),
])

ANSWER_LOG_SCHEMA = T.StructType([
    T.StructField("participant", T.StringType()),
    T.StructField("example_id", T.LongType()),
    T.StructField("sample_num", T.LongType()),
    T.StructField("story_id", T.LongType()),
    T.StructField("envelope", ENVELOPE_SCHEMA),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
])

# Fallback message of an error reply that carries no message.
UNKNOWN_ERROR = "Unknown error"


# S2 -----------------------------------------------------------------------
def read_answers(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema: T.StructType | None = None) -> DataFrame:
    """Scan an answer log (Parquet by default; JSON lines with a declared schema).  A JSON line that can not
    be read becomes a row of nulls; ``read_answer_log`` tells such lines apart."""
    reader = spark.read
    if fmt == "json":
        reader = reader.schema(schema or ANSWER_LOG_SCHEMA)
    elif schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


# Our wording for log lines that give no reply.
ERR_NOT_JSON = "The line is no JSON object of the log's schema"
ERR_NO_PARTICIPANT = "The line names no participant"
ERR_NO_KEY = "The line names no problem row"


def read_answer_log(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    key=("example_id", "sample_num", "story_id"),
                    participant_col: str = "participant") -> tuple[DataFrame, DataFrame]:
    """A JSON-lines answer log -> (answers, broken lines).

    answers: the rows that name a participant and, in one of the ``key`` columns that the schema has, a
    problem row.  broken lines: file_path, line (its whole text) and error, for every other line
    that is not blank: it is cut off or otherwise no JSON, a value does not fit the schema, or it
    can not be joined to anything.  Lines are parsed map-side, in splits of a file; nothing
    is shuffled, and neither output fails at a broken line."""
    schema = schema or ANSWER_LOG_SCHEMA
    keys = [k for k in ([key] if isinstance(key, str) else key) if k in schema.names]
    if not keys:
        raise ValueError("the schema has no key column")
    raw, row = "_line", "_row"
    whole = T.StructType([*schema.fields, T.StructField(raw, T.StringType())])
    lines = spark.read.text(path).filter(py_strip(F.col("value")) != F.lit("")).select(
        F.col("_metadata.file_path").alias("file_path"), "value",
        F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw}).alias(row))
    r = F.col(row)
    error = (F.when(r.isNull() | r[raw].isNotNull() | ~F.ltrim("value").startswith("{"), F.lit(ERR_NOT_JSON))
             .when(r[participant_col].isNull(), F.lit(ERR_NO_PARTICIPANT))
             .when(F.coalesce(*[r[k].cast("string") for k in keys]).isNull(), F.lit(ERR_NO_KEY)))
    answers = lines.filter(error.isNull()).select(*[r[n].alias(n) for n in schema.names])
    broken = lines.filter(error.isNotNull()).select("file_path", F.col("value").alias("line"), error.alias("error"))
    return answers, broken


def broken_counts(broken: DataFrame) -> DataFrame:
    """Broken lines per file and error: (file_path, error, lines)."""
    return broken.groupBy("file_path", "error").agg(F.count(F.lit(1)).alias("lines"))


def _first_text(parts: Column) -> Column:
    texts = F.filter(parts, lambda p: p["kind"] == F.lit("text"))
    return F.try_element_at(texts, F.lit(1))


# S3 -----------------------------------------------------------------------
def decode_envelope(df: DataFrame, envelope_col: str = "envelope") -> DataFrame:
    """Decode reply envelopes in the evaluator's order of checks.

    1. an error object (``response_kind='error'`` or an ``error_message``) -> error_response
       with that message;
    2. a response that is not a success -> parse_error "Invalid response type: <kind>";
    3. a result that is not a message -> parse_error "Invalid result type";
    4. no part of kind text -> parse_error "No text in response";
    5. otherwise the FIRST text part, stripped (later parts are ignored) -> ok.
    JSON text envelopes are parsed with ``from_json`` first.  Adds
    ``reply_status``, ``answer``, ``error`` (and ``elapsed_s`` from the envelope).
    """
    env = F.col(envelope_col)
    if isinstance(df.schema[envelope_col].dataType, T.StringType):
        env = F.from_json(env, ENVELOPE_SCHEMA)
    resp_kind = F.coalesce(env["response_kind"], F.lit("success"))
    result_kind = F.coalesce(env["result_kind"], F.lit("message"))
    first = _first_text(F.coalesce(env["parts"], F.array().cast(T.ArrayType(PART_SCHEMA))))
    is_error = (resp_kind == F.lit("error")) | env["error_message"].isNotNull()
    status = (
        F.when(is_error, F.lit(STATUS_ERROR_RESPONSE))
        .when(resp_kind != F.lit("success"), F.lit(STATUS_PARSE_ERROR))
        .when(result_kind != F.lit("message"), F.lit(STATUS_PARSE_ERROR))
        .when(first.isNull(), F.lit(STATUS_PARSE_ERROR))
        .otherwise(F.lit(STATUS_OK))
    )
    error = (
        F.when(is_error, F.coalesce(env["error_message"], F.lit(UNKNOWN_ERROR)))
        .when(resp_kind != F.lit("success"), F.concat(F.lit(MSG_INVALID_RESPONSE), resp_kind))
        .when(result_kind != F.lit("message"), F.lit(MSG_INVALID_RESULT))
        .when(first.isNull(), F.lit(MSG_NO_TEXT))
    )
    answer = F.when(status == F.lit(STATUS_OK), py_strip(F.coalesce(first["text"], F.lit(""))))
    return (df.withColumn("reply_status", status)
              .withColumn("answer", answer)
              .withColumn("error", error)
              .withColumn("elapsed_s", env["elapsed_s"])
              .drop(envelope_col))


def decode_flat(df: DataFrame, answer_col: str = "answer",
                error_col: str = "error_message") -> DataFrame:
    """Flat logs: a non-NULL error message is an error reply; a NULL answer is a
    reply without text; otherwise the stripped answer text."""
    err = F.col(error_col)
    ans = F.col(answer_col)
    status = (F.when(err.isNotNull(), F.lit(STATUS_ERROR_RESPONSE))
              .when(ans.isNull(), F.lit(STATUS_PARSE_ERROR))
              .otherwise(F.lit(STATUS_OK)))
    error = F.when(err.isNotNull(), err).when(ans.isNull(), F.lit(MSG_NO_TEXT))
    out = (df.withColumn("_status", status)
             .withColumn("_error", error)
             .withColumn("_answer", F.when(err.isNull(), py_strip(ans))))
    return (out.drop(answer_col, error_col, "reply_status", "answer", "error")
               .withColumnRenamed("_status", "reply_status")
               .withColumnRenamed("_answer", "answer")
               .withColumnRenamed("_error", "error"))
