"""Sinks (K1-K4): structured JSON, text report, per-example table, leaderboard.

Only report tables (one row per participant) are ever brought together into one
row; graded rows are written out distributed, never collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answer_eval.functions.text import LABELS, format_fixed, format_percent, right_align
from answer_eval.operators.metrics import REPORT_COLUMNS
from answer_eval.session import ensure_checkpoint_dir
from answer_eval.sources.numbering import number_rows

# ---------------------------------------------------------------------------
# Layout of the per-participant text block, in output order.
# ---------------------------------------------------------------------------
AGENT_LINE = "\nAgent: "
BULLET = "  • "
LINE_TOTAL = "Total Cases: "
LINE_CORRECT = "Correct: "
LINE_INCORRECT = "Incorrect: "
LINE_PARSE_ERRORS = "Parse Errors: "
LINE_ACCURACY = "Accuracy: "
LINE_PER_CATEGORY = "Per-category:"
LINE_AVG_TIME = "Avg Time/Case: "
LINE_TOTAL_TIME = "Total Time: "
CATEGORY_INDENT = "    "
CATEGORY_WIDTH = 9

# Our wording of the combined report's header and footer.
TEXT_HEADER = "Evaluation complete\n\nEvaluated "
TEXT_AGENTS = " agent(s):\n"
TEXT_FOOTER = "\nPer-example results are in the results table.\n"


# K1 -----------------------------------------------------------------------
def participant_json(report: DataFrame) -> DataFrame:
    """The report's columns besides its fields, and ``json``: one participant per row, so any
    number of them is written distributed."""
    lead = [c for c in report.columns if c not in REPORT_COLUMNS]
    fields = F.struct(*[c for c in REPORT_COLUMNS if c in report.columns])
    return report.select(*lead, F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def results_json(report: DataFrame, order_col="id", by: str | None = None) -> DataFrame:
    """One row (per value of ``by``), column ``json``: the report row itself for one
    participant, else ``{"data": [rows...]}`` in the order of ``order_col`` (one column or
    several).  NULL fields are kept.  The document is one row by nature; for very many
    participants take ``participant_json``."""
    opts = {"ignoreNullFields": "false"}
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    fields = F.struct(*[c for c in REPORT_COLUMNS if c in report.columns])
    rows = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("_o"), fields.alias("r"))))
    grouped = report.groupBy(by) if by else report
    agg = grouped.agg(F.count(F.lit(1)).alias("_n"), rows.alias("_rows"))
    single = F.to_json(F.col("_rows")[0]["r"], opts)
    many = F.to_json(F.struct(F.transform("_rows", lambda x: x["r"]).alias("data")), opts)
    return agg.select(*([by] if by else []), F.when(F.col("_n") == 1, single).otherwise(many).alias("json"))


def _category_lines() -> Column:
    lines = []
    for lab in LABELS:
        p = lab.lower()
        line = F.concat(F.lit(CATEGORY_INDENT), right_align(F.lit(lab), CATEGORY_WIDTH), F.lit(": "),
                        F.col(f"{p}_correct").cast("string"), F.lit("/"), F.col(f"{p}_total").cast("string"),
                        F.lit(" = "), format_fixed(F.col(f"{p}_accuracy")), F.lit("%"))
        lines.append(F.when(F.col(f"{p}_total") > 0, line))
    return F.concat_ws("\n", *lines)


def _seconds(c: str) -> Column:
    return F.coalesce(F.concat(format_fixed(F.col(c)), F.lit("s")), F.lit("n/a"))


# K2 -----------------------------------------------------------------------
def participant_text(report: DataFrame, lead=()) -> DataFrame:
    """(id, text), after the ``lead`` columns: the text block of each participant.  Per-label lines only for
    labels present, in the order True, False, Uncertain."""
    ratio = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0))
    nl = F.lit("\n")
    text = F.concat(
        F.lit(AGENT_LINE), F.col("agent"), nl,
        F.lit(BULLET + LINE_TOTAL), F.col("total").cast("string"), nl,
        F.lit(BULLET + LINE_CORRECT), F.col("correct").cast("string"), nl,
        F.lit(BULLET + LINE_INCORRECT), F.col("incorrect").cast("string"), nl,
        F.lit(BULLET + LINE_PARSE_ERRORS), F.col("parse_errors").cast("string"), nl,
        F.lit(BULLET + LINE_ACCURACY), format_percent(ratio), nl,
        F.lit(BULLET + LINE_PER_CATEGORY), nl, _category_lines(), nl,
        F.lit(BULLET + LINE_AVG_TIME), _seconds("avg_time_per_case"), nl,
        F.lit(BULLET + LINE_TOTAL_TIME), _seconds("time_used"), nl,
    )
    return report.select(*lead, "id", text.alias("text"))


def results_text(report: DataFrame, order_col="id", by: str | None = None) -> DataFrame:
    """One row (per value of ``by``), column ``text``: header, every participant's block in the
    order of ``order_col``, footer; for very many participants take ``participant_text``."""
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    blocks = participant_text(report, [c for c in dict.fromkeys([*order, *([by] if by else [])]) if c != "id"])
    grouped = blocks.groupBy(by) if by else blocks
    agg = grouped.agg(F.count(F.lit(1)).alias("_n"),
                      F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("_o"), "text"))).alias("_b"))
    body = F.array_join(F.transform("_b", lambda x: x["text"]), "")
    text = F.concat(F.lit(TEXT_HEADER), F.col("_n").cast("string"), F.lit(TEXT_AGENTS), body,
                    F.lit(TEXT_FOOTER))
    return agg.select(*([by] if by else []), text.alias("text"))


# K1 / K2 for any number of participants -----------------------------------
def _parts(bodies: DataFrame, order: list[str], text: Column, head: Column, foot: Column) -> DataFrame:
    """(part, text): the numbered bodies between part 0 and the last part.  The numbering reads them more than
    once, so they are checkpointed and whatever makes the report runs once."""
    ensure_checkpoint_dir(bodies.sparkSession)
    numbered, n = number_rows(bodies.checkpoint(), order, col_name="part", start=1)
    ends = bodies.sparkSession.range(2).select(
        F.when(F.col("id") == 0, F.lit(0)).otherwise(F.lit(n + 1)).cast("bigint").alias("part"),
        F.when(F.col("id") == 0, head(n)).otherwise(foot(n)).alias("text"))
    return numbered.select("part", text(n).alias("text")).unionByName(ends).filter(F.col("text").isNotNull())


def json_parts(report: DataFrame, order_col="id") -> DataFrame:
    """``results_json`` as numbered lines (part, text): an opening line, a line per participant in the order
    of ``order_col``, a closing line.  Read in order of ``part`` they are the document; one
    participant is its own row alone, none are an empty list."""
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    fields = F.struct(*[c for c in REPORT_COLUMNS if c in report.columns])
    bodies = report.select(*order, F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))
    comma = lambda n: F.when(F.col("part") < n, F.concat("json", F.lit(","))).otherwise(F.col("json"))
    return _parts(bodies, order, comma, lambda n: F.lit(None if n == 1 else '{"data":['),
                  lambda n: F.lit(None if n == 1 else "]}"))


def text_parts(report: DataFrame, order_col="id") -> DataFrame:
    """``results_text`` as numbered parts (part, text); the parts joined by line feeds are the document."""
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    blocks = participant_text(report, [c for c in order if c != "id"])
    # every part ends with a line feed, which the joining one stands for
    cut = lambda c: F.regexp_replace(c, r"\n\z", "")
    return _parts(blocks, order, lambda n: cut(F.col("text")), lambda n: cut(F.lit(f"{TEXT_HEADER}{n}{TEXT_AGENTS}")),
                  lambda n: cut(F.lit(TEXT_FOOTER)))


def write_parts(parts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes parts as lines of text files: the files in the order of their names, one after the other, are
    the document.  Parts are range-partitioned by number, so the writing is distributed."""
    (parts.repartitionByRange("part").sortWithinPartitions("part").select("text")
     .write.mode(mode).text(path))


# K3 -----------------------------------------------------------------------
def write_results(graded: DataFrame, path: str, mode: str = "overwrite",
                  participant_col: str = "participant", key: str | None = None,
                  max_records_per_file: int = 5_000_000) -> None:
    """Per-example results, Parquet partitioned by participant (distributed write).

    Range partitioning on (participant, key) gives every task a contiguous slice, so
    a task writes into one or two participant folders (no participants x tasks
    small files), while a participant holding a third of all rows still spans many
    tasks.  Files are capped at ``max_records_per_file`` rows."""
    order = [key] if key else [c for c in ("example_id", "sample_num", "story_id") if c in graded.columns][:1]
    keys = [participant_col, *order]
    (graded.repartitionByRange(*keys)
     .write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(participant_col).parquet(path))


# K4 -----------------------------------------------------------------------
def leaderboard(report: DataFrame) -> DataFrame:
    """``SELECT id, score, accuracy FROM results`` over the report table."""
    view = f"results_{uuid.uuid4().hex[:12]}"
    report.createOrReplaceTempView(view)
    return report.sparkSession.sql(f"SELECT id, score, accuracy FROM {view}")
