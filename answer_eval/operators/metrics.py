"""Aggregations over graded rows (A1-A9, U1).

All counts come out of one grouped pass with conditional counts (partial
aggregation map-side, so a participant holding a third of all rows still reduces
to one row per map partition before the shuffle).  Counts are BIGINT, rates
DOUBLE, rounding is half-to-even like Python's ``round``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answer_eval.functions.text import (
    LABELS, STATUS_EXCEPTION, STATUS_PARSE_ERROR, epoch_micros, percent_of, round_even,
)
from answer_eval.operators.grade import correctness, prepare_replies, row_key

REPORT_COLUMNS = (
    "id", "score", "accuracy", "agent", "agent_id", "pass_rate", "correct", "total",
    "incorrect", "parse_errors", "time_used", "avg_time_per_case", "max_score",
    "true_correct", "true_total", "true_accuracy",
    "false_correct", "false_total", "false_accuracy",
    "uncertain_correct", "uncertain_total", "uncertain_accuracy",
)


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _is_parse_error() -> Column:
    return (~F.col("correct")) & F.col("status").isin(STATUS_PARSE_ERROR, STATUS_EXCEPTION)


def _count_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("correct")).alias("correct"),
        F.count_if(_is_parse_error()).alias("parse_errors"),
    ]


def _with_incorrect(df: DataFrame) -> DataFrame:
    return df.withColumn("incorrect", F.col("total") - F.col("correct") - F.col("parse_errors"))


# A1 -----------------------------------------------------------------------
def outcome_counts(graded: DataFrame, by="participant") -> DataFrame:
    """total, correct, parse_errors (parse_error or exception, when not correct),
    incorrect = the rest.  Correct is tested first, so the three sum to total."""
    keys = _by(by)
    out = graded.groupBy(*keys).agg(*_count_aggs())
    return _with_incorrect(out).select(*keys, "total", "correct", "incorrect", "parse_errors")


# A2 -----------------------------------------------------------------------
def accuracy(graded: DataFrame, by="participant", participants: DataFrame | None = None,
             participant_col: str = "participant") -> DataFrame:
    """correct / total, 0.0 when total is 0 (a participant without rows, reached
    through a left join from ``participants``)."""
    keys = _by(by)
    counts = graded.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"),
                                       F.count_if(F.col("correct")).alias("correct"))
    if participants is not None:
        counts = (participants.select(participant_col).distinct()
                  .join(counts, participant_col, "left")
                  .fillna(0, subset=["total", "correct"]))
    ratio = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0))
    return counts.select(*keys, "total", "correct", ratio.alias("accuracy"))


def _wall_clock(start: str, end: str) -> Column:
    micros = F.max(epoch_micros(end)) - F.min(epoch_micros(start))
    return micros / F.lit(1_000_000.0)


# A3 -----------------------------------------------------------------------
def avg_time_per_case(graded: DataFrame, by="participant", start: str = "started_at",
                      end: str = "ended_at") -> DataFrame:
    """Wall clock of the whole run (max end - min start) / number of cases, 0.0 when
    empty; the mean of per-row times is exposed separately as mean_time_per_case."""
    keys = _by(by)
    # Mean row time from integer microseconds (exact, order-independent sum).
    row_us = epoch_micros(end) - epoch_micros(start)
    out = graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        _wall_clock(start, end).alias("wall_clock_s"),
        (F.sum(row_us) / F.count(F.lit(1)) / F.lit(1_000_000.0)).alias("mean_time_per_case"),
    )
    avg = F.when(F.col("total") > 0, F.col("wall_clock_s") / F.col("total")).otherwise(F.lit(0.0))
    return out.select(*keys, "total", "wall_clock_s", avg.alias("avg_time_per_case"),
                      "mean_time_per_case")


# A8 -----------------------------------------------------------------------
def total_time(graded: DataFrame, by="participant", start: str = "started_at",
               end: str = "ended_at") -> DataFrame:
    """Total evaluation time per participant: max(end) - min(start), rounded to 2."""
    keys = _by(by)
    return graded.groupBy(*keys).agg(round_even(_wall_clock(start, end), 2).alias("time_used"))


# A4 -----------------------------------------------------------------------
def label_breakdown(graded: DataFrame, by="participant") -> DataFrame:
    """Long per-label breakdown on the raw (case-sensitive) expected label."""
    keys = [*_by(by), "expected"]
    out = graded.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"),
                                    F.count_if(F.col("correct")).alias("correct"))
    return out.select(*keys, "total", "correct",
                      percent_of(F.col("correct"), F.col("total")).alias("accuracy"))


def _wide_aggs() -> list[Column]:
    aggs = []
    for label in LABELS:
        p = label.lower()
        is_label = F.col("expected") == F.lit(label)
        aggs.append(F.count_if(is_label & F.col("correct")).alias(f"{p}_correct"))
        aggs.append(F.count_if(is_label).alias(f"{p}_total"))
    return aggs


def _wide_rates() -> list[Column]:
    out = []
    for label in LABELS:
        p = label.lower()
        out += [F.col(f"{p}_correct"), F.col(f"{p}_total"),
                percent_of(F.col(f"{p}_correct"), F.col(f"{p}_total")).alias(f"{p}_accuracy")]
    return out


# A5 -----------------------------------------------------------------------
def label_breakdown_wide(graded: DataFrame, by="participant") -> DataFrame:
    """Nine columns for the three labels (0 / 0 / 0.0 when a label is absent);
    other labels do not appear.  Same single grouped pass, no pivot shuffle."""
    keys = _by(by)
    return graded.groupBy(*keys).agg(*_wide_aggs()).select(*keys, *_wide_rates())


# A9 -----------------------------------------------------------------------
def label_breakdown_with_totals(graded: DataFrame, by="participant") -> DataFrame:
    """Overall and per-label counts in ONE pass: GROUPING SETS ((by), (by, expected)).
    ``level`` is 'overall' (expected NULL) or 'label'."""
    keys = _by(by)
    sets = [[F.col(k) for k in keys], [*[F.col(k) for k in keys], F.col("expected")]]
    out = graded.groupingSets(sets, *keys, "expected").agg(
        F.grouping(F.col("expected")).alias("_g"),
        *_count_aggs(),
    )
    level = F.when(F.col("_g") == 1, F.lit("overall")).otherwise(F.lit("label"))
    out = _with_incorrect(out)
    return out.select(*keys, "expected", level.alias("level"), "total", "correct", "incorrect",
                      "parse_errors", percent_of(F.col("correct"), F.col("total")).alias("accuracy"))


def _report_from_counts(counts: DataFrame, participant_col: str, has_time: bool, lead=()) -> DataFrame:
    name = F.col(participant_col)
    score = percent_of(F.col("correct"), F.col("total"))
    if has_time:
        time_used = round_even(F.col("_wall"), 2)
        avg = F.when(F.col("total") > 0, round_even(F.col("_wall") / F.col("total"), 2)).otherwise(F.lit(0.0))
    else:
        time_used = avg = F.lit(None).cast("double")
    return counts.select(
        *lead, name.alias("id"), score.alias("score"), score.alias("accuracy"), name.alias("agent"),
        F.col("agent_id"), score.alias("pass_rate"), "correct", "total", "incorrect",
        "parse_errors", time_used.alias("time_used"), avg.alias("avg_time_per_case"),
        F.col("total").alias("max_score"), *_wide_rates(),
    )


def _attach_participants(counts: DataFrame, participants: DataFrame | None,
                         participant_col: str, keys: list[str]) -> DataFrame:
    count_cols = ["total", "correct", "parse_errors",
                  *[f"{lab.lower()}_{k}" for lab in LABELS for k in ("correct", "total")]]
    if participants is None:
        return counts.withColumn("agent_id", F.col(participant_col))
    plist = participants.select(
        *dict.fromkeys([*keys, participant_col]),
        (F.col("agent_id") if "agent_id" in participants.columns else F.col(participant_col)).alias("agent_id"))
    out = plist.join(counts, keys, "left").fillna(0, subset=count_cols)
    return out


# A6 -----------------------------------------------------------------------
def report(graded: DataFrame, participants: DataFrame | None = None,
           participant_col: str = "participant", by=None) -> DataFrame:
    """One report row per participant (A1 + A2 + A3 + A5, rounded half-even).

    ``score = accuracy = pass_rate`` (percent, 2 decimals), ``id = agent``,
    ``max_score = total``.  Time columns need ``started_at``/``ended_at`` on the
    graded rows (wall clock); without them they are NULL.  With ``participants``
    (participant, agent_id) every participant gets a row, zero counts included.

    ``by`` names the columns that tell participants apart where names do not (a request's
    id and the position in it); they come first in the output.
    """
    keys = _by(by) or [participant_col]
    has_time = "started_at" in graded.columns and "ended_at" in graded.columns
    aggs = [*_count_aggs(), *_wide_aggs()]
    if has_time:
        aggs.append(_wall_clock("started_at", "ended_at").alias("_wall"))
    counts = graded.groupBy(*keys).agg(*aggs)
    counts = _with_incorrect(_attach_participants(counts, participants, participant_col, keys))
    if has_time:
        counts = counts.withColumn("_wall", F.coalesce(F.col("_wall"), F.lit(0.0)))
    return _report_from_counts(counts, participant_col, has_time, _by(by))


def evaluate_report(problems: DataFrame, participants: DataFrame, answers: DataFrame,
                    key=None, participant_col: str = "participant",
                    mode: str = "substring", dedupe: str | None = None,
                    order_col: str | None = None) -> DataFrame:
    """A6 straight from problems, participants and a decoded answer log, without
    materialising the P x N expected rows.

    Replies are normalised map-side and de-duplicated as ``grade`` does it
    (``prepare_replies``), joined to the gold labels and counted.  A missing reply is a
    parse error that is never correct, so per participant: total = N, label totals =
    the problem table's, parse_errors += N - answered.  No job runs before the result is
    used, and join sides are left to the engine, which measures them.
    """
    key = row_key(key, problems, answers)
    gold = problems.select(*key, "expected")
    totals = {"total": F.count(F.lit(1))} | {
        f"{lab.lower()}_total": F.count_if(F.col("expected") == F.lit(lab)) for lab in LABELS}
    replies = prepare_replies(answers, key, participant_col, mode, dedupe, order_col).drop("error", "time")
    known = participants.select(participant_col).distinct()
    answered = (replies.join(gold, key, "inner")
                .join(known, participant_col, "left_semi")
                .withColumn("correct", correctness(F.col("predicted"), F.col("expected"), F.col("status"))))
    has_time = "started_at" in answered.columns and "ended_at" in answered.columns
    aggs = [F.count(F.lit(1)).alias("_answered"), F.count_if(F.col("correct")).alias("correct"),
            F.count_if(_is_parse_error()).alias("_parse")]
    aggs += [F.count_if((F.col("expected") == F.lit(lab)) & F.col("correct")).alias(f"{lab.lower()}_correct")
             for lab in LABELS]
    if has_time:
        aggs.append(_wall_clock("started_at", "ended_at").alias("_wall"))
    counts = answered.groupBy(participant_col).agg(*aggs)
    people = participants.select(
        participant_col,
        (F.col("agent_id") if "agent_id" in participants.columns else F.col(participant_col)).alias("agent_id"))
    zero_cols = ["_answered", "correct", "_parse", *[f"{lab.lower()}_correct" for lab in LABELS]]
    counts = people.join(counts, participant_col, "left").fillna(0, subset=zero_cols) \
        .withColumns({name: gold.agg(n).scalar() for name, n in totals.items()}) \
        .withColumn("parse_errors", F.col("_parse") + F.col("total") - F.col("_answered"))
    counts = _with_incorrect(counts)
    if has_time:
        counts = counts.withColumn("_wall", F.coalesce(F.col("_wall"), F.lit(0.0)))
    return _report_from_counts(counts, participant_col, has_time)


# A7 -----------------------------------------------------------------------
def run_summary(runs: DataFrame, agent_col: str = "participant",
                error_col: str = "error_message") -> DataFrame:
    """Per agent: ``Completed``, or ``ERROR - <message>`` (smallest message) when
    any of its runs failed."""
    out = runs.groupBy(agent_col).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(F.col(error_col)).alias("failed_runs"),
        F.min(F.col(error_col)).alias("_err"),
    )
    status = F.when(F.col("_err").isNull(), F.lit("Completed")).otherwise(
        F.concat(F.lit("ERROR - "), F.col("_err")))
    return out.select(F.col(agent_col).alias("agent"), "runs", "failed_runs", status.alias("status"))


# U1 -----------------------------------------------------------------------
def combine(*dfs: DataFrame) -> DataFrame:
    """Append per-participant results (by column name)."""
    if not dfs:
        raise ValueError("combine needs at least one DataFrame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
