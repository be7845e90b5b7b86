"""Attempt logs of the code-writing agent: first terminal attempt (W2), repair
message lists (W3), solver verdicts (T14 over a table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answer_eval.functions.prompts import REPAIR_SYSTEM, REPAIR_TEMPLATE, message, render
from answer_eval.functions.text import DEFAULT_LABEL, LABELS, entailment_verdict, error_text, last_verdict_line

MAX_REPAIRS = 3
# Fixed value: error text used when the previous attempt left none.
MSG_PREVIOUS_FAILED = "Previous code execution failed"

_OUTCOMES = ("no_output", "timeout", "success")


def _terminal(cols: list[str]) -> tuple[Column, Column, Column]:
    """The three ways an attempt ends the run: no program, timed out, return code 0."""
    no_output = F.col("code").isNull() if "code" in cols else F.lit(False)
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False)) if "timed_out" in cols else F.lit(False)
    return no_output, timed_out, F.coalesce(F.col("returncode") == 0, F.lit(False))


# W2 -----------------------------------------------------------------------
def resolve_attempts(attempts: DataFrame, problems: DataFrame | None = None,
                     max_repairs: int = MAX_REPAIRS, problem_col: str = "problem_id") -> DataFrame:
    """Final answer per problem from its attempt log.

    Attempts 0..max_repairs in order; the first *terminal* one decides: missing
    program (``code`` NULL) -> Uncertain; timed out -> Uncertain (not repaired);
    return code 0 -> last verdict line of stdout (Uncertain when none).  When no
    attempt is terminal (all failed) or there are none -> Uncertain, ``exhausted``.

    One grouped aggregate (partial aggregation map-side, no sort, no window): the
    candidate (attempt, outcome, verdict) is packed into one BIGINT whose minimum
    is the first terminal attempt.
    """
    cols = attempts.columns
    a = attempts.filter((F.col("attempt") >= 0) & (F.col("attempt") <= max_repairs))
    no_output, timed_out, success = _terminal(cols)
    terminal = no_output | timed_out | success
    outcome = F.when(no_output, 0).when(timed_out, 1).otherwise(2)
    verdict = F.when(no_output | timed_out, F.lit(DEFAULT_LABEL)).otherwise(last_verdict_line(F.col("stdout")))
    verdict_code = F.when(verdict == LABELS[0], 0).when(verdict == LABELS[1], 1).otherwise(2)
    packed = F.col("attempt").cast("bigint") * 16 + outcome * 4 + verdict_code
    per_problem = a.groupBy(problem_col).agg(
        F.min(F.when(terminal, packed)).alias("_first"),
        F.count(F.lit(1)).alias("attempts_made"),
    )
    if problems is not None:
        per_problem = (problems.select(problem_col).distinct()
                       .join(per_problem, problem_col, "left")
                       .fillna(0, subset=["attempts_made"]))
    first = F.col("_first")
    label_arr = F.array(*[F.lit(x) for x in LABELS])
    outcome_arr = F.array(*[F.lit(x) for x in _OUTCOMES])
    # element_at with a NULL index is not reliably NULL: decode only when present
    found = first.isNotNull()
    return per_problem.select(
        problem_col,
        F.when(found, F.element_at(label_arr, (first % 4).cast("int") + 1))
         .otherwise(F.lit(DEFAULT_LABEL)).alias("answer"),
        F.when(found, F.element_at(outcome_arr, ((first / 4).cast("bigint") % 4).cast("int") + 1))
         .otherwise(F.lit("exhausted")).alias("resolved_by"),
        F.when(found, (first / 16).cast("bigint")).alias("final_attempt"),
        F.col("attempts_made").cast("bigint").alias("attempts_made"),
    )


# W3 -----------------------------------------------------------------------
def repair_messages(attempts: DataFrame, problem_text_col: str = "problem_text",
                    max_repairs: int = MAX_REPAIRS, problem_col: str = "problem_id",
                    system: str = REPAIR_SYSTEM, template: str = REPAIR_TEMPLATE) -> DataFrame:
    """For every attempt k in 1..max_repairs that was made because all attempts before it
    failed: the [system, user] messages built from the original problem and the code and
    error text of attempt k-1.  An attempt after a terminal one (see
    ``resolve_attempts``) is no repair and has no messages.

    The first terminal attempt is a pre-aggregated minimum per problem; the previous
    attempt is found by an equi-join on (problem, attempt - 1): no window, so a
    problem with a very long log is not one task's sort.
    """
    made = attempts.filter((F.col("attempt") >= 0) & (F.col("attempt") <= max_repairs))
    prev = made.select(
        problem_col, (F.col("attempt") + 1).alias("attempt"),
        F.col("code").alias("previous_code"),
        error_text(F.col("stderr"), F.col("returncode")).alias("previous_error"),
    )
    no_output, timed_out, success = _terminal(attempts.columns)
    ends = made.groupBy(problem_col).agg(
        F.min(F.when(no_output | timed_out | success, F.col("attempt"))).alias("_end"))
    cur = made.filter(F.col("attempt") >= 1).select(problem_col, "attempt", problem_text_col) \
        .join(ends, problem_col).filter(F.col("_end").isNull() | (F.col("attempt") <= F.col("_end"))).drop("_end")
    joined = cur.join(prev, [problem_col, "attempt"], "left")
    err = F.coalesce(F.col("previous_error"), F.lit(MSG_PREVIOUS_FAILED))
    user = render(template, na_text="None", problem=F.col(problem_text_col),
                  code=F.col("previous_code"), error=err)
    return joined.select(
        problem_col, "attempt", err.alias("previous_error"),
        F.array(message("system", F.lit(system)), message("user", user)).alias("messages"),
    )


# T14 over a table ---------------------------------------------------------------
def solver_verdicts(checks: DataFrame, neg_col: str = "neg_check", pos_col: str = "pos_check") -> DataFrame:
    """Adds ``verdict`` from the two solver outcomes of each row."""
    return checks.withColumn("verdict", entailment_verdict(F.col(neg_col), F.col(pos_col)))
