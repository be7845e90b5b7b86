"""Grading: expected rows (J1), answers joined to gold (J2), outcome
classification (T11) and the correctness predicate (T12).

Plan shape (see ``grade``): replies are normalised map-side and reduced to narrow
columns *before* any shuffle; duplicates per (participant, key) are removed after
one hash exchange on that key, whose partitioning and sort order the join to the
expected rows reuses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answer_eval.functions.text import (
    MSG_COULD_NOT_PARSE, PRED_ERROR, PRED_EXCEPTION, PRED_PARSE_ERROR,
    STATUS_ERROR_RESPONSE, STATUS_EXCEPTION, STATUS_OK, STATUS_PARSE_ERROR,
    elapsed_seconds, label_of_lower, last_verdict_line, normalise_answer,
)
# Error text of an expected row for which the log holds no reply (our wording).
MSG_NO_REPLY = "No reply recorded for this sample"


# Pairs of one cell of a participants x problems product.
CELL_PAIRS = 1 << 20
# Shortest block of numbers that a participant with a limit takes as one.
RANGE = 64
# Participant rows up to which a product sends them to all tasks.
SMALL_ROWS = 10_000
# Columns that name one row of the problem table, best first.
ROW_KEYS = ("example_id", "sample_num")


def _key_list(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def row_key(key, *tables: DataFrame) -> list[str]:
    """The given key, else the first of ``ROW_KEYS`` that all tables have.

    Every problem row is graded by itself, so the key must name rows: a story's id does
    not, where a story has several examples."""
    if key is not None:
        return _key_list(key)
    for name in ROW_KEYS:
        if all(name in t.columns for t in tables):
            return [name]
    raise ValueError(f"no row key: name one, or give all tables one of {', '.join(ROW_KEYS)}")


# J1 -----------------------------------------------------------------------
def grid(left: int, right: int, cell: int = CELL_PAIRS) -> tuple[int, int]:
    """Parts of both sides of a product of ``left`` x ``right`` rows: cells of about ``cell`` pairs, with
    the fewest copies (each left row once per right part, each right row once per left part)."""
    cells = -(-left * right // cell)
    if cells <= 1:
        return 1, 1
    a = min(left, max(1, round(math.sqrt(cells * left / right))))
    b = min(right, -(-cells // a))
    return min(left, -(-cells // b)), b


def _all(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def _parts(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def _meet(left: DataFrame, right: DataFrame, keys: list[str], right_rows: int) -> DataFrame:
    """Equi-join of rows that ``explode`` has multiplied.  Spark estimates a side without its copies and would
    send millions of them through the driver, so the counted rows say whether the right side is broadcast."""
    return left.join(right.hint("broadcast" if right_rows <= SMALL_ROWS else "merge"), keys)


def expected_rows(problems: DataFrame, participants: DataFrame, n_problems: int | None = None,
                  n_participants: int | None = None, on=()) -> DataFrame:
    """Every participant paired with every problem: exactly P x N output rows.

    Both sides are counted (unless the counts are given) and cut into parts so that a pair
    of parts is one cell of about ``CELL_PAIRS`` pairs: the tasks grow with the product.  Every row has
    one copy per part of the other side, and an equi-join on the cell pairs them, so either
    side may be the large one and neither is collected.  With ``on`` (columns of both) a participant meets
    its own problems only, ``n_problems`` of them."""
    n = problems.count() if n_problems is None else n_problems
    p = participants.count() if n_participants is None else n_participants
    rows, columns = grid(max(1, n), max(1, p))
    left = problems.withColumn("_row", F.pmod(_all(problems), F.lit(rows))).withColumn("_column", _parts(columns))
    right = participants.withColumn("_column", F.pmod(_all(participants), F.lit(columns))) \
        .withColumn("_row", _parts(rows))
    return _meet(left, right, ["_row", "_column", *on], p * rows).drop("_row", "_column")


def granted(limit: str, n_problems: int) -> Column:
    """How many of the first ``n_problems`` a limit grants: missing or 0 = all, N > 0 = the first N, N < 0 = all
    but the last |N|."""
    return F.expr(f"CASE WHEN coalesce({limit}, 0) = 0 THEN {n_problems}L WHEN {limit} > 0 "
                  f"THEN least({limit}, {n_problems}L) ELSE greatest({n_problems}L + {limit}, 0L) END")


def limited_rows(problems: DataFrame, participants: DataFrame, n_problems: int, num_col: str = "sample_num",
                 limit_col: str = "max_examples", on=()) -> DataFrame:
    """Every participant paired with as many of the first problems as its limit says (``granted``).
    ``problems`` carry dense numbers from 1; with ``on`` (columns of both) each value of it has its own.

    A limit is an interval of numbers from 1.  A participant whose interval is the whole table
    goes into the product (``expected_rows``).  Any other interval is cut into full blocks of numbers and the
    positions behind them, a row each, and equi-joins on block and number bring the problems: no pair beyond a
    limit is made, and a long interval is about twice the square root of its length in rows.  Many
    participants ask for the same numbers, so the joins have a second key, a part of the
    participants, and the asked problems one copy per part."""
    keyed = participants.withColumn("_take", granted(limit_col, n_problems))
    whole, some = F.col("_take") == n_problems, (F.col("_take") > 0) & (F.col("_take") < n_problems)
    facts = keyed.agg(F.count_if(whole).alias("whole"), F.count_if(some).alias("some"),
                      F.max(F.when(some, F.col("_take"))).alias("longest")).first()
    full = expected_rows(problems, keyed.filter(whole).drop("_take"), n_problems, facts["whole"], on)
    if not facts["some"]:
        return full
    block = max(RANGE, math.isqrt(facts["longest"]))
    keyed = keyed.filter(some).withColumn("_blocks", F.floor(F.col("_take") / block)) \
        .withColumn("_behind", F.col("_take") % block)
    facts = keyed.agg(F.lit(facts["longest"]).alias("longest"), F.count_if(F.col("_blocks") > 0).alias("long"),
                      F.sum("_blocks").alias("blocks"), F.count_if(F.col("_behind") > 0).alias("some"),
                      F.sum("_behind").alias("positions")).first()
    number = F.col(num_col)

    def pairs(rows: DataFrame, key: str, of_problem: Column, first: Column, last: Column, n_rows: int,
              n_participants: int, width: int) -> DataFrame:
        # as many participants meet one copy of a problem as make CELL_PAIRS pairs of a key
        parts = -(-n_participants * width // CELL_PAIRS)
        asked = rows.withColumn("_part", F.pmod(_all(participants), F.lit(parts))) \
            .withColumn(key, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))) \
            .drop("_take", "_blocks", "_behind")
        given = problems.filter(number <= facts["longest"]).withColumn("_part", _parts(parts))
        if key != num_col:
            given = given.withColumn(key, of_problem)
        return _meet(given, asked, [key, "_part", *on], n_rows).select(*full.columns)

    out = full
    if facts["long"]:
        out = out.unionByName(pairs(keyed.filter("_blocks > 0"), "_block", F.floor((number - 1) / block), F.lit(0),
                                    F.col("_blocks") - 1, facts["blocks"], facts["long"], block))
    if facts["some"]:
        out = out.unionByName(pairs(keyed.filter("_behind > 0"), num_col, number, F.col("_blocks") * block + 1,
                                    F.col("_take"), facts["positions"], facts["some"], 1))
    return out


# T10/T11 on replies ---------------------------------------------------------
def prediction(reply_status: Column, answer: Column, mode: str = "substring") -> tuple[Column, Column, Column]:
    """(predicted, status, parse-failure flag) of one decoded reply.

    error reply -> Uncertain / error_response; bad envelope -> ERROR / parse_error;
    raised or timed out -> EXCEPTION / exception; no label in the text ->
    PARSE_ERROR / parse_error; else the label / ok.  ``mode='last_line'`` reads the
    last verdict line instead of substring containment.
    """
    return _prediction(reply_status, _label(answer, mode))


def _label(answer: Column, mode: str) -> Column:
    if mode == "substring":
        return normalise_answer(answer)
    if mode == "last_line":
        return last_verdict_line(answer, default=None)
    raise ValueError(f"unknown mode {mode!r}")


def _labelled(df: DataFrame, mode: str) -> DataFrame:
    """df with ``_label``, a column of its own (as is the lower-cased text below it): the columns that follow
    from it read it several times, and a long answer is gone through once."""
    if mode == "substring":
        return df.withColumn("_low", F.lower("answer")).withColumn("_label", label_of_lower(F.col("_low"))).drop("_low")
    return df.withColumn("_label", _label(F.col("answer"), mode))


def _prediction(reply_status: Column, label: Column) -> tuple[Column, Column, Column]:
    no_label = (reply_status == F.lit(STATUS_OK)) & label.isNull()
    predicted = (
        F.when(reply_status == F.lit(STATUS_ERROR_RESPONSE), F.lit("Uncertain"))
        .when(reply_status == F.lit(STATUS_PARSE_ERROR), F.lit(PRED_ERROR))
        .when(reply_status == F.lit(STATUS_EXCEPTION), F.lit(PRED_EXCEPTION))
        .when(no_label, F.lit(PRED_PARSE_ERROR))
        .otherwise(label)
    )
    status = F.when(no_label, F.lit(STATUS_PARSE_ERROR)).otherwise(reply_status)
    return predicted, status, no_label


def prepare_replies(answers: DataFrame, key=None, participant_col: str = "participant",
                    mode: str = "substring", dedupe: str | None = None,
                    order_col: str | None = None) -> DataFrame:
    """Decoded replies -> one narrow row per (participant, key).

    Output: participant, key..., predicted, status, error, time, and started_at /
    ended_at when the log has them.  Normalisation runs map-side so the long
    answer text never reaches a shuffle.

    dedupe: ``first`` keeps the first reply per key in the order of ``order_col`` (ties: the
    smallest reply); ``error`` fails the job at a second reply; ``none`` trusts the log
    to be unique (no shuffle at all).  By default ``first`` with an ``order_col`` and
    ``error`` without: no reply is dropped without being asked for.
    """
    dedupe = dedupe or ("first" if order_col else "error")
    if dedupe not in ("first", "error", "none"):
        raise ValueError(f"unknown dedupe {dedupe!r}")
    if dedupe == "first" and not order_col:
        raise ValueError("dedupe='first' needs an order_col")
    keys = [*_key_list(participant_col), *row_key(key, answers)]
    predicted, status, no_label = _prediction(F.col("reply_status"), F.col("_label"))
    error = F.when(no_label, F.lit(MSG_COULD_NOT_PARSE)).otherwise(F.col("error"))
    cols = answers.columns
    if "started_at" in cols and "ended_at" in cols:
        time = elapsed_seconds("started_at", "ended_at")
    elif "elapsed_s" in cols:
        time = F.col("elapsed_s").cast("double")
    else:
        time = F.lit(None).cast("double")
    time = F.when(F.col("reply_status") == F.lit(STATUS_EXCEPTION), F.lit(0.0)).otherwise(time)
    extra = [c for c in ("started_at", "ended_at") if c in cols]
    order = [order_col] if order_col else []
    narrow = _labelled(answers, mode).select(
        *keys, *order,
        predicted.alias("predicted"), status.alias("status"), error.alias("error"),
        time.alias("time"), *extra,
    )
    value_cols = ["predicted", "status", "error", "time", *extra]
    if dedupe == "none":
        return narrow.drop(*order)
    # One reply per key: row_number over the key (hash exchange + one reduce-side
    # sort, which a following sort-merge join on the same key reuses).  Ties are
    # broken by the reply columns so the pick is deterministic.
    sort = [F.col(c).asc_nulls_last() for c in [*order, *value_cols]]
    ranked = narrow.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*sort)))
    if dedupe == "error":
        text = F.concat(F.lit("duplicate reply for key "), F.to_json(F.struct(*keys)))
        kept = ranked.filter(F.assert_true(F.col("_rank") == 1, text).isNull())
    else:
        kept = ranked.filter(F.col("_rank") == 1)
    return kept.drop("_rank", *order)


def correctness(predicted: Column, expected: Column, status: Column) -> Column:
    """T12: case-insensitive match for ok and error replies; never for the rest."""
    counts = status.isin(STATUS_OK, STATUS_ERROR_RESPONSE)
    return F.coalesce(counts & (F.lower(predicted) == F.lower(expected)), F.lit(False))


# J2 / T11 / T12 -------------------------------------------------------------
def grade(expected: DataFrame, answers: DataFrame, key=None,
          participant_col: str = "participant", mode: str = "substring",
          dedupe: str | None = None, order_col: str | None = None) -> DataFrame:
    """Graded rows: every expected row survives (left outer equi-join on
    participant + key); a missing reply is an ``exception`` row with time 0.0.

    ``expected`` needs participant (one column or several), key and ``expected`` (the
    coerced gold label);
    ``answers`` the decoded reply columns (``reply_status``, ``answer``, ``error``).
    """
    key = row_key(key, expected, answers)
    keys = [*_key_list(participant_col), *key]
    replies = prepare_replies(answers, key, participant_col, mode, dedupe, order_col)
    reply_cols = [c for c in replies.columns if c not in keys]
    joined = expected.join(replies.withColumn("_hit", F.lit(True)), keys, "left")
    hit = F.col("_hit").isNotNull()
    predicted = F.when(hit, F.col("predicted")).otherwise(F.lit(PRED_EXCEPTION))
    status = F.when(hit, F.col("status")).otherwise(F.lit(STATUS_EXCEPTION))
    error = F.when(hit, F.col("error")).otherwise(F.lit(MSG_NO_REPLY))
    time = F.when(hit, F.col("time")).otherwise(F.lit(0.0))
    out = (joined.withColumn("predicted", predicted)
                 .withColumn("status", status)
                 .withColumn("error", error)
                 .withColumn("time", time)
                 .withColumn("correct", correctness(F.col("predicted"), F.col("expected"), F.col("status")))
                 .drop("_hit"))
    ordered = [c for c in expected.columns] + [c for c in ("predicted", "correct", "time", "status", "error")]
    ordered += [c for c in reply_cols if c not in ordered]
    return out.select(*ordered)


def grade_inline(log: DataFrame, key, participant_col: str = "participant",
                 expected_col: str = "expected", mode: str = "substring") -> DataFrame:
    """Grade a decoded log whose rows already carry the gold label (each row is
    one expected sample): map-side only -- no join, no shuffle."""
    predicted, status, no_label = _prediction(F.col("reply_status"), F.col("_label"))
    error = F.when(no_label, F.lit(MSG_COULD_NOT_PARSE)).otherwise(F.col("error"))
    if "started_at" in log.columns and "ended_at" in log.columns:
        time = elapsed_seconds("started_at", "ended_at")
    elif "elapsed_s" in log.columns:
        time = F.col("elapsed_s").cast("double")
    else:
        time = F.lit(None).cast("double")
    time = F.when(F.col("reply_status") == F.lit(STATUS_EXCEPTION), F.lit(0.0)).otherwise(time)
    extra = [c for c in ("started_at", "ended_at") if c in log.columns]
    out = _labelled(log, mode).select(participant_col, *_key_list(key), F.col(expected_col).alias("expected"),
                     predicted.alias("predicted"), status.alias("status"), error.alias("error"),
                     time.alias("time"), *extra)
    return out.withColumn("correct", correctness(F.col("predicted"), F.col("expected"), F.col("status")))
