"""Conversation history (W4) and task lifecycle gates (F3, J3, X2 batch twin).

History is kept in long form -- one row per message with its position in the
conversation -- never as one collected list per conversation: a conversation can
be arbitrarily long, and the messages sent for a user turn are simply the rows of
its conversation up to that turn's position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answer_eval.functions.prompts import DIRECT_SYSTEM
from answer_eval.sources.problems import number_within

# Task states after which a task is never processed again.
TERMINAL_STATES = ("completed", "canceled", "failed", "rejected")


def message_tie(role_col: str, text_col: str) -> Column:
    """What orders messages of one conversation and turn, in the batch and in the stream."""
    return F.xxhash64(F.col(role_col), F.col(text_col))


# W4 -----------------------------------------------------------------------
def conversation_history(log: DataFrame, system: str = DIRECT_SYSTEM, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """Long-form history: (conv_id, position, role, content, turn).

    The agent puts its system message first only when the history is empty, i.e.
    when the conversation's first logged message is not already a system message (a message
    without a role is none); then every logged message in turn order, messages of one turn in
    the order of ``message_tie``.  Positions are 0-based and dense.
    The per-conversation first role is one aggregate; numbering is the skew-safe
    ``number_within`` (no whole conversation in one task), whose join is the only shuffle of texts.
    """
    return _positions(log, system, conv_col, turn_col, role_col, text_col, F.col(text_col))


def _positions(log, system, conv_col, turn_col, role_col, text_col, content: Column) -> DataFrame:
    tie = message_tie(role_col, text_col)
    first_role = log.groupBy(conv_col).agg(
        F.min_by(F.struct(F.col(role_col).alias("role")), F.struct(F.col(turn_col), tie)).alias("_first"))
    system_rows = first_role.filter(~F.col("_first.role").eqNullSafe(F.lit("system"))).select(
        conv_col, F.lit(0).alias("_k"), F.lit(None).cast(log.schema[turn_col].dataType).alias(turn_col),
        F.lit(0).cast("bigint").alias("_tie"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    rows = log.select(conv_col, F.lit(1).alias("_k"), turn_col, tie.alias("_tie"),
                      F.col(role_col).alias("role"), content.alias("content"))
    both = system_rows.unionByName(rows)
    numbered = number_within(both, [conv_col], ["_k", turn_col, "_tie"], col_name="position", start=0)
    return numbered.select(conv_col, "position", "role", "content", turn_col)


def conversation_prefixes(log: DataFrame, system: str = DIRECT_SYSTEM, conv_col: str = "conv_id",
                          turn_col: str = "turn", role_col: str = "role",
                          text_col: str = "text") -> DataFrame:
    """For every user turn: how many messages were sent with it (system first if
    the history was empty, all earlier turns, then this one) -- the prefix of the
    long-form history ending at this turn.  (conv_id, turn, position, messages_sent)."""
    # positions need a hash of the texts only: none is shuffled for them
    hist = _positions(log, system, conv_col, turn_col, role_col, text_col, F.lit(None).cast("string"))
    return (hist.filter(F.col("role") == F.lit("user"))
            .select(conv_col, turn_col, "position", (F.col("position") + 1).alias("messages_sent")))


def messages_sent(history: DataFrame, turns: DataFrame, conv_col: str = "conv_id",
                  turn_col: str = "turn") -> DataFrame:
    """The messages sent for chosen turns: ``history`` as ``conversation_history`` gives it,
    ``turns`` the wanted (conv_id, turn).  (conv_id, turn, messages), the messages being an
    array of (position, role, content) up to and with that turn.  A turn that the history
    lacks gives no row; each result is one row, as the list itself is one request."""
    ends = turns.select(conv_col, turn_col).distinct() \
        .join(history.select(conv_col, turn_col, F.col("position").alias("_end")), [conv_col, turn_col])
    ends = ends.groupBy(conv_col, turn_col).agg(F.max("_end").alias("_end"))
    sent = history.select(conv_col, "position", "role", "content").join(ends, conv_col) \
        .filter(F.col("position") <= F.col("_end"))
    return sent.groupBy(conv_col, turn_col).agg(
        F.array_sort(F.collect_list(F.struct("position", "role", "content"))).alias("messages"))


# F3 -----------------------------------------------------------------------
def open_tasks(tasks: DataFrame, state_col: str = "state") -> DataFrame:
    """Task messages whose state is not terminal."""
    return tasks.filter(~F.col(state_col).isin(*TERMINAL_STATES))


def finished_tasks(tasks: DataFrame, task_col: str = "task_id", state_col: str = "state",
                   seq_col: str | None = None) -> DataFrame:
    """Distinct finished tasks, one row per task (an aggregate with map-side
    partial aggregation, so a hot task does not skew later joins).

    Without ``seq_col`` every row is a task's current state; with it the rows are
    a state log and a task's current state is its latest one (``max_by``)."""
    if seq_col is not None:
        tasks = tasks.groupBy(task_col).agg(F.max_by(F.col(state_col), F.col(seq_col)).alias(state_col))
    return tasks.filter(F.col(state_col).isin(*TERMINAL_STATES)).select(task_col).distinct()


# J3 -----------------------------------------------------------------------
def skip_finished(requests: DataFrame, tasks: DataFrame, task_col: str = "task_id",
                  state_col: str = "state", seq_col: str | None = None) -> DataFrame:
    """Requests whose task has not finished (left anti join on the task id)."""
    done = finished_tasks(tasks, task_col, state_col, seq_col)
    # an aggregate stage: AQE broadcasts it only after measuring it small
    return requests.join(done, task_col, "left_anti")


# X2 batch twin ---------------------------------------------------------------
def gate_tasks_batch(tasks: DataFrame, task_col: str = "task_id", seq_col: str = "seq",
                     state_col: str = "state") -> DataFrame:
    """Messages that pass the terminal-task gate: a message passes unless a
    terminal state was seen for its task strictly *before* it (so seen but
    unfinished tasks pass again, and the terminal message itself passes).

    First terminal sequence per task is one aggregate; the gate is an equi-join
    back -- no window, so a task with a third of all messages is not sorted in one
    task.
    """
    first_term = (tasks.filter(F.col(state_col).isin(*TERMINAL_STATES))
                  .groupBy(task_col).agg(F.min(seq_col).alias("_first_terminal")))
    # one row per task from an aggregate stage: AQE broadcasts it only after
    # measuring it small, otherwise a shuffle join (skew join splits a hot task)
    joined = tasks.join(first_term, task_col, "left")
    passes = F.col("_first_terminal").isNull() | (F.col(seq_col) <= F.col("_first_terminal"))
    return joined.filter(passes).drop("_first_terminal")
