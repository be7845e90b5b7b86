"""Structured Streaming forms of the stateful operators (``transformWithState``).

X1 ``conversation_stream``: messages arrive per conversation; the output is the
long-form history (same rows as the batch ``conversation_history``).  The state
per conversation is one number (the next position; its presence means the history
is not empty), not the message list, so a long conversation does not grow it.

X2 ``gate_tasks_stream``: a task message passes unless a terminal state was seen for its
task at a lower sequence number; state per task is the lowest terminal number so far.

Rows of a key are taken as they arrive.  What a micro-batch brings of one key is held in memory
up to ``HOLD`` rows and beyond that in the key's list state, so a key with a third of all
rows needs memory for its order numbers only.

Order.  Within a micro-batch messages are ordered by turn, then by a hash of role and text (the same
rule as in the batch operator); across micro-batches X1 keeps the order of arrival, which is the
source's duty (as it was the caller's).  X2 needs no order: a terminal message that
arrives after later messages have passed can not take them back, but it passes itself, so
``gate_tasks_batch`` over the stream's output gives the same rows as over all messages, in
whatever order and batches they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from answer_eval.functions.prompts import DIRECT_SYSTEM
from answer_eval.operators.history import TERMINAL_STATES, message_tie

HOLD = 10_000           # rows of a key held in memory


def _field(df: DataFrame, name: str) -> T.StructField:
    """The column's own type: ids may be numbers or strings."""
    return T.StructField(name, df.schema[name].dataType)


def history_schema(src: DataFrame) -> T.StructType:
    return T.StructType([
        _field(src, "conv_id"),
        T.StructField("position", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        _field(src, "turn"),
    ])


class _Held:
    """One key's rows of a micro-batch, in the order of arrival; read once."""

    def __init__(self, state):
        self.state, self.rows, self.spilled = state, [], False

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) >= HOLD:
            self.state.appendList(self.rows)
            self.rows, self.spilled = [], True

    def read(self) -> Iterator[tuple]:
        if self.spilled:
            yield from self.state.get()
            self.state.clear()
        yield from self.rows


class _History(StatefulProcessor):
    def __init__(self, system: str, timeout_ms: int | None, turn_type: T.DataType):
        self.system, self.timeout_ms, self.turn_type = system, timeout_ms, turn_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", T.StructType([T.StructField("position", T.LongType())]))
        self.held = handle.getListState("held", T.StructType([
            T.StructField("turn", self.turn_type), T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        conv, held, turns, ties, first = key[0], _Held(self.held), [], [], None
        for row in rows:
            turn = row["turn"]
            order = (turn is not None, 0 if turn is None else turn, row["_tie"])     # nulls first
            if first is None or order < first[0]:
                first = (order, row["role"])
            turns.append(order[:2])
            ties.append(order[2])
            held.add((turn, row["role"], row["text"]))
        known = self.next.get() if self.next.exists() else None
        start = known[0] if known else 0
        if not known and first[1] != "system":
            # empty history and no logged system message: the agent's goes first
            yield Row(conv_id=conv, position=0, role="system", content=self.system, turn=None)
            start = 1
        place = np.empty(len(turns), np.int64)
        place[sorted(range(len(turns)), key=lambda i: (turns[i], ties[i]))] = np.arange(start, start + len(turns))
        for i, (turn, role, text) in enumerate(held.read()):
            yield Row(conv_id=conv, position=int(place[i]), role=role, content=text, turn=turn)
        self.next.update((start + len(turns),))
        if self.timeout_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.next.clear()
        return iter([])

    def close(self) -> None:
        pass


def conversation_stream(stream: DataFrame, system: str = DIRECT_SYSTEM,
                        timeout_ms: int | None = None) -> DataFrame:
    """X1: keyed history state per conversation (conv_id, turn, role, text) ->
    long-form history rows.

    ``timeout_ms`` forgets a conversation idle for that long (its next message
    starts a new history).  It uses processing-time timers, for which Spark keeps
    scheduling (no-data) micro-batches: run such a query continuously (default or
    processing-time trigger), not with ``availableNow``, which would never end.
    """
    src = stream.select("conv_id", "turn", "role", "text")
    processor = _History(system, timeout_ms, src.schema["turn"].dataType)
    return src.withColumn("_tie", message_tie("role", "text")).groupBy("conv_id").transformWithState(
        processor, history_schema(src), "Append", "ProcessingTime" if timeout_ms else "None")


class _Gate(StatefulProcessor):
    def __init__(self, seq_type: T.DataType):
        self.seq_type = seq_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        seq = T.StructField("seq", self.seq_type)
        self.first_terminal = handle.getValueState("first_terminal", T.StructType([seq]))
        self.held = handle.getListState("held", T.StructType([seq, T.StructField("state", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.first_terminal.get()[0] if self.first_terminal.exists() else None
        low, held = known, _Held(self.held)
        for row in rows:
            seq, state = row["seq"], row["state"]
            if state in TERMINAL_STATES and seq is not None and (low is None or seq < low):
                low = seq
            held.add((seq, state))
        for seq, state in held.read():
            if low is None or (seq is not None and seq <= low):
                yield Row(task_id=key[0], seq=seq, state=state)
        if low != known:
            self.first_terminal.update((low,))

    def close(self) -> None:
        pass


def gate_tasks_stream(stream: DataFrame) -> DataFrame:
    """X2: (task_id, seq, state) stream -> messages that pass the gate as far as it is known; see the
    module docstring for messages that come late."""
    src = stream.select("task_id", "seq", "state")
    schema = T.StructType([_field(src, "task_id"), _field(src, "seq"), T.StructField("state", T.StringType())])
    return src.groupBy("task_id").transformWithState(_Gate(src.schema["seq"].dataType), schema, "Append", "None")


def _uses_processing_time(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().logical().toString()
    return "TransformWithState" in plan and ", ProcessingTime," in plan


def run_to_table(stream_result: DataFrame, out_path: str, checkpoint_path: str) -> None:
    """Run a stateful stream over everything available (availableNow) into a
    Parquet sink and wait for it; read the result back with ``spark.read``.

    Streams with processing-time timers never finish under availableNow (Spark
    schedules no-data batches for them forever) and are refused here."""
    if _uses_processing_time(stream_result):
        raise ValueError("processing-time timers need a continuously running query; "
                         "start it with writeStream yourself instead of run_to_table")
    q = (stream_result.writeStream.format("parquet").outputMode("append")
         .option("path", out_path).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
