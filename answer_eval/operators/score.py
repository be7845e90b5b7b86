"""D1: apply a user-supplied answerer (prompt -> text) to every row.

The answerer is an ordinary Python callable passed in by the caller (an HTTP
client, a local model, a rule).  A task answers its partition with up to
``calls_per_task`` calls in flight.  ``max_concurrency`` bounds the calls in flight of the whole job,
whatever the cluster's size: there are then no more partitions, hence tasks, than
``max_concurrency // calls_per_task``.  Without it partitions are the input's, or ``partitions`` many.

``ledger`` names a folder that driver and executors share.  The prompts are written there first, each
with a slot and a row number (a slot is ``SLOT_ROWS`` rows of one partition at most), and a task records its replies as it gets them, ``ledger_every`` at a
time.  A task that is run again, or a job started again with the same ledger, reads
what is recorded of its slots and asks for the rest only; what a lost task had in flight or not yet
recorded is all that is asked again.

With both, what is not recorded is asked at once, in rounds: a job of as many tasks as the bound allows over
about ``ROUND_BYTES`` of prompts a task, so no task's input grows with the table.  The result then only reads the
record, on all cores; a reply lost after that fails it, and the next call asks for it again.  Without a ledger
a bounded job's few tasks share the whole input.

A call runs in a daemon thread.  One that is not back after ``timeout_s`` becomes an
``exception`` row and is left behind: it can not be killed, but neither the task nor the
worker's end waits for it.  A failing row becomes an ``exception`` row and never
fails the job; a transient error (by exception type) is retried with delay
``base_delay_s * 2**k``.  An empty or missing text is a reply without text, or, with
``empty_mode`` (see ``default_answer``), the default label.  Output is a decoded answer
log: the input columns plus reply_status, answer, error, started_at, ended_at -- ready
for ``grade`` / ``evaluate_report``.

Persist the result (write it or ``checkpoint()``) before using it twice, or give a ledger, so the
answerer is not re-run.
"""

from __future__ import annotations

import concurrent.futures as cf
import json
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answer_eval.functions.text import DEFAULT_LABEL, MSG_NO_TEXT
from answer_eval.sources.problems import path_exists

REPLY_FIELDS = [
    T.StructField("reply_status", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
]

MSG_TIMEOUT = "Timed out after {} s"


def _once(fn, prompt, timeout_s):
    """fn(prompt) in a daemon thread; TimeoutError if it is not back in time."""
    done: queue.SimpleQueue = queue.SimpleQueue()

    def run():
        try:
            done.put((fn(prompt), None))
        except BaseException as exc:  # noqa: BLE001  handed to the caller
            done.put((None, exc))

    threading.Thread(target=run, daemon=True).start()
    try:
        text, exc = done.get(timeout=timeout_s)
    except queue.Empty:
        raise TimeoutError(MSG_TIMEOUT.format(timeout_s)) from None
    if exc is not None:
        raise exc
    return text


def _call(fn, prompt, timeout_s, retries, base_delay_s, transient):
    attempt = 0
    while True:
        try:
            return _once(fn, prompt, timeout_s)
        except transient:
            if attempt + 1 >= retries:
                raise
            time.sleep(base_delay_s * (2 ** attempt))
            attempt += 1


class _Ledger:
    """Recorded replies of one slot: files of JSON lines, each complete from the moment it is there."""

    def __init__(self, root: str, slot: int):
        self.fs, path = _file_system(root)
        self.folder = f"{path}/replies/{slot}"
        self.fs.create_dir(self.folder, recursive=True)
        self.done: dict[int, tuple] = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.folder)):
            if info.base_name.endswith(".json"):
                with self.fs.open_input_stream(info.path) as f:
                    for line in f.readall().decode().splitlines():
                        row, *reply, start, end = json.loads(line)
                        self.done[row] = (*reply, pd.Timestamp(start), pd.Timestamp(end))

    def record(self, replies: list[tuple[int, tuple]]) -> None:
        lines = "\n".join(json.dumps([row, *r[:3], r[3].isoformat(), r[4].isoformat()]) for row, r in replies)
        name = f"{self.folder}/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(name) as f:
            f.write(lines.encode())
        self.fs.move(name, f"{name}.json")
        self.done.update(replies)


def _file_system(root: str):
    if root.startswith("file:/") and not root.startswith("file://"):
        root = root[5:]
    return pafs.FileSystem.from_uri(root)


SLOT, PLACE = "__slot", "__place"
SLOT_ROWS = 1 << 14
ROUND_BYTES = 64 << 20     # of prompts as written, for a task in a round


def _recorded_prompts(df: DataFrame, ledger: str) -> DataFrame:
    """The input as the ledger holds it, a folder per slot; written there by the first job that uses the ledger."""
    path = f"{ledger}/prompts"
    if not path_exists(df.sparkSession, f"{path}/_SUCCESS"):
        place = F.monotonically_increasing_id()
        df.withColumn(SLOT, F.floor(place / F.lit(SLOT_ROWS)).cast("bigint")) \
            .withColumn(PLACE, place.bitwiseAND(F.lit((1 << 33) - 1))) \
            .write.mode("overwrite").partitionBy(SLOT).parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(PLACE, T.LongType()), T.StructField(SLOT, T.LongType())])
    return df.sparkSession.read.schema(schema).parquet(path)


def _rounds(asked: DataFrame, ledger: str, size: int) -> list[list[int]]:
    """Slots with prompts that lack a recorded reply, in groups of about ``size`` bytes of prompts."""
    spark, path = asked.sparkSession, f"{ledger}/replies"
    slots = asked.select(SLOT, F.col("_metadata.file_size").alias("_bytes")) \
        .groupBy(SLOT).agg(F.count(F.lit(1)).alias("_rows"), F.max("_bytes").alias("_bytes"))
    if path_exists(spark, path):
        lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
        slot = F.regexp_extract("_metadata.file_path", r"/([0-9]+)/[^/]+$", 1).cast("bigint")
        known = lines.select(slot.alias(SLOT), F.regexp_extract("value", r"^\[([0-9]+)", 1).alias("_row")).distinct()
        slots = slots.join(known.groupBy(SLOT).agg(F.count(F.lit(1)).alias("_known")), SLOT, "left") \
            .filter("coalesce(_known, 0) < _rows")
    groups, room = [], 0
    for r in slots.orderBy(SLOT).collect():
        if room < r["_bytes"]:
            groups.append([])
            room = size
        groups[-1].append(r[SLOT])
        room -= r["_bytes"]
    return groups


def score(df: DataFrame, fn: Callable[[str], str | None], prompt_col: str = "prompt",
          calls_per_task: int = 1, partitions: int | None = None, timeout_s: float = 120.0, retries: int = 5,
          base_delay_s: float = 7.0, transient: tuple[type[BaseException], ...] = (),
          empty_mode: str | None = None, max_concurrency: int | None = None, ledger: str | None = None,
          ledger_every: int = 50) -> DataFrame:
    """Answer every row's prompt with ``fn``; see the module docstring."""
    if max_concurrency is not None:
        if max_concurrency < 1:
            raise ValueError("max_concurrency must be positive")
        calls_per_task = min(calls_per_task, max_concurrency)
        partitions = min(partitions or max_concurrency, max_concurrency // calls_per_task)
    if empty_mode not in (None, "direct", "code"):
        raise ValueError(f"unknown empty_mode {empty_mode!r}")
    out_schema = T.StructType([*df.schema.fields, *REPLY_FIELDS])
    transient = tuple(transient) or (_NeverRaised,)

    def answer(prompt):
        start = pd.Timestamp.now(tz="UTC")
        try:
            text = _call(fn, prompt, timeout_s, retries, base_delay_s, transient)
            if empty_mode and (text is None or empty_mode == "direct" and text == ""):
                text = DEFAULT_LABEL
            out = ("parse_error", None, MSG_NO_TEXT) if text is None else ("ok", str(text).strip(), None)
        except Exception as exc:  # a failing row never fails the job
            out = ("exception", None, str(exc))
        return (*out, start, pd.Timestamp.now(tz="UTC"))

    def replies(pool, pdf: pd.DataFrame, ledgers: dict, ask: bool) -> Iterator[tuple]:
        prompts = pdf[prompt_col].tolist()
        if not ledger:
            yield from pool.map(answer, prompts)
            return
        places = list(zip(pdf[SLOT].tolist(), pdf[PLACE].tolist()))
        for slot in dict.fromkeys(s for s, _ in places):
            if slot not in ledgers:
                ledgers.clear()         # rows come slot by slot
                ledgers[slot] = _Ledger(ledger, slot)
            own = [(p, prompt) for (s, p), prompt in zip(places, prompts) if s == slot]
            due = [x for x in own if x[0] not in ledgers[slot].done]
            if due and not ask:
                raise RuntimeError(f"{len(due)} replies of slot {slot} are no longer in the ledger")
            for i in range(0, len(due), ledger_every):
                some = due[i:i + ledger_every]
                ledgers[slot].record(list(zip([p for p, _ in some], pool.map(answer, [x for _, x in some]))))
            for p, _ in own:
                yield ledgers[slot].done[p]

    def ask_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledgers: dict[int, _Ledger] = {}
        with cf.ThreadPoolExecutor(max_workers=calls_per_task) as pool:
            for pdf in batches:
                yield pd.DataFrame({"asked": [sum(1 for _ in replies(pool, pdf, ledgers, True))]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledgers: dict[int, _Ledger] = {}
        # every worker of the pool waits for its call no longer than the timeouts, so leaving it is bounded
        with cf.ThreadPoolExecutor(max_workers=calls_per_task) as pool:
            for pdf in batches:
                rows = list(replies(pool, pdf, ledgers, not rounds))
                out = pdf.drop(columns=[SLOT, PLACE]) if ledger else pdf.copy()
                for k, name in enumerate(("reply_status", "answer", "error")):
                    out[name] = pd.Series([r[k] for r in rows], index=pdf.index, dtype=object)
                for k, name in ((3, "started_at"), (4, "ended_at")):
                    out[name] = pd.Series([r[k] for r in rows], index=pdf.index, dtype="datetime64[us, UTC]")
                yield out

    rounds = bool(ledger) and max_concurrency is not None
    if ledger:
        asked = _recorded_prompts(df, ledger)
        if rounds:
            for slots in _rounds(asked, ledger, partitions * ROUND_BYTES):
                asked.filter(F.col(SLOT).isin(slots)).select(prompt_col, SLOT, PLACE) \
                    .repartitionByRange(partitions, SLOT, PLACE).sortWithinPartitions(SLOT, PLACE) \
                    .mapInPandas(ask_only, "asked bigint").write.format("noop").mode("overwrite").save()
        elif partitions:
            asked = asked.repartition(partitions, SLOT).sortWithinPartitions(SLOT, PLACE)
    else:
        asked = df.repartition(partitions) if partitions else df
    return asked.mapInPandas(run, out_schema)


class _NeverRaised(Exception):
    """Placeholder so ``except transient`` matches nothing when none are given."""
