"""Best-fit packing of documents into sequences of ``capacity`` tokens.

A document's tokens are its ids and a closing id 0.  Documents longer than the
capacity are cut into pieces of that length and a rest.  Bulk-synchronous best-fit,
longest pieces first:

1. Pieces are range-sorted by length (then id, piece) and kept; a piece's global
   rank is the count before its range plus its place in it.
2. Lengths are integers of at most ``capacity``, so all pieces of one length are one
   run of ranks, and gaps of one size are runs of sequences.  A superstep takes the
   next length: the sweep gives its pieces to the successor gaps (the least size that
   holds them), the k-th piece in rank to the k-th sequence of the run, opens new
   sequences when no gap is left, updates the gaps and repeats.
3. The runs of placements - (length, ranks) to (sequences, offset) - go back to all
   tasks, and every piece looks its place up by rank.

What the driver holds is the histogram of lengths (at most ``capacity`` rows), one
count per range, and the runs: each placement uses up a gap run or a length, and
live gap runs are merged by size, so their number depends on ``capacity`` and not
on the corpus.  A sequence is addressed as (run, index), so it is never listed.

Cases: null text: as empty, one piece of length 1 (id 0); null doc_id: packed like
any other; rows that repeat a doc_id are packed each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.llm.common import IS_SPACE, Scratch, WordHash, prepare, utf8

CACHE = 2_000_000      # distinct units a task remembers

# Bytes at whose meeting a word is cut further: an ASCII letter beside ASCII punctuation.
# Not the apostrophe (it binds "'s") and not the signs of the special tokens.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[x for x in b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = 2


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BAR = re.compile(rb"<\|")


def unit_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every unit: maximal runs without white space, cut between documents and
    where an ASCII letter meets ASCII punctuation."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tok = ~IS_SPACE[raw]
    kind = _KIND[raw]
    edge = np.ones(len(raw) + 1, bool)            # a unit may not reach across position i
    edge[1:-1] = (tok[1:] != tok[:-1]) | (kind[1:] + kind[:-1] == 3) & (kind[1:] != kind[:-1]) & (kind[1:] * kind[:-1] > 0)
    edge[off] = True
    return np.flatnonzero(edge[:-1] & tok), np.flatnonzero(edge[1:] & tok) + 1


class UnitTokenizer:
    """Token ids of whole texts, unit by unit.

    The normaliser lower-cases, and the pre-tokenizer crosses neither ASCII white space nor the meeting of an
    ASCII letter with ASCII punctuation; the normaliser works within those bounds, so
    a unit's ids do not depend on its neighbours.  Units are told apart by 64-bit
    hashes; each distinct one is tokenised once (while at most ``CACHE`` are known)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.hash = WordHash(3)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)       # sorted
        self.first = np.zeros(0, np.int64)        # where a known unit's ids begin
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes, raw, start, end) -> None:
        buf = raw.tobytes()
        units = [buf[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]
        lists = []
        for lo in range(0, len(units), 20_000):
            lists += [e.ids for e in self.tokenizer.encode_batch_fast(units[lo:lo + 20_000],
                                                                      add_special_tokens=False)]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        first = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(lists), np.uint32)])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and where each text's begin (one more at the end)."""
        raw, off = utf8(column)
        if not _BAR.search(raw):                  # no sign of a special token: case does not matter
            raw = _LOWER[raw]
        start, end = unit_spans(raw, off)
        of, unit = pd.factorize(self.hash(raw, start, end))
        at = np.empty(len(unit), np.int64)
        at[of[::-1]] = np.arange(len(of) - 1, -1, -1)
        if len(self.known) + len(unit) > CACHE:
            self._forget()
        place = np.searchsorted(self.known, unit)
        new = np.ones(len(unit), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != unit
        if new.any():
            self._learn(unit[new], raw, start[at[new]], end[at[new]])
            place = np.searchsorted(self.known, unit)
        first, count = self.first[place][of], self.count[place][of]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, off)]
        return ids, bounds


def _pieces(path: str, capacity: int):
    def rows(batches):
        tok = UnitTokenizer(path)
        for b in batches:
            ids, bounds = tok(b.column(1))
            # every document's ids and its closing 0
            ids = np.insert(ids, bounds[1:], 0).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            n = -(-np.diff(bounds) // capacity)
            owner = np.repeat(np.arange(b.num_rows), n)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(bounds)[owner] - start)
            lo = bounds[owner] + start
            raw = ids.tobytes()
            crc = [zlib.crc32(memoryview(raw)[4 * i:4 * j]) for i, j in zip(lo.tolist(), (lo + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return rows


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placement runs (length, first rank, pieces, first sequence, offset), ranks counted per
    length: piece first+k goes to sequence first+k at that offset.

    Gaps are runs of consecutive sequences with one gap size."""
    gaps: dict[int, list[tuple[int, int]]] = {}     # size -> [(first sequence, sequences)]
    sizes: list[int] = []                           # the sizes present, ascending
    out, opened = [], 0

    def add(size: int, first: int, n: int) -> None:
        if size <= 0:
            return
        if size not in gaps:
            gaps[size] = []
            bisect.insort(sizes, size)
        gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):     # one superstep per length
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)  # the successor gap
            if at == len(sizes):
                n = -(-left // (capacity // length))
                add(capacity, opened, n)
                opened += n
                continue
            size = sizes[at]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[at]
            use = min(n, left)
            out.append((length, rank, use, first, capacity - size))
            add(size - length, first, use)
            if use < n:
                add(size, first + use, n - use)
            rank += use
            left -= use
    return out


def _place(runs: list[tuple[int, int, int, int, int]], before: dict[int, int], less: dict[int, int]):
    """Looks every piece up: its global rank, then its rank within the length, then its run."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    lengths, rows = np.unique(table[:, 0], return_index=True)

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            part, at, length = (b.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 3))
            base = np.array([before[p] for p in part.tolist()], np.int64)
            rank = base + at - np.array([less[n] for n in length.tolist()], np.int64)
            row = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                lo = rows[np.searchsorted(lengths, n)]
                hi = np.searchsorted(table[:, 0], n, "right")
                row[own] = lo + np.searchsorted(table[lo:hi, 1], rank[own], "right") - 1
            seq = table[row, 3] + rank - table[row, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seq), pa.array(table[row, 4])],
                names=[*b.schema.names[:5], "sequence_id", "offset"])
    return place


def best_fit_packing(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None,
                     capacity: int = 2048) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    prepare(spark)
    if tokenizer_path is None:
        import public_tokenizers
        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = scratch.keep(docs.select("doc_id", "text").mapInArrow(_pieces(str(tokenizer_path), capacity), schema),
                          "pieces")
    place = F.monotonically_increasing_id()
    ranked = scratch.keep(
        pieces.repartitionByRange(parts, F.col("length").desc(), "doc_id", "piece", "ids_crc32")
        .sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "ids_crc32")
        .withColumn("at", place).withColumn("part", F.shiftright("at", 33).cast("int"))
        .withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), "ranked") \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "part", "at")
    scratch.drop("pieces")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sizes = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    less, total = {}, 0
    for n in sorted(counts, reverse=True):
        less[n] = total
        total += counts[n]
    return ranked.mapInArrow(_place(best_fit(counts, capacity), before, less),
                             schema + ", sequence_id long, offset long")
