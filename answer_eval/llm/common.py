"""What the operators of this subpackage share: session settings, intermediate
tables in the shared folder, keys of repeated rows, words as byte spans."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.session import configure, ensure_checkpoint_dir

# [\x20\x09-\x0D], the separators of a word
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = "[^\\x20\\x09-\\x0D]+"

# Arrow batches are bounded in bytes as well as rows, so that a batch of very
# long texts stays small in a Python worker; the shuffle files of a finished job
# go when its result is written.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """The session settings the operators rely on (idempotent)."""
    configure(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:       # a user's own setting stays
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


class Scratch:
    """Intermediate tables of one operator call, under ``spark.checkpoint.dir``.

    ``keep`` writes a DataFrame there and reads it back: lineage ends, a lost
    executor costs only the tasks that were running, and the shuffle files of the
    finished job are freed.  ``drop`` deletes one table of this call that no
    later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = ensure_checkpoint_dir(spark).rstrip("/")
        self.root = f"{base}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        schema = df.schema
        df.write.parquet(self.path(table))
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def same(*pairs) -> F.Column:
    """Null-safe equality of several column pairs."""
    cond = None
    for a, b in pairs:
        part = a.eqNullSafe(b)
        cond = part if cond is None else cond & part
    return cond


def columns(df: DataFrame) -> list[F.Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + x.replace("`", "``") + "`") for x in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of df clashes with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column (null: empty), without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[off[0]:off[-1]]
    return raw, off - off[0]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word, in order; a word ends with its document."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    tok = ~IS_SPACE[raw]
    first = tok.copy()
    first[1:] &= ~tok[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = tok[heads]
    last = tok.copy()
    last[:-1] &= ~tok[1:]
    tails = heads[1:] - 1
    last[tails] = tok[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


class WordHash:
    """64-bit hashes of byte spans: a polynomial over table-mapped bytes mod 2**64,
    from prefix sums, then mixed.  ``seed`` picks the table and the base."""

    STEP = 1 << 20

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 61, dtype=np.uint64)) * 8 + 5
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self._powers(self.base, self.STEP)
        self.down = self._powers(self.inv, self.STEP)

    @staticmethod
    def _powers(b: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(b, len(out), 1 << 64))])
        return out[:n]

    def __call__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            lo = start[i]
            j = max(i + 1, int(np.searchsorted(end, lo + self.STEP, "right")))
            n = int(end[j - 1] - lo)
            up, down = self.up, self.down
            if n > len(up):  # one word longer than the step
                up, down = self._powers(self.base, n), self._powers(self.inv, n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.table[raw[lo:lo + n]] * up[:n], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
