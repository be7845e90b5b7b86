"""Document fingerprints: quartile bucket digests.

The bytes of a text, with one sentinel byte before and after, give triplets
(b0 b1 b2, b0 b1 b3, b0 b2 b3 of every four bytes), counted in ``BUCKETS`` hashed
buckets.  The digest is one hex byte for the length (logarithmic) and two bits per
bucket: which quartile of the counts it lies in.  The difference of two digests is
the sum of the quartile steps plus the length steps, bounded by what unrelated
counts give on average; likeness is one minus its share of that bound.

Equal texts have equal digests.  Cases: null text: as empty; empty text: a digest
of its own (length byte 00); any length is counted in blocks; in ``with_next`` a
null doc_id comes last, rows that repeat a doc_id are ordered by their texts' hashes, the
row after the last is the first (a single row follows itself), an empty table
gives an empty result and other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType, StructType

from answer_eval.llm.common import Scratch, prepare

BUCKETS = 256
BLOCK = 1 << 20
LENGTH_BOUND = 32                       # steps of a length difference that count
BOUND = BUCKETS * 1.25                  # mean difference of independent quartile codes
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def bucket_counts(data: bytes) -> np.ndarray:
    x = np.frombuffer(b"\x02" + data + b"\x03", np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(x), BLOCK):
        y = x[lo:lo + BLOCK + 3].astype(np.uint32)
        for (i, j, k), factor in zip(_TRIPLETS, _FACTORS):
            n = min(BLOCK, len(y) - k)
            if n > 0:
                v = (y[i:i + n] << np.uint32(16)) | (y[j:j + n] << np.uint32(8)) | y[k:k + n]
                out += np.bincount((v * np.uint32(factor)) >> np.uint32(24), minlength=BUCKETS)
    return out


def digest(data: bytes) -> bytes:
    counts = bucket_counts(data)
    s = np.sort(counts)
    code = sum((counts > s[BUCKETS * q // 4 - 1]).astype(np.uint8) for q in (1, 2, 3))
    four = code.reshape(-1, 4)
    packed = (four[:, 0] << 6) | (four[:, 1] << 4) | (four[:, 2] << 2) | four[:, 3]
    size = min(255, round(math.log(len(data) + 1) / math.log(1.1)))
    return bytes([size]) + packed.astype(np.uint8).tobytes()


def _quartiles(d: bytes) -> np.ndarray:
    p = np.frombuffer(d, np.uint8)[1:]
    return np.stack([p >> 6, (p >> 4) & 3, (p >> 2) & 3, p & 3]).astype(np.int16)


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 at or beyond the bound."""
    steps = int(np.abs(_quartiles(a) - _quartiles(b)).sum()) + min(LENGTH_BOUND, abs(a[0] - b[0]))
    return 1.0 - min(steps, BOUND) / BOUND


@F.pandas_udf(StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """The hex digest of a string column (null: as empty)."""
    return pd.Series([digest((t or "").encode("utf-8", "surrogatepass")).hex() for t in texts], dtype=object)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two hex digests (null if either is null)."""
    return pd.Series([None if x is None or y is None else likeness(bytes.fromhex(x), bytes.fromhex(y))
                      for x, y in zip(a, b)], dtype="float64")


def with_next(spark: SparkSession, docs: DataFrame, fn, schema: str) -> DataFrame:
    """Applies ``fn(id, text, next text) -> tuple`` to every row, rows being ordered by doc_id
    descending.

    Range bounds come from the ids alone (one per partition); texts are shuffled
    once, each to the partition of its range, and the first row of a range also goes to
    the range before it, whose last row it follows."""
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = F.col
    d = docs.select("doc_id", "text").withColumn("t", F.xxhash64("text"))
    bounds = Scratch(spark, "ranges").keep(
        docs.select("doc_id").where("doc_id is not null").repartitionByRange(parts, c("doc_id").desc())
        .groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("top")), "bounds")
    tops = sorted({r["top"] for r in bounds.collect()})       # at most ``parts`` values, ascending
    least_null = d.where("doc_id is null").agg(F.min("t")).first()[0]
    last = len(tops) - (least_null is None)                   # null ids: a range of their own, the last

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        """Twice the range, plus one for a range's top id; range r holds ids up to the r-th
        largest top and above the next."""
        out = []
        for x in ids.to_pylist():
            i = -1 if x is None else bisect.bisect_left(tops, x)
            out.append(2 * (len(tops) - 1 - i) + (i >= 0 and tops[i] == x))
        return pa.array(out, pa.int32())

    d = d.withColumn("p", place("doc_id")).withColumn("r", F.expr("p div 2").cast("int")) \
        .withColumn("head", F.when(c("doc_id").isNull(), c("t") == F.lit(least_null)).otherwise(c("p") % 2 == 1))
    before = F.when(c("r") == 0, F.lit(last)).otherwise(c("r") - 1)
    d = d.withColumn("copy", F.explode(F.when(c("head"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))) \
        .withColumn("r", F.when(c("copy") == 1, before).otherwise(c("r"))) \
        .repartitionById(parts + 1, c("r")) \
        .sortWithinPartitions("r", "copy", c("doc_id").desc_nulls_last(), "t", "text") \
        .select("r", "copy", "doc_id", "text")
    fields = StructType.fromDDL(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        held, at = None, None                                 # the row that waits for its follower, its range
        for b in batches:
            rs, copies, ids, texts = (b.column(i).to_pylist() for i in range(4))
            out = []
            for r, copy, doc_id, text in zip(rs, copies, ids, texts):
                if held is not None and at == r:
                    out.append(fn(*held, text))
                held, at = (None if copy else (doc_id, text)), r
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, a) for v, a in zip(zip(*out), kinds)], names=names)

    return d.mapInArrow(run, schema)


def fingerprint_edits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third of its code points
    (rounded down) replaced by the first as many of the next document's, or all if that is
    shorter.  Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    memo: list = [None, b""]                                  # the last following text and its digest

    def compare(doc_id, text, following):
        known = memo[1] if text is not None and text is memo[0] else None
        memo[0], text, following = following, text or "", following or ""
        cut = len(text) // 3
        edited = (text[:len(text) - cut] + following[:cut]).encode("utf-8", "surrogatepass")
        own, other = known or digest(text.encode("utf-8", "surrogatepass")), digest(edited)
        near = memo[1] = digest(following.encode("utf-8", "surrogatepass"))
        return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), other.hex(),
                likeness(own, other), likeness(own, near))

    return with_next(spark, docs, compare,
                     f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                     "edited_fingerprint string, near_edited double, near_next double")
