"""Importance resampling towards a target distribution, by hashed word n-grams.

A feature is a run of 1 to ``n`` consecutive words of one document, joined by one space; its
bucket is the crc32 of its UTF-8 bytes modulo ``buckets``.  A bucket's gain is the
logarithm, in thousandths rounded down, of how much likelier a target feature falls into
it than one of the documents (both smoothed by one).  A document's weight is the sum of
its features' gains; with Gumbel noise, drawn from a hash of its id, the highest weights
are a draw without replacement with probabilities in proportion to exp(weight / 1000).

* Batch concatenation.  The texts of an Arrow batch are joined with a separator that no word
  holds, and one regex pass over the joined bytes finds the words of all of them; where
  a word begins says, by a search in the documents' offsets, whose it is.  A run whose first
  and last word are of two documents is masked, the rest is counted with ``bincount``.
  Matches are taken from the pass in bounded chunks, so a very long text costs no more memory
  than its bytes.
* Counts.  A task adds up its batches in one array of ``buckets`` counts, which are all
  that is shuffled.  The ``buckets`` totals and gains (80 KB) go through the driver.
* Ranks.  (score, doc_id) of the documents long enough are numbered distributedly.

Cases: null, empty or wordless text: no features, weight 0, never drawn while ``min_words`` is
above 0; null doc_id: hashed as the empty text, last among ties; rows that repeat a
doc_id are documents each (equal noise); an empty table gives an empty result; an empty
target gives gains all the same (t = T = 0).  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.llm.common import Scratch, prepare, utf8
from answer_eval.sources.problems import number_samples

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text whose A-Z are lower-cased, on its UTF-8 bytes
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\n"
BUCKETS = 10000
CHUNK = 1 << 17         # matches held at once


def joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of a column in lower case with a separator after each, and where each begins."""
    raw, off = utf8(column)
    data = raw.tobytes()
    parts = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    # bytes.lower changes A-Z only
    return SEPARATOR.join(parts).lower(), off[:-1] + np.arange(len(parts))


def word_runs(data: bytes, starts: np.ndarray, n: int, buckets: int):
    """(documents of words, documents of runs, buckets of runs) of each chunk of matches; a run
    belongs to the chunk of its last word."""
    matches = WORD.finditer(data)
    words: list[bytes] = []
    docs = np.zeros(0, np.int64)
    while found := [(m.start(), m.group()) for m in islice(matches, CHUNK)]:
        held = len(words)
        words += [w for _, w in found]
        begin = np.fromiter((p for p, _ in found), np.int64, len(found))
        docs = np.concatenate([docs, np.searchsorted(starts, begin, "right") - 1])
        crc = [zlib.crc32(w) for w in words]
        owners, codes = [docs[held:]], [np.array(crc[held:], np.int64)]
        for k in range(1, n):
            # runs of k + 1 words that end in this chunk
            crc = [zlib.crc32(w, zlib.crc32(b" ", c)) for c, w in zip(crc, words[k:])]
            last = np.arange(k, len(words))
            one = (docs[k:] == docs[:len(docs) - k]) & (last >= held)
            owners.append(docs[k:][one])
            codes.append(np.array(crc, np.int64)[one])
        yield docs[held:], np.concatenate(owners), np.concatenate(codes) % buckets
        keep = max(0, len(words) - (n - 1))
        words, docs = words[keep:], docs[keep:]


def bucket_counts(spark: SparkSession, texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of the column ``text`` fall into each bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, codes in word_runs(*joined(b.column(0)), n, buckets):
                total += np.bincount(codes, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                                         names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():                      # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket, in thousandths rounded down."""
    big_s, big_t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + k) / ((s + 1) * (big_t + k))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int) -> int:
    """Gumbel noise of a document, in thousandths rounded down."""
    key = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(key).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, n: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            size = b.num_rows
            n_words, n_features, weight = (np.zeros(size, np.int64) for _ in range(3))
            for words, owners, codes in word_runs(*joined(b.column(1)), n, len(gain)):
                n_words += np.bincount(words, minlength=size)
                n_features += np.bincount(owners, minlength=size)
                # whole numbers far below 2**53, so the doubles are exact
                weight += np.bincount(owners, gain[codes], minlength=size).astype(np.int64)
            drawn = np.array([noise(x, seed) for x in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, (n_words, n_features, weight, weight + drawn))],
                names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = BUCKETS,
             min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_words, n_features, weight, score and rank:
    1, 2, 3, ... for the ``percent`` % (rounded down) with the highest scores among the documents of
    ``min_words`` words or more, ties to the smaller doc_id; null for the rest.  ``target`` has the
    column text."""
    prepare(spark)
    scratch = Scratch(spark, "resampling")
    c = F.col
    gain = gains(bucket_counts(spark, docs, n, buckets), bucket_counts(spark, target, n, buckets))
    scored = scratch.keep(weigh(docs, gain, n, seed), "scored")
    long_enough = c("n_words") >= min_words
    draw = percent * scored.where(long_enough).count() // 100
    ranked = number_samples(scored.where(long_enough), [-c("score"), c("doc_id").isNull(), "doc_id"], col_name="rank")
    ranked = ranked.withColumn("rank", F.when(c("rank") <= draw, c("rank")))
    return ranked.unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(spark: SparkSession, docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves, with the columns of docs, one row per drawn doc_id and row."""
    ids = resample(spark, docs, target, **options).where("rank is not null") \
        .select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_drawn_id"]), "left_semi")
