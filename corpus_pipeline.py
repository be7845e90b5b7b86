"""The corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its input is what the
stage before it kept, written and read again.  All but the last return the columns of
documents, with n_chars brought up to date where a text changes.

1. quality: documents that the rule ensemble, learnt from labels, rejects go.
2. line_dedup: lines covered by a three-line window that starts earlier go.
3. near_dedup: of rows linked by five-word shingle sets of a similarity of 0.8 or more, one of
   each group stays: the one with the least doc_id (null last; of equal ids any one).
4. mixing: sources are mixed to their target weights; a document comes once per epoch
   that takes words of it, with the words taken.
5. packing: the mixed documents in sequences of 2048 tokens, a row per piece.

Every row is a document of its own in near_dedup, whatever its doc_id: equal texts leave one row
also where their ids are null or repeat.  Texts without words are copies of nothing and stay.
An empty table gives an empty result; further columns of documents pass through all stages but the
last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.llm.common import Scratch, free_name, prepare
from answer_eval.llm.line_dedup import line_dedup
from answer_eval.llm.minhash_dedup import minhash_dedup
from answer_eval.llm.mixing import mix_documents
from answer_eval.llm.packing import best_fit_packing
from answer_eval.llm.quality import keep_good


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, n_chars counted anew if it is one of them."""
    out = docs.select(*columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup(spark, docs, width=3), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = free_name(docs, "row_key")
    keyed = Scratch(spark, "near-dedup").keep(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = minhash_dedup(spark, keyed.select(F.col(key).alias("doc_id"), "text"), num=80, den=100, shingle=5) \
        .select(F.col("doc_id").alias("row"), "component_id")
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
    kept = found.join(ids, "row").groupBy("component_id") \
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select(F.col("first.row").alias("kept_key"))
    return keyed.join(kept, keyed[key] == kept["kept_key"], "left_semi").drop(key)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mix_documents(spark, docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark, docs, capacity=2048)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Trees, hashed signatures and token ids are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each kept in the shared folder."""
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])      # read for the last time
    return docs
