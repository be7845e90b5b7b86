"""Mixing sources to target weights (DataFrame functions only).

Sizes are words.  Sources in code point order, null last, weigh 5, 2, 1, repeating,
and share the words of the whole table by weight; no target exceeds ``max_epochs``
times its source's size, and the excess is reshared by weight among the others.

* Blocks.  The documents of a source lie one after the other in its word stream,
  which is cut into blocks of ``block`` words (the last may be shorter).  Where a
  document begins comes from a running sum within small chunks of a source and the
  sums of the chunks before, so a hot source is never one group.
* Slots.  A source with target t has slots for round(t) words: whole epochs over all
  of its blocks, then an epoch that stops at the last word due.  Every slot draws its
  output shard, so that the source counts of a shard are a multinomial draw given
  the totals (``mix_shards``); a document's first shard is in the report.
* Permutation.  Slot k of an epoch holds the block that a swap-or-not shuffle maps k to: in each of
  ``ROUNDS`` rounds, drawn by source and epoch, a block number x and its partner (key - x) mod n
  change places or not, as a hash of the larger one says.  Every round swaps pairs, so this
  is a permutation for any n, and its rounds backwards give the slot of the short last block.
* Join.  Slots meet the documents' pieces by (source, block); a document's taken words
  are the sum over its pieces.

All draws are hashes of (seed, source, epoch, slot), so reruns agree.

Cases: null or wordless text: size 0, nothing taken; null source: a source of its own;
null doc_id: a document like others; rows that repeat a doc_id are each a
document; sources without words have target 0; an empty table gives an empty result.
Sources go through one task as one row each, to be ranked and water-filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answer_eval.llm.common import WORD, Scratch, columns, prepare, same

WEIGHTS = (5, 2, 1)
ROUNDS = 40
CHUNK_DOCS = 2000       # documents of a source summed together
RANGE = 16384           # slots generated from one row


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, sid, source_size, n_docs, target) from rows of (source, size)."""
    c = F.col
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(c("source").asc_nulls_last())) - 1
    s = s.withColumn("sid", rank).withColumn(
        "w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sid", F.lit(len(weights)))))
    # in the order of size / weight: a source is capped if its share of what is left, by weight, exceeds its cap
    cap = max_epochs * c("source_size")
    up = W.orderBy(c("source_size") / c("w"), "sid")
    before, after = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("all", F.sum("source_size").over(whole)) \
        .withColumn("left", c("all") - F.coalesce(F.sum(cap).over(before), F.lit(0))) \
        .withColumn("capped", c("left") * c("w") > cap * F.sum("w").over(after))
    free_words = c("all") - F.coalesce(F.sum(F.when(c("capped"), cap)).over(whole), F.lit(0))
    free_weight = F.sum(F.when(~c("capped"), c("w"))).over(whole)
    target = F.when(c("capped"), cap.cast("double")).otherwise(free_words * c("w") / free_weight)
    return s.withColumn("target", target).select("source", "sid", "source_size", "n_docs", "target")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.xxhash64("text").alias("tag"), n_words(F.col("text")).alias("size"))


def layout(sized: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """sized with its source's columns and ``start``, the document's first word in its source's
    stream; (sid, chunk, row) names the row."""
    c = F.col
    src = sources.withColumnRenamed("source", "name")
    d = sized.join(src, same((sized["source"], c("name")))).drop("name") \
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tag"), F.ceil(c("n_docs") / CHUNK_DOCS)))
    own = W.partitionBy("sid", "chunk").orderBy("doc_id", "tag")
    d = d.withColumn("row", F.row_number().over(own)) \
        .withColumn("inside", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - c("size"))
    sums = d.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.sum("words").over(
        W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - c("words")).drop("words")
    return d.join(sums, ["sid", "chunk"]).withColumn("start", c("base") + c("inside")).drop("base", "inside")


def shuffled(x: Column, n: Column, *seed: Column, back: bool = False) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n - 1 (``back``: of its inverse)."""
    def swap(at, r):
        partner = F.pmod(F.pmod(F.xxhash64(*seed, r), n) - at, n)
        return F.when(F.xxhash64(F.greatest(at, partner), *seed, r) % 2 == 0, partner).otherwise(at)

    rounds = F.array(*[F.lit(r) for r in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    return F.aggregate(rounds, x.cast("long"), swap)


def slots(sources: DataFrame, block: int, seed: int, shard_slots: int, partitions: int) -> DataFrame:
    """(sid, epoch, slot, shard, block, words): one row per slot; ``words`` is how many words of
    its block it takes."""
    c = F.col
    n = F.ceil(c("source_size") / block)
    quota = F.round("target").cast("long")
    s = sources.where("source_size > 0").select(
        "sid", "source_size", n.alias("n"), F.expr("CAST(round(target) AS BIGINT) div source_size").alias("full"),
        F.pmod(quota, c("source_size")).alias("rest"))
    draw = [F.lit(seed), c("sid")]
    # the last epoch: one slot more may be due, where the short block is among those before
    s = s.withColumn("k", c("full") * c("n") + F.least(c("n"), F.when(c("rest") > 0, F.ceil(c("rest") / block) + 1)
                                                       .otherwise(0))) \
        .withColumn("shards", F.ceil(F.sum("k").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
                                     / shard_slots)) \
        .withColumn("short_slot", shuffled(c("n") - 1, c("n"), *draw, c("full"), back=True)) \
        .withColumn("lacking", c("n") * block - c("source_size"))
    ranges = s.where("k > 0").withColumn("r", F.explode(F.sequence(F.lit(0), F.ceil(c("k") / RANGE) - 1)))
    every = ranges.repartition(partitions, "sid", "r").withColumn(
        "slot", F.explode(F.sequence(c("r") * RANGE, F.least((c("r") + 1) * RANGE, c("k")) - 1)))
    e = every.withColumn("epoch", F.expr("slot div n")).withColumn("t", F.pmod("slot", "n")) \
        .withColumn("block", shuffled(c("t"), c("n"), *draw, c("epoch")))
    length = F.lit(block) - F.when(c("block") == c("n") - 1, c("lacking")).otherwise(0)
    before = c("t") * block - F.when(c("t") > c("short_slot"), c("lacking")).otherwise(0)
    due = F.when(c("epoch") < c("full"), length).otherwise(F.least(length, c("rest") - before))
    return e.select("sid", "epoch", "slot",
                    F.pmod(F.xxhash64(F.lit(seed + 1), "sid", "slot"), c("shards")).alias("shard"),
                    c("block").cast("long").alias("block"), due.cast("long").alias("words")).where("words > 0")


def pieces(laid: DataFrame, block: int) -> DataFrame:
    """A row per block that a document with words reaches into: its words [lo, hi) of the source."""
    c = F.col
    last = c("start") + c("size")
    blocks = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    return laid.where("size > 0").withColumn("block", F.explode(blocks)) \
        .withColumn("lo", F.greatest("start", c("block") * block)) \
        .withColumn("hi", F.least(last, (c("block") + 1) * block))


def _plan(spark: SparkSession, docs: DataFrame, scratch: Scratch, block: int, seed: int, shard_slots: int,
          weights, max_epochs: int) -> tuple[DataFrame, DataFrame]:
    """The laid out documents, and the taken word ranges (keys, epoch, shard, lo, hi)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = scratch.keep(_sized(docs), "sized")
    sources = scratch.keep(source_targets(sized, weights, max_epochs), "sources")
    laid = scratch.keep(layout(sized, sources, block), "laid")
    scratch.drop("sized")
    c = F.col
    p = pieces(laid, block).select("sid", "chunk", "row", "start", "block", "lo", "hi")
    s = slots(sources, block, seed, shard_slots, parts)
    # slots come from a few rows, which no size estimate shows: never broadcast them
    taken = p.join(s.hint("merge"), ["sid", "block"]) \
        .withColumn("hi", F.least("hi", c("block") * block + c("words"))).where("hi > lo") \
        .select("sid", "chunk", "row", "epoch", "shard", (c("lo") - c("start")).alias("lo"),
                (c("hi") - c("start")).alias("hi"))
    return laid, taken


def mix_report(spark: SparkSession, docs: DataFrame, block: int = 64, seed: int = 0, shard_slots: int = 4096,
               weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source_size, target (its
    source's) and taken, in words, and first_shard, the least output shard that gets words of it (null:
    none)."""
    prepare(spark)
    scratch = Scratch(spark, "mixing")
    laid, taken = _plan(spark, docs, scratch, block, seed, shard_slots, weights, max_epochs)
    keys = ["sid", "chunk", "row"]
    sums = taken.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("shard").alias("first_shard"))
    return laid.join(sums, keys, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "first_shard")


def mix_shards(spark: SparkSession, docs: DataFrame, block: int = 64, seed: int = 0, shard_slots: int = 4096,
               weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """What each output shard holds of each source: (shard, source, slots, words)."""
    prepare(spark)
    scratch = Scratch(spark, "mixing")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sources = scratch.keep(source_targets(_sized(docs), weights, max_epochs), "sources")
    drawn = slots(sources, block, seed, shard_slots, parts).groupBy("shard", "sid") \
        .agg(F.count("*").alias("slots"), F.sum("words").alias("words"))
    return drawn.join(sources.select("sid", "source"), "sid").select("shard", "source", "slots", "words")


def mix_documents(spark: SparkSession, docs: DataFrame, block: int = 64, seed: int = 0, shard_slots: int = 4096,
                  weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """The mixed documents, with the columns of docs: a row per document and epoch that takes
    words of it; a document taken whole keeps its text, else its taken words are
    joined by spaces.  Rows equal in doc_id and text share one row's other columns."""
    prepare(spark)
    scratch = Scratch(spark, "mixing")
    c = F.col
    laid, taken = _plan(spark, docs, scratch, block, seed, shard_slots, weights, max_epochs)
    keys = ["sid", "chunk", "row"]
    ranges = taken.groupBy(*keys, "epoch").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"), F.sum(c("hi") - c("lo")).alias("taken"))
    due = laid.select(*keys, c("doc_id").alias("k"), "tag", c("source").alias("src"), "size").join(ranges, keys) \
        .select("k", "tag", "src", F.when(c("taken") < c("size"), c("ranges")).alias("ranges"))
    row = docs.select(F.struct(*columns(docs)).alias("row"), docs["doc_id"].alias("id"),
                      F.xxhash64(docs["text"]).alias("t")).groupBy("id", "t").agg(F.first("row").alias("row"))
    words = F.regexp_extract_all(c("row.text"), F.lit(WORD), F.lit(0))
    # a lambda's argument is worked out once, so a text is split once for all of its ranges
    part = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        "ranges", lambda r: F.slice(w, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), " "))[0]
    both = due.join(row, same((c("k"), c("id")), (c("tag"), c("t"))))
    text = F.when(c("ranges").isNull(), c("row.text")).otherwise(part)
    new = {"text": text, "source": c("src")}
    return both.select(*[new.get(x, c("row").getField(x)).alias(x) for x in docs.columns])
