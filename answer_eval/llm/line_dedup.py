"""Line dedup by overlapping three-line windows (DataFrame functions only).

A text's lines are what newlines separate; a window is ``width`` consecutive lines,
hashed.  A window repeats if an equal one starts earlier: in a document with a
smaller id, or higher up in the same document.  Every repeat covers its lines;
covered positions merge to ranges, which go, and the lines outside them stay, joined
by newlines again.  Windows are judged on the input, not on what is left.

Windows that occur once are dropped after a pre-aggregated count, so the join back
carries repeats only; a frequent window's rows can be split there.

Cases: null text stays null (0 lines); fewer than ``width`` lines: unchanged; a text
whose lines all go becomes empty; null doc_id sorts before all others; rows that
repeat a doc_id come in the order of their texts' hashes, and rows equal in both
are one document; an empty table gives an empty result; other columns pass through
untouched, whatever their names.  Lines are compared by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answer_eval.llm.common import Scratch, columns, free_name, prepare, same


def covered_ranges(spark: SparkSession, docs: DataFrame, width: int = 3) -> DataFrame:
    """(id, tag, ranges): per document with repeats, the merged ranges of covered lines as
    array<struct<lo, hi>> (from 0, hi exclusive), in order.  ``tag`` is the text's hash."""
    c = F.col
    scratch = Scratch(spark, "line-dedup")
    lines = docs.where("text is not null") \
        .select(c("doc_id").alias("id"), F.xxhash64("text").alias("tag"), F.split("text", "\n", -1).alias("l")) \
        .where(F.size("l") >= width)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("l") - width),
        lambda i: F.struct(i.alias("at"),
                           F.xxhash64(*[F.get("l", i + k) for k in range(width)]).alias("h"),
                           F.xxhash64(F.lit(1), *[F.get("l", i + k) for k in range(width)]).alias("g")))
    every = lines.select("id", "tag", F.inline(windows))
    first = every.groupBy("h", "g").agg(F.min(F.struct("id", "tag", "at")).alias("f"), F.count("*").alias("n")) \
        .where("n > 1").select("h", "g", "f")
    first = scratch.keep(first, "first")
    later = every.join(first, ["h", "g"]).where(
        ~same((c("id"), c("f.id")), (c("tag"), c("f.tag")), (c("at"), c("f.at")))).select("id", "tag", "at").distinct()
    # merge what the repeats cover: a range begins where the last one ended before it
    by = W.partitionBy("id", "tag").orderBy("at")
    runs = later.withColumn("new", (c("at") > F.lag("at", 1, -width - 1).over(by) + width).cast("int")) \
        .withColumn("run", F.sum("new").over(by)) \
        .groupBy("id", "tag", "run").agg(F.min("at").alias("lo"), (F.max("at") + width).alias("hi"))
    return runs.groupBy("id", "tag").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def line_dedup(spark: SparkSession, docs: DataFrame, width: int = 3) -> DataFrame:
    """docs with ``text`` reduced to its kept lines, and n_lines, n_removed (underscores in
    front of these if docs has such columns)."""
    if width < 1:
        raise ValueError("width must be positive")
    prepare(spark)
    c = F.col
    ranges = covered_ranges(spark, docs, width)
    hit = "ranges"
    d = docs.select(F.struct(*columns(docs)).alias("row"), docs["doc_id"].alias("k"), F.xxhash64(docs["text"]).alias("t"))
    d = d.join(ranges, same((c("k"), c("id")), (c("t"), c("tag"))), "left") \
        .withColumn("l", F.split("row.text", "\n", -1))
    kept = F.transform(
        F.sequence(F.lit(0), F.size(hit)),
        lambda i: F.struct(F.when(i == 0, 0).otherwise(F.get(hit, i - 1)["hi"]).alias("lo"),
                           F.coalesce(F.get(hit, i)["lo"], F.size("l")).alias("hi")))
    left = F.flatten(F.transform(kept, lambda r: F.slice("l", r["lo"] + 1, r["hi"] - r["lo"])))
    text = F.when(c(hit).isNull(), c("row.text")).otherwise(F.array_join(left, "\n"))
    gone = F.coalesce(F.aggregate(hit, F.lit(0), lambda n, r: n + r["hi"] - r["lo"]), F.lit(0))
    out = [(text if x == "text" else c("row").getField(x)).alias(x) for x in docs.columns]
    size = F.when(c("row.text").isNull(), 0).otherwise(F.size("l"))
    return d.select(*out, size.cast("long").alias(free_name(docs, "n_lines")), gone.cast("long").alias(free_name(docs, "n_removed")))
