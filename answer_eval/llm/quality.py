"""Quality classifier: a sparse rule ensemble.

1. Statistics of a text, as Spark column expressions (``statistics``).
2. A forest of shallow trees is fitted on labelled rows; every path from a root to a
   node is a conjunctive rule over the statistics, bounds on one statistic merged.
3. A logistic model with an L1 penalty weighs the rules; most weights become zero.
4. The rules that are left are compiled into one Spark column expression: the score is
   the logistic function of the intercept and the weights of the rules that hold.

The model sees statistics of the text only.  It is fitted on the labelled rows whose
crc32(doc_id as text) mod 4 is not 2, or, where those are more than ``max_rows``, on
about that many of them drawn by the hash of doc_id (so the sample is bounded and
may be broadcast to fetch its texts).

Cases: null text: as empty, and empty texts have a score like others; null or
conflicting labels, null doc_id: not learnt from (a null doc_id is not held out); no
labels to learn from: every score is 0.5, and ``keep_good`` keeps every row; labels of one class: every score is their share; rows
that repeat a doc_id are scored each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.llm.common import WORD, Scratch, prepare

HELD_OUT = 2                 # the remainder mod 4 that is never learnt from
MAX_ROWS = 20_000
STATISTICS = ("chars", "words", "word_length", "upper", "digits", "marks", "signs", "distinct_words",
              "vocabulary", "lines", "distinct_lines", "words_per_line", "signed_words", "longest_word")


def statistics(text: Column) -> Column:
    """array<double> of STATISTICS, in that order."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.split(t, "\n", -1)

    def share(pattern: str) -> Column:
        return (n - F.char_length(F.regexp_replace(t, pattern, ""))) / F.greatest(n, F.lit(1))

    w = F.greatest(F.size(words), F.lit(1))
    distinct = F.size(F.array_distinct(words))
    solid = F.char_length(F.regexp_replace(t, "[\\x20\\x09-\\x0D]+", ""))
    values = [
        n, F.size(words), solid / w, share("\\p{Lu}+"), share("[0-9]+"), share("[.,;:]+"),
        share("[^\\p{L}\\p{N}\\s.,;:]+"), distinct / w, F.log1p(distinct) / F.log1p(w), F.size(lines),
        F.size(F.array_distinct(lines)) / F.size(lines), F.size(words) / F.size(lines),
        F.size(F.filter(words, lambda x: F.rlike(x, F.lit("[^\\p{L}\\p{N}.,;:]")))) / w,
        F.coalesce(F.array_max(F.transform(words, F.char_length)), F.lit(0)),
    ]
    return F.array(*[v.cast("double") for v in values])


@dataclass(frozen=True)
class Rule:
    """low < statistic <= high for every (index, low, high)."""

    bounds: tuple[tuple[int, float, float], ...]

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for i, low, high in self.bounds:
            x = F.get(stats, F.lit(i))
            if low > -math.inf:
                out = out & (x > low)
            if high < math.inf:
                out = out & (x <= high)
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    learnt: bool = True          # False: there were no rows to learn from

    def score(self, stats: Column) -> Column:
        """The compiled score, between 0 and 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def text(self) -> list[str]:
        return [" and ".join(f"{low:g} < {STATISTICS[i]} <= {high:g}" for i, low, high in r.bounds) + f": {w:+.4f}"
                for r, w in self.rules]


def tree_rules(node, bounds: dict | None = None) -> list[Rule]:
    """The rules of all nodes below a Spark ML tree's node."""
    bounds = bounds or {}
    if node.getClass().getSimpleName() != "InternalNode":
        return []
    split = node.split()
    i, t = split.featureIndex(), split.threshold()
    low, high = bounds.get(i, (-math.inf, math.inf))
    out = []
    for child, b in ((node.leftChild(), (low, min(high, t))), (node.rightChild(), (max(low, t), high))):
        path = bounds | {i: b}
        out.append(Rule(tuple((k, *path[k]) for k in sorted(path))))
        out += tree_rules(child, path)
    return out


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(stats, label) of at most about ``max_rows`` rows to learn from."""
    c = F.col
    known = labels.where("doc_id is not null and quality is not null").where(remainder(c("doc_id")) != HELD_OUT) \
        .groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi") \
        .select("doc_id", c("lo").cast("double").alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id") \
        .select(statistics(c("text")).alias("stats"), "label")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, trees: int = 20,
        depth: int = 3, penalty: float = 0.0001, seed: int = 7) -> RuleModel:
    """Fits the ensemble on docs (doc_id, text) and labels (doc_id, quality 0 or 1)."""
    prepare(spark)
    sample = Scratch(spark, "quality").keep(labelled(docs, labels, max_rows), "sample")
    seen = sample.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    if not seen["n"]:
        return RuleModel(0.0, (), learnt=False)
    if seen["p"] in (0.0, 1.0):
        return RuleModel(40.0 if seen["p"] else -40.0, ())
    rows = sample.coalesce(8).select(array_to_vector("stats").alias("features"), "stats", "label").cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5",
                                    minInstancesPerNode=5, seed=seed).fit(rows)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree._call_java("rootNode"))))
    if not rules:
        rows.unpersist()
        return RuleModel(math.log(seen["p"] / (1 - seen["p"])), ())
    held = F.array(*[r.column(F.col("stats")).cast("double") for r in rules])
    data = rows.select(array_to_vector(held).alias("features"), "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100).fit(data)
    rows.unpersist()
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights) if w))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
                   max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    model = fit(spark, docs, labels, max_rows)
    c = F.col
    return docs.select("doc_id", statistics(c("text")).alias("stats")) \
        .select("doc_id", F.coalesce(remainder(c("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
                model.score(c("stats")).alias("score")) \
        .withColumn("predicted", (c("score") >= threshold).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
              max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that the classifier accepts, unchanged; all rows if there was nothing to
    learn from, as nothing speaks against any of them then."""
    model = fit(spark, docs, labels, max_rows)
    if not model.learnt:
        return docs
    return docs.where(model.score(statistics(docs["text"])) >= threshold)
