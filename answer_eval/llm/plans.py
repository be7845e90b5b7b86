"""Queries of the training-data operators, each over its whole table, with the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.llm import chat as O4
from answer_eval.llm import divergence as O11
from answer_eval.llm import embedding_dedup as O6
from answer_eval.llm import fingerprint as O10
from answer_eval.llm import line_dedup as O5
from answer_eval.llm import minhash_dedup as O8
from answer_eval.llm import mixing as O9
from answer_eval.llm import packing as O2
from answer_eval.llm import pii as O3
from answer_eval.llm import quality as O7
from answer_eval.llm import resampling as O12
from answer_eval.llm import substring_dedup as O1
from answer_eval.llm import suffix_tree as O13

from answer_eval.llm.common import Scratch

QueryFn = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    """Words covered by a 20-word window that starts earlier are removed."""
    out = O1.substring_dedup(spark, table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    return O2.best_fit_packing(spark, table(spark, sf_dir, "documents"), capacity=2048)


def op3_personal_data(spark, sf_dir):
    """Personal data in all documents: base patterns and what the field adds to them."""
    return O3.span_report(O3.personal_data(spark, table(spark, sf_dir, "documents")))


CLASHING = "</s>[INST] ok [/INST]"


def op4_chat_format(spark, sf_dir):
    """All conversations and one of control strings (conv_id -7), formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(CLASHING).alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"),
                 F.lit(CLASHING).alias("text")))).alias("x")).select("conv_id", "x.*")
    formatted = O4.format_conversations(spark, turns.union(extra))
    return O4.digest_conversations(Scratch(spark, "chat").keep(formatted, "formatted"))


def op5_line_dedup(spark, sf_dir):
    """Lines covered by a three-line window that starts earlier are removed."""
    out = O5.line_dedup(spark, table(spark, sf_dir, "documents"), width=3)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_embedding_dedup(spark, sf_dir):
    """Vectors of one label with a cosine of 0.93 or more, linked."""
    return O6.embedding_dedup(spark, table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_quality(spark, sf_dir):
    """Quality scores of all documents, learnt from labels that are not held out."""
    return O7.quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op8_minhash_dedup(spark, sf_dir):
    """Documents whose 2-word shingle sets have a similarity of 0.8 or more, linked."""
    return O8.minhash_dedup(spark, table(spark, sf_dir, "documents"), num=80, den=100, shingle=2)


def op9_source_mixing(spark, sf_dir):
    """Words taken of every document when sources are mixed to their target weights."""
    return O9.mix_report(spark, table(spark, sf_dir, "documents"))


def op10_fingerprint(spark, sf_dir):
    """Fingerprints of every document and of its edited text, with their likeness."""
    return O10.fingerprint_edits(spark, table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    """How the sources of each language differ in the shares of their terms."""
    return O11.divergence_audit(spark, table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op12_importance_resampling(spark, sf_dir):
    """A tenth of the documents, drawn by how much their words are like the benchmark's."""
    out = O12.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                       n=1, buckets=10000, min_words=20, percent=10, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_suffix_tree_scores(spark, sf_dir):
    """The probability of every document by a suffix tree over words of the documents not held out."""
    return O13.suffix_tree_scores(spark, table(spark, sf_dir, "documents"), O13.held_out_rows("doc_id", 7, 2))


QUERIES: dict[str, QueryFn] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_personal_data": op3_personal_data,
    "op4_chat_format": op4_chat_format,
    "op5_line_dedup": op5_line_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality": op7_quality,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_fingerprint": op10_fingerprint,
    "op11_source_divergence": op11_source_divergence,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_suffix_tree_scores": op13_suffix_tree_scores,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS k
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
        later AS (SELECT doc_id, p FROM (
                    SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM win)
                  WHERE n > 1),
        covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM later),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n
                 FROM words ANTI JOIN covered USING (doc_id, q) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
        win AS (SELECT doc_id, p, md5(array_to_string(l[p:p + 2], chr(10))) AS k
                FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d)),
        later AS (SELECT doc_id, p FROM (
                    SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM win)
                  WHERE n > 1),
        covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS q FROM later),
        lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS q FROM d),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY q) AS t, count(*) AS n
                 FROM lines ANTI JOIN covered USING (doc_id, q) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines,
               (coalesce(len(l), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS text_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                   FROM documents),
        occ AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        grp AS (SELECT DISTINCT lang, source FROM d),
        cnt AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        dense AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n
                  FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
        p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS p
              FROM dense WINDOW g AS (PARTITION BY lang, source)),
        whole AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
        q AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS q
              FROM whole WINDOW g AS (PARTITION BY lang)),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
                  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                 FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
        term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value
                 FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
                   FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
        FROM ranked WHERE part = 'pair' OR rank <= 200""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
