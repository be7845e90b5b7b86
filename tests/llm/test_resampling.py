"""Importance resampling against a plain version."""

import hashlib
import math
import re
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases as K  # noqa: E402

from answer_eval.llm import plans  # noqa: E402
from answer_eval.llm import resampling as R  # noqa: E402

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def plain(docs, target, n, buckets, min_words, percent):
    s, t = [0] * buckets, [0] * buckets
    for texts, counts in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for f in features(x, n)[1]:
                counts[bucket(f, buckets)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
            for b in range(buckets)]
    rows = []
    for i, x in docs:
        size, fs = features(x, n)
        weight = sum(gain[bucket(f, buckets)] for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, size, len(fs), weight, score))
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    # rows that tie in score and doc_id are exchangeable
    ranks = [(r, k + 1 if k < percent * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return sorted([(*r, k) for r, k in ranks] + [(*r, None) for r in rows if r[1] < min_words], key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in df.collect()], key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_a_plain_version(spark, n, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 7)            # runs across chunks of matches
    rows = K.documents()
    target = ["abc ABC é bc", None, "", rows[5][1], "de de de"]
    df = R.resample(spark, K.frame(spark, rows), spark.createDataFrame([(x,) for x in target], "text string"),
                    n=n, buckets=50, min_words=20, percent=30)
    assert got(df) == plain(K.texts_by_row(rows), target, n, 50, 20, 30)


def test_no_run_crosses_documents():
    import pyarrow as pa
    data, starts = R.joined(pa.array(["a b", None, "", "c", "d e f"]))
    runs = [(d.tolist(), o.tolist()) for d, o, _ in R.word_runs(data, starts, 2, 10)]
    assert runs == [([0, 0, 3, 4, 4, 4], [0, 0, 3, 4, 4, 4, 0, 4, 4])]


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], K.SCHEMA)
    assert R.resample(spark, none, none.select("text")).collect() == []
    out = R.resample(spark, K.frame(spark, K.documents()), none.select("text"), min_words=0, percent=100)
    ranks = [r.rank for r in out.collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_drawn_documents_keep_their_columns(spark):
    docs = K.frame(spark, K.documents())
    target = docs.select("text")
    out = R.drawn_documents(spark, docs, target, percent=20)
    ids = {r.doc_id for r in R.resample(spark, docs, target, percent=20).where("rank is not null").collect()}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == ids and ids


def test_the_query_equals_a_plain_version_on_its_tables(spark):
    docs = [tuple(r) for r in plans.table(spark, SF, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in plans.table(spark, SF, "benchmark").collect()]
    want = sorted([(i, f, w, s, k) for i, _, f, w, s, k in plain(docs, target, 1, 10000, 20, 10)], key=repr)
    df = plans.QUERIES["op12_importance_resampling"](spark, SF)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert [t for _, t in df.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, df.collect()), key=repr) == want
