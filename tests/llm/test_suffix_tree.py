"""Suffix tree scores against a plain version of the same model, and on held-out documents."""

import math
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases as K  # noqa: E402

from answer_eval.llm import plans  # noqa: E402
from answer_eval.llm import suffix_tree as S  # noqa: E402

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i, modulus=7, remainder=2):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


def plain(docs, depth, min_count, cutoff):
    """docs: (doc_id, text, held out).  Contexts are tuples of tokens; the start mark is None, the end 1."""
    seqs = [(i, h, [None, *K.words((t or "").translate(UPPER)), 1]) for i, t, h in docs]
    one, after = Counter(), defaultdict(Counter)
    for _, h, s in seqs:
        if not h:
            for k in range(1, len(s)):
                one[s[k]] += 1
                for d in range(1, min(k, depth) + 1):
                    after[tuple(s[k - d:k])][s[k]] += 1
    n, v, kept = sum(one.values()), len(one), {()}

    def p(context, w):
        if not context:
            return (one[w] + 1) / (n + v + 1)
        shorter = p(context[1:], w)
        if context not in kept:
            return shorter
        c = after[context]
        return (c[w] + len(c) * shorter) / (sum(c.values()) + len(c))

    for d in range(1, depth + 1):
        grown = set()
        for x, c in after.items():
            if len(x) == d and x[1:] in kept and sum(c.values()) >= min_count:
                gain = sum(k * math.log(k / sum(c.values()) / p(x[1:], w)) for w, k in c.items())
                if gain >= cutoff * len(c):
                    grown.add(x)
        kept |= grown
    out = []
    for i, h, s in seqs:
        base = sum(math.log10(p((), w)) for w in s[1:])
        score = 0.0
        for k in range(1, len(s)):
            context = tuple(s[max(0, k - depth):k])
            while context not in kept:
                context = context[1:]
            score += math.log10(p(context, s[k]))
        out.append((i, h, len(s) - 1, sum(one[w] > 0 for w in s[1:]), n, base, score))
    return out, kept, p


def compare(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("depth, min_count, cutoff", [(1, 2, 0.5), (2, 3, 1.0), (3, 2, 0.0)])
def test_scores_equal_a_plain_version(spark, depth, min_count, cutoff, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(S, "BUCKET_KEYS", 900)
    rows = K.documents()
    docs = K.frame(spark, rows)
    out = S.suffix_tree_scores(spark, docs, S.held_out_rows(), depth, min_count, cutoff)
    want, kept, _ = plain([(r[0], r[1], held(r[0])) for r in rows], depth, min_count, cutoff)
    assert max(map(len, kept)) == depth
    compare(out.collect(), want)


def test_nothing_to_learn_from_and_empty_tables(spark):
    docs = K.frame(spark, K.documents())
    out = S.suffix_tree_scores(spark, docs, F.lit(True)).collect()
    assert len(out) == docs.count()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in out} == {(0, 0, 0.0, 0.0)}
    assert S.suffix_tree_scores(spark, spark.createDataFrame([], K.SCHEMA), F.lit(False)).collect() == []


def test_a_flag_that_is_null_is_learnt_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = S.suffix_tree_scores(spark, docs, F.lit(None).cast("boolean")).collect()
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out} == \
        {(1, False, 3, 3, 4), (2, False, 1, 1, 4)}


def test_predictions_sum_to_one():
    """Over all known tokens and an unknown one, in every retained context."""
    docs = [(k, "a b a c a b d a b a b e a c", False) for k in range(5)]
    _, kept, p = plain(docs, 2, 2, 0.0)
    assert len(kept) > 4
    for context in kept:
        assert sum(p(context, w) for w in ["a", "b", "c", "d", "e", 1, "unknown"]) == pytest.approx(1.0)


@pytest.mark.parametrize("top", [0, 127, 128, 40000, 1 << 31, 1 << 62])
def test_packed_numbers_come_back(top):
    x = np.array([0, -top, top, 5], np.int64)
    assert S._unpack(S._pack(x)).tolist() == x.tolist() and S._unpack(S._pack(x[:0])).tolist() == []


@pytest.mark.parametrize("n", [1, 2, 300])
def test_packed_keys_come_back(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
    assert S._unpack_keys(S._pack_keys(keys)).tolist() == keys.tolist()
    assert S._from_planes(S._planes(keys)).tolist() == keys.tolist()


@pytest.mark.parametrize("top", [5, 1 << 40, 1 << 60])
def test_codes_are_numbered_as_unique_does(top):
    codes = np.random.default_rng(top).integers(0, top, 500)
    for got, want in zip(S._numbered(codes), np.unique(codes, return_inverse=True)):
        assert got.tolist() == want.tolist()
    assert [x.tolist() for x in S._numbered(codes[:0])] == [[], []]


def test_blocks_hold_whole_documents(monkeypatch):
    import pyarrow as pa

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(S, "TaskContext", Context)
    monkeypatch.setattr(S, "BLOCK_TOKENS", 10)
    texts = ["a " * k for k in (3, 0, 25, 4, 4, 4, 1)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(7)), pa.array(texts), pa.array([None, True, False, False, True, False, False])],
        names=["doc_id", "text", "held_out"])
    rows = [r for b in S._blocks(pa.int64())([batch, batch.slice(0, 0), batch.slice(5, 2)]) for r in b.to_pylist()]
    assert [x for r in rows for x in r["ids"]] == [*range(7), 5, 6]
    assert len({r["block"] for r in rows}) == len(rows) and {r["block"] >> 32 for r in rows} == {3}
    sizes = [S._unpack(r["lengths"]).tolist() for r in rows]
    assert [x for s in sizes for x in s] == [4, 1, 26, 5, 5, 5, 2, 5, 2]
    assert all(sum(s) <= 10 or len(s) == 1 for s in sizes)


def test_the_query_equals_a_plain_version_and_beats_the_root(spark):
    docs = [tuple(r) for r in plans.table(spark, SF, "documents").select("doc_id", "text").collect()]
    df = plans.QUERIES["op13_suffix_tree_scores"](spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"),
                         ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    got = df.collect()
    compare(got, plain([(i, t, held(i)) for i, t in docs], 2, 8, 3.0)[0])
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
