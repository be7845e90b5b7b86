"""Substring, line and MinHash dedup against plain versions on the hard documents."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases as K  # noqa: E402

from answer_eval.llm import minhash_dedup as M  # noqa: E402
from answer_eval.llm.common import WordHash, utf8, word_spans  # noqa: E402
from answer_eval.llm.line_dedup import line_dedup  # noqa: E402
from answer_eval.llm.substring_dedup import _chain, _sliding_min, segments, substring_dedup  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def in_order(spark, df):
    """Distinct documents in the order the operators use: null id first, then id, then the text's hash."""
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("t")).distinct().collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    return [(r[0], r[1]) for r in rows]


def test_words_are_split_at_the_six_spaces_only():
    texts = ["a b\tc\nd\x0be\x0cf\rg", "", None, "\x1ca b c", " x  ", "é　ü"]
    raw, off = utf8(pa.array(texts))
    start, end, doc = word_spans(raw, off)
    got = [[raw[s:e].tobytes().decode() for s, e, d in zip(start, end, doc) if d == k] for k in range(len(texts))]
    assert got == [K.words(t) for t in texts]


def test_word_hash_does_not_depend_on_place_or_step():
    h = WordHash(4)
    h.STEP = 8
    data = "alpha beta alpha gamma-with-a-long-word alpha".encode()
    raw = np.frombuffer(data, np.uint8)
    start, end, _ = word_spans(raw, np.array([0, len(raw)]))
    x = h(raw, start, end)
    assert x[0] == x[2] == x[4] and len(set(x.tolist())) == 3
    assert (WordHash(4)(raw, start, end) == x).all()


def test_windows_have_one_anchor_each_whatever_the_block(monkeypatch):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 300).astype(np.uint64)
    doc = np.repeat([0, 1, 2], [150, 10, 140])
    from answer_eval.llm import substring_dedup as S
    whole = [(int(f + k), int(w[f - lo + k])) for a, first, count, w, lo in segments(h, doc, 20, 8)
             for f, n in zip(first, count) for k in range(n)]
    monkeypatch.setattr(S, "BLOCK", 40)
    cut = [(int(f + k), int(w[f - lo + k])) for a, first, count, w, lo in segments(h, doc, 20, 8)
           for f, n in zip(first, count) for k in range(n)]
    assert sorted(whole) == sorted(cut)
    assert [p for p, _ in sorted(whole)] == [*range(131), *range(160, 281)]
    assert _sliding_min(np.arange(10)[::-1], 3).tolist() == [7, 6, 5, 4, 3, 2, 1, 0]
    assert len(_chain(h, 20, 3)) == 281


def test_substring_dedup(spark):
    rows = K.documents()
    df = K.frame(spark, rows)
    docs = in_order(spark, df)
    later = K.first_places(docs, K.words, 20, " ")
    want = Counter()
    where = {d: k for k, d in enumerate(docs)}
    for i, t in K.texts_by_row(rows):
        w = K.words(t)
        gone = K.covered(later, where[i, t], len(w), 20)
        want[i, len(w), sum(gone), K.sha(" ".join(x for x, g in zip(w, gone) if not g))] += 1
    out = substring_dedup(spark, df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert sum(r.n_removed for r in out) > 400
    texts = {d: K.words(d[1]) for d in docs}
    for r in out:                                       # every factor is a copy of its reference
        for f in r.factors:
            assert f.length >= 20
            mine = [t for (i, _), t in texts.items() if i == r.doc_id]
            theirs = [t for (i, _), t in texts.items() if i == f.ref_doc]
            assert any(a[f.start:f.start + f.length] == b[f.ref_start:f.ref_start + f.length]
                       for a in mine for b in theirs)
        assert K.sha(r.kept_text) == r.kept_sha256


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(spark, K.frame(spark, [])).collect() == []


def test_line_dedup(spark):
    rows = K.documents()
    df = K.frame(spark, rows)
    docs = in_order(spark, df)
    lines = lambda t: [] if t is None else t.split("\n")
    later = K.first_places(docs, lines, 3, "\n")
    where = {d: k for k, d in enumerate(docs)}
    want = Counter()
    for i, t in K.texts_by_row(rows):
        ls = lines(t)
        gone = K.covered(later, where[i, t], len(ls), 3)
        kept = None if t is None else "\n".join(x for x, g in zip(ls, gone) if not g)
        want[i, kept, len(ls), sum(gone)] += 1
    out = line_dedup(spark, df)
    assert out.columns == df.columns + ["n_lines", "_n_removed"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r["_n_removed"]) for r in got) == want
    assert all(r["n_removed"] == r["a.b"] == "x" for r in got)
    assert sum(r["_n_removed"] for r in got) > 20
    assert line_dedup(spark, K.frame(spark, [])).collect() == []


@pytest.mark.parametrize("shingle", [2, 5])
def test_minhash_dedup(spark, shingle):
    rows = K.documents()
    docs = K.texts_by_row(rows)
    sets = [(i, K.shingles(t, shingle)) for i, t in docs]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x]
             if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    root = K.groups({i for i, _ in docs if i is not None}, links)
    # an id alone in its sets is its own component; wordless texts link with nothing
    want = Counter((i, len(s), root[i] if i is not None and s else i, i is None or not s or root[i] == i)
                   for i, s in sets)
    out = M.minhash_dedup(spark, K.frame(spark, rows), shingle=shingle).collect()
    assert Counter(tuple(r) for r in out) == want
    assert sum(not r.kept for r in out) >= 6
    if shingle == 2:
        assert M.minhash_dedup(spark, K.frame(spark, [])).collect() == []


def test_components_that_the_leaders_miss(spark, monkeypatch):
    """A chain of near copies: neighbours are alike, ends are not; blocks of few members."""
    monkeypatch.setattr(M, "BLOCK", 4)
    rng = random.Random(5)
    text, rows = [f"w{k}" for k in range(60)], []
    for k in range(40):
        rows.append((k, " ".join(text), "en", "s", 1, *K.EXTRA))
        for _ in range(2):
            text[rng.randrange(60)] = f"x{rng.random()}"
    sets = [(r[0], K.shingles(r[1], 2)) for r in rows]
    links = [(a, b) for a, s in sets for b, t in sets if a > b and 100 * len(s & t) >= 80 * len(s | t)]
    root = K.groups(range(40), links)
    out = M.minhash_dedup(spark, K.frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in out} == root


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    s = M.signatures([a, b], 160)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.12
    x = M.odd_sketches(s, 512)
    assert np.bitwise_count(x[0] ^ x[1]).sum() <= M.max_xor(512, 160, 0.6)
    assert M.max_xor(512, 160, 1.0) == 0 < M.max_xor(512, 160, 0.8) < M.max_xor(512, 160, 0.5)
