"""The divergence audit and its perfect hashes against plain versions."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases as K  # noqa: E402

from answer_eval.llm import divergence as D  # noqa: E402
from answer_eval.llm import perfect_hash as H  # noqa: E402

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_a_perfect_hash_is_minimal_and_knows_its_keys(n):
    keys = [f"k{i * i}é".encode() for i in range(n)]
    made = H.PerfectHash.build(keys)
    table = H.PerfectHash(*made[1:])
    slots = table.find(H.binary(keys), H.hashes(H.binary(keys)))
    assert sorted(slots.tolist()) == list(range(n)) and made[0] == len(table) == n
    assert [table.keys[int(s)].as_py() for s in slots[:50]] == keys[:50]
    others = H.binary([f"x{i}".encode() for i in range(3000)])
    assert (table.find(others, H.hashes(others)) == -1).all()


def test_keys_with_equal_hashes_are_kept_aside():
    keys = [b"a", b"b", b"c"]
    same = np.array([5, 5, 9], np.uint64)
    table = H.PerfectHash(*H.PerfectHash.build(keys, same)[1:])
    assert sorted(table.find(H.binary(keys), same).tolist()) == [0, 1, 2]
    assert table.find(H.binary([b"z"]), np.array([5], np.uint64)).tolist() == [-1]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 5)
    text = "Ab cdefghij  klé,m nop_qrs9tuvwxyz É"
    got = [t.decode() for piece in D.terms(text.encode()) for t in piece]
    assert got == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(UPPER))


def plain(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]            # lang, source, text
    df, count, groups = Counter(), defaultdict(Counter), {(r[0], r[1]) for r in rows}
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(UPPER))
        count[lang, source].update(found)
        df.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        sources = [s for x, s in groups if x == lang]

        def shares(c):
            n, v = sum(c[t] for t in kept), len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + v) for t in kept}

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        far = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pair = [(r, sum(far(p[s][t], p[r][t]) for t in kept)) for r in sources if r != s]
            term = [(t, far(p[s][t], whole[t])) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:limit])]
    return sorted(out)


def documents():
    rng = random.Random(3)
    rows = [(None, None, "only nulls here"), ("", None, "only nulls"), ("xx", "lonely", "word"), ("yy", "a", None),
            ("yy", "b", "12 34"), ("en", "empty", None), ("en", "rare", "zebra unicorn")]
    base = [r for r in K.documents() if r[1] is not None]
    for k in range(90):
        text = rng.choice(base)[1][:rng.choice([30, 400, 4000])]
        rows.append((rng.choice(["en", "en", "de", None]), f"s{k % 5}" if k % 9 else None, text + " Déjà THE the"))
    return rows + rows[:20]


@pytest.mark.parametrize("broadcast", [0, 4000, 8 << 20])
def test_the_audit_equals_a_plain_version(spark, broadcast, monkeypatch):
    for name, small in (("SHARD_KEYS", 60), ("HELD", 40), ("DENSE_CELLS", 300)):
        monkeypatch.setattr(D, name, small)
    rows = documents()
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)],
                                 "doc_id long, lang string, source string, text string, term string").repartition(3)
    got = D.divergence_audit(spark, docs, min_docs=3, top=7, broadcast_bytes=broadcast)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert [t for _, t in got.dtypes] == ["string"] * 4 + ["bigint", "int"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 7)


def test_the_audit_of_an_empty_table(spark):
    assert D.divergence_audit(spark, spark.createDataFrame([], K.SCHEMA)).collect() == []


def test_arrow_slices_hash_alike():
    keys = H.binary([b"a", b"bb", b"", b"ccc"])
    assert H.hashes(keys.slice(1, 2)).tolist() == H.hashes(H.binary([b"bb", b""])).tolist()
    assert pa.types.is_binary(keys.type)
