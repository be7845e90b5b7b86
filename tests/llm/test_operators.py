"""Packing, personal data, chat, embeddings, quality, mixing and fingerprints against plain versions."""

import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import cases as K  # noqa: E402

from answer_eval.llm import chat as C  # noqa: E402
from answer_eval.llm import embedding_dedup as E  # noqa: E402
from answer_eval.llm import fingerprint as P  # noqa: E402
from answer_eval.llm import mixing as X  # noqa: E402
from answer_eval.llm import packing as B  # noqa: E402
from answer_eval.llm import pii as D  # noqa: E402
from answer_eval.llm import plans  # noqa: E402
from answer_eval.llm import quality as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


# -- packing ---------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def test_units_give_the_ids_of_whole_texts(vocabulary):
    from tokenizers import Tokenizer
    whole, units = Tokenizer.from_file(str(vocabulary)), B.UnitTokenizer(str(vocabulary))
    text = st.text(st.sampled_from("aAbé̸́ \t\n\x0b\x1c\x85'sre1٣Σß<|endoftext|>.!,=😀—[]\\^_`{}~"), max_size=60)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(text, max_size=4))
    def check(texts):
        texts += ["x<|endoftext|>Y. <|ENDOFTEXT|>"] if len(texts) == 3 else []
        ids, bounds = units(pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]

    check()


def test_a_full_memory_of_units_is_forgotten(vocabulary, monkeypatch):
    monkeypatch.setattr(B, "CACHE", 3)
    units, fresh = B.UnitTokenizer(str(vocabulary)), B.UnitTokenizer(str(vocabulary))
    for t in ("a b c", "d e f g", "a g z"):
        assert units(pa.array([t]))[0].tolist() == fresh(pa.array([t]))[0].tolist()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20))
def test_best_fit_places_every_piece_once(counts):
    runs = B.best_fit(counts, 32)
    spans, seen = defaultdict(list), Counter()
    for length, rank, n, first, offset in runs:
        for k in range(n):
            spans[first + k].append((offset, length))
            seen[length, rank + k] += 1
    assert seen == Counter((length, k) for length, n in counts.items() for k in range(n))
    for s in spans.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        assert sum(n for _, n in s) <= 32
    assert set(spans) == set(range(len(spans)))
    # no two sequences could be one
    loads = sorted(sum(n for _, n in s) for s in spans.values())
    assert len(loads) < 2 or loads[0] + loads[1] > 32


def test_packing(spark, vocabulary):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(str(vocabulary))
    rows = K.documents()
    out = B.best_fit_packing(spark, K.frame(spark, rows), vocabulary, capacity=256).collect()
    want = Counter()
    for i, t in K.texts_by_row(rows):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for n, lo in enumerate(range(0, len(ids), 256)):
            part = ids[lo:lo + 256]
            want[i, n, lo, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        assert sum(n for _, n in s) <= 256
    total = sum(r.length for r in out)
    assert len(by) <= -(-total // 256) + 2
    assert B.best_fit_packing(spark, K.frame(spark, []), vocabulary).collect() == []


# -- personal data ---------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    checksum = lambda d: sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(d[::-1])) % 10
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if max(map(int, m.group().split("."))) <= 255]
    out += [("card", *m.span()) for m in CARD.finditer(text)
            if 14 <= len(digits(m)) <= 19 and checksum(digits(m)) == 0]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], D.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b1", "@", ".", "-", " ", "1", "22", "+", "+1", "(555)", " 555-1234", "255",
                                 "256", "é", ".com", "4041894974608795", "4", "%", "\n"]), max_size=16))
def test_base_spans(parts):
    text = "".join(parts)
    assert D.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_texts_take_linear_time():
    import time
    t = time.time()
    for x in ("a" * 10**6 + "@", "1" * 10**6, "1." * 500_000, "@a" * 300_000, "a@" * 300_000, "0" * 10**6 + ".1.1.1"):
        D.base_spans(x)
    assert time.time() - t < 20


def test_the_field_adds_what_other_mentions_support(spark):
    say = "some words that mean nothing at all here 42 and 2024 "
    rows = [(k, f"{say} mail user{k}.{k}x@host.example.com and call +1 (456) 555-{1000 + k} or see 10.0.{k}.1", "en",
             "s", 1, *K.EXTRA) for k in range(40)]
    rows += [(100, "write bosbt.42@mail8.example.com " + say * 30 + "signed bosbt.42 again", "en", "s", 1, *K.EXTRA),
             (101, "call +1 (456) 555-2186 " + say + "or just 555-2186", "en", "s", 1, *K.EXTRA),
             (102, "signed bosbt.42 or 555-2186 alone", "en", "s", 1, *K.EXTRA),
             (103, None, "en", "s", 1, *K.EXTRA), (None, "a@b.cd", "en", "s", 1, *K.EXTRA)]
    df = K.frame(spark, rows)
    out = {r.doc_id: r.spans for r in D.personal_data(spark, df).collect()}
    text = {r[0]: r[1] or "" for r in rows}
    for i, spans in out.items():
        assert [(s.kind, s.start, s.end) for s in spans if s.base] == plain_spans(text[i])
    added = {i: [(s.kind, text[i][s.start:s.end]) for s in spans if not s.base] for i, spans in out.items()}
    assert {i: a for i, a in added.items() if a} == {100: [("email", "bosbt.42")], 101: [("phone", "555-2186")]}
    report = {r.doc_id: r for r in D.span_report(D.personal_data(spark, df)).collect()}
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text[100]))
    assert report[100].base_sha256 == K.sha(base) and report[100].spans.startswith(base + ",email:")
    assert (report[100].n_email, report[101].n_phone, report[103].spans) == (1, 1, "")
    assert D.personal_data(spark, K.frame(spark, [])).collect() == []


def test_the_field_adds_what_its_shape_supports(spark):
    def card(k):
        head = f"40418949{k:07d}"
        return head + next(c for c in "0123456789" if D.luhn(head + c))

    rows = [(k, f"some words {card(k)} and {k} more", "en", "s", 1, *K.EXTRA) for k in range(300)]
    rows += [(k, f"an order {card(k)[:-1]}{(int(card(k)[-1]) + 1) % 10} here", "en", "s", 1, *K.EXTRA)
             for k in range(300, 340)]
    lost = f"{card(901)} {card(902)}"                    # one match of 32 digits, and dropped
    assert not D.base_spans(lost)
    rows += [(400, f"no base span {lost} here", "en", "s", 1, *K.EXTRA),
             (401, f"a card {card(903)} first, then {lost} here", "en", "s", 1, *K.EXTRA)]
    out = {r.doc_id: r.spans for r in D.personal_data(spark, K.frame(spark, rows)).collect()}
    text = {r[0]: r[1] for r in rows}
    added = {i: [(s.kind, text[i][s.start:s.end]) for s in spans if not s.base] for i, spans in out.items()}
    both = [("card", x) for x in lost.split()]
    assert {i: a for i, a in added.items() if a} == {400: both, 401: both}


def test_mentions_of_several_tokens_and_plain_names(spark):
    say = " some words that mean nothing at all here "
    rows = [(k, f"mail user{k}.{k}x@host.example.com or call +1 (456) 555-{1000 + k} or pay 4111 1111 1111 1111", "en",
             "s", 1, *K.EXTRA) for k in range(200)]
    told = {300: ("4111 1111 1111 1111" + say + "order 12 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
            301: ("+1 (456) 555-2186" + say + "456 555 2186", [("phone", "456 555 2186")]),
            302: ("+1 (456) 555-2186" + say + "(456) 555-2186", [("phone", "(456) 555-2186")]),
            303: ("jsmith@x.com" + say + "Jsmith, or jsmithers", [("email", "Jsmith")]),
            304: ("+1 (826) 555-4081 190.137.22.7" + say, [("phone", "+1 (826) 555-4081")]),
            305: ("support@x.com" + say + "our support", []),
            307: ("a.b1@x.com zz9%q 10.0.0.1 q=7~z" + say, []),
            306: (say + "12 4111 1111 1111 1112 and 456 555 2186 and jsmith", [])}
    rows += [(k, t, "en", "s", 1, *K.EXTRA) for k, (t, _) in told.items()]
    out = {r.doc_id: r.spans for r in D.personal_data(spark, K.frame(spark, rows)).collect()}
    text = {r[0]: r[1] for r in rows}
    added = {i: [(s.kind, text[i][s.start:s.end]) for s in spans if not s.base] for i, spans in out.items()}
    assert {i: a for i, a in added.items() if a} == {i: a for i, (_, a) in told.items() if a}


def test_runs_of_long_texts_take_linear_time():
    import time
    t = time.time()
    for x in ("1 " * 200_000, "12 4111 1111 1111 1111 " * 20_000, "+1 (456) 555-2186 x " * 10_000, "1.2 (" * 100_000):
        D.runs(x, D.base_spans(x))
    assert time.time() - t < 20


# -- chat ------------------------------------------------------------------

def test_chat_round_trip(spark):
    import random
    rng = random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "&", "&lt;", "&#91;", "&amp;", " ok ", "<", "[", "/s>", "0", "\n",
             "é😀", "INST]", "x" * 2000]
    rows = [(k, rng.choice([None, 0, 1, 1, 2]), rng.choice(["user", "assistant", "system", None, "<s>", "a[INST]b", ""]),
             None if rng.random() < .1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))), "x")
            for k in range(150) for _ in range(rng.randint(1, 4))]
    rows += [rows[0], (None, 0, "user", "nobody's", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k string")
    formatted = C.format_conversations(spark, df)
    f = {r.conv_id: r for r in formatted.collect()}
    got = {r.conv_id: r for r in C.digest_conversations(formatted).collect()}
    conv = defaultdict(list)
    for i, t, r, x, _ in rows:
        conv[i].append(((t is not None, t or 0), r or "", x or ""))
    plain = lambda x: x.replace("&lt;", "<").replace("&#91;", "[").replace("&amp;", "&")
    assert set(got) == set(conv)
    for i, turns in conv.items():
        turns.sort()
        said = [x for _, r, x in turns if r == "assistant"]
        g = got[i]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == K.sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (g.loss_chars, g.loss_sha256) == (len("".join(said)), K.sha("".join(said)))
        assert g.formatted_chars == len(f[i].formatted)
        masked = [f[i].formatted[s.start:s.start + s.length] for s in f[i].loss_spans]
        assert len(masked) == len(said) and all(x in (m, plain(m)) for x, m in zip(said, masked))
    assert C.digest_conversations(C.format_conversations(spark, df.limit(0))).collect() == []


def test_what_is_no_turn_does_not_parse(spark):
    bad = ["", "plain", "<s>0user[INST]x[/INST]", "<s>7user[INST]x[/INST]</s>", "<s>0user x</s>"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(bad)], "conv_id long, formatted string")
    assert [r.n_turns for r in C.digest_conversations(df).orderBy("conv_id").collect()] == [0] * len(bad)


def test_chat_query_adds_the_clashing_conversation(spark):
    r = plans.QUERIES["op4_chat_format"](spark, SF).where("conv_id = -7").collect()
    x = plans.CLASHING
    assert len(r) == 1 and r[0].n_turns == 2 and r[0].loss_sha256 == K.sha(x)
    assert r[0].turns_sha256 == K.sha(f"user\n{x}\nassistant\n{x}\n")


# -- embeddings ------------------------------------------------------------

def plain_links(rows, threshold=0.93):
    unit = {}
    for k, (i, label, v) in enumerate(rows):
        x = np.array(v or [], float) if v is None or None not in v else np.array([])
        if i is not None and label is not None and len(x) and np.isfinite(x).all() and x.any():
            unit[k] = (label, len(x)), x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit
             if a < b and unit[a][0] == unit[b][0] and unit[a][1] @ unit[b][1] >= threshold]
    n = Counter(k for pair in links for k in pair)
    root = K.groups({r[0] for r in rows if r[0] is not None}, [(rows[a][0], rows[b][0]) for a, b in links])
    return Counter((r[0], n[k], root.get(r[0]), r[0] is None or root[r[0]] == r[0]) for k, r in enumerate(rows))


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    rows = [(k, int(k % 3), (centres[k % 12] + rng.standard_normal(24) * 0.18).tolist()) for k in range(240)]
    rows += [(300 + k, 1, rows[7][2]) for k in range(40)]          # a hot vector
    rows += [(400, None, rows[0][2]), (401, 1, None), (402, 1, [0.0] * 24), (403, 1, [float("nan")] * 24),
             (404, 1, [None] * 24), (None, 1, rows[7][2]), (405, 1, []), (406, 1, [1.0, 0.0]), (407, 1, [2.0, 0.1]),
             (300, 1, rows[7][2]), (301, 2, rows[8][2]), (408, 1, [1e200] * 24)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, id string")
    out = E.embedding_dedup(spark, df).collect()
    assert Counter(tuple(r) for r in out) == plain_links(rows)
    assert E.embedding_dedup(spark, df.limit(0)).collect() == []


def test_tables_find_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    a = E._unit(rng.standard_normal((400, 64)))
    side = rng.standard_normal((400, 64))
    side = E._unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * side
    x, y = (E.table_keys(v, E.TABLES, E.PROJECTIONS, E.WIDTH) for v in (a, b))
    assert (x == y).any(axis=1).mean() >= 0.99


# -- quality ---------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = Q.quality_scores(spark, docs, labels)
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held) > 50
    assert out.count() == docs.count()


def test_quality_of_hard_rows_and_few_labels(spark):
    df = K.frame(spark, K.documents())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.quality_scores(spark, df, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (None, 1), (12, 0), (12, 1), (20, 1), (21, 1), (22, 1)],
                                "doc_id long, quality int")
    out = Q.quality_scores(spark, df, odd).collect()
    assert all(r.score > 0.99 and r.predicted == 1 for r in out) and len(out) == df.count()
    model = Q.RuleModel(-1.0, ((Q.Rule(((1, 2.0, 30.0),)), 3.0), (Q.Rule(((0, -float("inf"), 0.0),)), 1.0)))
    got = df.select("text", model.score(Q.statistics(df["text"])).alias("s")).collect()
    for r in got:
        w, n = len(K.words(r.text)), len(r.text or "")
        assert abs(r.s - 1 / (1 + np.exp(1.0 - 3.0 * (2 < w <= 30) - (n == 0)))) < 1e-12


def test_a_bounded_sample_of_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    assert 20 <= Q.labelled(docs, labels, max_rows=60).count() <= 110


def test_every_document_stays_where_no_label_can_be_learnt_from(spark):
    df = K.frame(spark, K.documents())
    want = Counter(df.select("doc_id", "text").collect())
    held = next(i for i in range(20, 60) if zlib.crc32(str(i).encode()) % 4 == 2)
    for labels in ([], [(held, 1), (1, None), (None, 1), (12, 0), (12, 1)]):
        kept = Q.keep_good(spark, df, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert kept.columns == df.columns and Counter(kept.select("doc_id", "text").collect()) == want
    seen = [i for i in range(20, 60) if zlib.crc32(str(i).encode()) % 4 != 2]
    bad = spark.createDataFrame([(i, 0) for i in seen], "doc_id long, quality int")
    assert Q.keep_good(spark, df, bad).count() == 0      # learnt: all bad


# -- mixing ----------------------------------------------------------------

@pytest.mark.parametrize("block", [4, 64])
def test_mixing(spark, block):
    rows = K.documents()
    df = K.frame(spark, rows)
    size, target = K.target_weights([(r[1], r[3]) for r in rows])
    out = X.mix_report(spark, df, block=block, shard_slots=50)
    got = out.collect()
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got) == Counter(
        (r[0], len(K.words(r[1])), size[r[3]], round(target[r[3]], 6)) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = defaultdict(float)
    for r in got:
        by[round(r.target, 6)] += r.taken
    want = defaultdict(float)
    for s in target:
        want[round(target[s], 6)] += target[s]
    assert all(abs(by[t] - want[t]) <= 3 for t in want)
    assert Counter(map(tuple, X.mix_report(spark, df.repartition(7), block=block, shard_slots=50).collect())) \
        == Counter(map(tuple, got))
    # the texts of the mix hold the words taken
    mixed = X.mix_documents(spark, df, block=block, shard_slots=50).collect()
    assert sum(len(K.words(r.text)) for r in mixed) == sum(r.taken for r in got)
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    texts = Counter()
    for r in mixed:
        texts[r.doc_id] += len(K.words(r.text))
    assert +texts == +taken


def test_slots_are_a_permutation_of_blocks_per_epoch(spark):
    s = spark.createDataFrame([(0, 1000, 2500.0), (1, 64, 10.0), (2, 0, 0.0), (3, 7, 21.0)],
                              "sid int, source_size long, target double")
    rows = X.slots(s, 8, 0, 16, 4).collect()
    for sid, size, target in ((0, 1000, 2500), (1, 64, 10), (3, 7, 21)):
        n = -(-size // 8)
        mine = [r for r in rows if r.sid == sid]
        assert sum(r.words for r in mine) == target
        for e in {r.epoch for r in mine}:
            blocks = [r.block for r in mine if r.epoch == e]
            assert len(set(blocks)) == len(blocks) and set(blocks) <= set(range(n))
            if (e + 1) * size <= target:
                assert len(blocks) == n
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    assert len({r.shard for r in rows if r.sid == 0}) > 5 and not [r for r in rows if r.sid == 2]


def test_block_numbers_are_shuffled_for_every_count(spark):
    from pyspark.sql import functions as F
    c, seed = F.col, [F.lit(3), F.col("n")]
    sizes = [*range(1, 200), 1021, 4096, 10000]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").repartition(8) \
        .withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), c("n") - 1)))
    df = df.withColumn("y", X.shuffled(c("x"), c("n"), *seed)).withColumn("z", X.shuffled(c("y"), c("n"), *seed, back=True))
    out = {r.n: r for r in df.groupBy("n").agg(
        F.count_distinct("y").alias("hit"), F.min("y").alias("low"), F.max("y").alias("high"),
        F.count_if(c("x") == c("y")).alias("fixed"), F.count_if(c("x") == c("z")).alias("back"),
        F.corr("x", "y").alias("corr")).collect()}
    for n, r in out.items():
        assert (r.hit, r.low, r.high, r.back) == (n, 0, n - 1, n)
        assert n < 8 or r.fixed < n / 2
        assert n < 1000 or abs(r["corr"]) < 0.15
    # the counts of blocks whose shuffle was the identity before
    for n in (90, 225225):
        few = spark.range(0, n, max(1, n // 500)).withColumn("y", X.shuffled(c("id"), F.lit(n).cast("long"), F.lit(0)))
        assert few.where("id <> y").count() > 0.9 * few.count()


@pytest.mark.parametrize("block", [4, 64])
def test_words_taken_of_each_document_follow_the_slots(spark, block):
    from answer_eval.llm.common import Scratch
    docs = K.frame(spark, K.documents())
    sized = X._sized(docs)
    sources = Scratch(spark, "test").keep(X.source_targets(sized), "sources")
    laid = X.layout(sized, sources, block).collect()
    slots = X.slots(sources, block, 0, 50, 4).collect()
    want, shards = Counter(), {}
    for d in laid:
        key = (d.doc_id, d["size"], d.sid)
        got = [(min(d.start + d["size"], s.block * block + s.words) - max(d.start, s.block * block), s.shard)
               for s in slots if s.sid == d.sid]
        got = [(n, shard) for n, shard in got if n > 0]
        want[key, sum(n for n, _ in got), min((x for _, x in got), default=None)] += 1
    sid = {(r.source_size, round(r.target, 6)): r.sid for r in sources.collect()}
    out = X.mix_report(spark, docs, block=block, shard_slots=50).collect()
    assert Counter(((r.doc_id, r["size"], sid[r.source_size, round(r.target, 6)]), r.taken, r.first_shard)
                   for r in out) == want
    table = X.mix_shards(spark, docs, block=block, shard_slots=50).collect()
    assert sum(r.slots for r in table) == len(slots) and sum(r.words for r in table) == sum(s.words for s in slots)
    assert len({r.shard for r in table}) > 1


def test_long_texts_are_mixed_in_linear_time(spark):
    import time
    seconds = []
    for n in (20_000, 80_000):
        rows = [(k, " ".join(f"w{i * 7 % 1000}" for i in range(n)), f"s{k % 3}") for k in range(4)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        start = time.time()
        X.mix_documents(spark, df).write.format("noop").mode("overwrite").save()
        seconds.append(time.time() - start)
    assert seconds[1] < 4 * seconds[0] + 8


def test_mixing_nothing(spark):
    assert X.mix_report(spark, K.frame(spark, [])).collect() == []
    assert X.mix_documents(spark, K.frame(spark, [])).collect() == []


# -- fingerprints ----------------------------------------------------------

def plain_digest(text):
    """Byte by byte: triplets of every four bytes, quartile codes, logarithmic length."""
    data = text.encode()
    x, counts = [2, *data, 3], [0] * 256
    for i in range(len(x)):
        for second, third, factor in ((1, 2, 0x9E3779B1), (1, 3, 0x85EBCA77), (2, 3, 0xC2B2AE3D)):
            if i + third < len(x):
                counts[((x[i] << 16 | x[i + second] << 8 | x[i + third]) * factor % 2 ** 32) >> 24] += 1
    order = sorted(counts)
    codes = [sum(c > order[64 * q - 1] for q in (1, 2, 3)) for c in counts]
    size = min(255, round(math.log(len(data) + 1) / math.log(1.1)))
    return size, codes


def plain_hex(digest):
    size, codes = digest
    four = [codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 256, 4)]
    return bytes([size, *four]).hex()


def plain_likeness(a, b):
    steps = sum(abs(x - y) for x, y in zip(a[1], b[1])) + min(32, abs(a[0] - b[0]))
    return 1 - min(steps, 320) / 320


def test_fingerprints_of_edits(spark):
    """Null and repeated ids included: ids descending, null last, equal ids by their texts' hashes."""
    from pyspark.sql import functions as F
    rows = [r for r in K.documents() if len(r[1] or "") < 3000]
    df = K.frame(spark, rows)
    docs = [(r.doc_id, r.text or "") for r in sorted(
        df.select("doc_id", "text", F.xxhash64("text").alias("t")).collect(),
        key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.t, r.text or ""))]
    want = Counter()
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + nxt[:cut]
        a, b, c = (plain_digest(x) for x in (t, edited, nxt))
        want[i, len(t), K.sha(edited), plain_hex(a), plain_hex(b), round(plain_likeness(a, b), 12),
             round(plain_likeness(a, c), 12)] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12),
                   round(r.near_next, 12)) for r in P.fingerprint_edits(spark, df).collect())
    assert got == want and any(k[0] is None for k in got)


@pytest.mark.parametrize("n", [0, 1, 8])
def test_every_row_has_one_follower(spark, n):
    rows = [(None, "x"), (None, None), (1, "a"), (1, "b"), (1, "b"), (2, None), (9, ""), (None, "y")][:n]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.fingerprint_edits(spark, df).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)


def test_likeness_is_bounded_and_sees_edits(spark):
    text = " ".join(f"word{k * 7919 % 1000}" for k in range(3000)).encode()
    other = " ".join(f"{k * 104729 % 10007:x}" for k in range(3000)).encode()
    a, b, c = P.digest(text), P.digest(text[:16000] + other[:4000]), P.digest(other)
    assert P.likeness(a, a) == 1.0 > P.likeness(a, b) > P.likeness(a, c) >= 0.0
    assert P.digest(b"") != P.digest(b"a") and len(P.digest(b"")) == len(a) == 1 + P.BUCKETS // 4
    data = text * 60                                    # more than one block
    n = len(data) + 2
    assert len(data) > P.BLOCK and P.bucket_counts(data).sum() == (n - 2) + 2 * (n - 3)
    df = spark.createDataFrame([("ab", "ab"), (None, ""), ("a", None)], "x string, y string")
    f = df.select(P.fingerprint("x").alias("x"), P.fingerprint("y").alias("y"))
    assert [r[0] for r in f.select(P.similarity("x", "y")).collect()][:2] == [1.0, 1.0]
