"""The corpus pipeline, stage by stage, against plain versions; registration and guards."""

import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases as K  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from answer_eval.llm import plans  # noqa: E402
from answer_eval.llm.quality import quality_scores  # noqa: E402

ROOT = Path(__file__).resolve().parents[2]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Hard documents, junk that labels mark as such, and good prose."""
    rng = random.Random(9)
    out = tmp_path_factory.mktemp("corpus")
    rows = [r[:5] for r in K.documents()]
    labels = []
    for k in range(200, 320):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60)]
        junk = k % 4 == 0
        text = " ".join(w + ("$$$" if junk else "") for w in words)
        rows.append((k, text, "en", f"src{k % 5}", len(text)))
        labels.append((k, int(not junk)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(out / "labels.parquet"))
    return str(out), dict(labels)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows that each stage gets and returns, through Parquet."""
    sf, _ = folder
    out = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {"documents": docs}
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(out / name))
        docs = found[name] = spark.read.parquet(str(out / name))
    return found


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(stages[n].columns == COLUMNS for n, _ in P.STAGES[:-1])
    for n in ("line_dedup", "mixing"):
        assert all(r[4] == len(r[1] or "") or r[1] is None for r in rows(stages[n]))


def test_quality_stage(spark, folder, stages):
    sf, labels = folder
    before, after = Counter(rows(stages["documents"])), Counter(rows(stages["quality"]))
    assert not after - before
    good = quality_scores(spark, stages["documents"], spark.read.parquet(f"{sf}/labels.parquet")) \
        .where("predicted = 1").collect()
    assert Counter(r.doc_id for r in good) == Counter(r[0] for r in after.elements())
    kept = {r[0] for r in after}
    assert {k for k, q in labels.items() if q} <= kept and not {k for k, q in labels.items() if not q} & kept


def test_line_stage(spark, stages):
    from pyspark.sql import functions as F
    df = stages["quality"]
    docs = [(r[0], r[1]) for r in sorted(
        df.select("doc_id", "text", F.xxhash64("text").alias("t")).distinct().collect(),
        key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]
    lines = lambda t: [] if t is None else t.split("\n")
    later = K.first_places(docs, lines, 3, "\n")
    where = {d: k for k, d in enumerate(docs)}
    want = Counter()
    for i, t, lang, source, _ in rows(df):
        gone = K.covered(later, where[i, t], len(lines(t)), 3)
        kept = None if t is None else "\n".join(x for x, g in zip(lines(t), gone) if not g)
        want[i, kept, lang, source] += 1
    assert Counter(r[:4] for r in rows(stages["line_dedup"])) == want


def test_near_dedup_stage(stages):
    before, after = rows(stages["line_dedup"]), rows(stages["near_dedup"])
    sets = [K.shingles(r[1], 5) for r in before]
    linked = lambda s, t: s and t and 100 * len(s & t) >= 80 * len(s | t)
    links = [(x, y) for x in range(len(sets)) for y in range(x) if linked(sets[x], sets[y])]
    root = K.groups(range(len(sets)), links)
    want = {}
    for k, r in enumerate(before):              # the least id of each group, null last
        want[root[k]] = min(want.get(root[k], (True, 0)), (r[0] is None, r[0] or 0))
    assert Counter((r[0] is None, r[0] or 0) for r in after) == Counter(want.values())
    assert not Counter(after) - Counter(before) and len(after) < len(before)
    kept = [K.shingles(r[1], 5) for r in after]
    assert not any(linked(s, t) for k, s in enumerate(kept) for t in kept[:k])


def test_near_dedup_leaves_one_row_of_equal_ids_and_of_null_ids(spark):
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(5, text), (5, text), (None, "x " + text), (None, "x " + text), (7, None), (7, None)],
                                 "doc_id long, text string").withColumn("row_key", P.F.lit("clash"))
    out = P.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(repr, (tuple(r)[:2] for r in out.collect()))) == sorted(map(repr, [(5, text), (7, None), (7, None)]))


def test_mixing_stage(stages):
    before, after = rows(stages["near_dedup"]), rows(stages["mixing"])
    _, target = K.target_weights([(r[1], r[3]) for r in before])
    got = defaultdict(int)
    for r in after:
        got[r[3]] += len(K.words(r[1]))
    assert all(abs(got[s] - t) <= 1 for s, t in target.items())
    texts = defaultdict(set)
    for r in before:
        texts[r[0]].add(tuple(K.words(r[1])))
    taken = Counter()
    for r in after:
        w = K.words(r[1])
        assert any(set(w) <= set(t) for t in texts[r[0]])
        taken[r[0]] += len(w)
    size = Counter()
    for r in before:
        size[r[0]] += len(K.words(r[1]))
    assert all(n <= 3 * size[i] for i, n in taken.items())


def test_packing_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter()
    for r in rows(stages["mixing"]):
        n = len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1
        for k, lo in enumerate(range(0, n, 2048)):
            want[r[0], k, lo, min(2048, n - lo)] += 1
    out = stages["packing"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(by) <= -(-sum(r.length for r in out) // 2048) + 1


def test_run_gives_what_the_stages_give(spark, folder, stages):
    key = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(P.run(spark, folder[0])) == key(stages["packing"])


def test_registration():
    import __spark_entry__ as E
    q = E.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in q if re.match(r"op\d+_", k)}
    assert "pipeline" in q and set(plans.oracle_sql()) <= set(q) and P.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    res = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in res.description]
    df = plans.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(res.fetchall())


def test_the_rest_does_not_import_this_subpackage():
    for p in [*ROOT.glob("answer_eval/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr                      # without a session


def test_no_python_on_the_native_main_paths(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("op4_chat_format", "op5_line_dedup", "op9_source_mixing"):
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan), name
