"""MinHash near-dedup with odd sketches.

A document's set is its distinct ``shingle``-word shingles (words as they are but
A-Z in lower case); with fewer words, the whole sequence is its one shingle.  Two
documents are linked if |intersection| >= ``threshold`` * |union|.

1. Per document: set size, digest of the sorted shingle hashes, MinHash values in
   ``bands`` bands of ``rows``, and an odd sketch: a parity bitmap of ``bits`` bits in
   which every (position, MinHash value) flips one bit.
2. Documents with equal sets are one class; its least doc_id stands for it.
3. Band keys with two classes or more give candidates, first (member, least member)
   of each key: as many as there are memberships.  A candidate lives if the XOR
   population count of the two sketches says a similarity of at least
   ``threshold - slack``, and is a link if the full sets confirm it.
4. Links give components.  Keys whose members lie in several components by then
   are compared in full, in blocks of ``BLOCK`` members, the count of an XOR deciding
   again which pairs to look at; sets of 32-bit hashes say which of those the full
   sets have to confirm.  Pairs inside a component are never formed and no other pair
   is written, so a large group of copies costs a row per membership.

Cases: null or wordless text: size 0, linked with nothing; null doc_id: a
component of its own (component_id null, kept); rows that repeat a doc_id are one
node with all their sets; an empty table gives an empty result; other columns are
not read.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.llm.common import Scratch, WordHash, mix, prepare, utf8, word_spans
from answer_eval.llm.components import components

BANDS, ROWS, BITS, SLACK = 32, 5, 512, 0.25
BLOCK = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_HASH: list[WordHash] = []


def shingle_sets(column, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a string column."""
    if not _HASH:
        _HASH.append(WordHash(2))
    raw, off = utf8(column)
    raw = _LOWER[raw]
    start, end, doc = word_spans(raw, off)
    h = _HASH[0](raw, start, end)
    bounds = np.searchsorted(doc, np.arange(len(off)))
    out = []
    if len(h) >= shingle:
        g = h[:len(h) - shingle + 1]
        for j in range(1, shingle):
            g = g * _BASE + h[j:len(h) - shingle + 1 + j]
        g = mix(g)
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if j - i >= shingle:
            out.append(np.unique(g[i:j - shingle + 1]))
        elif j > i:
            x = np.uint64(j - i)
            for k in range(i, j):
                x = (np.asarray([x]) * _BASE + h[k:k + 1])[0]
            out.append(mix(np.asarray([x ^ np.uint64(0x2545F4914F6CDD1D)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k MinHash values of every non-empty set."""
    rng = np.random.default_rng(5)
    a = (rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    b = rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]
    out = np.full((len(sets), k), np.uint32(0xFFFFFFFF))
    for n, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(out[n], (a * x[at:at + 2048] + b).min(axis=1), out=out[n])
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _BASE, (len(sig), bands))
    for r in range(rows):
        key = mix(key ^ v[:, :, r]) * _BASE + v[:, :, r]
    return mix(key)


def odd_sketches(sig: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps, packed to bytes."""
    n, k = sig.shape
    x = mix(sig.astype(np.uint64) + np.arange(1, k + 1, dtype=np.uint64) * _BASE)
    cell = (x % np.uint64(bits)).astype(np.int64) + np.arange(n)[:, None] * bits
    parity = (np.bincount(cell.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, bits), axis=1)


def max_xor(bits: int, k: int, similarity: float) -> int:
    """The XOR population count that sets of this similarity give on average: with
    2k(1 - s) flips, bits / 2 * (1 - (1 - 2 / bits) ** flips)."""
    return math.floor(bits / 2 * (1 - (1 - 2 / bits) ** (2 * k * (1 - similarity))))


def _rows(shingle: int, bands: int, rows: int, bits: int):
    def make(batches):
        for b in batches:
            sets = shingle_sets(b.column(1), shingle)
            size = np.array([len(s) for s in sets], np.int64)
            sig = signatures(sets, bands * rows)
            keys = band_keys(sig, bands, rows).view(np.int64)
            sk = odd_sketches(sig, bits)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands),
                                            pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size),
                 pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                 keys, pa.array([x.tobytes() for x in sk], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch"])
    return make


def _bitmaps(column: pa.Array) -> np.ndarray:
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]]
    return raw.reshape(len(column), -1)


def _alike(limit: int, num: int, den: int):
    """Keeps the pairs (a, b, n_a, n_b, s_a, s_b) whose sizes and sketches allow the threshold."""
    def keep(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n_a, n_b = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ok = np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num
            ok &= np.bitwise_count(_bitmaps(b.column(4)) ^ _bitmaps(b.column(5))).sum(axis=1) <= limit
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))
    return keep


def _confirm(shingle: int, num: int, den: int):
    """Keeps the pairs (a, b, text_a, text_b) whose full sets reach the threshold; rows with
    one ``a`` mostly stand together, so its set is built once."""
    def keep(batches):
        for b in batches:
            if not b.num_rows:
                continue
            left = b.column(0).to_pylist()
            heads = [i for i in range(len(left)) if i == 0 or left[i] != left[i - 1]]
            own = shingle_sets(b.column(2).take(pa.array(heads)), shingle)
            others = shingle_sets(b.column(3), shingle)
            ok, k = np.zeros(len(left), bool), -1
            for i, y in enumerate(others):
                if k + 1 < len(heads) and heads[k + 1] == i:
                    k += 1
                x = own[k]
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                ok[i] = both > 0 and den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok))
    return keep


def _small_sets(shingle: int):
    """(id, text) to the sorted distinct low 32 bits of the shingle hashes."""
    def make(batches):
        for b in batches:
            sets = [np.unique(x.astype(np.uint32)).tobytes() for x in shingle_sets(b.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "low"])
    return make


def _block_links(limit: int, num: int, den: int):
    """Input sorted by (key, i, j): the members (id, part, comp, n, sketch, low) of one block pair
    stand together, 2 * BLOCK or so of them.  Members of different components that sizes
    and sketches allow are compared by their low bits; what is alike is emitted, to be
    confirmed on full sets, and joins its components, so that no pair inside one is formed.
    Where the low bits leave the threshold open, a pair is emitted without joining."""
    def one(rows):
        if len(rows) < 2:
            return None
        part, comp, n = (rows.column(c).to_numpy(zero_copy_only=False).copy() for c in (4, 5, 6))
        bits = _bitmaps(rows.column(7))
        low = rows.column(8)
        off = np.frombuffer(low.buffers()[1], np.int32)[low.offset:low.offset + len(low) + 1] // 4
        flat = np.frombuffer(low.buffers()[2], np.uint32, count=int(off[-1]))
        i, j = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
        left = np.flatnonzero(part == i)
        right = left if i == j else np.flatnonzero(part == j)
        found = []
        for at, p in enumerate(left.tolist()):
            q = right[at + 1:] if i == j else right
            q = q[comp[q] != comp[p]]
            q = q[np.minimum(n[q], n[p]) * den >= np.maximum(n[q], n[p]) * num]
            if not len(q):
                continue
            apart = np.bitwise_count(bits[q] ^ bits[p]).sum(axis=1)
            q = q[np.argsort(apart, kind="stable")][:int((apart <= limit).sum())]
            own = flat[off[p]:off[p + 1]]
            for r in q.tolist():                       # the most alike first
                if comp[r] == comp[p]:
                    continue
                other = flat[off[r]:off[r + 1]]
                k = np.searchsorted(own, other)
                both = int((own[np.minimum(k, len(own) - 1)] == other).sum())
                of = len(own) + len(other) - both
                if (den * both - num * of) * 100 < -den * of:
                    continue                           # more than 0.01 below
                found.append((p, r))
                if (den * both - num * of) * 100 > den * of:
                    comp[comp == comp[r]] = comp[p]    # more than 0.01 above
        if not found:
            return None
        ids = rows.column(3)
        return pa.RecordBatch.from_arrays([ids.take(pa.array([f[k] for f in found], pa.int64())) for k in (0, 1)],
                                          names=["a", "b"])

    def make(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks().to_batches()[0]
            k = [t.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            cut = np.flatnonzero((k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])) + 1
            cut = [0, *cut.tolist()]
            for lo, hi in zip(cut[:-1], cut[1:]):
                if (out := one(t.slice(lo, hi - lo))) is not None:
                    yield out
            held = pa.Table.from_batches([t.slice(cut[-1])])
        if held is not None and (out := one(held.combine_chunks().to_batches()[0])) is not None:
            yield out
    return make


def minhash_dedup(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100, shingle: int = 2,
                  bands: int = BANDS, rows: int = ROWS, bits: int = BITS, slack: float = SLACK,
                  leaders: int = 1) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (least doc_id
    reachable over links) and kept (doc_id = component_id).  The threshold is num / den."""
    if bits % 8 or not 0 < num <= den:
        raise ValueError("bits must be a multiple of 8 and 0 < num <= den")
    prepare(spark)
    scratch = Scratch(spark, "minhash-dedup")
    kind = docs.schema["doc_id"].dataType.simpleString()
    limit = max_xor(bits, bands * rows, max(0.0, num / den - slack))
    c = F.col

    signed = scratch.keep(
        docs.select("doc_id", "text").mapInArrow(
            _rows(shingle, bands, rows, bits),
            f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, sketch binary"), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    reps = scratch.keep(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
    heads = usable.join(reps.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi")

    # memberships of band keys with two classes or more
    every = heads.select(c("doc_id").alias("id"), F.explode("bands").alias("key"))
    order = [F.min(F.struct(F.xxhash64("id", F.lit(r)), c("id"))).getField("id").alias(f"l{r}")
             for r in range(leaders)]
    shared = every.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    places = scratch.keep(every.join(shared, "key", "left_semi"), "places")
    lead = places.groupBy("key").agg(F.count("*").alias("n"), *order)

    wanted = places.select(c("id").alias("doc_id")).distinct()
    sketches = scratch.keep(
        heads.join(wanted, "doc_id", "left_semi").select(c("doc_id").alias("id"), c("n_shingles").alias("n"), "sketch"),
        "sketches")
    texts = scratch.keep(
        docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        b = texts.select(c("doc_id").alias("b"), c("text").alias("text_b"))
        a = texts.select(c("doc_id").alias("a"), c("text").alias("text_a"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b") \
            .mapInArrow(_confirm(shingle, num, den), f"u {kind}, v {kind}")

    def side(name: str) -> DataFrame:
        return sketches.select(c("id").alias(name), c("n").alias(f"n_{name}"), c("sketch").alias(f"s_{name}"))

    # first links: every member against the leaders of its keys
    led = places.join(lead, "key").select("id", F.explode(F.array([c(f"l{r}") for r in range(leaders)])).alias("l"))
    first = led.where("id <> l").select(F.least("id", "l").alias("a"), F.greatest("id", "l").alias("b")).distinct()
    first = scratch.keep(
        first.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "s_a", "s_b")
        .mapInArrow(_alike(limit, num, den), f"a {kind}, b {kind}"), "first")
    links = scratch.keep(confirmed(first), "links-first")
    roots = components(spark, links, Scratch(spark, "minhash-first"))

    # keys that still span components: all pairs across components, in blocks
    comp = places.join(roots, c("id") == c("node"), "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    comp = scratch.keep(comp, "places-comp")
    open_ = comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")) \
        .where("lo < hi").select("key", F.ceil(c("n") / BLOCK).cast("int").alias("parts"))
    members = comp.join(scratch.keep(open_, "open"), "key")
    low = texts.select(c("doc_id").alias("id"), "text").join(members.select("id").distinct(), "id", "left_semi") \
        .mapInArrow(_small_sets(shingle), f"id {kind}, low binary")
    rest = members.join(sketches.join(low, "id"), "id") \
        .withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), c("parts")).cast("int")) \
        .withColumn("x", F.explode(F.sequence(F.lit(0), c("parts") - 1))) \
        .select("key", F.least("part", "x").alias("i"), F.greatest("part", "x").alias("j"), "id", "part", "comp",
                "n", "sketch", "low")
    pairs = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j") \
        .mapInArrow(_block_links(limit, num, den), f"a {kind}, b {kind}") \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = scratch.keep(pairs, "second")
    more = scratch.keep(confirmed(pairs), "links-second")
    for t in ("places", "sketches", "texts", "first", "places-comp", "open", "second"):
        scratch.drop(t)
    joined = links.union(more)
    # rows that repeat a doc_id with other texts tie their classes together
    own = usable.select("doc_id", "digest").join(reps, "digest").select("doc_id", "rep").distinct()
    several = own.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    ties = own.join(several, "doc_id").where("rep <> lo").select(c("lo").alias("u"), c("rep").alias("v"))
    roots = components(spark, joined.union(ties), scratch)
    for t in ("links-first", "links-second"):
        scratch.drop(t)
    class_root = reps.join(roots, c("rep") == c("node"), "left") \
        .select(c("digest").alias("of"), F.coalesce("root", "rep").alias("root"))
    return signed.join(class_root, (c("digest") == c("of")) & c("doc_id").isNotNull() & (c("n_shingles") > 0), "left") \
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")) \
        .withColumn("kept", c("doc_id").eqNullSafe(c("component_id")))
