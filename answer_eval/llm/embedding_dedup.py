"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are compared only within one label (and one number of components).  Two are
linked if their cosine, in double precision, is at least ``threshold``.

1. Equal vectors of a label are one class; its least vec_id stands for it.
2. A class's vector is normalised and hashed in ``tables`` tables; a table's key is
   ``projections`` Gaussian projections, shifted and quantised by ``width``.  Unit vectors at
   the threshold are sqrt(2 - 2 * threshold) apart, where one projection agrees with
   probability p = 1 - 2 Phi(-w/c) - 2c / (sqrt(2 pi) w) (1 - exp(-w^2 / 2c^2)); at the
   defaults p = 0.851 and a pair of cosine 0.93 is missed by all tables with
   probability 0.0009, one of 0.95 with 0.00003.
3. Keys with two classes or more are compared exactly, as matrix products of blocks of
   ``BLOCK`` members.  Classes that are close share many tables, often as the same set: of keys
   with equal members (two 64-bit checksums and the number) only the first table's is compared.
   A pair counts in the first table that it shares, so it counts
   once; that table's set can not be one of an earlier table.  A block pair emits a row per member that found links: how many vectors they
   stand for, and the least id they tie it to; pairs are never written.
4. The ties give components.

Cases: null label or vec_id, null, empty or zero vector, null or non-finite
components: linked with nothing, a component of its own (kept); rows that repeat a
vec_id are vectors of their own that share a node; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from answer_eval.llm.common import Scratch, mix, prepare
from answer_eval.llm.components import components

TABLES, PROJECTIONS, WIDTH = 64, 14, 2.0
BLOCK = 1024


def _vectors(kind):
    """(vec_id, label, embedding) to the components' bytes, in their own precision, and their digest,
    null where a vector can't be linked."""
    def rows(batches):
        for b in batches:
            vecs, digests = [], []
            for label, v, key in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(0).to_pylist()):
                x = None
                if label is not None and key is not None and v and None not in v:
                    x = np.asarray(v, kind)
                    x = x.tobytes() if np.isfinite(x).all() and x.any() else None
                vecs.append(x)
                digests.append(hashlib.md5(x).digest() if x else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(vecs, pa.binary()), pa.array(digests, pa.binary())],
                names=["vec_id", "label", "vec", "digest"])
    return rows


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, rows: np.ndarray, kind) -> np.ndarray:
    return np.stack([np.frombuffer(column[int(k)].as_buffer(), kind) for k in rows]).astype(np.float64)


def table_keys(unit: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """The 64-bit key of every row in every table."""
    rng = np.random.default_rng(unit.shape[1])
    a = rng.standard_normal((unit.shape[1], tables * projections))
    b = rng.uniform(0, width, tables * projections)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(-1, tables, projections)
    key = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), cells.shape[:2])
    for p in range(projections):
        key = mix(key + cells[:, :, p] * np.uint64(0x9E3779B97F4A7C15))
    return key


def _keys(tables: int, projections: int, width: float, kind):
    """(cid, label, rep, m, vec) to those and the table keys, the label and size mixed in."""
    def rows(batches):
        for b in batches:
            size = np.array([len(v) // np.dtype(kind).itemsize for v in b.column(4).to_pylist()], np.int64)
            label = np.array([int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little")
                              for x in b.column(1).to_pylist()], np.uint64)
            keys = np.zeros((b.num_rows, tables), np.uint64)
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                keys[own] = table_keys(_unit(_matrix(b.column(4), own, kind)), tables, projections, width)
            keys = mix(keys + (mix(label) ^ size.astype(np.uint64))[:, None])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables),
                                             pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "keys"])
    return rows


def _compare(threshold: float, kind):
    """Input sorted by (key, i, j): members (table, part, class, rep, m, vec, keys) of one block
    pair.  Emits (class, links, rep, root)."""
    def one(rows):
        if len(rows) < 2:
            return None
        i, j, t = (rows.column(c)[0].as_py() for c in (1, 2, 3))
        part = rows.column(4).to_numpy(zero_copy_only=False)
        m = rows.column(7).to_numpy(zero_copy_only=False)
        every = np.arange(len(rows))
        left, right = every[part == i], every[part == j]
        if not len(left) or not len(right):
            return None
        unit = _unit(_matrix(rows.column(8), every, kind))
        a, b = np.nonzero(unit[left] @ unit[right].T >= threshold)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        if t and len(a):
            keys = rows.column(9)
            width = len(keys[0])
            keys = keys.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[:, :t]
            new = np.ones(len(a), bool)
            for lo in range(0, len(a), 100_000):
                s = slice(lo, lo + 100_000)
                new[s] = ~(keys[a[s]] == keys[b[s]]).any(axis=1)
            a, b = a[new], b[new]
        if not len(a):
            return None
        links = np.bincount(a, m[b], len(rows)) + np.bincount(b, m[a], len(rows))
        ids = rows.column(6).to_numpy(zero_copy_only=False)
        root = ids.copy()
        while True:                                  # least id along the links
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            if (least == root).all():
                break
            root = least
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [rows.column(5).take(pa.array(hit)), pa.array(links[hit].astype(np.int64)), pa.array(ids[hit]),
             pa.array(root[hit])], names=["cid", "links", "rep", "root"])

    def make(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            t = (now if held is None else pa.concat_tables([held, now])).combine_chunks().to_batches()[0]
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


def embedding_dedup(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES,
                    projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """One row per row of vectors (vec_id: long, label, embedding): vec_id, n_links,
    component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    prepare(spark)
    scratch = Scratch(spark, "embedding-dedup")
    c = F.col
    kind = vectors.schema["label"].dataType.simpleString()
    number = np.float32 if vectors.schema["embedding"].dataType.elementType == FloatType() else np.float64
    v = scratch.keep(vectors.select(c("vec_id").cast("long"), "label", "embedding").mapInArrow(
        _vectors(number), f"vec_id long, label {kind}, vec binary, digest binary"), "vectors")
    usable = v.where("digest is not null")
    reps = scratch.keep(usable.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")),
                        "reps")
    heads = usable.join(reps, ["label", "digest"]).where("vec_id = rep") \
        .dropDuplicates(["label", "digest"]) \
        .select(F.xxhash64("label", "digest").alias("cid"), "label", "rep", "m", "vec")
    classes = scratch.keep(heads.mapInArrow(
        _keys(tables, projections, width, number), f"cid long, label {kind}, rep long, m long, vec binary, keys array<long>"), "classes")

    every = classes.select("cid", F.posexplode("keys").alias("t", "key"))
    sums = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"sum{k}") for k in (0, 1)]
    full = every.groupBy("key").agg(F.count("*").alias("n"), F.min("t").alias("t"), *sums).where("n > 1") \
        .groupBy("n", "sum0", "sum1").agg(F.min_by("key", F.struct("t", "key")).alias("key")) \
        .select("key", F.ceil(c("n") / BLOCK).cast("int").alias("parts"))
    members = every.join(scratch.keep(full, "keys"), "key") \
        .withColumn("part", F.pmod(F.xxhash64("cid"), c("parts")).cast("int")) \
        .withColumn("x", F.explode(F.sequence(F.lit(0), c("parts") - 1))) \
        .select("key", F.least("part", "x").alias("i"), F.greatest("part", "x").alias("j"), "t", "part", "cid")
    pairs = members.join(classes.select("cid", "rep", "m", "vec", "keys"), "cid") \
        .select("key", "i", "j", "t", "part", "cid", "rep", "m", "vec", "keys") \
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = scratch.keep(pairs.mapInArrow(_compare(threshold, number), "cid long, links long, rep long, root long"), "found")
    for t in ("classes", "keys"):
        scratch.drop(t)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    ties = found.where("rep <> root").select(c("rep").alias("u"), c("root").alias("v"))
    # a vec_id that stands in several classes ties them together
    own = usable.join(reps, ["label", "digest"]).select("vec_id", "rep").distinct()
    lows = own.groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    again = own.join(lows, "vec_id").where("rep <> lo").select(c("lo").alias("u"), c("rep").alias("v"))
    roots = components(spark, ties.union(again), scratch)
    per_class = reps.join(links, F.xxhash64("label", "digest") == c("cid"), "left").join(roots, c("rep") == c("node"), "left") \
        .select(c("label").alias("of"), c("digest").alias("d"), F.coalesce("root", "rep").alias("component"),
                (c("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = v.join(per_class, (c("label") == c("of")) & (c("digest") == c("d")), "left") \
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", c("vec_id").eqNullSafe(c("component_id")))
