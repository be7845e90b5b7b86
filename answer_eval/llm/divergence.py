"""Audit of how the sources of a language differ in their terms.

Terms are runs of letters (A-Z lower-cased, every character beyond ASCII counts as one); a
language keeps the terms that at least ``min_docs`` of its documents hold.

* Frequency filter.  A task counts in how many of its documents a (language, term) occurs and
  the sums of all tasks decide, exactly.
* Perfect hashes.  The kept (language, term) pairs are dealt into shards of about
  ``SHARD_KEYS``; each shard gets a minimal perfect hash with its keys stored in slot order.
* Recount.  A second pass over the documents looks every term up in the shards of the
  commonest terms, which are broadcast: as many as fit ``broadcast_bytes``, whatever
  the size of the vocabulary.  A verified hit adds to a dense array of the shard's slots, one per
  (language, source); a task holds at most ``DENSE_CELLS`` cells and writes them out beyond.
  What is no key of these shards is counted by name and meets the other shards, which are not
  broadcast, in a shuffle on the shard: a task streams one shard after the other and counts
  into the dense slots of one group at a time.  With a vocabulary that fits, nothing is left
  to shuffle.
* Divergence.  The share of a term is p = 1 + floor(10**9 (count + 1) / (N + V)) in whole
  numbers, the distance of a share p from q is f = floor((p - q)**2 / q).  The sum of f over all
  kept terms of a pair of sources needs no row for a term that both lack: with z the share of
  a count of 0 it is V f(z, z') plus, for the terms that one or both hold, the differences
  to that.  Terms that one holds enter by their histogram of shares, terms that both hold by an
  equi-join on the slot, added up at once.

Cases: null text, lang and source read as ''; groups without terms are groups; a language
without kept terms has pairs of value 0 and no terms; a language with one source has no
pairs; repeated rows are documents each; an empty table gives an empty result; other columns
are not read; long texts are cut into pieces between terms.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answer_eval.llm.common import Scratch, prepare, utf8
from answer_eval.llm.perfect_hash import PerfectHash, binary, hashes

# [^\x00-\x40\x5B-\x60\x7B-\x7F]+, on the UTF-8 bytes of a text whose A-Z are lower-cased
TERM = re.compile(rb"[a-z\x80-\xff]+")
OTHER = re.compile(rb"[^a-z\x80-\xff]")
PIECE = 1 << 20             # bytes of a text searched at once
HELD = 300_000              # entries counted by name before a task writes them out
SHARD_KEYS = 20_000
DENSE_CELLS = 24_000_000    # 96 MB of counts
KEY_BYTES = 16              # of a key in a shard, beside its own
ONE = 1_000_000_000


def terms(text: bytes):
    """The terms of a text, in lists of a bounded piece each."""
    text = text.lower()                 # changes A-Z only
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            gap = OTHER.search(text, at + PIECE)
            end = gap.start() if gap else end
        yield TERM.findall(text, at, end)
        at = end


def _texts(column: pa.Array) -> list[bytes]:
    raw, off = utf8(column)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _keys(lang: str, names: list[bytes]) -> list[bytes]:
    head = lang.encode() + b"\0"        # no term holds a zero byte
    return [head + t for t in names]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n): documents of a language that hold a term, from (lang, text)."""
    def rows(held):
        for lang, c in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(c), pa.string()), binary(list(c)).cast(pa.string()),
                 pa.array(list(c.values()), pa.int64())], names=["lang", "term", "n"])

    def run(batches):
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                own: set[bytes] = set()
                for piece in terms(text):
                    own.update(piece)
                held.setdefault(lang, Counter()).update(own)
                if sum(map(len, held.values())) > HELD:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long") \
        .groupBy("lang", "term").agg(F.sum("n").alias("n"))


def build_shards(kept: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, int, int]:
    """(shards, number of broadcast ones, number of others): the first hold the commonest terms.
    ``kept`` has (lang, term, n)."""
    level = F.floor(F.log2("n") * 8).cast("int")
    size = F.octet_length("lang") + F.octet_length("term") + 1 + KEY_BYTES
    tiers = kept.groupBy(level.alias("level")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")) \
        .collect()                                       # at most 8 x 64 rows
    room, cut, common, rest = broadcast_bytes, None, 0, 0
    for r in sorted(tiers, key=lambda r: -r["level"]):
        if rest == 0 and r["bytes"] <= room:
            room, cut, common = room - r["bytes"], r["level"], common + r["n"]
        else:
            rest += r["n"]
    heads, tails = -(-common // SHARD_KEYS), -(-rest // SHARD_KEYS)

    def place(batches):
        for b in batches:
            keys = [k for lang, t in zip(b.column(0).to_pylist(), _texts(b.column(1))) for k in _keys(lang, [t])]
            h, common_ = hashes(binary(keys)), b.column(2).to_numpy(zero_copy_only=False)
            shard = np.where(common_, h % np.uint64(max(1, heads)), h % np.uint64(max(1, tails)) + np.uint64(heads))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), binary(keys)], names=["shard", "key"])

    def build(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_pylist()
        made = PerfectHash.build(sorted(keys))
        return pa.table({"shard": pa.array(group.column("shard").to_pylist()[:1], pa.int32()),
                         **{c: pa.array([v], t) for c, v, t in zip(
                             ("n", "sizes", "bits", "ends", "keys"), made,
                             (pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()))}})

    is_common = F.lit(False) if cut is None else level >= cut
    placed = kept.select("lang", "term", is_common.alias("common")).mapInArrow(place, "shard int, key binary")
    shards = placed.groupBy("shard").applyInArrow(build, f"shard int, {PerfectHash.COLUMNS}")
    return shards, heads, tails


def vocabulary(shards: DataFrame) -> DataFrame:
    """(slot, lang, term) of all shards; a slot is its shard and its place there."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                table = PerfectHash(r["sizes"], r["bits"], r["ends"], r["keys"])
                pairs = [k.rsplit(b"\0", 1) for k in table.keys.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(pairs)) + (r["shard"] << 32)),
                     binary([p[0] for p in pairs]).cast(pa.string()),
                     binary([p[1] for p in pairs]).cast(pa.string())], names=["slot", "lang", "term"])

    return shards.mapInArrow(run, "slot long, lang string, term string")


# Counts on their way: a row per (shard, group) and write-out of a task.  ``items`` are slots (int32)
# of a broadcast shard, or terms joined by a line feed, which no term holds.
_PACKED = "shard int, lang string, source string, named boolean, items binary, counts binary"
_COUNTS = "lang string, source string, slot long, n long"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      names=["shard", "lang", "source", "named", "items", "counts"])


def recount(spark: SparkSession, docs: DataFrame, shards: DataFrame, heads: int, tails: int) -> DataFrame:
    """``_PACKED`` rows from (lang, source, text): hits of broadcast shards by slot; terms that may be
    keys of the other shards by name."""
    rows = shards.where(F.col("shard") < heads).orderBy("shard").collect()   # within the broadcast's bound
    shared = spark.sparkContext.broadcast([(r["shard"], r["sizes"], bytes(r["bits"]), bytes(r["ends"]),
                                            bytes(r["keys"])) for r in rows])

    def by_slot(pages):
        out = []
        for (group, shard), cells in pages.items():
            at = np.flatnonzero(cells)
            out.append((shard, *group, False, at.astype(np.int32).tobytes(), cells[at].astype(np.int64).tobytes()))
        for i in range(0, len(out), 500):
            yield _packed(out[i:i + 500])

    def by_name(held):
        for (lang, source), c in held.items():
            names, counts = list(c), np.fromiter(c.values(), np.int64, len(c))
            shard = (hashes(binary(_keys(lang, names))) % np.uint64(tails)).astype(np.int64) + heads
            order = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.diff(shard[order])) + 1
            out = [(int(shard[own[0]]), lang, source, True, b"\n".join([names[i] for i in own.tolist()]),
                    counts[own].tobytes()) for own in np.split(order, cut) if len(own)]
            if out:
                yield _packed(out)

    def find(tables, lang, names):
        """(shard, slot) of the names, slot -1 where a broadcast shard does not hold one."""
        keys = binary(_keys(lang, names))
        h = hashes(keys)
        shard = (h % np.uint64(max(1, heads))).astype(np.int64)
        slot = np.full(len(names), -1, np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        for own in np.split(order, cut):
            if len(own) and int(shard[own[0]]) in tables:
                slot[own] = tables[int(shard[own[0]])].find(keys.take(pa.array(own)), h[own])
        return shard, slot

    def run(batches):
        tables = {shard: PerfectHash(*parts) for shard, *parts in shared.value}
        pages: dict[tuple, np.ndarray] = {}
        held: dict[tuple, Counter] = {}
        cells = seen = names_held = 0
        for b in batches:
            found: dict[str, dict[str, Counter]] = {}
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2))):
                c = found.setdefault(lang, {}).setdefault(source, Counter())
                for piece in terms(text):
                    c.update(piece)
                    seen += len(piece)
            for lang, sources in found.items():
                # every term of the batch is looked up once
                place = {t: i for i, t in enumerate(set().union(*sources.values()))}
                shard, slot = find(tables, lang, list(place))
                for source, c in sources.items():
                    at = np.fromiter(map(place.__getitem__, c), np.int64, len(c))
                    counts, known = np.fromiter(c.values(), np.int64, len(c)), slot[at] >= 0
                    own, ns = at[known], counts[known]
                    for s in np.unique(shard[own]).tolist():
                        page = pages.get(((lang, source), s))
                        if page is None:
                            page = pages[(lang, source), s] = np.zeros(len(tables[s]), np.int32)
                            cells += len(page)
                        one = shard[own] == s
                        page[slot[own[one]]] += ns[one].astype(np.int32)
                    if tails:
                        left = held.setdefault((lang, source), Counter())
                        names_held -= len(left)
                        left.update({t: n for t, n, k in zip(c, c.values(), known.tolist()) if not k})
                        names_held += len(left)
            if cells > DENSE_CELLS or seen > 1 << 30:
                yield from by_slot(pages)
                pages, cells, seen = {}, 0, 0
            if names_held > HELD:
                yield from by_name(held)
                held, names_held = {}, 0
        yield from by_slot(pages)
        yield from by_name(held)

    return docs.select("lang", "source", "text").mapInArrow(run, _PACKED)


def _streamed(rows: DataFrame, parts: int, *keys: str):
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


class _Cells:
    """The dense slots of the group that streams by."""

    def __init__(self):
        self.group, self.cells = None, None

    def add(self, group, slots, counts):
        """Yields the finished group's rows when the next one begins."""
        if group != self.group:
            yield from self.rows()
            self.group, self.cells = group, np.zeros(SHARD_KEYS, np.int64)
        if len(slots) and int(slots.max()) >= len(self.cells):
            self.cells = np.concatenate([self.cells, np.zeros(int(slots.max()) + 1, np.int64)])
        self.cells[slots] += counts             # slots of one row are distinct

    def rows(self):
        if self.group is not None:
            shard, lang, source = self.group
            at = np.flatnonzero(self.cells)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), len(at)), pa.repeat(pa.scalar(source, pa.string()), len(at)),
                 pa.array(at + (shard << 32)), pa.array(self.cells[at])], names=["lang", "source", "slot", "n"])


def by_slot(hits: DataFrame, parts: int) -> DataFrame:
    """Rows by slot summed to (lang, source, slot, n), one group's dense slots of a shard at a time."""
    def run(batches):
        sums = _Cells()
        for b in batches:
            for shard, lang, source, items, counts in zip(*(b.column(i).to_pylist() for i in range(5))):
                yield from sums.add((shard, lang, source), np.frombuffer(items, np.int32),
                                    np.frombuffer(counts, np.int64))
        yield from sums.rows()

    rows = hits.where("not named").select("shard", "lang", "source", "items", "counts")
    return _streamed(rows, parts, "shard", "lang", "source").mapInArrow(run, _COUNTS)


def resolve(hits: DataFrame, shards: DataFrame, heads: int, parts: int) -> DataFrame:
    """Terms counted by name -> (lang, source, slot, n): every shard streams through one task, its keys
    first, then its counts group by group."""
    none = lambda kind: F.lit(None).cast(kind)
    keys = shards.where(F.col("shard") >= heads).select(
        "shard", F.lit(0).alias("kind"), F.lit("").alias("lang"), F.lit("").alias("source"),
        "keys", "ends", "bits", "sizes")
    counts = hits.where("named").select(
        "shard", F.lit(1).alias("kind"), "lang", "source", F.col("items").alias("keys"), F.col("counts").alias("ends"),
        none("binary").alias("bits"), none("array<int>").alias("sizes"))
    both = keys.unionByName(counts).repartition(parts, "shard").sortWithinPartitions("shard", "kind", "lang", "source")

    def counted(table, rows, sums):
        """Looks the terms of many rows of one shard up at once."""
        keys, bounds = [], [0]
        for _, lang, _, items, _ in rows:
            keys += _keys(lang, items.split(b"\n"))
            bounds.append(len(keys))
        keys = binary(keys)
        slot = table.find(keys, hashes(keys))
        for (shard, lang, source, _, counts), lo, hi in zip(rows, bounds, bounds[1:]):
            hit = slot[lo:hi] >= 0
            yield from sums.add((shard, lang, source), slot[lo:hi][hit], np.frombuffer(counts, np.int64)[hit])

    def run(batches):
        table, at, sums = None, None, _Cells()
        for b in batches:
            rows = []
            for shard, kind, lang, source, items, ends, bits, sizes in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    if rows:
                        yield from counted(table, rows, sums)
                    table, at, rows = PerfectHash(sizes, bits, ends, items), shard, []
                elif shard == at:               # else no key was dealt to this shard
                    rows.append((shard, lang, source, items, ends))
            if rows:
                yield from counted(table, rows, sums)
        yield from sums.rows()

    return both.mapInArrow(run, _COUNTS)


def _share(n: str, total: str, v: str) -> F.Column:
    """1 + floor(10**9 (n + 1) / (total + v)), in whole numbers beyond 64 bits."""
    return F.expr(f"1 + (cast({ONE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) "
                  f"div cast({total} + {v} as decimal(20,0))").cast("long")


def _apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _sums(x: str, name: str) -> list[F.Column]:
    """Sums of the high and the low half of a long, so that no sum of longs overflows."""
    return [F.sum(F.expr(f"shiftright({x}, 32)")).alias(f"{name}_high"),
            F.sum(F.expr(f"({x}) & 4294967295L")).alias(f"{name}_low")]


def _sum(name: str) -> F.Column:
    return F.expr(f"cast({name}_high as decimal(19,0)) * 4294967296 + {name}_low").cast("decimal(38,0)")


def divergence(groups: DataFrame, counts: DataFrame, words: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """(lang, source, part, item, value, rank) from the groups (lang, source), their positive counts
    (lang, source, slot, n) and the vocabulary (slot, lang, term)."""
    c = F.col
    sizes = words.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    g = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left") \
        .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total")) \
        .withColumn("z", F.when(c("v") > 0, _share("0", "total", "v")))
    g = scratch.keep(g, "shares-of-none")
    held = scratch.keep(counts.join(g, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
                        .select("lang", "source", "slot", "p", "z"), "shares")
    a, b = ([c(x).alias(f"{x}_{side}") for x in ("source", "slot", "p", "z")] for side in "ab")
    pair = ["lang", "source_a", "source_b"]
    # terms that both hold, beyond what the other three parts count for them; each pair once for both directions
    beyond = lambda x, y: (f"{_apart(f'p_{x}', f'p_{y}')} - {_apart(f'p_{x}', f'z_{y}')} "  # noqa: E731
                           f"- {_apart(f'z_{x}', f'p_{y}')} + {_apart(f'z_{x}', f'z_{y}')}")
    both = held.select("lang", *a).join(
        held.select(c("lang").alias("lang_b"), *b), c("slot_a") == c("slot_b")).where("source_a < source_b") \
        .groupBy(*pair).agg(*_sums(beyond("a", "b"), "to"), *_sums(beyond("b", "a"), "back"))
    both = scratch.keep(both.select(*pair, _sum("to").alias("to"), _sum("back").alias("back")), "common")
    common = both.select(*pair, c("to").alias("value")).union(
        both.select("lang", "source_b", "source_a", c("back").alias("value")))
    ga = g.select("lang", c("source").alias("source_a"), "v", c("z").alias("z_a"))
    gb = g.select("lang", c("source").alias("source_b"), c("z").alias("z_b"))
    pairs = ga.join(gb, "lang").where("source_a <> source_b")
    lacking = pairs.select(*pair, F.when(c("v") > 0, F.expr(f"cast(v as decimal(20,0)) * {_apart('z_a', 'z_b')}"))
                           .otherwise(0).cast("decimal(38,0)").alias("value"))
    shares = held.groupBy("lang", "source", "p").agg(F.first("z").alias("z"), F.count("*").alias("k"))
    own = shares.select("lang", c("source").alias("source_a"), c("p").alias("p_a"), c("z").alias("z_a"), "k") \
        .join(gb, "lang").where("source_a <> source_b").groupBy(*pair) \
        .agg(*_sums(f"k * ({_apart('p_a', 'z_b')} - {_apart('z_a', 'z_b')})", "s")).select(*pair, _sum("s").alias("value"))
    other = shares.select("lang", c("source").alias("source_b"), c("p").alias("p_b"), c("z").alias("z_b"), "k") \
        .join(ga, "lang").where("source_a <> source_b").groupBy(*pair) \
        .agg(*_sums(f"k * ({_apart('z_a', 'p_b')} - {_apart('z_a', 'z_b')})", "s")).select(*pair, _sum("s").alias("value"))
    summed = lacking.unionByName(common).unionByName(own).unionByName(other) \
        .groupBy(*pair).agg(F.sum("value").cast("long").alias("value"))
    by = W.partitionBy("lang", "source").orderBy(c("value").desc(), c("item"))
    sources = summed.select("lang", c("source_a").alias("source"), F.lit("pair").alias("part"),
                            c("source_b").alias("item"), "value").withColumn("rank", F.row_number().over(by))

    whole = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")) \
        .join(totals.groupBy("lang").agg(F.sum("total").alias("total")), "lang").join(sizes, "lang") \
        .select("slot", _share("n", "total", "v").alias("q"))
    above = held.join(whole, "slot").where("p > q").select("lang", "source", "slot", F.expr(_apart("p", "q")).alias("value"))
    ranked = above.join(words.select("slot", c("term").alias("item")), "slot") \
        .select("lang", "source", F.lit("term").alias("part"), "item", "value") \
        .withColumn("rank", F.row_number().over(by)).where(c("rank") <= top)
    return sources.unionByName(ranked)


def divergence_audit(spark: SparkSession, docs: DataFrame, min_docs: int = 3, top: int = 200,
                     broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The audit of docs (text, lang, source): lang, source, part, item, value, rank.

    part ``pair``: item is another source of the language, value the sum of the distances of the
    source's shares from the other's over all kept terms.  part ``term``: item is a kept term that the
    source holds in a larger share than its language, value the distance; the ``top`` first."""
    prepare(spark)
    scratch = Scratch(spark, "divergence")
    read = docs.select(*[F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("lang", "source", "text")])
    kept = scratch.keep(document_frequencies(read).where(F.col("n") >= min_docs), "kept")
    built, heads, tails = build_shards(kept, broadcast_bytes)
    shards = scratch.keep(built, "shards")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hits = scratch.keep(recount(spark, read, shards, heads, tails), "hits")
    slots = by_slot(hits, parts)
    if tails:
        slots = slots.unionByName(resolve(hits, shards, heads, parts))
    counts = scratch.keep(slots, "counts")
    for done in ("kept", "hits"):
        scratch.drop(done)
    words = scratch.keep(vocabulary(shards), "words")
    groups = scratch.keep(read.select("lang", "source").distinct(), "groups")
    return divergence(groups, counts, words, top, scratch)
