"""Substring dedup by relative Lempel-Ziv parsing.

A document is a sequence of words; a window is ``width`` consecutive words of
it.  A window is a repeat if its word sequence also starts earlier: in a document
with a smaller id, or in the same document at an earlier word.  The parse factors
every document against the text before it:

* The reference is indexed in blocks.  Every window has an anchor, the least of
  its ``gram``-word hashes (leftmost on ties).  Consecutive windows with one
  anchor form a segment; the anchor names the block that holds all other
  occurrences of the segment's windows.  So looking a segment up in its block is
  looking it up in every block.
* Blocks whose anchor occurs once hold no repeat and go first, on rows of
  (anchor, doc, start) only.
* Equal segments are one class, pre-aggregated to their first occurrence; all
  later occurrences are matches of it.  Classes of one block are compared window
  by window, which finds matches that end inside a segment.
* Per document, adjacent matches on the same diagonal are joined greedily to
  factors (start, length, ref_doc, ref_start).  Windows across a factor boundary
  belong to segments of their own and are looked up like all others, so the next
  factor may begin up to ``width - 1`` words before the last one ends.

Factors of ``width`` words or more are the duplicate spans.  Words are compared
by hashes: 64 bits for the anchor and 64 more for the window.

Cases: null text or text without words gives no factors, zero counts and the hash
of the empty string; fewer than ``width`` words: nothing is removed; a null
doc_id sorts before all others; rows that repeat a doc_id come in the order of
their texts' hashes, and rows equal in both are one document, each with its
result; an empty table gives an empty result; other columns are not read.  A text of any length is
handled in blocks of ``BLOCK`` words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.llm.common import Scratch, WordHash, mix, prepare, same, utf8, word_spans

GRAM = 8
BLOCK = 1 << 22
_POS = np.uint64(24)          # low bits of a packed (hash, position); BLOCK + width < 2**24
_BASE = 0x9E3779B97F4A7C15


def _chain(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of n consecutive elements at every position, by doubling."""
    out, have, rest, parts = h, 1, n, []
    powers = h
    size = 1
    while rest:
        if rest & 1:
            parts.append((size, powers))
        rest >>= 1
        if rest:
            powers = powers[:-size] * np.uint64(pow(base, size, 1 << 64)) + powers[size:]
            size *= 2
    m = len(h) - n + 1
    acc, at = np.zeros(m, np.uint64), 0
    for size, p in parts:
        acc = acc * np.uint64(pow(base, size, 1 << 64)) + p[at:at + m]
        at += size
    return acc


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < n:
        out = np.minimum(out[:len(x) - n + 1], out[n - size:n - size + len(x) - n + 1])
    return out


def _blocks(doc: np.ndarray):
    """Ranges of words handled together: whole documents up to BLOCK words; a longer
    document is cut relative to its own start, so cuts never depend on the batch."""
    if len(doc) == 0:
        return
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.append(heads[1:], len(doc))
    lo = hi = heads[0]
    for s, e in zip(heads.tolist(), ends.tolist()):
        if e - s > BLOCK:
            if hi > lo:
                yield lo, hi, hi
            for p in range(s, e, BLOCK):
                yield p, min(p + BLOCK, e), e
            lo = hi = e
        elif e - lo > BLOCK:
            yield lo, hi, hi
            lo, hi = s, e
        else:
            hi = e
    if hi > lo:
        yield lo, hi, hi


def segments(h: np.ndarray, doc: np.ndarray, width: int, gram: int):
    """Yields (anchor hash, first window, windows, window hashes, base of those) per block;
    positions are indexes into h."""
    span = width - gram + 1
    for lo, hi, end in _blocks(doc):
        top = min(hi + width - 1, end)      # windows start in [lo, hi), words reach to top
        if top - lo < width:
            continue
        x, d = h[lo:top], doc[lo:top]
        m = len(x) - width + 1
        ok = d[width - 1:] == d[:m]
        if not ok.any():
            continue
        g = mix(_chain(x, gram, _BASE))
        packed = ((g >> _POS) << _POS) | np.arange(len(g), dtype=np.uint64)
        at = (_sliding_min(packed, span)[:m] & np.uint64((1 << 24) - 1)).astype(np.int64)
        win = mix(_chain(x, width, _BASE) ^ np.uint64(0x5851F42D4C957F2D))
        cut = np.flatnonzero(ok & np.concatenate([[True], (at[1:] != at[:-1]) | ~ok[:-1]]))
        valid = np.cumsum(ok)
        stop = np.append(cut[1:], m)
        count = valid[stop - 1] - valid[cut] + 1
        yield g[at[cut]], cut + lo, count, win, lo


_HASH: list[WordHash] = []


def _hashes(column) -> tuple[np.ndarray, ...]:
    if not _HASH:
        _HASH.append(WordHash(1))
    raw, off = utf8(column)
    start, end, doc = word_spans(raw, off)
    return raw, start, end, doc, _HASH[0](raw, start, end)


def _anchor_rows(width: int, gram: int):
    def rows(batches):
        for b in batches:
            ids = b.column(0)
            _, _, _, doc, h = _hashes(b.column(1))
            base = np.searchsorted(doc, np.arange(len(ids)))
            for a, first, _, _, _ in segments(h, doc, width, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), ids.take(pa.array(doc[first])),
                     pa.array((first - base[doc[first]]).astype(np.int64))],
                    names=["h", "doc_id", "start"])
    return rows


def _segment_rows(width: int, gram: int):
    """Input: doc_id, tag, text, starts (sorted); one row per wanted segment."""
    def rows(batches):
        for b in batches:
            ids, tags = b.column(0), b.column(1)
            _, _, _, doc, h = _hashes(b.column(2))
            lists = b.column(3)
            want = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            base = np.searchsorted(doc, np.arange(len(ids)))
            want = np.sort(want + base[owner])
            for a, first, count, win, lo in segments(h, doc, width, gram):
                hit = np.isin(first, want)
                a, first, count = a[hit], first[hit], count[hit]
                if not len(a):
                    continue
                step = np.repeat(first - lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                w = win[step + np.arange(int(count.sum()))]
                offsets = np.concatenate([[0], np.cumsum(count * 8)]).astype(np.int32)
                for at in range(0, len(a), 20000):   # bounded batches
                    i, j = at, min(at + 20000, len(a))
                    data = pa.Array.from_buffers(
                        pa.binary(), j - i,
                        [None, pa.py_buffer((offsets[i:j + 1] - offsets[i]).tobytes()),
                         pa.py_buffer(w[offsets[i] // 8:offsets[j] // 8].tobytes())])
                    d = pa.array(doc[first[i:j]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[i:j].view(np.int64)), data, ids.take(d), tags.take(d),
                         pa.array((first[i:j] - base[doc[first[i:j]]]).astype(np.int64))],
                        names=["h", "w", "doc_id", "tag", "start"])
    return rows


def _window_rows(batches):
    """One row per window of a class's first occurrence."""
    for b in batches:
        h, w, ids, tags, starts = (b.column(i) for i in range(5))
        _, off, data = w.buffers()
        off = np.frombuffer(off, np.int32)[w.offset:w.offset + len(w) + 1]
        count = np.diff(off) // 8
        row = np.repeat(np.arange(len(w)), count)
        r = np.frombuffer(data, np.uint8)[off[0]:off[-1]].tobytes()
        r = np.frombuffer(r, np.int64)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [h.take(take), pa.array(r), ids.take(take), tags.take(take),
             pa.array(starts.to_numpy(zero_copy_only=False)[row] + inside)],
            names=["h", "r", "doc_id", "tag", "start"])


def matches(spark: SparkSession, docs: DataFrame, scratch: Scratch, width: int = 20, gram: int = GRAM) -> DataFrame:
    """(doc_id, tag, start, windows, ref_doc, ref_start): ``windows`` repeated windows from
    word ``start`` on, first seen in ref_doc from word ref_start on.  ``tag`` is the
    hash of the text, which tells rows with equal doc_id apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", "text")
    anchors = scratch.keep(
        d.mapInArrow(_anchor_rows(width, gram), f"h long, doc_id {kind}, start long"), "anchors")
    # kept before they are joined: both sides of the join are then shuffled for it, and the
    # rows of a hot block can be split
    repeated = scratch.keep(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    wanted = scratch.keep(anchors.join(repeated, "h", "left_semi").select("doc_id", "start"), "wanted")
    scratch.drop("anchors")

    starts = wanted.groupBy("doc_id").agg(F.collect_list("start").alias("starts")) \
        .withColumnRenamed("doc_id", "of")
    tagged = d.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    segs = scratch.keep(
        tagged.join(starts, same((tagged.doc_id, starts.of))).select("doc_id", "tag", "text", "starts")
        .mapInArrow(_segment_rows(width, gram),
                    f"h long, w binary, doc_id {kind}, tag long, start long"), "segments")
    scratch.drop("wanted")

    place = F.struct("doc_id", "tag", "start")
    classes = scratch.keep(
        segs.groupBy("h", "w").agg(F.min(place).alias("f"))
        .select("h", "w", F.xxhash64("w").alias("c"), "f.doc_id", "f.tag", "f.start"), "classes")

    # later occurrences of a class: all windows repeat
    slim = segs.select("h", F.xxhash64("w").alias("c"), (F.length("w") / 8).cast("long").alias("windows"),
                       "doc_id", "tag", "start")
    first = classes.select("h", "c", F.col("doc_id").alias("ref_doc"), F.col("tag").alias("ref_tag"),
                           F.col("start").alias("ref_start"))
    c = F.col
    later = slim.join(first, ["h", "c"]) \
        .where(~same((c("doc_id"), c("ref_doc")), (c("tag"), c("ref_tag")), (c("start"), c("ref_start")))) \
        .select("doc_id", "tag", "start", "windows", "ref_doc", "ref_start")

    # first occurrences: windows that another class has earlier
    shared = scratch.keep(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "shared")
    wins = classes.join(shared, "h", "left_semi").select("h", "w", "doc_id", "tag", "start") \
        .mapInArrow(_window_rows, f"h long, r long, doc_id {kind}, tag long, start long")
    wins = scratch.keep(wins, "windows")
    least = wins.groupBy("h", "r").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1") \
        .select("h", "r", "f")
    least = scratch.keep(least, "least")
    inner = wins.join(least, ["h", "r"]).where(~same((place, F.col("f")))) \
        .select("doc_id", "tag", "start", F.lit(1).cast("long").alias("windows"),
                c("f.doc_id").alias("ref_doc"), c("f.start").alias("ref_start"))
    return later.unionByName(inner)


def _parse(start, windows, ref_doc, ref_start, width):
    """Greedy factors from the matches of one document (any order)."""
    order = sorted(range(len(start)), key=lambda i: (start[i], -windows[i]))
    out: list[list] = []
    for i in order:
        s, n, d, r = start[i], windows[i], ref_doc[i], ref_start[i]
        end = s + n + width - 1
        if out:
            s0, e0, d0, r0 = out[-1]
            if d == d0 and r - s == r0 - s0 and s <= e0 - width + 1:   # same diagonal, next window
                out[-1][1] = max(e0, end)
                continue
            if end <= e0:
                continue
        out.append([s, end, d, r])
    return out


def _apply(width: int):
    def rows(batches):
        for b in batches:
            ids, extra = b.column(0), b.column(2)
            raw, off = utf8(b.column(1))
            start, end, doc = word_spans(raw, off)
            base = np.searchsorted(doc, np.arange(len(ids) + 1))
            n_words, n_removed, digests, texts, factors = [], [], [], [], []
            lists = extra.to_pylist()
            for k in range(len(ids)):
                i, j = int(base[k]), int(base[k + 1])
                found = lists[k]
                s, e = start[i:j], end[i:j]
                keep = np.ones(j - i, bool)
                parsed = []
                if found:
                    parsed = _parse([m["start"] for m in found], [m["windows"] for m in found],
                                    [m["ref_doc"] for m in found], [m["ref_start"] for m in found], width)
                    for f in parsed:
                        keep[f[0]:f[1]] = False
                buf = _kept(raw, s, e, keep)
                n_words.append(j - i)
                n_removed.append(int((~keep).sum()))
                digests.append(hashlib.sha256(buf).hexdigest())
                texts.append(buf)
                factors.append([{"start": int(f[0]), "length": int(f[1] - f[0]), "ref_doc": f[2],
                                 "ref_start": f[3]} for f in parsed])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                                       ("ref_doc", ids.type), ("ref_start", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(factors, kind),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "factors", "kept_text"])
    return rows


def _kept(raw, s, e, keep) -> bytes:
    """Kept words joined by one space."""
    s, e = s[keep], e[keep]
    if not len(s):
        return b""
    lo, hi = int(s[0]), int(e[-1])
    flag = np.zeros(hi - lo + 2, np.int8)
    flag[s - lo] += 1
    flag[e - lo + 1] -= 1           # the byte after a word is its separator
    mask = np.cumsum(flag, dtype=np.int8)[:hi - lo].astype(bool)
    piece = raw[lo:hi].copy()
    gap = e[:-1] - lo
    piece[gap] = 32
    return piece[mask].tobytes()


def substring_dedup(spark: SparkSession, docs: DataFrame, width: int = 20, gram: int = GRAM) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (of
    the kept words joined by one space), factors (start, length in words, ref_doc,
    ref_start) and kept_text."""
    if not 1 <= gram <= width:
        raise ValueError("gram must lie between 1 and width")
    prepare(spark)
    scratch = Scratch(spark, "substring-dedup")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = scratch.keep(matches(spark, docs, scratch, width, gram), "matches")
    for t in ("repeated", "segments", "classes", "shared", "windows", "least"):
        scratch.drop(t)
    entry = F.collect_list(F.struct("start", "windows", "ref_doc", "ref_start"))
    m = found.groupBy("doc_id", "tag").agg(entry.alias("found")) \
        .withColumnsRenamed({"doc_id": "of", "tag": "of_tag"})
    d = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    both = d.join(m, same((d.doc_id, m.of), (d.tag, m.of_tag)), "left").select("doc_id", "text", "found")
    return both.mapInArrow(
        _apply(width),
        f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, "
        f"factors array<struct<start:bigint,length:bigint,ref_doc:{kind},ref_start:bigint>>, kept_text string")
