"""Personal data: base patterns and a skip-chain conditional random field.

Base spans are found per kind, leftmost and without overlap: email, ip (four parts up
to 255), card (14 to 19 digits that pass the Luhn test) and phone (10 to 15 digits after
"+").  A match that fails its test is dropped and not retried.

The field then reads every document again.  Its nodes are the base spans, whose labels
are observed, every other token with a digit or "@", runs of digit groups (see ``runs``),
and the tokens that share a key with another node: the same characters (case and
punctuation aside), the same digits, the same last seven digits, or an address's local
part (of letters only: if a base address of the text has it and it names no role, as
"info" does).  Potentials:

* node: how often a node of this shape carries each label; the shape of what reads as a
  card number tells whether it passes the Luhn test;
* chain: between nodes that are neighbours in the text;
* skip: between nodes that share a key, however far apart, one weight per sort of key.

Loopy sum-product passes messages over both sorts of edges, so that what is said about
one mention reaches the others; a token whose marginal prefers a label over "none", and clearly over the other labels, is
added as a span of it, be it by its shape alone and in a document without base spans.
Nodes sharing a key form a chain of occurrences, each also tied to the first, so edges
grow with nodes.  Of added spans that overlap, the likelier stays, then the longer.

The weights are fitted piecewise, on about ``sample_docs`` documents drawn by hash:
counts of (shape, label) and (label, next label), a base span counting once, and agreement over shared keys, smoothed;
the table is bounded by ``max_shapes`` shapes.

Cases: null or empty text: no spans; a text of any length is scanned in linear time;
null doc_id and repeated rows: each its own row; an empty table gives an empty result;
other columns are not read.  Positions are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.llm.common import Scratch, prepare

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SKIPS = ("same", "digits", "tail", "local")          # sorts of shared keys
SAMPLE_DOCS, MAX_SHAPES = 4000, 2000
ROUNDS, DAMP = 12, 0.5
MESSAGES = 65536                                     # updated at a time
SMOOTH = 5.0                                         # a shape seen a few times says little

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"\+?\(?[0-9]+(?:[ ().-]{1,3}[0-9]+)+")
_GROUP = re.compile(r"(?:\+?\()?[0-9]+|\+[0-9]+")
# mailboxes named after what they are for (RFC 2142 and the like) are nobody's name
_ROLES = frozenset("abuse admin contact enquiries ftp hello help hostmaster info inquiries mail marketing news noc "
                   "noreply office postmaster press sales security service support team usenet uucp webmaster "
                   "www".split())
_EDGE = "()[]{}<>.,;:!?\"'*#&%$|"


def emails(text: str) -> list[tuple[int, int]]:
    """An address begins where the run of local characters before its "@" begins, or where the
    last address ended; every run is looked at once."""
    out, done, seen = [], 0, 0
    at = text.find("@")
    while at >= 0:
        lo = max(done, seen)
        start = lo + len(text[lo:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        seen = at + 1
        at = text.find("@", max(seen, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then in the order of KINDS."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def shape(token: str) -> str:
    """Letters as one a, a run of digits as its length, other characters as they are; what reads
    as a card number: the number of its digits, with a star if it passes the Luhn test."""
    if len(token) >= 14 and _CARD.fullmatch(token):
        digits = _NOT_DIGIT.sub("", token)
        if 14 <= len(digits) <= 19:
            return f"<{len(digits)}>" + "*" * luhn(digits)
    out = re.sub(r"[0-9]+", lambda m: f"<{min(len(m.group()), 20)}>", re.sub(r"[^\W\d_]+", "a", token))
    return out if len(out) <= 40 else out[:39] + "~"


def keys(token: str) -> list[tuple[str, str]]:
    """(sort, key) pairs under which mentions of one thing meet."""
    digits = _NOT_DIGIT.sub("", token)
    plain = "".join(c for c in token.lower() if c.isalnum())
    out = []
    if len(plain) >= 6 and digits or "@" in token:
        out.append(("same", plain))
    if len(digits) >= 7:
        out.append(("digits", digits))
        if len(digits) > 7:
            out.append(("tail", digits[-7:]))
        else:
            out.append(("tail", digits))
    local = token.split("@", 1)[0].lower()
    if len(local) >= 5 and any(c.isdigit() or c in "._" for c in local) and any(c.isalpha() for c in local):
        out.append(("local", local))
    return out


def candidate(token: str) -> bool:
    """May be a span by itself."""
    return any(c.isdigit() or c == "@" for c in token)


def runs(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Stretches of two or more digit groups beside the base spans: in every run of groups, from
    the left, the longest stretch whose joined digits end the digits of a base span, 7 at least;
    and the whole run where it has 7 to 19 digits and none of those."""
    ends = {d[k:] for _, a, b in base for d in [_NOT_DIGIT.sub("", text[a:b])] for k in range(len(d) - 6)}
    cuts, out, at = [], [], 0
    for _, a, b in sorted(base, key=lambda s: s[1]):              # the text between base spans
        if a > at:
            cuts.append((at, a))
        at = max(at, b)
    cuts.append((at, len(text)))
    for lo, hi in cuts:
        for m in _RUN.finditer(text, lo, hi):
            groups = [(g.start(), g.end(), _NOT_DIGIT.sub("", g.group())) for g in _GROUP.finditer(text, *m.span())]
            i, n, linked = 0, len(groups), False
            while ends and i < n:
                joined, best = "", -1
                for j in range(i, n):
                    joined += groups[j][2]
                    if len(joined) > 19:
                        break
                    if j > i and joined in ends:
                        best = j
                if best >= 0:
                    out.append((groups[i][0], groups[best][1]))
                    linked = True
                i = max(i, best) + 1
            if not linked and 7 <= sum(len(g[2]) for g in groups) <= 19:
                out.append(m.span())
    return out


def nodes(text: str, base: list[tuple[str, int, int]]) -> tuple[list, list]:
    """Nodes (start, end, label index or -1, keys), in text order: base spans, the tokens beside
    them with a digit or "@", runs of digit groups, and tokens that share a key with some node;
    and the chain and skip edges (i, j, sort), none between nodes that overlap."""
    found = [(a, b, LABELS.index(k), keys(text[a:b])) for k, a, b in base]
    names = set()
    for k, (kind, a, b) in enumerate(base):
        local = text[a:b].split("@", 1)[0].lower()
        if kind == "email" and len(local) >= 5 and local not in _ROLES and any(c.isalpha() for c in local):
            names.add(local)
            found[k] = (*found[k][:3], list(dict.fromkeys([*found[k][3], ("local", local)])))
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        if not any(c.isdigit() or c in "@._" for c in token) and not names:
            continue
        body = token.strip(_EDGE)
        a = m.start() + token.find(body) if body else m.start()
        b = a + len(body)
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not body or at < len(taken) and taken[at][0] < b:
            continue
        own = keys(body)
        if body.lower() in names and ("local", body.lower()) not in own:
            own.append(("local", body.lower()))
        if own or candidate(body):
            found.append((a, b, -1, own))
    tokens = {n[:2] for n in found}
    found += [(a, b, -1, keys(text[a:b])) for a, b in runs(text, base) if (a, b) not in tokens]
    found.sort(key=lambda n: (n[0], n[1]))
    by_key = defaultdict(list)
    for i, n in enumerate(found):
        for k in n[3]:
            by_key[k].append(i)
    edges = set()
    for (sort, _), members in by_key.items():
        for x, y in zip(members, members[1:]):
            edges.add((x, y, sort))
            edges.add((members[0], y, sort))
    edges = {(x, y, s) for x, y, s in edges if x != y and found[x][1] <= found[y][0]}
    linked = {i for x, y, _ in edges for i in (x, y)}
    keep = [i for i, n in enumerate(found) if n[2] >= 0 or i in linked or candidate(text[n[0]:n[1]])]
    new = {i: k for k, i in enumerate(keep)}
    best: dict[tuple[int, int], str] = {}
    for x, y, s in edges:
        pair = (new[x], new[y])
        if pair not in best or SKIPS.index(s) < SKIPS.index(best[pair]):
            best[pair] = s
    out = [found[i] for i in keep]
    for k in range(len(out) - 1):
        if 0 <= out[k + 1][0] - out[k][1] <= 1:
            best.setdefault((k, k + 1), "chain")
    return out, [(x, y, s) for (x, y), s in sorted(best.items())]


class Field:
    """Log potentials of a skip-chain field."""

    def __init__(self, shapes: dict[str, list[float]], other: list[float], chain: list[list[float]],
                 skip: dict[str, float]):
        self.shapes, self.other, self.chain, self.skip = shapes, other, chain, skip

    def marginals(self, text: str, found: list, edges: list) -> np.ndarray:
        n, size = len(found), len(LABELS)
        node = np.array([self.shapes.get(shape(text[a:b]), self.other) if label < 0 else [0.0] * size
                         for a, b, label, _ in found], float).reshape(n, size)
        for k, (_, _, label, _) in enumerate(found):
            if label >= 0:                               # observed
                node[k] = -50.0
                node[k, label] = 0.0
        if not edges:
            return _soft(node)
        sorts = [*SKIPS, "chain"]
        table = np.array([np.eye(size) * self.skip[s] for s in SKIPS] + [self.chain])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        pair = np.array([sorts.index(s) for _, _, s in edges])
        pair = np.concatenate([pair, pair + len(sorts)])
        src = np.array([x for x, _, _ in edges] + [y for _, y, _ in edges])
        dst = np.array([y for _, y, _ in edges] + [x for x, _, _ in edges])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        msg = np.zeros((len(src), size))
        for _ in range(ROUNDS):
            belief = node.copy()
            np.add.at(belief, dst, msg)
            out = belief[src] - msg[back]
            new = np.concatenate([_logsum(out[k:k + MESSAGES, :, None] + table[pair[k:k + MESSAGES]])
                                  for k in range(0, len(out), MESSAGES)])
            new -= _logsum(new[:, :, None])
            msg = DAMP * msg + (1 - DAMP) * new
        belief = node.copy()
        np.add.at(belief, dst, msg)
        return _soft(belief)

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        found, edges = nodes(text, base)
        if len(found) == len(base):
            return []
        p = self.marginals(text, found, edges)
        top = p.argmax(axis=1)
        said = [(float(p[i, k]), a, b, k) for i, ((a, b, label, _), k) in enumerate(zip(found, top.tolist()))
                if label < 0 and k > 0 and p[i, k] > 2 * np.sort(p[i, 1:])[-2]]   # no label by neighbours alone
        starts: list[int] = []
        out: list[tuple[str, int, int]] = []
        for _, a, b, k in sorted(said, key=lambda x: (-x[0], x[1] - x[2], x[1])):
            i = bisect_left(starts, a)
            if (i == 0 or out[i - 1][2] <= a) and (i == len(out) or b <= out[i][1]):
                starts.insert(i, a)
                out.insert(i, (LABELS[k], a, b))
        return out


def _logsum(x: np.ndarray) -> np.ndarray:
    m = x.max(axis=1, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=1, keepdims=True)))[:, 0]


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counts(batches):
    """Pieces to fit on: (sort, name, label, other label, n)."""
    for b in batches:
        total: Counter = Counter()
        for text in b.column(0).to_pylist():
            text = text or ""
            base = base_spans(text)
            covered = [(a, e, LABELS.index(k)) for k, a, e in base]
            at, last, span = 0, None, None
            for m in _TOKEN.finditer(text):
                while at < len(covered) and covered[at][1] <= m.start():
                    at += 1
                hit = at < len(covered) and covered[at][0] < m.end()
                if hit and span == at:                   # within one span
                    continue
                span = at if hit else None
                label = covered[at][2] if hit else 0
                if last is not None:
                    total["chain", "", last, label] += 1
                last = label
            found, edges = nodes(text, base)
            for a, e, label, _ in found:
                if label >= 0 or candidate(text[a:e]):
                    total["shape", shape(text[a:e]), max(label, 0), 0] += 1
            for x, y, s in edges:
                if s != "chain" and (found[x][2] >= 0 or found[y][2] >= 0):
                    total["skip", s, int(found[x][2] == found[y][2]), 0] += 1
        if total:
            rows = list(total.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0][0] for r in rows]), pa.array([r[0][1] for r in rows]),
                 pa.array([r[0][2] for r in rows], pa.int32()), pa.array([r[0][3] for r in rows], pa.int32()),
                 pa.array([r[1] for r in rows], pa.int64())], names=["sort", "name", "x", "y", "n"])


def fit(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_shapes: int = MAX_SHAPES) -> Field:
    """Piecewise estimates from about ``sample_docs`` documents."""
    c = F.col
    n = docs.count()
    d = docs.select("text")
    if n > sample_docs:
        d = d.where(F.pmod(F.xxhash64("text"), F.lit(n)) < sample_docs)
    total = d.mapInArrow(_counts, "sort string, name string, x int, y int, n long") \
        .groupBy("sort", "name", "x", "y").agg(F.sum("n").alias("n"))
    total = Scratch(spark, "pii").keep(total, "counts")
    few = total.where("sort <> 'shape'").collect()                   # labels x labels, sorts of keys
    top = total.where("sort = 'shape'").groupBy("name").agg(F.sum("n").alias("all")) \
        .orderBy(c("all").desc(), "name").limit(max_shapes)
    seen = defaultdict(lambda: [0] * len(LABELS))
    for r in total.where("sort = 'shape'").join(F.broadcast(top), "name").select("name", "x", "n").collect():
        seen[r["name"]][r["x"]] += r["n"]
    chain = np.ones((len(LABELS), len(LABELS)))
    agree = {s: [1.0, 1.0] for s in SKIPS}                           # different, equal
    for r in few:
        if r["sort"] == "chain":
            chain[r["x"], r["y"]] += r["n"]
        else:
            agree[r["name"]][r["x"]] += r["n"]
    marginal = chain.sum(axis=0) / chain.sum()
    chain = np.log(chain / chain.sum(axis=1, keepdims=True) / marginal[None, :]).clip(-2.0, 2.0)
    chain[0, :] = chain[:, 0] = 0.0
    # a token that is no base span is doubtful: "none" starts ahead, and a label needs support
    prior = np.array([2.0, 0.0, 0.0, 0.0, 0.0])

    def potential(counts) -> list[float]:
        x = np.asarray(counts, float) + SMOOTH
        return (prior + np.log(x / x.sum()).clip(-3.0, 0.0)).tolist()

    skip = {s: float(np.clip(math.log(v[1] / v[0]), 2.0, 4.0)) + {"same": 2.0, "digits": 2.0}.get(s, 1.0)
            for s, v in agree.items()}
    return Field({k: potential(v) for k, v in seen.items()}, potential([0] * len(LABELS)), chain.tolist(), skip)


def _spans(field: Field):
    def rows(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("base", pa.bool_())]))
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                every = [(k, a, e, True) for k, a, e in base]
                every += [(k, a, e, False) for k, a, e in field.added(text or "", base)]
                every.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": a, "end": e, "base": f} for k, a, e, f in every])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])
    return rows


def personal_data(spark: SparkSession, docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, spans (kind, start, end, base), by start,
    then kind; ``base`` tells pattern matches from what the field added."""
    prepare(spark)
    field = field or fit(spark, docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _spans(field), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def listing(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_report(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all)."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in KINDS]
    return found.select("doc_id", *n, F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))
