"""Documents that are hard on the operators, and plain versions of what they compute."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, h string, id string, tag string, "
          "row string, ranges string, n_removed string, rep string, digest string, key string, words string, "
          "size string, `a.b` string")
EXTRA = ("x",) * 12


def words(text):
    return WORD.findall(text or "")


def documents(seed=1, n=60):
    """Null ids, texts and sources, empty and blank texts, a very long one, exact and near copies,
    shared passages and lines, repeated rows, and one id with two texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = say(45)
    lines = "\n".join(say(5) for _ in range(4))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, say(19)), (7, say(20)),
            (8, "same " * 60), (9, "\n".join(["line"] * 9)), (10, say(6000) + " " + passage), (11, passage)]
    base = say(120)
    rows += [(12, base), (13, base), (14, base.replace(" ", "  ", 3)), (15, base.upper() + " END")]
    for k in range(20, n):
        t = say(rng.randint(1, 90))
        if k % 4 == 0:
            t += " " + passage + " " + say(9)
        if k % 5 == 0:
            t = say(4) + "\n" + lines + "\n" + t
        if k % 7 == 0:
            near = base.split(" ")
            near[rng.randrange(len(near))] = "changed"
            t = " ".join(near)
        rows.append((k, t))
    rows += [rows[8], rows[8], (30, "another text of an id " + passage), (None, passage + " of nobody"), (None, None)]
    out = []
    for k, (i, t) in enumerate(rows):
        source = None if k % 11 == 0 else f"src{k * k % 5}"
        out.append((i, t, "en", source, len(t or ""), *EXTRA))
    rng.shuffle(out)
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def texts_by_row(rows):
    return [(r[0], r[1]) for r in rows]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def first_places(docs, units, width, sep):
    """The places (document, start) of windows that start earlier; documents in the given order."""
    seen, later = set(), set()
    for k, (_, text) in enumerate(docs):
        u = units(text)
        for p in range(len(u) - width + 1):
            w = sep.join(u[p:p + width])
            if w in seen:
                later.add((k, p))
            else:
                seen.add(w)
    return later


def covered(later, k, n, width):
    gone = set()
    for d, p in later:
        if d == k:
            gone.update(range(p, p + width))
    return [q in gone for q in range(n)]


def shingles(text, n):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if len(w) >= n:
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def groups(ids, linked):
    """Least id reachable, per id, given pairs of ids."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def target_weights(rows, top=3):
    """Sizes and targets per source, by resharing until no source is above its bound."""
    size = defaultdict(int)
    for text, source in rows:
        size[source] += len(words(text))
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(top * size[s] for s in full)
        w = sum(weight[s] for s in free)
        target = {s: top * size[s] for s in full} | {s: rest * weight[s] / w for s in free}
        above = [s for s in free if target[s] > top * size[s]]
        if not above:
            return dict(size), target
        full |= set(above)


__all__ = ["Counter"] + [k for k in dir() if not k.startswith("_")]
