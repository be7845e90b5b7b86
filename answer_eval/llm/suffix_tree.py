"""Language-model scores from a probabilistic suffix tree over words.

A token is a word (A-Z lower-cased), and every document ends with one end token.  The root
of the tree predicts a token by its smoothed count, (c + 1) / (N + V + 1).  A context, the
last 1 to ``depth`` tokens (a start mark stands before the first), is tested if it
occurs ``min_count`` times or more in the documents learnt from and its suffix is retained;
it is retained if the divergence of its next tokens from what its suffix predicts, times
its occurrences, is at least ``cutoff`` nats for each distinct next token.  A retained
context predicts w by (c(w) + D p(w)) / (n + D): c(w) of its n occurrences are followed by w, D is
the number of distinct next tokens and p its suffix's prediction (Witten-Bell).  Every token
is scored in the longest retained suffix of what stands before it.

Nothing is learnt at the driver and no model is broadcast.  Documents lie in blocks of about
``BLOCK_TOKENS`` tokens, written once as hashed words.  Every count that the model needs is
an exchange: a block asks for each distinct key it holds (word, run of tokens, context), with its own
values.  Its keys are sorted and cut into buckets, equal ranges of the hashes, of about
``BUCKET_KEYS`` keys over all blocks; one row holds a block's keys of a bucket.  A task sums a bucket
key by key (a key comes at most once from a block) and answers each row in the order of its
keys.  The rounds are: words; then per context length the runs of that context and a next
token, and the contexts' gains.  Each round reads the blocks with the answers so far and works out
anew what was asked, so that nothing but answers is kept between rounds.  A gain is summed over the
occurrences in documents learnt from; a run's first block counts it as a next token.

Words and runs are compared by 64-bit hashes.  Gains are summed in whole numbers
(``GAIN_BITS`` binary places), so a retained context does not depend on the order of rows.

Cases: null or empty text: the end token alone; a document without a learnable flag (null) is
learnt from; null and repeated doc_ids: documents each; nothing to learn from: N = 0 and every
token has probability 1; an empty table gives an empty result; other columns are not read;
a long text is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from answer_eval.llm.common import Scratch, WordHash, mix, prepare, utf8, word_spans

BLOCK_TOKENS = 1 << 20
BUCKET_KEYS = 1 << 20
GAIN_BITS = 16
_HASH = WordHash(13)
_END = np.uint64(0x656E64656E64656E)
_START = np.uint64(0x7374617274737461)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CONTEXT = np.uint64(0x636F6E74657874)

_ASK = "bucket int, block long, keys binary, x binary, y binary"
_ANSWER = "round int, block long, bucket int, fresh long, x binary, y binary, lead binary"


_CODEC = "zstd"


def _squeezed(data: bytes) -> bytes:
    """Compressed, after its length: what is kept and shuffled are entropy-coded bytes."""
    return len(data).to_bytes(8, "little") + pa.compress(data, _CODEC, asbytes=True)


def _restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), _CODEC, asbytes=True)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each that hold them all, after a byte that says how many."""
    for kind in (np.int8, np.int16, np.int32):
        if len(x) == 0 or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return bytes([np.dtype(kind).itemsize]) + _squeezed(x.astype(kind).tobytes())
    return b"\x08" + _squeezed(x.astype(np.int64).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(_restored(data[1:]), f"i{data[0]}").astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, low bytes first: the high planes compress well."""
    size = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([size]) + _squeezed(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(_restored(data[1:]), np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view("<u8")


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: the first one, then the steps."""
    return keys[:1].tobytes() + _planes(np.diff(keys))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), _from_planes(data[8:])]), dtype=np.uint64)


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes in order, the place of each code among them), as np.unique gives them; codes and
    places are sorted as one number where they fit into it."""
    bits = len(codes).bit_length()
    if not len(codes) or int(codes.max()).bit_length() + bits > 63:
        return np.unique(codes, return_inverse=True)
    both = np.sort(codes << bits | np.arange(len(codes)))
    ordered = both >> bits
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty(len(codes), np.int64)
    place[both & ((1 << bits) - 1)] = np.cumsum(new) - 1
    return ordered[new], place


def _records(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")))
    values = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, t in zip(values, types)], names=names)


def _lower(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def _blocks(id_type: pa.DataType):
    """Rows of (doc_id, text, held_out) -> one row per block."""
    def close(part, k, ids, held, hashed, lengths):
        tokens, words = pd.factorize(np.concatenate(hashed))
        # the commonest words first, so that most tokens are small numbers
        common = np.argsort(-np.bincount(tokens), kind="stable")
        place = np.empty(len(words), np.int64)
        place[common] = np.arange(len(words))
        words, tokens = words[common], place[tokens]
        learnt = np.concatenate(lengths)[~np.array(held, bool)].sum()
        values = [(part << 32) + k, ids, len(tokens), int(learnt), words.tobytes(), _planes(tokens),
                  _pack(np.concatenate(lengths)), _pack(~np.array(held, bool))]
        types = [pa.int64(), pa.list_(id_type), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        names = ["block", "ids", "size", "learnt", "words", "tokens", "lengths", "train"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        ids, held, hashed, lengths, size = [], [], [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            raw, off = utf8(b.column(1))
            raw = _lower(raw)
            start, end, doc = word_spans(raw, off)
            counts = np.bincount(doc, minlength=b.num_rows)
            all_ids, flags, h = b.column(0).to_pylist(), b.column(2).to_pylist(), _HASH(raw, start, end)
            # an end token after the words of each document
            h = np.insert(h, np.cumsum(counts), _END)
            bounds = np.concatenate([[0], np.cumsum(counts + 1)])
            first = 0
            while first < b.num_rows:
                last = int(np.searchsorted(bounds, bounds[first] + BLOCK_TOKENS - size, "right")) - 1
                if last == first and not ids:       # longer than a block
                    last += 1
                ids += all_ids[first:last]
                held += [bool(x) for x in flags[first:last]]
                hashed.append(h[bounds[first]:bounds[last]])
                lengths.append(counts[first:last] + 1)
                size += int(bounds[last] - bounds[first])
                first = last
                if size >= BLOCK_TOKENS or first < b.num_rows:
                    yield close(part, k, ids, held, hashed, lengths)
                    ids, held, hashed, lengths, size, k = [], [], [], [], 0, k + 1
        if ids:
            yield close(part, k, ids, held, hashed, lengths)
    return run


class Block:
    """The arrays of one block, and what the answers of each round add.

    A run of length d + 1 is numbered among the block's distinct asked runs of that length; a context
    of length d is the run of length d that ends before the token."""

    def __init__(self, row: dict, min_count: int, cutoff: float):
        self.ids, self.min_count, self.cutoff = row["ids"], min_count, cutoff
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = _from_planes(row["tokens"]).astype(np.int64)
        self.lengths = _unpack(row["lengths"])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = _unpack(row["train"]) == 1
        self.learnt = np.repeat(self.train, self.lengths)
        self.own = np.bincount(self.tokens[self.learnt], minlength=len(self.words))
        # by context length: keys, own counts and counts of runs; retained contexts, their next tokens
        self.keys, self.owned, self.counts = [], [], []
        self.leads, self.kept, self.followers = [None], [None], [None]
        self.run_contexts, self.examples, self._tested = [None], [None], {}

    # words
    def ask_words(self):
        return self.words, np.arange(len(self.words)), self.own, np.zeros_like(self.own)

    def words_known(self, i, x, y, lead):
        self.known = known = np.zeros(len(self.words), np.int64)
        known[i] = x
        end = int(np.flatnonzero(self.words == _END)[0])
        # the start mark comes last; it stands once in every document, as the end does
        self.counts.append(np.append(known, known[end]))
        self.owned.append(np.append(self.own, self.own[end]))
        self.keys.append(np.append(self.words, _START))
        context = np.concatenate([[0], self.tokens[:-1]])
        context[self.starts] = len(known)
        self.contexts, self.runs = [None, context], [None]

    def tested(self, d: int) -> np.ndarray:
        """Positions whose context of length d may be retained."""
        if d in self._tested:
            return self._tested[d]
        context = self.contexts[d]
        ok = context >= 0
        ok[ok] = self.counts[d - 1][context[ok]] >= self.min_count
        if d > 1:
            shorter = np.flatnonzero(ok)
            ok[shorter] = self.kept[d - 1][self.contexts[d - 1][shorter]]
        self._tested[d] = ok
        return ok

    # runs of d context tokens and a next one
    def ask_runs(self, d: int):
        at = np.flatnonzero(self.tested(d) & (self.known[self.tokens] > 0))
        w = len(self.words)
        codes, run = _numbered(self.contexts[d][at] * w + self.tokens[at])
        context, token = codes // w, codes % w
        own = np.bincount(run[self.learnt[at]], minlength=len(codes))
        self.keys.append(mix(self.keys[d - 1][context] * _STEP + self.words[token]))
        self.owned.append(own)
        self.run_contexts.append(context)
        example = np.empty(len(codes), np.int64)
        example[run] = at                       # a position of each run
        self.examples.append(example)
        place = np.full(len(self.tokens), -1)
        place[at] = run
        self.runs.append(place)
        longer = np.concatenate([[-1], place[:-1]])
        longer[self.starts] = -1
        self.contexts.append(longer)
        # where all occurrences of the context or of the token are in this block there is nothing to ask
        alone = (self.counts[d - 1][context] == self.owned[d - 1][context]) | (self.known[token] == self.own[token])
        i = np.flatnonzero(~alone)
        return self.keys[d][i], i, own[i], np.zeros(len(i), np.int64)

    def runs_known(self, d: int, i, x, y, lead):
        total, first = self.owned[d].astype(np.int64), self.owned[d] > 0
        total[i], first[i] = x, lead
        self.counts.append(total)
        self.leads.append(first)

    # contexts of length d: their gain and their distinct next tokens
    def asked_contexts(self, d: int):
        """(keys, numbers) of the contexts of length d that are tested."""
        there = np.zeros(len(self.keys[d - 1]), bool)
        there[self.contexts[d][self.tested(d)]] = True
        i = np.flatnonzero(there)
        return mix(self.keys[d - 1][i] ^ _CONTEXT), i

    def ask_contexts(self, d: int, n: int, v: int):
        own, context = self.owned[d], self.run_contexts[d]
        learnt = own > 0
        # all occurrences of a run have one context, so one prediction without its first token
        at = self.examples[d][learnt]
        follows = self.counts[d][learnt] / self.counts[d - 1][context[learnt]]
        nats = np.rint(np.log(follows / self.predictions(d - 1, n, v, at)) * (1 << GAIN_BITS))
        size = len(self.keys[d - 1])
        # whole numbers far below 2**53, so the doubles are exact
        gain = np.bincount(context[learnt], nats * own[learnt], minlength=size).astype(np.int64)
        followers = np.bincount(context[self.leads[d]], minlength=size)
        keys, i = self.asked_contexts(d)
        return keys, i, gain[i], followers[i]

    def contexts_known(self, d: int, i, x, y, lead):
        size = len(self.keys[d - 1])
        kept, follow = np.zeros(size, bool), np.zeros(size, np.int64)
        follow[i] = y
        kept[i] = (y > 0) & (x >= self.cutoff * y * (1 << GAIN_BITS))
        self.kept.append(kept)
        self.followers.append(follow)

    def predictions(self, depth: int, n: int, v: int, at: np.ndarray | None = None) -> np.ndarray:
        """The probability of the tokens at the given positions (all), each in its longest retained context
        of ``depth`` tokens at most."""
        at = np.arange(len(self.tokens)) if at is None else at
        p = (self.known[self.tokens[at]] + 1) / (n + v + 1)
        for d in range(1, depth + 1):
            some = np.flatnonzero(self.tested(d)[at])
            some = some[self.kept[d][self.contexts[d][at[some]]]]
            context, run = self.contexts[d][at[some]], self.runs[d][at[some]]
            c = np.where(run >= 0, self.counts[d][run], 0)
            more = self.followers[d][context]
            p[some] = (c + more * p[some]) / (self.counts[d - 1][context] + more)
        return p

    def scores(self, depth: int, n: int, v: int) -> dict:
        by = lambda x: np.add.reduceat(x, self.starts)  # noqa: E731  every document has a token
        return {"held_out": ~self.train, "n_tokens": self.lengths,
                "n_known": by((self.known[self.tokens] > 0).astype(np.int64)),
                "base_score": by(np.log10((self.known[self.tokens] + 1) / (n + v + 1))),
                "score": by(np.log10(self.predictions(depth, n, v)))}


def _ask(block: Block, step: int, n: int, v: int):
    """What a block asks in a round: the words, then runs and contexts of each length."""
    if step == 0:
        return block.ask_words()
    d = (step + 1) // 2
    return block.ask_runs(d) if step % 2 else block.ask_contexts(d, n, v)


def _asked(block: Block, step: int):
    """(keys, numbers) of a round that has been answered."""
    if step == 0:
        return block.ask_words()[:2]
    return block.ask_runs((step + 1) // 2)[:2] if step % 2 else block.asked_contexts(step // 2)


def _learn(block: Block, step: int, *answer) -> None:
    if step == 0:
        block.words_known(*answer)
    elif step % 2:
        block.runs_known((step + 1) // 2, *answer)
    else:
        block.contexts_known(step // 2, *answer)


def _sorted_asks(keys: np.ndarray, buckets: int):
    """The order of the keys, and where each bucket's begin and end in it."""
    order = np.argsort(keys)
    bucket = ((keys[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return order, [(int(bucket[a]), a, e) for a, e in zip(first, [*first[1:], len(order)])]


def _asks(block_id: int, asked, buckets: int) -> pa.RecordBatch:
    keys, _, x, y = asked
    order, cuts = _sorted_asks(keys, buckets)
    rows = [(k, block_id, _pack_keys(keys[o]), _pack(x[o]), _pack(y[o])) for k, o in ((k, order[a:e]) for k, a, e in cuts)]
    return _records(_ASK, rows)


def _sum_buckets(step: int):
    """Rows of ``_ASK``, those of a bucket together and by block -> rows of ``_ANSWER``."""
    def close(bucket, rows):
        keys = np.concatenate([k for _, k, _, _ in rows])
        x, y = (np.concatenate([r[c] for r in rows]) for c in (2, 3))
        order = np.argsort(keys)
        head = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        of = np.empty(len(keys), np.int64)
        of[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(keys))))
        all_x, all_y = np.add.reduceat(x[order], head)[of], np.add.reduceat(y[order], head)[of]
        # the first row, by block, in which a key has a positive x
        lead, positive = np.zeros(len(keys), bool), np.flatnonzero(x > 0)
        lead[positive[np.unique(of[positive], return_index=True)[1]]] = True
        out, at = [], 0
        for block, own, _, _ in rows:
            to = at + len(own)
            out.append((step, block, bucket, int(lead.sum()) if at == 0 else 0, _pack(all_x[at:to]),
                        _pack(all_y[at:to]), np.packbits(lead[at:to]).tobytes()))
            at = to
        return _records(_ANSWER, out)

    def run(batches):
        at, rows = None, []
        for b in batches:
            for bucket, block, keys, x, y in zip(*(c.to_pylist() for c in b.columns)):
                if rows and bucket != at:
                    yield close(at, rows)
                    rows = []
                at = bucket
                rows.append((block, _unpack_keys(keys), _unpack(x), _unpack(y)))
        if rows:
            yield close(at, rows)
    return run


def suffix_tree_scores(spark: SparkSession, docs: DataFrame, held_out: Column, depth: int = 2, min_count: int = 8,
                       cutoff: float = 3.0) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known (tokens that the documents
    learnt from hold), train_tokens, base_score (log10 by the root alone) and score (log10 by the tree).
    Documents where ``held_out`` is true are not learnt from."""
    if depth < 1 or min_count < 1:
        raise ValueError("depth and min_count must be positive")
    prepare(spark)
    scratch = Scratch(spark, "suffix-tree")
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    read = docs.select("doc_id", "text", held_out.alias("held_out"))
    blocks = scratch.keep(read.mapInArrow(
        _blocks(id_type), f"block long, ids array<{kind}>, size long, learnt long, words binary, tokens binary, "
                          "lengths binary, train binary"), "blocks")
    sums = blocks.agg(F.sum("size").alias("size"), F.sum("learnt").alias("n")).first()
    n, v = sums["n"] or 0, 0
    buckets = max(1, -(-(sums["size"] or 0) // BUCKET_KEYS))
    parts = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def opened(row: dict, answers: pa.Table | None, step: int) -> Block:
        """A block that knows the answers of all rounds before ``step``."""
        block = Block(row, min_count, cutoff)
        rows = sorted(answers.to_pylist(), key=lambda r: (r["round"], r["bucket"])) if answers is not None else []
        for k in range(step):
            keys, i = _asked(block, k)
            own = [r for r in rows if r["round"] == k]
            x, y = (np.concatenate([np.zeros(0, np.int64), *[_unpack(r[c]) for r in own]]) for c in "xy")
            lead = np.concatenate([np.zeros(0, bool), *[
                np.unpackbits(np.frombuffer(r["lead"], np.uint8), count=len(_unpack(r["x"]))) == 1 for r in own]])
            _learn(block, k, i[_sorted_asks(keys, buckets)[0]], x, y, lead)
        return block

    def ask_first(batches):
        for b in batches:
            for row in b.to_pylist():
                yield _asks(row["block"], _ask(Block(row, min_count, cutoff), 0, n, v), buckets)

    def ask_again(step):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            return pa.Table.from_batches(
                [_asks(row["block"], _ask(opened(row, right, step), step, n, v), buckets)])
        return run

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = opened(left.to_pylist()[0], right, last)
        out = block.scores(depth, n, v)
        return pa.table({"doc_id": pa.array(block.ids, id_type), "held_out": out["held_out"],
                         "n_tokens": out["n_tokens"], "n_known": out["n_known"],
                         "train_tokens": np.full(len(block.ids), n, np.int64),
                         "base_score": out["base_score"], "score": out["score"]})

    last, answers = 2 * depth + 1, None
    for step in range(last):
        asks = blocks.mapInArrow(ask_first, _ASK) if step == 0 else \
            blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask_again(step), _ASK)
        sums = asks.repartition(parts, "bucket").sortWithinPartitions("bucket", "block") \
            .mapInArrow(_sum_buckets(step), _ANSWER)
        got = scratch.keep(sums, f"answers-{step}")
        answers = got if step == 0 else answers.unionByName(got)
        if step == 0:
            v = got.agg(F.sum("fresh")).first()[0] or 0
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")


def held_out_rows(doc_id: str = "doc_id", modulus: int = 7, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text has this remainder (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))
