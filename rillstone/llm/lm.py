"""Language-model scores: masked pseudo-likelihood of a bidirectional window network trained in numpy.

Words (runs of ASCII letters, digits and characters beyond ASCII, lower-cased) are counted over all documents.  Each word seen
``COMMON`` times or more that makes up ``LEAST_SHARE`` of all, and each of the ``WORDS`` most frequent, has an id of its own (at most
``1 / LEAST_SHARE`` can); the rest, each rarer than any of these, are
hashed to a quarter as many ids, and a word among them has an equal part of its id's probability.  The number of ids thus follows the
corpus.  The network predicts every word from the ``SIDE`` words before and the ``SIDE`` after it: their embeddings, each with a
diagonal matrix of its place, add up to a hidden layer; a softmax over classes of ids and one over the ids of the class give the
id's probability.  Classes are ids of like frequency, about as many as each has ids.

Training covers every word of every document: a hash of the document's key and the place deals runs of ``RUN`` places out to the rounds, so
that after the last each was a target once, and that no round misses a field of texts with a period.  In a round each partition starts
from the common weights, learns its places in steps that grow longer, and gives back its weights; Spark averages them, weighted by
the words learnt, before the next round.

A document's score is the sum over its words of the log-probability given both sides.  Places beyond the text's ends are a mark of
their own.  Null texts and texts without words have 0 words, a sum of 0 and null means.  Repeated rows get the same score; an empty
table gives an empty table.  Columns besides the id and the text don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .scratch import Scratch

#: words of at least so many sightings, and so many words at least, have ids of their own
COMMON, LEAST_SHARE, WORDS = 1000, 1e-7, 4096
LEAST_PER_CLASS = 64
SIDE, HIDDEN = 2, 16
ROUNDS, RATE = 2, 0.15
#: places in the first and the longest step of learning, how many steps as long as the next have gone before, and places scored at once
FIRST, BATCH, STEPS, AT_ONCE = 256, 16_384, 16, 16_384
#: places in a row that go to the same round, and rows of a softmax at a time, so that they stay in the cache
RUN, ROWS = 64, 2048
#: distinct words that a task of the count holds, weights in a row of a round's result, and bytes of texts that become ids, or of ids, at a time
HELD, PART, IDS_AT_ONCE = 1 << 20, 4096, 1 << 18


class Net(NamedTuple):
    embed: np.ndarray  # ids + 1, HIDDEN; the last is the mark beyond a text's ends
    place: np.ndarray  # 2 SIDE, HIDDEN
    bias: np.ndarray  # HIDDEN
    to_class: np.ndarray  # HIDDEN + 1, classes; the last row is the bias
    to_word: np.ndarray  # classes, HIDDEN + 1, ids of a class; likewise


class Vocabulary(NamedTuple):
    known: np.ndarray  # sorted hashes, as int64, of the words with an id of their own
    rank: np.ndarray  # their ids
    bucket_rank: np.ndarray  # ids of the buckets of all other words
    distinct: np.ndarray  # words of each id
    counts: np.ndarray  # sightings of each id, most frequent first

    def ids(self, code: np.ndarray) -> np.ndarray:
        code = code.view(np.int64)
        at = np.minimum(np.searchsorted(self.known, code), max(0, len(self.known) - 1))
        if not len(self.bucket_rank):
            return self.rank[at]
        return np.where(self.known[at] == code, self.rank[at], self.bucket_rank[code % len(self.bucket_rank)])


def shape_of(n: int) -> tuple[int, int]:
    """(classes, ids of a class) for n ids."""
    per = max(LEAST_PER_CLASS, int(np.ceil(np.sqrt(n))))
    return max(1, -(-n // per)), per


def start(counts: np.ndarray, seed: int = 3) -> Net:
    """counts: of ids in order of rank; output biases begin at the log of the frequencies."""
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    n, per = shape_of(len(counts))
    share = np.full(n * per, 1e-9)
    share[: len(counts)] = counts + 1
    share = share.reshape(n, per)
    by_class = share.sum(1)
    to_class, to_word = draw(HIDDEN + 1, n, s=0.05), draw(n, HIDDEN + 1, per, s=0.05)
    to_class[-1], to_word[:, -1] = np.log(by_class / by_class.sum()), np.log(share / by_class[:, None])
    return Net(draw(n * per + 1, HIDDEN, s=0.1), 0.5 + draw(2 * SIDE, HIDDEN, s=0.1), np.zeros(HIDDEN, np.float32), to_class, to_word)


def flatten(net: Net) -> np.ndarray:
    return np.concatenate([w.ravel() for w in net])


def unflatten(flat: np.ndarray, n_ids: int = WORDS) -> Net:
    n, per = shape_of(n_ids)
    shapes = [(n * per + 1, HIDDEN), (2 * SIDE, HIDDEN), (HIDDEN,), (HIDDEN + 1, n), (n, HIDDEN + 1, per)]
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(np.ascontiguousarray(flat[at : at + size], np.float32).reshape(shape))
        at += size
    return Net(*out)


#: places of the words around, from each place
AROUND = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def stream(ids: np.ndarray, doc: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts one after another with ``SIDE`` marks before, between and behind them; the place of each word in it."""
    at = np.arange(len(ids)) + SIDE * (doc + 1)
    out = np.full(len(ids) + SIDE * (int(doc[-1]) + 2 if len(doc) else 1), mark, np.uint16 if mark < 1 << 16 else np.int32)
    out[at] = ids
    return out, at


def hidden_layer(net: Net, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer of every place of a stream but the ``SIDE`` first and last, and the stream's embeddings."""
    n, given = len(text) - 2 * SIDE, net.embed[text]
    out = np.empty((n, net.embed.shape[1]), np.float32)
    out[:] = net.bias
    for j, step in enumerate(AROUND):
        out += given[SIDE + step : SIDE + step + n] @ np.diag(net.place[j])
    return np.tanh(out, out=out), given


def _far(weights: np.ndarray) -> bool:
    """Whether logits beyond 60 can come of these weights; the hidden layer lies within 1."""
    return not (np.abs(weights[..., :-1, :]).sum(-2) + weights[..., -1, :]).max() <= 60


def _logits(one: np.ndarray, weights: np.ndarray, far: bool) -> np.ndarray:
    """At most 60; they are only looked through where they can come so far."""
    x = one @ weights
    return np.minimum(x, 60, out=x) if far else x


def _powers(logits: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits, in their place, and its sum of each row."""
    np.exp(logits, out=logits)
    return logits, logits @ ones[: logits.shape[1]]


def _by_class(group: np.ndarray, classes: int) -> Iterator[tuple[int, int, int]]:
    """(class, first row, row after the last) of sorted classes."""
    bounds = np.searchsorted(group, np.arange(classes + 1)).tolist()
    yield from ((c, lo, hi) for c, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if hi > lo)


def _grouped(net: Net, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by class, and class and number within it in that order."""
    classes, _, per = net.to_word.shape
    group = (word // per).astype(np.uint16 if classes < 1 << 16 else np.int64)
    order = np.argsort(group, kind="stable")
    return order, group[order], word[order] - group[order].astype(np.int64) * per


def _with_one(hidden: np.ndarray) -> np.ndarray:
    """A column of ones behind the hidden layer, for the biases."""
    out = np.ones((len(hidden), hidden.shape[1] + 1), hidden.dtype)
    out[:, :-1] = hidden
    return out


def log_probabilities(net: Net, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P(id | window) of the ids at these places of a stream."""
    order, group, inner = _grouped(net, text[at].astype(np.int64))
    hidden, row = _with_one(hidden_layer(net, text)[0][at[order] - SIDE]), np.arange(len(at))
    ones, far = np.ones(max(net.to_word.shape), np.float32), (_far(net.to_class), _far(net.to_word))

    def chance(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
        picked = logits[row[: len(own)], own].astype(np.float64)
        return picked - np.log(_powers(logits, ones)[1])

    found = np.concatenate([chance(_logits(hidden[lo : lo + ROWS], net.to_class, far[0]), group[lo : lo + ROWS]) for lo in range(0, len(at), ROWS)])
    for c, lo, hi in _by_class(group, len(net.to_word)):
        found[lo:hi] += chance(_logits(hidden[lo:hi], net.to_word[c], far[1]), inner[lo:hi])
    out = np.empty(len(at))
    out[order] = found
    return out


class Learner:
    """Adagrad from given weights."""

    def __init__(self, net: Net):
        self.net = Net(*[w.copy() for w in net])
        self.square = Net(*[np.full_like(w, 1e-6) for w in net])
        self.seen = 0

    def _move(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        w, s = getattr(self.net, name), getattr(self.square, name)
        s[at] += grad * grad
        w[at] -= RATE * grad / np.sqrt(s[at])

    def gradients(self, text: np.ndarray, at: np.ndarray) -> tuple[float, dict]:
        """Summed loss of the words at these places of a stream, and the gradients (to_word by class)."""
        net, n = self.net, len(text) - 2 * SIDE
        every, given = hidden_layer(net, text)
        order, group, inner = _grouped(net, text[at].astype(np.int64))
        at = at[order]
        hidden, row = every[at - SIDE], np.arange(len(at))
        one, chance, back = _with_one(hidden), np.empty(len(at), np.float32), np.empty_like(hidden)
        ones, far = np.ones(max(net.to_word.shape), np.float32), (_far(net.to_class), _far(net.to_word))
        grads = {"to_class": np.zeros_like(net.to_class), "to_word": {}}

        def output(weights: np.ndarray, lo: int, hi: int, own: np.ndarray, far: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(chances, gradient of the hidden layer, gradient of the weights) of one softmax over some rows."""
            # the rows' sums divide the narrow factors, not the wide one
            (p, total), its = _powers(_logits(one[lo:hi], weights, far), ones), (row[: hi - lo], own)
            share = (1 / total)[:, None]
            got = p[its] / total
            p[its] -= total
            return got, (p @ weights[:-1].T) * share, (one[lo:hi] * share).T @ p

        for lo in range(0, len(at), ROWS):
            hi = min(len(at), lo + ROWS)
            chance[lo:hi], back[lo:hi], to_class = output(net.to_class, lo, hi, group[lo:hi], far[0])
            grads["to_class"] += to_class
        for c, lo, hi in _by_class(group, len(net.to_word)):
            got, to_hidden, grads["to_word"][c] = output(net.to_word[c], lo, hi, inner[lo:hi], far[1])
            chance[lo:hi] *= got
            back[lo:hi] += to_hidden
        back *= 1 - hidden * hidden
        # what reaches a word of the stream comes from the places around it
        wide = np.zeros((n + 4 * SIDE, hidden.shape[1]), np.float32)
        wide[at + SIDE] = back
        to_embed, to_place = np.zeros((n + 2 * SIDE, hidden.shape[1]), np.float32), np.empty_like(net.place)
        for j, step in enumerate(AROUND):
            to_embed += wide[SIDE - step : SIDE - step + n + 2 * SIDE] @ np.diag(net.place[j])
            to_place[j] = np.einsum("ij,ij->j", wide[2 * SIDE : 2 * SIDE + n], given[SIDE + step : SIDE + step + n])
        grads["place"], grads["bias"] = to_place, back.sum(0)
        order = np.argsort(text, kind="stable")
        ids = text[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        grads["embed"] = ids[first].astype(np.int64), np.add.reduceat(to_embed[order], first)
        return -float(np.log(np.maximum(chance, 1e-30)).sum()), grads

    def learn(self, text: np.ndarray, at: np.ndarray) -> float:
        """One step on the words at these places; their mean loss before it."""
        loss, grads = self.gradients(text, at)
        for c, grad in grads.pop("to_word").items():
            self._move("to_word", grad, c)
        ids, to_embed = grads.pop("embed")
        self._move("embed", to_embed, ids)
        for name, grad in grads.items():
            self._move(name, grad)
        self.seen += len(at)
        return loss / len(at)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = tb.words(data, offs, tb.ALNUM)
    return w.hash, w.doc


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return code, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """h (hash), n (sightings) of each distinct word in column t, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, have = [], 0

        def rows(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(code), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(code[lo : lo + 65_536].view(np.int64)), pa.array(n[lo : lo + 65_536])], ["h", "n"])

        for batch in batches:
            for _, _, data, offs in tb.groups(batch.column(0)):
                parts.append(np.unique(_words(data, offs)[0], return_counts=True))
                have += len(parts[-1][0])
                if have >= 2 * HELD:
                    parts = [_merged(parts)]
                    have = len(parts[0][0])
                    if have >= HELD:
                        yield from rows(*parts.pop())
                        have = 0
        if parts:
            yield from rows(*_merged(parts))

    return docs.select("t").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Ids of the words in column t."""
    disk = Scratch(docs.sparkSession, "lm")
    counts = disk.save(corpus_counts(docs), "counts")
    least = max(COMMON, LEAST_SHARE * (counts.agg(F.sum("n")).first()[0] or 0))
    own, left = counts.filter(F.col("n") >= least).toArrow(), F.col("n") < least
    if own.num_rows < WORDS:
        own = counts.orderBy(F.desc("n"), "h").limit(WORDS).toArrow()
        if own.num_rows:
            n, h = own["n"][-1].as_py(), own["h"][-1].as_py()
            left = (F.col("n") < n) | (F.col("n") == n) & (F.col("h") > h)
    known, seen = own["h"].to_numpy(), own["n"].to_numpy()
    rest = counts.filter(left).select((F.expr(f"pmod(h, {max(LEAST_PER_CLASS, len(known) // 4)})")).cast("int").alias("b"), "n")
    found = rest.groupBy("b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).toArrow()
    disk.drop("counts")
    buckets = max(LEAST_PER_CLASS, len(known) // 4) if found.num_rows else 0
    total, distinct = np.zeros(buckets, np.int64), np.ones(buckets, np.int64)
    total[found["b"].to_numpy()], distinct[found["b"].to_numpy()] = found["n"].to_numpy(), found["d"].to_numpy()
    order = np.argsort(known, kind="stable")
    known, seen = known[order], seen[order]
    both = np.concatenate((seen, total))
    by_rank = np.argsort(-both, kind="stable")
    rank = np.empty(len(both), np.int64)
    rank[by_rank] = np.arange(len(both))
    distinct = np.concatenate((np.ones(len(known), np.int64), distinct))
    return Vocabulary(known, rank[: len(known)], rank[len(known) :], distinct[by_rank], both[by_rank])


def _kind(vocab: Vocabulary) -> type:
    """Numbers that hold every id."""
    return np.uint16 if len(vocab.counts) <= 1 << 16 else np.int32


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """docs: k, s, t.  k, s and the ids of the text's words in order, as bytes; none for a null.  Texts are cut into words here once, not in each round."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(vocab), _kind(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = sent.value
        for batch in batches:
            ids, ends = [], [np.zeros(1, np.int64)]
            for lo, hi, data, offs in tb.groups(batch.column(2), IDS_AT_ONCE):
                code, doc = _words(data, offs)
                ids.append(vocab.ids(code).astype(kind))
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(doc, minlength=hi - lo)))
            coded, offs = np.concatenate(ids) if ids else np.empty(0, kind), np.concatenate(ends) * kind().itemsize
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(coded)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], ["k", "s", "ids"])

    return docs.select("k", "s", "t").mapInArrow(run, "k long, s long, ids binary")


def _coded(column: pa.Array, kind: type) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids, how many each row has) of groups of whole rows."""
    for lo, hi, data, offs in tb.groups(column, IDS_AT_ONCE):
        yield lo, hi, data.view(kind), np.diff(offs) // kind().itemsize


def round_of(nth: np.ndarray, salt: np.ndarray, rounds: int) -> np.ndarray:
    """The round that learns each place, from its number in the document and the hash of the document's key."""
    return (tb.mix(tb.mix(salt) + (nth // RUN).astype(np.uint64)) % np.uint64(rounds)).astype(np.int64)


def one_round(coded: DataFrame, vocab: Vocabulary, net: Net, nth_round: int, rounds: int) -> Net:
    """The average of the weights that all partitions learn from ``net``, weighted by the words learnt."""
    sent, kind = coded.sparkSession.sparkContext.broadcast(net), _kind(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        learner, kept, have = Learner(net), [], 0
        step = FIRST

        def learn() -> int:
            """Learns what is kept; gives the length of the next step."""
            text, chosen = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            at = np.flatnonzero(chosen)
            lo, size = 0, step
            while lo < len(at):
                some = at[lo : lo + size]
                begin = some[0] - SIDE
                learner.learn(text[begin : some[-1] + SIDE + 1], some - begin)
                lo, size = lo + size, min(BATCH, max(FIRST, learner.seen // STEPS))
            return size

        for batch in batches:
            salt = batch.column(1).to_numpy().view(np.uint64)
            for lo, _, ids, size in _coded(batch.column(0), kind):
                if not len(ids):
                    continue
                doc = np.repeat(np.arange(len(size)), size)
                nth = np.arange(len(ids)) - (np.cumsum(size) - size)[doc]
                text, at = stream(ids, doc, len(net.embed) - 1)
                chosen = np.zeros(len(text), bool)
                chosen[at] = round_of(nth, salt[lo + doc], rounds) == nth_round
                # the words around the chosen ones, and no others
                near = chosen.copy()
                for step in range(1, SIDE + 1):
                    near[step:] |= chosen[:-step]
                    near[:-step] |= chosen[step:]
                kept.append((text[near], chosen[near]))
                have += int(chosen.sum())
                if have >= 4 * BATCH:
                    step, have = learn(), 0
        if have:
            learn()
        if learner.seen:
            flat = flatten(learner.net)
            for lo in range(0, len(flat), PART):
                part = flat[lo : lo + PART]
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([part], pa.list_(pa.float32())), pa.array([learner.seen], pa.int64())], ["i", "w", "n"])

    def mean(rows: pa.Table) -> pa.Table:
        w = rows["w"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        n = rows["n"].to_numpy().astype(np.float64)
        return pa.table({"i": rows["i"][:1], "w": pa.array([(n @ w / n.sum()).astype(np.float32)], pa.list_(pa.float32()))})

    # what reaches the driver is one set of weights
    got = coded.select("ids", "s").mapInArrow(run, "i int, w array<float>, n long").groupBy("i").applyInArrow(mean, "i int, w array<float>").toArrow()
    if not got.num_rows:
        return net
    flat = flatten(net)
    for lo, part in zip(got["i"].to_pylist(), got["w"], strict=True):
        flat[lo : lo + len(part)] = part.values.to_numpy()
    return unflatten(flat, len(vocab.counts))


def learn(coded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Net:
    """coded: ids, s (hash of the key)."""
    net = start(vocab.counts)
    for i in range(rounds):
        net = one_round(coded, vocab, net, i, rounds)
    return net


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Net]:
    """docs: t, s (hash of the key).  Gives the ids of words and the network."""
    vocab, disk = vocabulary(docs), Scratch(docs.sparkSession, "lm")
    net = learn(disk.save(encode(docs.withColumn("k", F.lit(0).cast("long")), vocab), "ids"), vocab, rounds)
    disk.drop("ids")
    return vocab, net


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, n_tokens, logprob (sum), mean_logprob, perplexity of each row under the network trained on all rows."""
    given = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))
    vocab = vocabulary(given)
    coded = Scratch(docs.sparkSession, "lm").save(encode(given.withColumn("s", F.xxhash64("k")), vocab), "ids")
    sent, kind = docs.sparkSession.sparkContext.broadcast((vocab.distinct, learn(coded, vocab, rounds))), _kind(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, net = sent.value
        share = np.log(distinct)
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for lo, hi, ids, size in _coded(batch.column(1), kind):
                doc = np.repeat(np.arange(len(size)), size)
                text, at = stream(ids, doc, len(net.embed) - 1)
                for i in range(0, len(ids), AT_ONCE):
                    some = at[i : i + AT_ONCE]
                    begin = some[0] - SIDE
                    logs = log_probabilities(net, text[begin : some[-1] + SIDE + 1], some - begin) - share[ids[i : i + AT_ONCE]]
                    total[lo:hi] += np.bincount(doc[i : i + AT_ONCE], logs, minlength=hi - lo)
                n[lo:hi] = size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total)], ["k", "n_tokens", "logprob"])

    out = coded.select("k", "ids").mapInArrow(run, "k long, n_tokens long, logprob double")
    mean = F.when(F.col("n_tokens") > 0, F.col("logprob") / F.col("n_tokens"))
    return out.select(F.col("k").alias(key), "n_tokens", "logprob", mean.alias("mean_logprob"), F.exp(-mean).alias("perplexity"))
