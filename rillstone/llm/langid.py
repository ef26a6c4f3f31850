"""Language identification: a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of whole documents: about ``PER_LANG`` of each language, or
as many as have ``PER_LANG_BYTES`` together where that is less, drawn by hash.  A document is cut into stretches of ``SPAN`` bytes
without a gap; the network labels every byte of a stretch with a distribution over languages, and the document's probabilities
are the mean over all its bytes.

The fit sees only text and non-null lang of documents that are not held out.  Null texts and texts without a letter are
``und`` with score 0; without a labelled document in the fit every text is.  Repeated rows get the same answer; ties go to
the language first in order; an empty table gives an empty table.  Columns besides those named don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .quality import fold, held_out

HIDDEN, SPAN, BATCH = 8, 128, 1024
PER_LANG, PER_LANG_BYTES = 300, 1 << 20
EPOCHS, RATE, TRAIN_BATCH = 2, 0.01, 128
#: a small sample is gone through more often, until so many steps are done
LEAST_STEPS = 400
PAD = 256
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32


class Network(NamedTuple):
    """Two directions in the first axis; gates in the second: update, reset, candidate.

    x: what each byte (and the pad) adds to the gates; u: what the state adds; v, c: state to languages."""

    langs: list[str]
    x: np.ndarray  # 2, 3 hidden, 257
    u: np.ndarray  # 2, 3 hidden, hidden
    v: np.ndarray  # 2, langs, hidden
    c: np.ndarray  # langs, 1


def start(langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    return Network(langs, draw(2, 3 * hidden, 257, s=0.3), draw(2, 3 * hidden, hidden, s=0.4), draw(2, len(langs), hidden, s=0.3), np.zeros((len(langs), 1), np.float32))


def _padded(net: Network) -> Network:
    """The pad leaves the state as it is: its update gate is shut."""
    x, hidden = net.x.copy(), net.u.shape[2]
    x[:, :, PAD] = 0
    x[:, :hidden, PAD] = 60
    return net._replace(x=x)


def _sigmoid(a: np.ndarray) -> None:
    a *= 0.5
    np.tanh(a, out=a)
    a *= 0.5
    a += 0.5


def _softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    logits -= logits.max(axis, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis, keepdims=True)
    return logits


def label_bytes(net: Network, codes: np.ndarray) -> np.ndarray:
    """Distributions (span, langs, batch) for byte codes (span, batch), pads at the end."""
    net = _padded(net)
    span, batch = codes.shape
    hidden = net.u.shape[2]
    states = np.empty((span + 1, 2, hidden, batch), np.float32)
    states[0] = 0
    a, x = np.empty((2, 3 * hidden, batch), np.float32), np.empty((2, 3 * hidden, batch), np.float32)
    gates, new = a[:, : 2 * hidden], a[:, 2 * hidden :]
    for t in range(span):
        h = states[t]
        np.matmul(net.u, h, out=a)
        np.take(net.x[0], codes[t], axis=1, out=x[0], mode="clip")
        np.take(net.x[1], codes[span - 1 - t], axis=1, out=x[1], mode="clip")
        gates += x[:, : 2 * hidden]
        _sigmoid(gates)
        new *= gates[:, hidden:]
        new += x[:, 2 * hidden :]
        np.tanh(new, out=new)
        np.subtract(h, new, out=states[t + 1])
        states[t + 1] *= gates[:, :hidden]
        states[t + 1] += new
    logits = np.matmul(net.v[0], states[1:, 0])
    logits += np.matmul(net.v[1], states[:0:-1, 1])
    logits += net.c
    return _softmax(logits, 1)


def gradients(net: Network, codes: np.ndarray, answer: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the bytes of (span, batch) codes and its gradients for x, u, v, c."""
    net = _padded(net)
    span, batch = codes.shape
    hidden = net.u.shape[2]
    both = np.stack((codes, codes[::-1]), 1)  # span, 2, batch
    states = np.zeros((span + 1, 2, hidden, batch), np.float32)
    kept = []
    for t in range(span):
        a = np.matmul(net.u, states[t])
        x = np.stack([net.x[d][:, both[t, d]] for d in (0, 1)])
        gates = a[:, : 2 * hidden] + x[:, : 2 * hidden]
        _sigmoid(gates)
        z, r = gates[:, :hidden], gates[:, hidden:]
        new = np.tanh(x[:, 2 * hidden :] + r * a[:, 2 * hidden :])
        states[t + 1] = new + z * (states[t] - new)
        kept.append((z, r, new, a[:, 2 * hidden :]))
    forward, backward = states[1:, 0], states[:0:-1, 1]
    p = _softmax(np.matmul(net.v[0], forward) + np.matmul(net.v[1], backward) + net.c, 1)
    real = (codes != PAD).astype(np.float32)
    total = max(1.0, float(real.sum()))
    loss = -float((np.log(np.maximum(1e-9, p[:, answer, np.arange(batch)])) * real).sum()) / total
    p[:, answer, np.arange(batch)] -= 1
    p *= real[:, None, :] / total
    dv = np.stack((np.einsum("tlb,thb->lh", p, forward, optimize=True), np.einsum("tlb,thb->lh", p, backward, optimize=True)))
    out = np.stack((np.matmul(net.v[0].T, p), np.matmul(net.v[1].T, p)[::-1]), 1)
    dx, du = np.zeros_like(net.x), np.zeros_like(net.u)
    dh = np.zeros((2, hidden, batch), np.float32)
    one = np.zeros((batch, 257), np.float32)
    row = np.arange(batch)
    for t in range(span - 1, -1, -1):
        z, r, new, inner = kept[t]
        dh = dh + out[t]
        dnew = dh * (1 - z) * (1 - new * new)
        dz = dh * (states[t] - new) * z * (1 - z)
        dr = dnew * inner * r * (1 - r)
        da = np.concatenate((dz, dr, dnew * r), 1)
        dx_t = np.concatenate((dz, dr, dnew), 1)
        for d in (0, 1):
            one[row, both[t, d]] = 1
            dx[d] += dx_t[d] @ one
            one[row, both[t, d]] = 0
        du += np.matmul(da, states[t].transpose(0, 2, 1))
        dh = dh * z + np.matmul(net.u.transpose(0, 2, 1), da)
    dx[:, :, PAD] = 0
    return loss, [dx, du, dv, p.sum((0, 2))[:, None]]


def train(langs: list[str], codes: np.ndarray, answer: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam over shuffled batches; codes: (stretches, span)."""
    net = start(langs, seed=seed)
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    weights = [net.x, net.u, net.v, net.c]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    batches = -(-len(codes) // TRAIN_BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for lo in range(0, len(order), TRAIN_BATCH):
            some = order[lo : lo + TRAIN_BATCH]
            _, grads = gradients(net, codes[some].T, answer[some])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * (1 - 0.9 * step / steps)
            for w, g, m, s in zip(weights, grads, first, second, strict=True):
                g *= min(1.0, 1 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def stretches(data: np.ndarray, offs: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(codes (n, span), text of each): every text cut without a gap; pads fill the last one of each."""
    length = np.diff(offs)
    per = -(-length // span)
    doc = np.repeat(np.arange(len(length)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    at = offs[:-1][doc] + nth * span
    index = at[:, None] + np.arange(span)
    inside = index < offs[1:][doc][:, None]
    codes = _FOLD[data[np.where(inside, index, 0)]] if len(data) else np.empty((0, span), np.int64)
    codes[~inside] = PAD
    return codes, doc


def fit(docs: DataFrame, per_lang: int = PER_LANG, per_lang_bytes: int = PER_LANG_BYTES) -> Network | None:
    """docs: k, t, lang.  Null without a labelled document."""
    own = docs.filter("k is not null and lang is not null and t is not null").filter(fold(F.col("k")) != 0)
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("size")).collect()
    if not counts:
        return None
    langs = sorted(r.lang for r in counts)
    share = F.coalesce(*[F.when(F.col("lang") == r.lang, F.lit(min(1.0, per_lang / r.n, per_lang_bytes / max(1, r.size)))) for r in counts])
    drawn = own.filter((F.pmod(F.xxhash64("k", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column(1).to_pylist()
            for lo, _, data, offs in tb.groups(batch.column(0)):
                codes, doc = stretches(data, offs)
                cuts = codes.astype("<u2")
                for at in range(0, len(cuts), 8192):
                    some = slice(at, at + 8192)
                    yield pa.RecordBatch.from_arrays([pa.array([named[lo + d] for d in doc[some]], pa.string()), pa.array([x.tobytes() for x in cuts[some]], pa.binary())], ["lang", "cut"])

    got = drawn.select("t", "lang").mapInArrow(run, "lang string, cut binary").toArrow()
    if not got.num_rows:
        return None
    rows = sorted(zip(got["lang"].to_pylist(), got["cut"].to_pylist(), strict=True))
    codes = np.frombuffer(b"".join(cut for _, cut in rows), "<u2").reshape(len(rows), SPAN).astype(np.int64)
    number = {k: i for i, k in enumerate(langs)}
    return train(langs, codes, np.array([number[k] for k, _ in rows]))


def document_probabilities(net: Network, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """texts x langs: mean distribution over all bytes; even for an empty text."""
    codes, doc = stretches(data, offs)
    total = np.zeros((len(offs) - 1, len(net.langs)))
    for lo in range(0, len(doc), BATCH):
        some = codes[lo : lo + BATCH]
        p = label_bytes(net, some.T)
        p *= (some.T != PAD)[:, None, :]
        np.add.at(total, doc[lo : lo + BATCH], p.sum(0).T)
    size = np.diff(offs)[:, None]
    return np.where(size > 0, total / np.maximum(size, 1), 1 / len(net.langs))


def append_languages(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with __lang and __lang_score of each row's text."""
    lettered = F.coalesce(F.expr(f"`{text}` rlike '\\\\p{{L}}'"), F.lit(False))
    if net is None:
        return docs.withColumns({"__lang": F.lit(UNKNOWN), "__lang_score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make(column: pa.Array) -> list[pa.Array]:
        # texts without a letter come as null
        known = column.is_valid().to_pylist()
        names, scores = [], []
        for lo, hi, data, offs in tb.groups(column):
            p = document_probabilities(sent.value, data, offs)
            best = p.argmax(1)
            for d in range(hi - lo):
                names.append(sent.value.langs[best[d]] if known[lo + d] else UNKNOWN)
                scores.append(min(1.0, float(p[d, best[d]])) if known[lo + d] else 0.0)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    seen = docs.withColumn("__seen", F.when(lettered, F.col(text)))
    out = tb.append(seen, "__seen", [("__lang", T.StringType()), ("__lang_score", T.DoubleType())], make)
    return out.drop("__seen")


def fit_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Network | None:
    return fit(docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"), docs[lang].alias("lang")), per_lang)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """key, held_out, lang_pred, score of each row, learnt from its rows that are not held out."""
    net = fit_documents(docs, key, text, lang, per_lang)
    out = append_languages(docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")), net, "t")
    return out.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__lang_score").alias("score"))
