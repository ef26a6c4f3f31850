"""Learnt operators: gradients, held-out accuracy, recall, and the corner cases."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillstone.llm import ann, langid, lm, quality, queries

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "... 123 !!", "de", None), (4, "The cat and the dog. " * 3000, None, "b"), (4, "The cat and the dog. " * 3000, None, "b"), (None, "le la les de", "fr", "c"), (5, "und der die das " * 20, "de", "c"), (6, "the of and to " * 20, "en", "c")]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as k", "'y' as t")


def test_byte_network_gradients():
    rng = np.random.default_rng(0)
    net = langid.start(["a", "b", "c"])
    net = net._replace(x=net.x.astype(float), u=net.u.astype(float), v=net.v.astype(float), c=net.c.astype(float))
    codes, answer = rng.integers(97, 120, (7, 5)), rng.integers(0, 3, 5)
    codes[5:, 2] = langid.PAD
    _, grads = langid.gradients(net, codes, answer)
    for w, g, at in zip(net[1:], grads, [(1, 20, int(codes[1, 1])), (1, 18, 3), (0, 2, 6), (1, 0)], strict=True):
        old = w[at]  # states are kept in single precision, which bounds how exact a difference can be
        w[at] = old + 1e-3
        up = langid.gradients(net, codes, answer)[0]
        w[at] = old - 1e-3
        down = langid.gradients(net, codes, answer)[0]
        w[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 2e-5


def test_pads_change_nothing():
    net = langid.start(["a", "b"])
    codes = np.random.default_rng(1).integers(97, 120, (9, 4))
    padded = np.vstack((codes, np.full((5, 4), langid.PAD)))
    assert np.allclose(langid.label_bytes(net, codes), langid.label_bytes(net, padded)[:9], atol=1e-5)


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = queries.op8_language(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_corner_cases(spark, odd):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[4].lang_pred in ("en", "de")
    assert langid.identify(odd).count() == 8
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0


def test_isotonic_is_the_least_squares_fit():
    y = np.array([0.1, 0.5, 0.3, 0.9, 0.2, 1.0])
    at, level = quality.isotonic(np.arange(6.0), y, np.ones(6))
    assert np.allclose(level, [0.1, 0.4, 0.55, 1.0]) and (np.diff(at) > 0).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op6_quality(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_never_sees_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, round(r.score, 9)) for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_corner_cases(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (6, None, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(odd, labels).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(odd.limit(0), labels).count() == 0


def test_quality_equals_a_dense_ridge(spark, sf):
    """The whole query at the smallest scale: one dense solve, isotonic levels by their max-min formula, every document scored plainly."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    _, model = quality.fit_documents(docs, labels)
    crc = lambda k: zlib.crc32(str(k).encode()) % 5
    given = {r.doc_id: r.quality for r in labels.collect() if crc(r.doc_id)}
    rows = {r.doc_id: quality.statistics(*lm.tb.buffers(pa.array([r.text])))[0] for r in docs.collect()}
    ids = [d for d in sorted(given) if d in rows]
    x, y = np.array([rows[d] for d in ids]), np.array([given[d] for d in ids], float)
    assert np.allclose(model.centre, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-3))
    fitted = np.array([crc(d) != 1 for d in ids])
    z = model.features(x)
    gram = z[fitted].T @ z[fitted]
    penalty = quality.RIDGE * fitted.sum() * np.eye(len(gram))
    penalty[0, 0] = 0
    weights = np.linalg.solve(gram + penalty, z[fitted].T @ y[fitted])
    assert np.allclose(z @ weights, z @ model.weights, atol=1e-6)
    cell = np.clip(np.floor((z[~fitted] @ weights + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)
    cells = sorted(set(cell))
    mean = lambda lo, hi: y[~fitted][(cell >= cells[lo]) & (cell <= cells[hi])].mean()
    level = [max(min(mean(j, k) for k in range(i, len(cells))) for j in range(i + 1)) for i in range(len(cells))]
    blocks = {}
    for c, v in zip(cells, level, strict=True):
        blocks.setdefault(round(v, 9), []).append(c)
    at = [np.average([(c + 0.5) * 2 / quality.BINS - 0.5 for c in cs], weights=[(cell == c).sum() for c in cs]) for cs in blocks.values()]
    assert np.allclose(model.steps, list(blocks), atol=1e-8) and np.allclose(model.steps_at, at, atol=1e-8)
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert got.keys() == rows.keys()
    for d, r in got.items():
        want = min(1.0, max(0.0, float(np.interp(model.features(rows[d][None])[0] @ weights, at, list(blocks)))))
        assert abs(r.score - want) < 1e-5 and r.held_out == (crc(d) == 0)


def _plain_language(net, text):
    """Byte by byte from the definition of the gates; mean distribution over all bytes."""
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    data = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    h, total = net.u.shape[2], np.zeros(len(net.langs))
    for at in range(0, len(data), langid.SPAN):
        cut = data[at : at + langid.SPAN]
        states = []
        for d, line in enumerate((cut, cut[::-1])):
            state, seen = np.zeros(h), []
            for b in line:
                x, a = net.x[d][:, b].astype(float), net.u[d].astype(float) @ state
                z, r = sigmoid(x[:h] + a[:h]), sigmoid(x[h : 2 * h] + a[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * a[2 * h :])
                seen.append(state)
            states.append(seen)
        for forward, backward in zip(states[0], states[1][::-1], strict=True):
            logits = np.exp(net.v[0] @ forward + net.v[1] @ backward + net.c[:, 0])
            total += logits / logits.sum()
    return total / len(data)


def test_languages_equal_a_plain_recomputation(spark, sf):
    """The whole query at the smallest scale against the learnt network run byte by byte."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = langid.fit_documents(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got.keys() == rows.keys()
    checked = 0
    for d in sorted(rows):
        text = rows[d] or ""
        if not any(c.isalpha() for c in text):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
        elif len(text) < 3000 and checked < 25:
            p = _plain_language(net, text)
            checked += 1
            assert got[d].lang_pred == net.langs[int(p.argmax())] and abs(got[d].score - p.max()) < 1e-3
    assert checked == 25


def test_languages_are_learnt_from_whole_texts(spark, monkeypatch):
    """What tells the languages apart stands at the end of long texts only."""
    rows = [(i, "x y z " * 400 + ("ä ö ü " if i % 2 else "é è ê ") * 400, "de" if i % 2 else "fr") for i in range(40)]
    seen = []
    monkeypatch.setattr(langid, "train", lambda langs, codes, answer: seen.append((codes, answer)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit_documents(docs)
    codes, answer = seen[0]
    fitted = [(t.encode(), k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 5]
    assert (codes != langid.PAD).sum() == sum(len(t) for t, _ in fitted) and len(answer) == sum(-(-len(t) // langid.SPAN) for t, _ in fitted)
    langid.fit_documents(docs, per_lang=5)
    assert 0 < len(seen[1][1]) < len(answer) / 2


def test_lm_beats_the_unigram(spark):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("a b c d e", "f g h i j", "k l m n o")) for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score_documents(docs).collect()
    mean = sum(r.logprob for r in got) / sum(r.n_tokens for r in got)
    assert mean > -1.6 and all(r.n_tokens == 300 for r in got)  # 15 equally frequent words: -2.7 without context
    strange = spark.createDataFrame([*rows, (999, "a k f o b e j c " * 40)], "doc_id long, text string")
    scores = {r.doc_id: r.mean_logprob for r in lm.score_documents(strange).collect()}
    assert scores[999] < sorted(scores.values())[3]


def test_lm_learns_every_place_of_a_period(spark):
    docs = spark.createDataFrame([(i, "w0 w1 w2 w3 w4 w5 w6 w7 " * 40) for i in range(300)], "doc_id long, text string")
    got = lm.score_documents(docs).collect()
    assert all(r.n_tokens == 320 and r.mean_logprob > -0.7 for r in got)  # -2.1 without context


def test_lm_rounds_share_out_every_place():
    nth, salt = np.tile(np.arange(256), 500), np.repeat(np.arange(500), 256).astype(np.uint64)
    got = lm.round_of(nth, salt, 2)
    assert set(got) == {0, 1} and all(200 < got[nth == i].sum() < 300 for i in range(256))


def _code(*names):
    w = lm.tb.words(*lm.tb.buffers(pa.array(names)), lm.tb.ALNUM)
    return w.hash


def test_lm_tells_a_rare_word_from_the_frequent_one_of_its_cell(spark):
    names = [f"g{i}" for i in range(60_000)]
    cell = _code(*names) % np.uint64(4096)
    rare = names[int(np.flatnonzero(cell == _code("the")[0] % np.uint64(4096))[0])]
    docs = spark.createDataFrame([*((i, "the") for i in range(2000)), (5000, rare)], "doc_id long, text string")
    got = {r.doc_id: r.logprob for r in lm.score_documents(docs).collect()}
    assert got[0] > -0.5 and got[5000] < got[0] - 3


def test_lm_vocabulary_follows_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 3)
    rows = [(f"c{i} " * 3,) for i in range(5000)] + [(f"r{i}",) for i in range(3000)]
    vocab = lm.vocabulary(spark.createDataFrame(rows, "t string"))
    common, rest = vocab.ids(_code(*(f"c{i}" for i in range(5000)))), vocab.ids(_code(*(f"r{i}" for i in range(3000))))
    assert len(set(common)) == 5000 and not set(common) & set(rest) and (vocab.counts[common] == 3).all()
    assert vocab.counts.sum() == 18_000 and (vocab.distinct[rest] == np.bincount(rest)[rest]).all()
    few = lm.vocabulary(spark.createDataFrame(rows[:100], "t string"))
    assert len(few.counts) == 100
    monkeypatch.setattr(lm, "COMMON", 1000)
    some = lm.vocabulary(spark.createDataFrame(rows, "t string"))
    assert len(some.known) == 4096 and some.counts.sum() == 18_000 and len(set(some.ids(some.known.view(np.uint64)))) == 4096


def test_lm_corner_cases(spark, odd):
    got = [r for r in lm.score_documents(odd).collect()]
    assert len(got) == 8 and [(r.n_tokens, r.logprob, r.perplexity) for r in got if r.doc_id in (1, 2)] == [(0, 0.0, None)] * 2
    assert lm.score_documents(odd.limit(0)).count() == 0


def _tiny_net(ids=100, seed=4):
    rng = np.random.default_rng(seed)
    net = lm.start(np.sort(rng.integers(1, 1000, ids))[::-1])
    return lm.Net(*[(w + rng.normal(0, 0.3, w.shape)).astype(np.float64) for w in net])


def _plain_log_probability(net, around, word):
    """From the definition: one word, sums over all ids of a softmax in double precision."""
    hidden = np.tanh(net.bias + sum(net.place[j] * net.embed[x] for j, x in enumerate(around)))
    c, i = divmod(word, net.to_word.shape[2])
    classes, words = net.to_class[-1] + hidden @ net.to_class[:-1], net.to_word[c, -1] + hidden @ net.to_word[c, :-1]
    return classes[c] - np.log(np.exp(classes).sum()) + words[i] - np.log(np.exp(words).sum())


def _plain_score(net, texts):
    mark = len(net.embed) - 1
    out = []
    for t in texts:
        wide = [mark, mark, *t, mark, mark]
        out.append(sum(_plain_log_probability(net, [wide[i], wide[i + 1], wide[i + 3], wide[i + 4]], w) for i, w in enumerate(t)))
    return out


def test_lm_scores_equal_a_plain_recomputation(spark, sf):
    """The whole query at the smallest scale, with the learnt weights, word by word from the definition."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = docs.selectExpr("doc_id as k", "text as t")
    vocab, net = lm.train(given.select("t", F.xxhash64("k").alias("s")))
    rows = {r.doc_id: r for r in docs.collect()}
    scored = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert scored.keys() == rows.keys()
    net = lm.Net(*[w.astype(np.float64) for w in net])
    for d in sorted(rows)[::10]:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in rows[d].text or ""))
        ids = vocab.ids(_code(*w)).tolist() if w else []
        want = _plain_score(net, [ids])[0] - np.log(vocab.distinct[ids]).sum()
        assert scored[d].n_tokens == len(w) and abs(scored[d].logprob - want) <= 1e-4 * max(1, abs(want))


def test_texts_become_ids_once(spark, monkeypatch):
    """op9: rounds and scores read the ids of the words; empty texts and nulls keep their rows, also where ids take four bytes."""
    texts = ["b a b", None, "", " .", *(f"w{i % 130} a" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    vocab = lm.vocabulary(docs)
    with monkeypatch.context() as m:
        m.setattr(lm, "IDS_AT_ONCE", 64)
        for kind in (np.uint16, np.int32):
            m.setattr(lm, "_kind", lambda vocab, kind=kind: kind)
            rows = {r.k: r for r in lm.encode(docs.withColumn("s", F.xxhash64("k")), vocab).collect()}
            for k, t in enumerate(texts):
                w = re.findall("[0-9a-z]+", t or "")
                assert np.frombuffer(rows[k].ids, kind).tolist() == (vocab.ids(_code(*w)).tolist() if w else [])
            column = pa.array([bytes(rows[k].ids) for k in range(len(texts))], pa.binary())
            for c in (column, column.cast(pa.large_binary())):
                parts = list(lm._coded(c, kind))
                assert len(parts) > 1 and np.concatenate([p[3] for p in parts]).tolist() == [len(re.findall("[0-9a-z]+", t or "")) for t in texts]
                assert b"".join(p[2].tobytes() for p in parts) == b"".join(column.to_pylist())
    coded = lm.encode(docs.withColumn("s", F.xxhash64("k")), vocab).select("ids", "s")
    net = lm.learn(coded, vocab)
    assert net.embed.shape == lm.start(vocab.counts).embed.shape and not np.array_equal(net.to_class, lm.start(vocab.counts).to_class)


def test_lm_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = _tiny_net()
    texts = [rng.integers(0, 100, 9).tolist(), [5], rng.integers(0, 100, 4).tolist()]
    text, at = lm.stream(np.concatenate(texts), np.repeat([0, 1, 2], [9, 1, 4]), len(net.embed) - 1)
    learner = lm.Learner(lm.Net(*[w.astype(np.float32) for w in net]))
    loss, grads = learner.gradients(text, at)
    assert abs(loss + sum(_plain_score(net, texts))) < 1e-3
    whole = {k: grads[k] for k in ("place", "bias", "to_class")}
    whole["embed"] = np.zeros_like(net.embed)
    whole["embed"][grads["embed"][0]] = grads["embed"][1]
    whole["to_word"] = np.zeros_like(net.to_word)
    for c, grad in grads["to_word"].items():
        whole["to_word"][c] = grad
    for name, grad in whole.items():
        w = getattr(net, name)
        for at in zip(*[rng.integers(0, n, 12) for n in w.shape], strict=True):
            kept = w[at]
            w[at] = kept + 1e-4
            up = -sum(_plain_score(net, texts))
            w[at] = kept - 1e-4
            down = -sum(_plain_score(net, texts))
            w[at] = kept
            assert abs((up - down) / 2e-4 - grad[at]) < 2e-3 * max(1, abs(grad[at])), (name, at)


def test_lm_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(3)
    learner = lm.Learner(lm.start(np.ones(lm.WORDS)))
    text, at = lm.stream(rng.integers(0, 50, 400), np.zeros(400, int), lm.WORDS)
    losses = [learner.learn(text, at) for _ in range(30)]
    assert losses[-1] < 0.7 * losses[0]
    assert np.allclose(lm.flatten(lm.unflatten(lm.flatten(learner.net))), lm.flatten(learner.net))


def test_neighbours_recall_and_exact_distances(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in ann.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("id") % 5 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11)) and np.allclose([r.score for r in found], [d[ids == r.vec_id][0] for r in found], rtol=1e-14)
        hit += len(set(best) & {r.vec_id for r in found})
    assert len(got) == sum(ids % 5 == 0) and hit >= 0.9 * 10 * len(got)


def test_neighbours_corner_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as part")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("id").isin(0, 4), k=10).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 2, 0.0), (0, 4, 9, 0.707107)]
    assert ann.nearest(df.limit(0), F.col("id") == 0).count() == 0


def test_neighbours_of_very_large_and_very_small_vectors(spark):
    for unit in (1e200, 1e-200):
        df = spark.createDataFrame([(i, [unit * 3 * i, unit * 4 * i]) for i in range(1, 7)], "vec_id long, embedding array<double>")
        got = sorted((r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("id") == 1, k=10).collect())
        assert [(a, b) for a, b, _ in got] == [(i, i + 1) for i in range(1, 6)]
        assert np.allclose([c / unit for _, _, c in got], [5 * i for i in range(1, 6)], rtol=1e-12)


def test_balanced_parts():
    x = np.random.default_rng(5).normal(size=(600, 8))
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 8), 6)
    assert np.bincount(part, minlength=6).max() <= np.ceil(ann.SLACK * 100) and (part >= 0).all()


def test_logits_are_held_back_where_they_come_far():
    """op9: only weights that can give logits beyond 60 have them looked through; sums divide the narrow factors, the result is the softmax's."""
    rng = np.random.default_rng(5)
    text = np.array([64, 64, *rng.integers(0, 64, 40), 64, 64])
    at = np.arange(2, 42)
    for size in (1.0, 500.0):
        net = lm.start(np.arange(64, 0, -1))
        net.to_word[:, :-1] *= size
        assert lm._far(net.to_word) == (size > 1)
        hidden = lm._with_one(lm.hidden_layer(net, text)[0]).astype(float)
        x = np.minimum(hidden @ net.to_word[0].astype(float), 60)
        p = np.exp(x) / np.exp(x).sum(1)[:, None]
        own = p[np.arange(40), text[at]]
        assert np.allclose(lm.log_probabilities(net, text, at), np.log(own), atol=1e-3)
        loss, grads = lm.Learner(net).gradients(text, at)
        p[np.arange(40), text[at]] -= 1
        assert np.isclose(loss, -np.log(own).sum(), rtol=1e-3) and np.allclose(grads["to_word"][0], hidden.T @ p, atol=1e-2)
