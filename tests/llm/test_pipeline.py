"""The pipeline's stages: what each keeps, and that all of what is kept is packed."""

import re

import numpy as np
import pyarrow as pa
from test_text_operators import expected_hits

import corpus_pipeline
from rillstone.llm import langid, packing, quality, queries
from rillstone.llm import textbytes as tb


def test_stages_and_result(spark, sf):
    docs = queries.table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_dedup", "decontamination", "packing"]
    kept, before = docs, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns and 0 < kept.count() <= before
        before = kept.count()
    assert kept.select("doc_id").distinct().count() == before
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_result_against_plain_recomputation(spark, sf):
    """What run() packs, from plain code: scores from the definition with the learnt weights, all pairs of shingle sets, and a scan
    for passages; each id of what is left is in one piece."""
    docs = queries.table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()

    _, model = quality.fit_documents(docs, queries.table(spark, sf, "labels"))
    good = {}
    for d, r in rows.items():
        x = quality.statistics(*tb.buffers(pa.array([r.text])))[0]
        z = [min(8, max(-8, v)) for v in (x - model.centre) / model.scale]
        raw = model.weights[0] + sum(w * np.sqrt(2 / len(model.phases)) * np.cos(np.dot(z, model.frequencies[:, i]) + model.phases[i]) for i, w in enumerate(model.weights[1:]))
        if min(1, max(0, np.interp(raw, model.steps_at, model.steps))) >= quality.THRESHOLD:
            good[d] = r

    kept = spark.createDataFrame(list(good.values()), docs.schema)
    net = langid.fit_documents(kept)
    least = 1 / len(net.langs) + corpus_pipeline.LEAST_MARGIN * (1 - 1 / len(net.langs))
    # the network's pass over a text is held against the definition in test_models
    best = lambda text: langid.document_probabilities(net, *tb.buffers(pa.array([text]))).max()
    spoken = {d: r for d, r in good.items() if any(c.isalpha() for c in r.text or "") and best(r.text) >= least}

    sets, parent = {}, {d: d for d in spoken}
    for d, r in spoken.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in r.text))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(spoken)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    left = {d for d in spoken if root(d) == d and not expected_hits("".join(c.lower() if c.isascii() else c for c in rows[d].text), items)[1]}

    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == left
    tokens = {r.doc_id: r.doc_tokens for r in got}
    encode = packing.encoder(queries.tokenizer_path(), 0)
    assert all(len(encode(rows[d].text)) // 4 == n for d, n in tokens.items())
    # where each piece goes is replayed in test_text_operators
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held, whole in ((pieces, tokens), (sequences, None)):
        for name, spans in held.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at and length > 0
                at += length
            assert at == whole[name] if whole else at == packing.WINDOW or at & (at - 1) == 0 and at < packing.WINDOW


def test_odd_documents(spark, tmp_path):
    rows = [(1, "the of and to " * 30, "en", "a", 1), (1, "the of and to " * 30, "en", "a", 1), (2, None, "en", "a", 0), (3, "", None, None, 0), (None, "und der die das " * 30, "de", "b", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, None} and sum(r.start == 0 for r in got) == 2
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
