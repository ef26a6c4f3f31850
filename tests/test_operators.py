"""Windows, joins, samples and summaries: plain recursions, literal cases, and independence of partitions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.functions import arrow
from rillstone.operators import aggregates as A, datasets as D, joins as J, sampling as S, scoring as C, windows as W
from rillstone.operators.running import nearby, running
from rillstone.plans import training_set as P


@pytest.fixture(scope="module")
def packets(spark):
    rng = random.Random(1)
    rows = []
    for run in range(6):
        at = 0
        for i in range(60):
            at += rng.randint(0, 300)
            rows.append((f"r{run}", i, float(at), float(rng.randint(0, 400))))
    return spark.createDataFrame(rows, "run_id string, packet_index int, arrival_ms double, duration_ms double")


def test_playout_and_backlog(spark, packets):
    rows = sorted(map(tuple, packets.collect()))
    end, total, expected = {}, {}, {}
    for run, i, at, d in rows:
        start = max(at, end.get(run, float("-inf")))
        end[run] = start + d
        total[run] = max(0.0, total.get(run, 0.0) + d - 170)
        expected[run, i] = (start, end[run], start - at, total[run])
    for parts in (1, 7):
        df = packets.repartition(parts)
        got = W.backlog(W.fifo_playout(df, ["run_id"], ["packet_index"]), ["run_id"], ["packet_index"], F.col("duration_ms"), F.lit(170.0)).collect()
        assert {(r.run_id, r.packet_index): (r.playout_start_ms, r.playout_end_ms, r.queue_delay_ms, r.backlog) for r in got} == expected
        cut = df.withColumn("b", F.floor(F.col("packet_index") / 7))
        got = W.backlog(W.fifo_playout(cut, ["run_id"], ["packet_index"], block="b"), ["run_id"], ["packet_index"], F.col("duration_ms"), F.lit(170.0), block="b").collect()
        assert {(r.run_id, r.packet_index): (r.playout_start_ms, r.playout_end_ms, r.queue_delay_ms, r.backlog) for r in got} == expected


def test_running_in_blocks(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").withColumn("b", F.floor(F.col("i") / 11))
    for kind in ("sum", "max", "min", "last"):
        plain, cut = ({(r.k, r.i): r.x for r in running(df, ["k"], ["i"], F.col("v"), kind, "x", block).collect()} for block in (None, "b"))
        assert plain == cut and len(cut) == 300


def test_known_units(spark):
    """Two packets of 200 ms at 100 and 150; units at 50, 250 and 400; sends of 500 and 900."""
    p = spark.createDataFrame([("r", 0, 100.0, 200.0), ("r", 1, 150.0, 200.0)], "run string, packet_index int, arrival_ms double, duration_ms double")
    p = W.fifo_playout(p, ["run"], ["packet_index"]).withColumn("audio_end_ms", (F.col("packet_index") + 1) * 200.0).withColumn("audio_start_ms", F.col("audio_end_ms") - 200)
    u = spark.createDataFrame([("r", 0, 50.0), ("r", 1, 250.0), ("r", 2, 400.0)], "run string, unit int, position_ms double")
    elapsed = W.unit_playout(p, J.packet_at(p, u, "run").select("run", "unit", "packet_index", "position_ms"), "run")
    sends = spark.createDataFrame([("r", 100.0, 500.0, 0), ("r", 300.0, 900.0, 1)], "run string, t double, sent double, n int")
    delays = J.as_of(sends, elapsed.select("run", F.col("elapsed_ms").alias("t"), F.col("unit").alias("n")), "run", "t", "sent", "n")
    assert [r.elapsed_ms for r in elapsed.orderBy("unit").collect()] == [150.0, 350.0, 500.0]
    assert [r.sent_as_of for r in delays.orderBy("n").collect()] == [500.0, 900.0, 900.0]


def test_interpolation(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 200.0), ("a", 2, None), ("a", 3, 300.0), ("a", 4, None)], "k string, i int, v double")
    assert [r.v_filled for r in W.interpolate(df, ["k"], "i", "v").orderBy("i").collect()] == [200.0, 200.0, 250.0, 300.0, 300.0]


def test_latency_recursion(spark):
    rng = random.Random(4)
    rows = []
    for run in range(20):
        n = rng.randint(1, 15)
        rows.append((run, sorted(rng.uniform(0, 120) for _ in range(n)), 100.0, rng.randint(1, 20)))
    got = {r.run: r for r in C.emission_latency(spark.createDataFrame(rows, "run int, delays array<double>, source_length double, reference_length int")).collect()}
    for run, d, src, ref in rows:
        n, gamma, prev, dal = len(d), len(d) / src, None, 0.0
        for i, x in enumerate(d):
            prev = x if prev is None else max(x, prev + 1 / gamma)
            dal += prev - i / gamma
        tau = next((i + 1 for i, x in enumerate(d) if x >= src), n)
        lag = lambda m: sum(d[i] - i * src / m for i in range(tau)) / tau
        assert got[run].dal == pytest.approx(dal / n) and got[run].al == pytest.approx(lag(ref)) and got[run].laal == pytest.approx(lag(max(n, ref))) and got[run].ap == pytest.approx(sum(d) / (src * n))


def test_frames(spark):
    rng = random.Random(6)
    rows = [(k, i, c) for k in range(30) for i, c in enumerate(sorted(rng.uniform(0, 3) for _ in range(8)))]
    df = spark.createDataFrame(rows, "k int, i int, cut_s double").withColumn("total", F.lit(60))
    got = {}
    for r in W.frame_cuts(df, "k", "i", 12.5, "total").collect():
        got[r.k, r.i] = r.frame_end
    for k in range(30):
        last = 0
        for i in range(8):
            last = max(max(1, round(rows[k * 8 + i][2] * 12.5)), last + 1)
            assert got[k, i] == min(last, 60)


def test_chunk_boundaries(spark):
    spans = spark.createDataFrame([("d", 0, 0, 2, 3), ("d", 1, 2, 2, 3), ("d", 2, 2, 3, 3), ("e", 0, 0, 9, 9)], "k string, chunk int, word_start int, word_end int, n_words int")
    iv = spark.createDataFrame([("d", 0.1, 0.5), ("d", 0.5, 0.9), ("d", 1.0, 1.04), ("e", 0.0, 1.0)], "k string, start_s double, end_s double")
    got = {(r.k, r.chunk): (r.start_s, r.end_s, r.reason) for r in W.chunk_times(spans, iv, "k").collect()}
    assert got["d", 0] == (0.1, 0.9, None) and got["d", 1][:2] == (None, None) and got["d", 2][:2] == (None, None) and got["e", 0][2] == "interval_word_mismatch"
    timed = spark.createDataFrame([("d", 0, None, None), ("d", 1, 0.5, 1.0), ("d", 2, 1.5, 2.0)], "k string, i int, start_s double, end_s double").withColumn("dur", F.lit(3.0))
    edges = W.edge_silence(timed, "k", "i", "dur").orderBy("i").collect()
    assert [(r.start_s, r.end_s) for r in edges] == [(None, None), (0.0, 1.0), (1.5, 3.0)]
    assert [r.cut_s for r in W.cut_points(timed.filter("i > 0"), "k", "i").orderBy("i").collect()] == [1.25, 2.0]


def test_emissions(spark):
    frag = spark.createDataFrame([("r", 0, "hel", 1.0), ("r", 1, "lo wor", 2.0), ("r", 2, "", 2.5), ("r", 3, "ld", 3.0)], "r string, i int, t string, at double")
    assert [(r.word, r.at) for r in W.word_emissions(frag, "r", "i", "t", "at").orderBy("unit").collect()] == [("hello", 2.0), ("world", 3.0)]
    times, warn = W.fit_emissions(F.col("x"), F.col("n"))
    got = spark.createDataFrame([([1.0, 2.0], 3), ([1.0, 2.0], 1), ([], 2)], "x array<double>, n int").select(times.alias("t"), warn.alias("w")).collect()
    assert [(r.t, r.w) for r in got] == [([1.0, 2.0, 2.0], "padded"), ([1.0], "trimmed"), ([0.0, 0.0], "zeros")]
    assert spark.range(1).select(W.proxy_times(F.lit(4), F.lit(1000.0)).alias("x")).first().x == [250.0, 500.0, 750.0, 1000.0]
    words = spark.createDataFrame([("r", 0, "ab!", 0.0, 1.0)], "r string, i int, w string, start_s double, end_s double")
    assert [(r.unit, r.unit_end_s) for r in W.timed_units(words, ["r", "i"], "w").orderBy("unit_in_word").collect()] == [("a", 0.5), ("b", 1.0)]
    align = arrow.align_units(spark.createDataFrame([("r", list("abcd"), list("xbcy"), [1.0, 2.0, 3.0, 4.0])], "r string, hyp array<string>, heard array<string>, heard_s array<double>"), "r").orderBy("unit").collect()
    assert [r.unit_s for r in align] == [None, 2.0, 3.0, None] and align[0].coverage == 0.5


def test_grouping(spark):
    got = spark.range(1).select(W.greedy_groups(F.array(*map(F.lit, [200, 90, 20, 300, 200])), F.array(*map(F.lit, [False, True, False, False, True])), 400).alias("g")).first().g
    assert got == [[0, 1], [2, 3], [4]]
    seg = spark.createDataFrame([("k", 0, "—"), ("k", 1, "a"), ("k", 2, "..."), ("k", 3, "b")], "k string, i int, t string")
    assert [r.text for r in W.merge_unspoken(seg, ["k"], "i", "t").orderBy("segment").collect()] == ["—a...", "b"]
    r = D.row_requests(seg, ["k"], "i", "t", 4).first()
    assert r.texts == ["—a...", "b"] and r.groups == [[0], [1]] and r.spoken_chars == 2
    wins = spark.range(1).select(F.array(*map(F.lit, [4.0, 9.0, 12.0, 30.0])).alias("e"))
    assert [(w.lo, w.hi) for w in W.grouped_windows(wins, "e", 10.0).first().windows] == [(0.0, 9.0), (9.0, 12.0), (12.0, 30.0)]
    t = D.trajectory_rows(spark.createDataFrame([(1, "['a', 'b']"), (2, "[]"), (3, "x"), (4, "['<a>']"), (5, "['!']")], "i int, raw string"), "i", "raw")
    assert {r.i: r.reason for r in t.collect()} == {1: None, 2: "no_turns", 3: "unreadable", 4: "dirty", 5: "no_turns"}


def test_soft_window(spark):
    start, held = [], []
    for _ in range(30):
        held.append(len(held))
    n_held, expected = 0, []
    for n in range(1, 31):
        n_held += 1
        if n_held >= 6:
            n_held = 3
        expected.append(n - n_held)
    got = spark.range(1, 31).select(W.soft_window_start(F.col("id"), 6, 3).alias("s")).collect()
    assert [r.s for r in got] == expected and start == []


def test_joins(spark):
    gold = spark.createDataFrame([("a",), ("a__speed_2",), ("b",)], "id string")
    pred = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "id string, seq int, candidate string")
    assert {r.id: r.candidate for r in C.join_predictions(gold, pred).collect()} == {"a": "y", "a__speed_2": "y", "b": None}
    rows = spark.createDataFrame([("k", "a  b")], "row_key string, candidate_text string")
    stale = J.attach_scores(rows, spark.createDataFrame([("k", 4, 0.5)], "row_key string, hypothesis_chars int, score double")).first()
    assert (stale.chars_mismatch.expected, stale.chars_mismatch.actual, stale.score) == (4, 3, 0.5)
    todo = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, t string")
    assert [r.i for r in J.resume(todo, [todo.filter("i = 1"), todo.filter("i = 3")], ["i"]).collect()] == [2]
    up = {r.i: r.t for r in J.upsert(todo, spark.createDataFrame([(2, "z"), (4, "n")], "i int, t string"), "i").collect()}
    assert up == {1: "a", 2: "z", 3: "c", 4: "n"}
    w = spark.createDataFrame([("s", 0.0, 10.0, 25.0), ("t", 9.0, 10.0, 25.0), ("u", 12.0, 40.0, 25.0), ("v", 25.0, 30.0, 25.0), ("w", 31.0, 45.0, 0.0), ("x", 5.0, None, None), ("y", None, 12.0, 25.0)], "id string, start_s double, end_s double, duration_s double")
    got = {}
    for r in J.sentence_windows(w, 10.0).collect():
        got.setdefault(r.id, []).append(r.window_index)
    assert {k: sorted(v) for k, v in got.items()} == {"s": [0], "t": [0], "u": [1, 2], "w": [3, 4], "x": [0], "y": [0, 1]}
    trace = J.update_trace(spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0])], "i int, p string, d array<double>"), spark.createDataFrame([(1, "c", [3.0])], "i int, p string, d array<double>"), "i", ["p", "d"])
    assert {r.i: (r.p, r.d, r.updated) for r in trace.collect()} == {0: ("a", [1.0], False), 1: ("c", [3.0], True)}
    m = J.turn_manifest(spark.createDataFrame([("a", 0, "x"), ("b", 0, "x"), ("c", 0, "x")], "id string, turn int, text string"), spark.createDataFrame([("a", "p"), ("b", "p")], "id string, path string"), spark.createDataFrame([("a", 3)], "id string, n_intervals int"))
    assert {r.id: r.reason for r in m.collect()} == {"a": None, "b": "missing_textgrid", "c": "missing_target_manifest"}
    par = J.parallel_text(spark.createDataFrame([("a", 0), ("z", 1)], "id string, pos int"), spark.createDataFrame([("a", 7, "x"), ("b", 1, "y")], "id string, pos int, text string"))
    assert {r.id: r.english for r in par.collect()} == {"a": "x", "z": "y"}
    over = J.window_intervals(spark.createDataFrame([("r", 0, 0.0, 1.0), ("r", 1, 1.0, 2.0)], "run string, window_index int, lo double, hi double"), spark.createDataFrame([("r", 0, 0.9, 1.5, "x")], "run string, pos int, start_s double, end_s double, text string"), "run", 0.5, midpoint=False)
    assert sorted(r.window_index for r in over.collect()) == [0, 1] and {r.n_units for r in over.collect()} == {1}
    e = J.enrich_manifest(todo.withColumnRenamed("i", "id"), spark.createDataFrame([(1, (0.5,))], "id int, s struct<x:double>"), "s")
    assert {r.id: r.audit_x for r in e.collect()} == {1: 0.5, 2: None, 3: None}
    ev = C.evaluate_predictions(spark.createDataFrame([("a", "ab", 2.0, 2.0), ("b", "x", 1.0, 1.0)], "id string, text string, source_s double, reference_s double"), spark.createDataFrame([("a", "ac", 1.0)], "id string, text string, speech_s double"))
    assert {r.id: (r.missing, r.rtf, r.early_stop, r.cer) for r in ev.collect()} == {"a": (False, 0.5, True, 0.5), "b": (True, None, False, 1.0)}
    j = C.merge_judge(spark.createDataFrame([("a", 1)], "id string, x int"), spark.createDataFrame([("a", 4.0)], "id string, overall double")).first()
    assert j.judge_overall_norm == 0.8


def test_summaries(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)] + [(99, None)], "i int, v double")
    s = A.metric_summary(df, ["v"]).first()
    assert (s.n, s["mean"], s.p50, s.p90, s.p95, s["min"], s["max"]) == (10, 4.5, 4.5, 8.1, 8.55, 0.0, 9.0)
    n = A.nearest_rank(df, ["v"]).first()
    assert (n.p50, n.p90) == (5.0, 9.0)
    p = A.paired_stats(spark.createDataFrame([(0.1, 0.2), (0.5, 0.5), (0.9, 0.1)], "a double, b double"), "a", "b").first()
    assert (p.n, p.win, p.lose, p.tie) == (3, 1, 1, 1)
    rows = [(1, 2, 1, ["ok", "missing", "missing"], [1.0, None], 3.0), (2, 2, 0, None, [5.0], None), (3, 2, 2, ["ok", "corrupt"], [1.0, 2.0], 3.2), (4, 3, 3, [], [], 9.0), (5, 1, 1, [None], [1.0], 1.36)]
    iss = A.manifest_issues(spark.createDataFrame(rows, "id int, n_sources int, n_boundaries int, wavs array<string>, chunk_s array<double>, full_s double"))
    assert {r.id: (r.sum_s, r.issues) for r in iss.collect()} == {
        1: (1.0, ["boundary_count_mismatch", "missing_target_wav", "target_chunk_count_mismatch", "target_chunk_duration_sum_delta"]), 2: (5.0, []), 3: (3.0, ["corrupt_target_wav"]), 4: (0.0, []), 5: (1.0, ["target_chunk_duration_sum_delta"]),
    }
    assert tuple(A.manifest_summary(iss).first()) == (5, 3, 2, 1)
    rtf = A.rtf_summary(spark.createDataFrame([([0.5, 1.5, None],), ([2.0],), (None,)], "r array<double>"), "r").first()
    assert tuple(rtf) == (3, 1.333333, 1.5, 1.9, 0.666667)
    t = A.talk_assembly(spark.createDataFrame([("t", 1, 10.0), ("t", 2, 10.0)], "talk string, row_id int, source_s double"), spark.createDataFrame([(1, 8.0)], "row_id int, target_s double"), "talk").first()
    assert (t.sessions, t.missing, t.target_s, t.duration_ratio) == (2, 1, 8.0, 0.4)
    pr = A.probe_summary(spark.createDataFrame([("r", "s", 1.0, 2.0), ("r", "s", 3.0, 2.0), ("r", "t", None, 2.0)], "run string, stream string, latency_s double, budget_s double"), "run").first()
    assert (pr.n, pr.ok, pr.failed, pr.fit, pr.missed, pr.streams) == (3, 2, 1, 1, 1, 2)
    c = A.cell_summary(spark.createDataFrame([("r", [1], [1], 1.0, 0.5, 2.0), ("r", [1, 2], [3], 3.0, 1.5, 4.0)], "run string, source_ids array<int>, hypothesis_ids array<int>, ending_offset double, first_offset double, span double"), "run").first()
    assert (c.groups, c.one_to_one, c.many_to_one, c.largest, c.ending_p50) == (2, 1, 1, 2, 2.0)
    g = A.config_sweep(spark.createDataFrame([("r", "audio", 11.0, 2.0), ("r", "control", 1.0, 9.0), ("r", "audio", None, 1.0)], "run string, kind string, arrival_s double, duration_s double"), spark.createDataFrame([("r", 10.0, 5.0)], "run string, start_s double, source_s double")).first()
    assert (g.first_arrival_s, g.last_arrival_s, g.duration_lag_s) == (1.0, 1.0, -3.0)
    assert A.system_summary(df, df.withColumn("v", F.col("v") * 2), ["v"]).count() == 2
    d = A.document_sources(spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "d string, i int, t string"), "d", "i", "t").first()
    assert (d.joined, d.first_row) == ("a b", 1)


def timing_plainly(chunks):
    """Playback of (arrival, duration, cumulative) in order of arrival, step by step."""
    chunks = sorted((c for c in chunks if c[0] is not None), key=lambda c: c[0])
    if not chunks:
        return None
    end = before = 0.0
    for arrival, own, cum in chunks:
        d = own if own is not None else max(0.0, (before if cum is None else cum) - before)
        if d <= 0:
            continue
        end = max(end, arrival) + d
        before = max(before, cum) if cum is not None else before + d
    return max(c[0] for c in chunks), end if end > 0 else None


def test_final_timing_and_run_rows(spark):
    rng = random.Random(6)
    maybe = lambda x, p=0.3: None if rng.random() < p else x
    runs = {k: [(maybe(round(rng.uniform(0, 20), 2), 0.1), maybe(rng.choice([0.0, -1.0, 0.5, 2.0, 3.0])), maybe(round(rng.uniform(0, 15), 1))) for _ in range(rng.randint(1, 12))] for k in range(80)}
    rows = [(k, i, *c) for k, cs in runs.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "run int, seq int, arrival_s double, audio_duration_s double, cumulative_audio_duration_s double")
    got = {r.run: (r.final_arrival_s, None if r.playback_end_s is None else round(r.playback_end_s, 6)) for r in A.final_timing(df, "run").collect()}
    want = {k: timing_plainly(cs) for k, cs in runs.items()}
    assert got == {k: (v[0], None if v[1] is None else round(v[1], 6)) for k, v in want.items() if v}

    timeline = spark.createDataFrame([("r", 1.0, 0.0, 0.6, True), ("r", 0.2, 0.5, 0.1, False)], "run string, backlog double, queue double, deficit double, violation boolean")
    sentences = spark.createDataFrame([("r", "missed"), ("r", "covered")], "run string, status string")
    timing = spark.createDataFrame([("r", 12.0, 13.5)], "run string, final_arrival_s double, playback_end_s double")
    given = spark.createDataFrame([("r", 10.0, 9.0, "x"), ("q", None, 2.0, "y"), ("p", 20.0, 9.0, "z")], "run string, source_stream_duration_s double, generated_duration_s double, direction string")
    m = {r.run: r for r in A.run_metrics(given, timeline, sentences, timing, "run").collect()}
    r = m["r"]
    assert (r.max_backlog_s, r.mean_backlog_s, r.max_queue_s, r.mean_deficit_s, r.backlog_violation_rate, r.deficit_violation_rate, r.missed_sentence_rate, r.sentence_count) == (1.0, 0.6, 0.5, 0.35, 0.5, 0.5, 0.5, 2)
    assert (r.full_s2s_rtf, r.end_lag_s, r.duration_end_lag_s, r.final_target_arrival_s, r.final_arrival_lag_s, r.wall_clock_playback_end_s, r.wall_clock_end_delay_s, r.direction) == (0.9, -1.0, -1.0, 12.0, 2.0, 13.5, 3.5, "x")
    q = m["q"]
    assert (q.full_s2s_rtf, q.end_lag_s, q.max_backlog_s, q.missed_sentence_rate, q.sentence_count, q.final_arrival_lag_s, q.wall_clock_end_delay_s) == (None, 2.0, 0.0, None, 0, None, None)


def test_self_history_copies(spark):
    kind = "array<struct<frames:int,codes:string,runaway:boolean>>"
    rows = spark.createDataFrame([("a", [(10, "g0"), (10, "g1"), (10, "g2"), (10, "g3"), (0, "g4"), (10, "g5")]), ("b", [(10, "g"), (10, "g")]), ("c", [(10, "g")]), ("d", [(10, "g"), (10, "g")])], "id string, turns array<struct<frames:int,codes:string>>")
    made = spark.createDataFrame([("a", [(20, "m0", False), (21, "m1", None), (5, "m2", None), (10, "m3", True), (10, "m4", False), (10, "m5", False), (1, "more", False)]), ("b", [(10, "m", False)]), ("c", [(10, "m", False)])], f"id string, turns {kind}")
    got = J.self_history_copies(rows, made, 1.0, 1.0, 2.0).collect()
    assert [(r.id, r.source_id, r.swapped, r.total) for r in got] == [("a_v4self", "a", 2, 6)]
    assert [(t.frames, t.codes, t.context_only) for t in got[0].turns] == [(20, "m0", True), (10, "g1", False), (5, "m2", True), (10, "g3", False), (0, "g4", False), (10, "g5", False)]
    assert J.self_history_copies(rows, made, 0.0, 1.0, 2.0).count() == 0 == J.self_history_copies(rows, made, 1.0, 0.0, 2.0).count()
    many = spark.range(400).select(F.col("id").cast("string").alias("id"), F.array_repeat(F.struct(F.lit(4).alias("frames"), F.lit("g").alias("codes")), 5).alias("turns"))
    copies = J.self_history_copies(many, many.withColumn("turns", F.transform("turns", lambda t: F.struct(t["frames"], t["codes"], F.lit(False).alias("runaway")))), 0.5, 0.5, 2.0)
    n, swapped = copies.agg(F.count(F.lit(1)), F.avg("swapped")).first()
    assert 140 < n < 240 and 1.7 < swapped < 2.6


def test_stored_values_agree_up_to_their_last_decimal(spark):
    rows = [("a", "34.8", "34.83"), ("b", "34.8", "34.86"), ("c", "34.80", "34.83"), ("d", "7", "7.5"), ("e", "x", "x"), ("f", "1.5", None), ("g", "0.25", "0.255"), ("h", "0.25", "0.2550001")]
    df = spark.createDataFrame(rows, "name string, a string, b string")
    got = {r.name: (r.changed, r.agrees) for r in J.compare_values(df.select("name", F.col("a").alias("value")), df.select("name", F.col("b").alias("value"))).collect()}
    assert got == {"a": (True, True), "b": (True, False), "c": (True, False), "d": (True, True), "e": (False, False), "f": (True, False), "g": (True, True), "h": (True, False)}


def test_label_numbers_and_speed_deltas(spark):
    df = spark.createDataFrame([("f", True, 4.0, 0.5, None), ("f", False, 8.0, None, None), ("g", None, None, 1.5, None)], "file string, accepted boolean, output_units double, output_over_budget_ratio double, output_reference_ratio double")
    got = {r.file: r for r in A.label_summary(df, "file").collect()}
    assert (got["f"].records, got["f"].accepted, got["f"].rejected, got["f"].acceptance_rate, got["f"].output_units_p50, got["f"].output_units_p90, got["f"].output_over_budget_ratio_count) == (2, 1, 1, 0.5, 6.0, 7.6, 1)
    assert (got[None].records, got[None].output_units_mean, got[None].output_over_budget_ratio_max, got[None].output_reference_ratio_count, got[None].output_reference_ratio_mean, got["g"].output_units_count) == (3, 6.0, 1.5, 0, None, 0)
    row = lambda i, speed, score, end, first=0.0, null=None: ("k", i, speed, score, end, first, null)
    rows = [row(1, 1.0, 0.5, 100.0), row(1, 1.5, 0.7, 150.0, 10.0), row(2, 1.0, 0.5, 100.0, 5.0), row(2, 1.5, 0.4, 300.0, 25.0), row(3, 1.0, 0.1, 1.0), row(3, 1.5, 0.1, 1.0, 1.0, "over_translation"), row(4, 1.0, 0.1, 1.0), row(5, 1.0, 1.0, 1.0), row(5, 1.5, 1.0, 1.0, None)]
    r = J.speed_pairs(spark.createDataFrame(rows, "k string, source_id int, speed double, score double, end_ms double, first_ms double, null_type string"), ["k"], (1.0, 1.5)).collect()
    assert [(x.speed, x.common, x.n, x.score_delta, x.end_delta_ms, x.end_delta_p50_ms, x.end_delta_p90_ms, x.first_delta_p50_ms) for x in r] == [(1.5, 4, 2, 0.05, 125.0, 125.0, 185.0, 15.0)]


def test_contexts_of_pairs(spark):
    df = spark.createDataFrame([("c", i, f"u{i}", f"a{i}") for i in range(6)], "conv string, turn int, user string, assistant string")
    seen = lambda out: {r.turn: [x.user for x in r.context] for r in out.collect()}
    assert seen(W.pair_context(df, "conv", "turn", 3)) == {0: [], 1: ["u0"], 2: ["u0", "u1"], 3: ["u1", "u2"], 4: ["u2", "u3"], 5: ["u3", "u4"]}
    assert seen(W.pair_context(df, "conv", "turn", 1))[5] == []

    def pinned(size):
        out, window, anchor = {}, [], None
        for i in range(6):
            out[i] = list(window)
            window.append(f"u{i}")
            anchor = anchor or window[0]
            window = [anchor, *[t for t in window if t != anchor][-(size - 2) :]]
        return out

    for size in (3, 4, 5, 9):
        assert seen(W.pinned_context(df, "conv", "turn", size)) == pinned(size)


def test_scores_of_whole_runs(spark):
    rows = [("a", "en", "hello world again", "hello world"), ("b", "zh", "你好世界", "你好新世界"), ("c", "ja-JP", "世界", "世界"), ("d", None, "", "gone"), ("e", "en", "said", "")]
    got = {r.run: r for r in C.run_text_metrics(spark.createDataFrame(rows, "run string, target_lang string, candidate string, reference string"), "run").collect()}
    assert len(got) == 5
    assert (got["a"].wer, got["a"].candidate_units, got["a"].bleu_tokenizer) == (0.5, 3, "13a")
    assert (got["b"].wer, got["b"].cer, got["b"].candidate_units, got["b"].reference_units, got["b"].bleu_tokenizer) == (0.2, 0.2, 4, 5, "zh")
    assert (got["c"].cer, got["c"].chrf, got["c"].bleu_tokenizer) == (0.0, 100.0, "char")
    assert (got["d"].wer, got["d"].cer, got["d"].bleu, got["e"].wer) == (1.0, 1.0, 0.0, 1.0)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 3)
    for f in (lambda d: S.stratified_sample(d, ["g"], 20, "id", 1), lambda d: S.assemble(d.withColumn("ok", F.col("id") % 7 == 0), "id", "ok", 30, 2), lambda d: S.split_by_counts(d, "id", "g", (("a", 0.5), ("b", 0.5)), 3)):
        a, b = (sorted(tuple(map(str, r)) for r in f(df.repartition(n)).collect()) for n in (1, 9))
        assert a == b and a
    ranks = [r["__rank"] for r in S.global_rank(df.withColumn("u", S.unit_interval(F.col("id"))), "u", "id").orderBy("u").collect()]
    assert ranks == list(range(1, 3001))
    counts = {r.split: r["count"] for r in S.split_by_counts(df, "id", "g", (("a", 0.7), ("b", 0.3)), 3).groupBy("split").count().collect()}
    assert counts == {"a": 2100, "b": 900}
    with pytest.raises(ValueError):
        S.assign_split(F.lit(0.5), [("a", 0.0)])
    dup = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), ("", 4)], "k string, i int")
    assert sorted((r.k, r.i) for r in S.first_of_each(dup, "k", "i").collect()) == [("", 3), ("", 4), ("a", 1)]


def test_augmentations(spark):
    df = spark.createDataFrame([(i, [[f"{i}{t}{u}" for u in range(3)] for t in range(6)]) for i in range(30)], "id int, turns array<array<string>>")
    pk = S.package_segments(spark.createDataFrame([("a", ["x", "y"], ["t", " "])], "id string, audios array<string>, texts array<string>"), "id", "audios", "texts", "seg").collect()
    assert [r.segment_id for r in pk] == ["seg_a_00000"]
    qe = S.qe_segments(spark.createDataFrame([("a", ["xxxx", "yyyy"], "one two three four")], "id string, s array<string>, c string"), "id", "s", "c").orderBy("segment").collect()
    assert [(r.hypothesis, r.weight_chars) for r in qe] == [("one two", 4), ("three four", 4)]
    both = S.paired_segments(spark.createDataFrame([("a", [("x  y", "z"), ("", "q"), ("u", None), ("w", "v")]), ("b", None)], "id string, s array<struct<source string, target string>>"), "id", "s").orderBy("segment").collect()
    assert [(r.qe_id, r.segments, r.source, r.hypothesis, r.weight_chars) for r in both] == [("a||seg=000", 2, "x y", "z", 4), ("a||seg=001", 2, "w", "v", 2)]
    assert S.report_rank(spark.createDataFrame([(None, "kit", None, "x")], "speed double, model string, chunk_ms int, label string")).first().o_speed == 999999.0
    assert S.union_copies([("a", df), ("b", df)]).groupBy("copy_kind").count().count() == 2


def test_whole_jobs(spark):
    corpus = spark.createDataFrame([(f"i{n}", " ".join(["word"] * (8 + n % 30)), " ".join(["wort"] * (8 + n % 40)), "en", "de", str(16000 * (3 + n % 9))) for n in range(200)] + [("bad", "", "x", "en", "de", "1")], "id string, src_text string, tgt_text string, src_lang string, tgt_lang string, n_frames string")
    d = P.decisions(corpus, spark.createDataFrame([("i0",)], "id string"), (1.0, 2.0), (("train", 0.8), ("dev", 0.2)), 7)
    assert d.count() == 398 and d.select("id", "split").distinct().count() == 199
    assert P.training_set(d, {"train": 10, "dev": -1}, 3).filter("split = 'train'").groupBy("kind").count().filter("count > 10").count() == 0
    total = P.summary(d).filter("split is null and speed is null").first()
    assert total.total == 398 and total.pass_through + total.needs_compression == 398
    gold = spark.createDataFrame([("a", "en", "s", "one two", 3.0)], "id string, lang string, source_text string, reference string, budget double")
    gold = gold.withColumns({"terms": F.array().cast("array<string>"), "duration_s": F.lit(2.0), "max_wpm": F.lit(185.0), "rate": F.lit(2.75), "budget_s": F.lit(2.0), "rtf_threshold": F.lit(1.0), "end_lag": F.lit(0.0), "max_lag": F.lit(1.5)})
    rows, summary, missing = P.score_predictions(gold, spark.createDataFrame([("a", 0, "one two")], "id string, seq int, candidate string"), ["heuristic_aggregate"])
    assert rows.first().heuristic_aggregate == 1.0 and summary.first().n == 1 and missing.count() == 0
    lab = P.accepted_labels(spark.createDataFrame([("a", "x", "one two", "en", 5, "concise"), ("b", "", "one", "en", 5, "concise")], "id string, text string, reference string, lang string, budget int, mode string"))
    assert {r.id: r.accepted for r in lab.collect()} == {"a": True, "b": False}


def test_long_sessions_cross_blocks(spark):
    """The same sessions with and without blocks, and as a plain walk finds them."""
    import hashlib
    import random

    rng = random.Random(4)
    rows = [(s, i, rng.choice([0, 1, 4, 9, None]), i // b) for s, n, b in (("hot", 700, 9), ("one", 1, 5), ("few", 12, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i int, n int, b int")
    want = {}
    for s in ("hot", "one", "few"):
        have, need, first, members = 0, 0, None, {}
        for _, i, n, _ in (r for r in rows if r[0] == s):
            if have >= need:
                u = int.from_bytes(hashlib.sha1(f"3:{s}:{i}".encode()).digest()[:8], "big") / 2**64
                have, need, first = 0, 20 + int(u * 16), i
            have += n or 0
            members.setdefault(first, [0, []])
            members[first][0] += n or 0
            members[first][1].append(i)
        want |= {(s, i): (f, size >= 20) for f, (size, ids) in members.items() for i in ids}
    for block in (None, "b"):
        assert {(r.s, r.i): (r.session, r.kept) for r in D.long_sessions(df, "s", "i", "n", 3, block=block).collect()} == want
    assert sum(not kept for _, kept in want.values()) > 0


def _loops(units, new, before, least):
    """Whether a changed turn is what one of the three modes can make of it."""
    if before and new == before + units[: len(units) // 4]:
        return "replay"
    extra = len(new) - len(units)
    if before and new[extra:] == units:
        for size in range(least, len(before) + 1):
            if extra in (size, 2 * size) and new[:extra] == before[-size:] * (extra // size):
                return "carry"
    for size in range(least, len(units) // 2 + 1):
        if extra in (size, 2 * size, 3 * size):
            for at in range(len(units) - size + 1):
                span = units[at : at + size]
                if new == units[: at + size] + span * (extra // size) + units[at + size :]:
                    return "intra"
    return None


def test_loops_and_repetitions(spark):
    df = spark.createDataFrame([(i, [[f"{i}.{t}.{u}" for u in range((i * 7 + t * 5) % 40)] for t in range(1 + i % 7)]) for i in range(120)], "id int, turns array<array<string>>")
    given = {str(r.id): r.turns for r in df.collect()}
    rows = S.loop_corruption(df, "id", "turns", 3, fraction=0.8).collect()
    assert {r.id: r.turns for r in rows if not r.context_only} == given
    modes = []
    for r in (r for r in rows if r.context_only):
        old, new = given[r.id.removesuffix("_looped")], r.turns
        assert 1 <= len(r.context_only) <= 3 and len(new) - 1 not in r.context_only and len(new) == len(old)
        for i, (u, v) in enumerate(zip(old, new, strict=True)):
            if i in r.context_only:
                modes.append(_loops(u, v, new[i - 1] if i else [], 8))
            else:
                assert u == v
    assert set(modes) == {"intra", "carry", "replay"}
    rows = S.repeat_inside(df, "id", "turns", 3, fraction=1.0).collect()
    assert {r.id: r.turns for r in rows if not r.context_only} == given
    made = {r.id.removesuffix("_repeated"): r for r in rows if r.context_only}
    assert made.keys() == {i for i, t in given.items() if any(len(u) >= 16 for u in t[:-1])}
    for i, r in made.items():
        (k,) = r.context_only
        old, new = given[i][k], r.turns[k]
        size = (len(new) - len(old)) // 2
        assert 8 <= size <= min(24, len(old) // 2) and [t for j, t in enumerate(r.turns) if j != k] == [t for j, t in enumerate(given[i]) if j != k]
        assert any(new == old[: at + size] + old[at : at + size] * 2 + old[at + size :] for at in range(len(old) - size + 1))
    late = S.drop_lead(df, "id", "turns", 2, fraction=1.0).filter("dropped > 0").collect()
    assert {r.id.split("_mid")[0] for r in late} == {i for i, t in given.items() if len(t) >= 5} and all(r.turns == given[r.id.split("_mid")[0]][r.dropped :] and len(r.turns) >= 4 for r in late)


def test_ranks_of_large_and_skewed_groups(spark):
    rng = random.Random(5)
    odd = [0.0] * 3000 + [rng.gauss(0, 1) for _ in range(4000)] + [1e12, -1e12, float("inf")] + [7.5] * 900
    rows = [(None, x) for x in odd] + [("b", float(i % 3)) for i in range(50)] + [("c", 1.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in A.metric_summary(df, ["v"], ["k"]).collect()}
    want = df.groupBy("k").agg(*[F.bround(F.percentile("v", F.lit(q)), 6).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))], F.count("v").alias("n")).collect()
    assert len(got) == len(want) == 3
    for r in want:
        assert (got[r.k].n, got[r.k].p50, got[r.k].p90, got[r.k].p95) == (r.n, r.p50, r.p90, r.p95)
    ranks = {r.k: r for r in A.nearest_rank(df, ["v"], ["k"]).collect()}
    for k in (None, "b", "c"):
        v = sorted(x for key, x in rows if key == k)
        assert (ranks[k].p50, ranks[k].p90, ranks[k]["min"], ranks[k]["max"]) == (v[len(v) // 2], v[min(len(v) - 1, int(0.9 * len(v)))], v[0], v[-1])
    assert A.metric_summary(df.limit(0), ["v"], ["k"]).count() == 0


def test_sweep_scores(spark):
    sent = spark.createDataFrame([("a", 2, "world", False), ("a", 1, "hello ", None), ("a", 3, "draft", True), ("a", 4, " TTS-finish ", False), ("c", 1, None, False)], "run string, message_id int, text string, unstable boolean")
    refs = spark.createDataFrame([("a", "hello world"), ("b", "left out"), ("c", "none")], "run string, reference string")
    got = {r.run: r for r in C.sweep_scores(sent, refs).collect()}
    assert (got["a"].cer, got["a"].wer, got["a"].candidate_chars, got["a"].candidate_units, round(got["a"].chrf)) == (0.0, 0.0, 11, 2, 100)
    assert [(got[k].cer, got[k].bleu, got[k].candidate_chars) for k in "bc"] == [(1.0, 0.0, 0)] * 2


def test_turn_rows(spark):
    turns = spark.createDataFrame([("s", 0, 3.0, "hi"), ("s", 1, 0.0, None), ("t", 0, 1.0, "x"), ("u", 0, 1.0, "x"), ("v", 0, 1.0, "x")], "id string, turn int, source_s double, text string")
    targets = spark.createDataFrame([("s", "p"), ("u", "p"), ("v", "p")], "id string, path string")
    spans = spark.createDataFrame([("s", 0, 0.5, 2.0), ("s", 1, None, None)], "id string, turn int, start_s double, end_s double")
    rows, left = D.turn_rows(turns, targets, spans, spark.createDataFrame([("v", "ValueError")], "id string, error string"), [1.0, 1.5])
    assert {(r.id, r.reason) for r in left.collect()} == {("t", "missing_target_manifest"), ("u", "missing_textgrid"), ("v", "textgrid_exception:ValueError")}
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {f"s__speed_{s}__chunk_000{t}" for s in ("1", "1.5") for t in (0, 1)}
    r = got["s__speed_1.5__chunk_0000"]
    assert (r.current_source_s, r.target_s, r.rtf, r.audios, r.expected_empty) == (2.0, 1.5, 0.75, ["s__speed_1.5__chunk_0000.wav"], False)
    r = got["s__speed_1__chunk_0001"]
    assert (r.target_s, r.rtf, r.audios, r.expected_empty, r.row_id) == (None, None, ["s__speed_1__chunk_0000.wav", "s__speed_1__chunk_0001.wav"], True, "s")


@pytest.mark.parametrize("most", [2_000_000, 0])
@pytest.mark.parametrize("least", [0.0, 0.35, 0.75, 1.0])
def test_containment_by_index_and_by_rare_tokens(spark, most, least, monkeypatch):
    rng = random.Random(9)
    words = [f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(60)]
    pick = lambda n: sorted({rng.choice(words) for _ in range(n)})
    items = [(i, pick(rng.randint(1, 12))) for i in range(15)] + [(98, []), (99, None)]
    docs = [(f"d{i}", pick(rng.randint(0, 40))) for i in range(60)] + [("none", None), ("like", items[0][1])]
    monkeypatch.setattr(J, "MEETINGS", 50)
    a, b = spark.createDataFrame(items, "item long, w array<string>"), spark.createDataFrame(docs, "doc string, w array<string>").repartition(3)
    got = sorted((r.item, r.doc, r.n, r.c) for r in J.containment_join(a, b, least, most_indexed=most).collect())
    want = sorted((i, d, len(w), c) for i, w in items if w for d, v in docs if (c := len(set(w) & set(v or []))) and c >= least * len(w) - 1e-9)
    assert got == want


def test_percentiles_take_two_passes_and_are_exact(spark):
    rng = random.Random(8)
    rows = [("a", rng.gauss(0, 1)) for _ in range(4000)] + [("b", float(rng.randrange(3))) for _ in range(500)] + [("c", 7.0), ("d", 1.0), ("d", 2.0), ("e", float("inf")), ("e", -1.0), ("e", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    exact = {k: sorted(v for x, v in rows if x == k) for k in "abcde"}
    for r in A.nearest_rank(df, ["v"], ["k"]).collect():
        x = exact[r.k]
        assert (r.n, r.p50, r.p90, r.min, r.max) == (len(x), x[len(x) // 2], x[min(len(x) - 1, int(0.9 * len(x)))], x[0], x[-1])
    inter = {r.k: r for r in A.interpolated(A.unpivot_numbers(df, ["k"], ["v"]), ["k"], {"p05": 0.05, "p50": 0.5, "p99": 0.99}).collect()}
    for k in "abcd":
        for name, q in (("p05", 0.05), ("p50", 0.5), ("p99", 0.99)):
            assert inter[k][name] == pytest.approx(np.percentile(exact[k], 100 * q))
    assert A.nearest_rank(df.filter("v is null"), ["v"], ["k"]).count() == 0


def test_blocks_of_long_sessions_change_nothing(spark):
    """Neighbours, next values, cuts, interpolations, runs and packet lookups: with blocks (some of them empty of values) as without."""
    rng = random.Random(11)
    rows = [(f"s{k}", i, float(i) + rng.random(), float(i) + 1 + rng.random(), None if rng.random() < 0.7 else float(i) * 2 + rng.random(), rng.choice(["x", "y", None])) for k in range(3) for i in range(60) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, i int, start_s double, end_s double, v double, w string").withColumn("b", F.floor(F.col("i") / 7)).repartition(4)
    same = lambda f: sorted(map(repr, f(None).collect())) == sorted(map(repr, f("b").collect()))
    for kind in ("before", "after", "ahead"):
        assert same(lambda b, kind=kind: nearby(df, ["k"], ["i"], F.col("v"), kind, "out", b).select("k", "i", "out"))
    assert same(lambda b: W.cut_points(df, "k", "i", b).select("k", "i", "cut_s"))
    assert same(lambda b: W.interpolate(df, ["k"], "i", "v", b).select("k", "i", "v_filled"))
    assert same(lambda b: W.consecutive_groups(df, ["k"], ["i"], "w", b).select("k", "i", "group"))
    own = sorted(r for r in rows if r[0] == "s0")
    filled = {r.i: r.v_filled for r in W.interpolate(df, ["k"], "i", "v", "b").filter("k = 's0'").collect()}
    known = [(r[1], r[4]) for r in own if r[4] is not None]
    assert filled == pytest.approx({r[1]: float(np.interp(r[1], [x for x, _ in known], [y for _, y in known])) for r in own})
    packets = spark.createDataFrame([("r", j, float(10 * j + 10)) for j in range(20)] + [("q", 0, 5.0)], "run string, packet_index int, audio_end_ms double")
    asked = spark.createDataFrame([("r", u, float(x)) for u, x in enumerate([0, 10, 11, 99, 100, 200, 201, 999])] + [("q", 0, 7.0)], "run string, unit int, position_ms double")
    want = {("r", 0): 0, ("r", 1): 0, ("r", 2): 1, ("r", 3): 9, ("r", 4): 9, ("r", 5): 19, ("r", 6): 19, ("r", 7): 19, ("q", 0): 0}
    for block in (None, lambda t: F.floor(t / 30)):
        assert {(r.run, r.unit): r.packet_index for r in J.packet_at(packets, asked, "run", block).collect()} == want


def test_folds_of_long_arrays_are_linear(spark):
    rng = random.Random(12)
    sizes, ends = [rng.randint(1, 90) for _ in range(40_000)], [rng.random() < 0.2 for _ in range(40_000)]
    began = time.time()
    groups = spark.createDataFrame([(sizes, ends)], "s array<int>, e array<boolean>").select(W.greedy_groups(F.col("s"), F.col("e"), 400).alias("g")).first().g
    assert [i for g in groups for i in g] == list(range(40_000)) and all(sum(sizes[i] for i in g) <= 400 for g in groups)
    wins = W.grouped_windows(spark.createDataFrame([([float(x) for x in np.cumsum(sizes)],)], "e array<double>"), "e", 500.0).first().windows
    assert time.time() - began < 20
    assert wins[0].lo == 0 and wins[-1].hi == sum(sizes) and all(a.hi == b.lo for a, b in zip(wins, wins[1:])) and max(w.hi - w.lo for w in wins) <= 500
    whole = W.fixed_windows(spark.createDataFrame([(70.0,), (0.0,)], "d double"), "d", 0.0).collect()
    assert [(r.window_index, r.window_start_s, r.window_end_s) for r in whole] == [(0, 0.0, 70.0)]


def test_alignment_of_whole_talks():
    """The automaton and the meetings of places find the same runs; a talk of 20,000 units with many repeats takes seconds."""
    rng = random.Random(13)
    for _ in range(300):
        k = rng.choice([1, 2, 4])
        a, b = ([rng.randrange(k) for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert arrow._longest_by_suffixes(a, b, 0, len(a), 0, len(b)) == arrow._longest_by_places(a, b, 0, len(a), 0, len(b))
    a = [min(rng.randrange(30), rng.randrange(30)) for _ in range(20_000)]
    b = [x if rng.random() > 0.1 else rng.randrange(30) for x in a if rng.random() > 0.1]
    began = time.time()
    pairs = arrow.matching_blocks(a, b)
    assert time.time() - began < 15 and len(pairs) > 12_000 and all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("midpoint", [True, False])
def test_intervals_of_very_unlike_lengths_meet_in_few_cells(spark, midpoint):
    rng = random.Random(14)
    length = lambda: rng.choice([0.0, 0.3, 1.0, 7.0, 100.0, 5000.0])
    wins = [(rng.choice("rs"), i, lo, lo + length()) for i in range(60) for lo in [rng.uniform(-20, 300)]]
    ivs = [(rng.choice("rs"), i, lo, lo + length(), f"t{i}") for i in range(80) for lo in [rng.uniform(-20, 300)]] + [("r", 900, 0.0, 1e7, "long"), ("s", 901, 3.0, 2.0, "turned"), ("s", 902, None, 2.0, "open")]
    w = spark.createDataFrame(wins, "run string, window_index int, lo double, hi double")
    i = spark.createDataFrame(ivs, "run string, pos int, start_s double, end_s double, text string")
    got = {(r.run, r.window_index): (r.n_units, r.text) for r in J.window_intervals(w, i, "run", 1.0, midpoint).collect()}
    want = {}
    for run, k, lo, hi in wins:
        own = [(p, t) for q, p, a, b, t in ivs if q == run and a is not None and (lo <= (a + b) / 2 < hi if midpoint else a < hi and b > lo)]
        if own:
            want[run, k] = (len(own), " ".join(t for _, t in sorted(own)))
    assert got == want



def test_links_of_blocks_are_one_walk(spark):
    """F8: no block gathers those before it; many blocks of one row are a stream as any other."""
    df = spark.range(300).select(F.lit("s").alias("s"), F.col("id").cast("int").alias("i"), (F.col("id") % 7).cast("int").alias("n"), F.col("id").alias("b"))
    split = D.long_sessions(df, "s", "i", "n", 3, block="b")
    assert "collect_list(" not in split._jdf.queryExecution().analyzed().toString()
    assert {(r.i, r.session, r.kept) for r in split.collect()} == {(r.i, r.session, r.kept) for r in D.long_sessions(df, "s", "i", "n", 3).collect()}
