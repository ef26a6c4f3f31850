"""Files read and written, and streams against their batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rillstone.operators import joins as J, windows as W
from rillstone.sources import files
from rillstone.streaming import sessions as X
from rillstone.streaming.tables import UpsertTable, upsert_each_batch

TIER = '''File type = "ooTextFile"
Object class = "TextGrid"
item []:
    item [1]:
        class = "IntervalTier"
        name = "phones"
        intervals [1]:
            xmin = 0
            xmax = 0.2
            text = "h"
    item [2]:
        class = "IntervalTier"
        name = "words"
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = "say ""hi"""
        intervals [2]:
            xmin = 0.5
            xmax = 0.7
            text = "sil"
        intervals [3]:
            xmin = 0.7
            xmax = 0.7
            text = "x"
'''


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{"id": "y", "n": 2}\n')
    assert files.read_records(spark, str(tmp_path / "a.jsonl"), "id string, n int").count() == 2
    assert files.read_records(spark, str(tmp_path / "a.jsonl"), "id string, n int", limit=1).count() == 1
    (tmp_path / "b.jsonl").write_text('{"id": "x", "n": 1}\n{"id": bad\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|_corrupt"):
        files.read_records(spark, str(tmp_path / "b.jsonl"), "id string, n int").collect()
    bad = files.read_records(spark, str(tmp_path / "b.jsonl"), "id string, n int", strict=False).cache()
    assert bad.filter("_corrupt_record is not null").count() == 1
    todo = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "id string, n int")
    out = str(tmp_path / "out")
    files.append_new(todo.filter("n < 2"), out, ["id"])
    files.append_new(todo, out, ["id"])
    files.append_new(todo, out, ["id"])
    assert sorted(r.id for r in files.read_records(spark, out, "id string, n int").collect()) == ["x", "y", "z"]


def test_tables_and_scores(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\taudio\na\tx:1:2\n")
    assert files.sniff_separator(spark, str(tmp_path / "t.tsv")) == "\t"
    assert files.read_table(spark, str(tmp_path / "t.tsv"), "id string, audio string").first().audio == "x:1:2"
    (tmp_path / "s.txt").write_text("BLEU\t12.5\nnote\nWER\tx\n")
    wide = files.wide_scores(files.read_scores(spark, str(tmp_path / "s.txt")), ["BLEU", "WER"]).first()
    assert (wide.BLEU, wide.WER) == (12.5, None)
    (tmp_path / "w.csv").write_text("YAAL,AL\n1.5,2\n")
    assert {r.metric: r.value for r in files.read_scores(spark, str(tmp_path / "w.csv"), wide=True).collect()} == {"YAAL": 1.5, "AL": 2.0}
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, t string")
    files.write_report(df, str(tmp_path / "r"), ["t", "i"], ["i"])
    assert [p.read_text() for p in (tmp_path / "r").glob("*.csv")] == ["t\ti\na\t1\nb\t2\n"]
    best = files.best_candidates(spark.createDataFrame([("a", "ZH", 100.0, 2.0), ("b", "zh", 100.0, 1.0), ("c", "en", 100.0, 0.0), ("d", "zh", 1.0, 0.0)], "id string, lang string, duration_s double, score double"), ["zh"], 10.0, 5)
    assert [r.id for r in best.collect()] == ["b", "a"]


def test_runs_shards_and_intervals(spark, tmp_path):
    for run, manifest in (("r1", '{"run_id": "m", "speed": 1.5}'), ("r2", None)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "result.json").write_text('{"run_id": "o",\n "text": "t"}')
        if manifest:
            (tmp_path / "runs" / run / "manifest.json").write_text(manifest)
    got = {r.run_dir: (r.run_id, r.speed) for r in files.read_runs(spark, str(tmp_path / "runs"), "run_id string, text string", "run_id string, speed double").collect()}
    assert got == {"r1": ("m", 1.5), "r2": ("o", None)}
    with pytest.raises(Exception, match="missing required field speed"):
        files.require_fields(spark.createDataFrame([("a", None)], "run_id string, speed double"), ["run_id", "speed"]).collect()
    shards = spark.createDataFrame([("a", 0, 1, "x"), ("a", 1, 0, "y"), ("b", 1, 2, "z")], "id string, shard int, line int, t string")
    assert {r.id: r.t for r in files.union_shards(shards, "id", "shard", "line").collect()} == {"a": "x", "b": "z"}
    assert {r.shard: (r.n, r.missing) for r in files.shard_counts(shards, spark.range(3).selectExpr("cast(id as int) as shard"), "shard").collect()} == {0: (1, False), 1: (2, False), 2: (0, True)}
    (tmp_path / "d1.TextGrid").write_text(TIER)
    rows = files.spoken_intervals(files.read_intervals(spark, str(tmp_path / "*.TextGrid"))).collect()
    assert [(r.doc_id, r.tier, r.start_s, r.end_s, r.text) for r in rows] == [("d1", "words", 0.0, 0.5, 'say "hi"')]


def run_stream(spark, tmp_path, df, make, name, shuffled=False):
    """Three files, one a trigger, through a stream into memory."""
    src = str(tmp_path / f"in-{name}")
    n = df.count()
    rows = df.orderBy(df.columns[1]).collect()
    if shuffled:
        random.Random(7).shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i * n // 3 : (i + 1) * n // 3], df.schema).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(src)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    q.stop()
    return spark.table(name).collect()


def test_playout_stream_is_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"r{k}", i, float(i * 100 + rng.randint(0, 200)), float(rng.randint(0, 300)), 16000) for k in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "run_id string, packet_index int, arrival_ms double, duration_ms double, sample_rate int")
    batch = {(r.run_id, r.packet_index): r.playout_end_ms for r in W.fifo_playout(df, ["run_id"], ["packet_index"]).collect()}
    assert {(r.run_id, r.packet_index): r.playout_end_ms for r in run_stream(spark, tmp_path, df, lambda s: X.playout(s, first=0), "playout")} == batch
    assert {(r.run_id, r.packet_index): r.playout_end_ms for r in run_stream(spark, tmp_path, df, lambda s: X.playout(s, first=0), "playout_shuffled", shuffled=True)} == batch
    pos = run_stream(spark, tmp_path, df, X.packet_positions, "positions")
    total = {(r[0], r[1]): sum(x[3] for x in rows if x[0] == r[0] and x[1] <= r[1]) for r in rows}
    assert {(r.run_id, r.packet_index): r.audio_end_ms for r in pos} == total and not any(r.index_gap or r.rate_change for r in pos)


def test_backlog_words_and_context_streams(spark, tmp_path):
    rng = random.Random(3)
    df = spark.createDataFrame([("r", i, float(rng.randint(0, 300)), 150.0) for i in range(30)], "run_id string, step int, cost_ms double, budget_ms double")
    batch = {r.step: r.backlog for r in W.backlog(df, ["run_id"], ["step"], F.col("cost_ms"), F.col("budget_ms")).collect()}
    assert {r.step: r.backlog_ms for r in run_stream(spark, tmp_path, df, lambda s: X.running_backlog(s, first=0), "backlogs", shuffled=True)} == batch
    text = "ab cd  efg h ij klm no p "
    deltas = spark.createDataFrame([("r", i, text[i * 2 : i * 2 + 2], float(i)) for i in range(len(text) // 2 + 1)], "run_id string, seq int, text string, at_ms double")
    batch = {r.unit: (r.word, r.at_ms) for r in W.word_emissions(deltas, "run_id", "seq", "text", "at_ms").collect()}
    assert {r.unit: (r.word, r.at_ms) for r in run_stream(spark, tmp_path, deltas, X.word_emissions, "words", shuffled=True)} == batch
    turns = spark.createDataFrame([("r", i) for i in range(1, 31)], "run_id string, turn int")
    got = {r.turn: r.context_start for r in run_stream(spark, tmp_path, turns, lambda s: X.soft_context(s, 6, 3), "contexts")}
    assert got == {r.turn: r.s for r in turns.select("turn", W.soft_window_start(F.col("turn"), 6, 3).alias("s")).collect()}


def test_windows_sessions_and_upserts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", t0 + dt.timedelta(seconds=s), float(s)) for s in (1, 4, 9, 12, 25, 29, 61, 200, 400)]
    df = spark.createDataFrame(rows, "run_id string, ts timestamp, cumulative_s double")
    got = {r.start: (r.emitted_s, r.packets) for r in run_stream(spark, tmp_path, df, lambda s: X.window_emissions(s, 10, "5 seconds"), "emitted")}
    done = {k: v for k, v in {r.start: (r.emitted_s, r.packets) for r in X.window_emissions(df, 10, "5 seconds").collect()}.items() if k < t0 + dt.timedelta(seconds=390)}
    assert got == done
    batch = {(r.start, r.n) for r in X.sessions(df, "run_id", "ts", "20 seconds", "5 seconds").collect()}
    live = {(r.start, r.n) for r in run_stream(spark, tmp_path, df, lambda s: X.sessions(s, "run_id", "ts", "20 seconds", "5 seconds"), "sess")}
    assert live <= batch and len(live) == len(batch) - 1


def test_upserts_are_idempotent_and_stay_small(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    later = t0 + dt.timedelta(minutes=10)
    events = spark.createDataFrame([("a", t0, 1), ("b", t0, 2), ("a", t0, 1), ("a", later, 2)], "id string, ts timestamp, v int")
    src = str(tmp_path / "up")
    events.coalesce(1).write.json(src)
    kept = UpsertTable(spark, str(tmp_path / "table"), "id", "ts", buckets=2)
    assert kept.read(events.schema).count() == 0
    upsert_each_batch(spark.readStream.schema(events.schema).json(src), kept, "1 minute", str(tmp_path / "cp-up")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.id: r.v for r in kept.read().collect()} == {"a": 2, "b": 2}

    many = UpsertTable(spark, str(tmp_path / "many"), "id", "ts", buckets=2, most_deltas=3)
    rng, state, most_files = random.Random(1), {}, 0
    for n in range(14):
        rows = [(f"k{rng.randrange(12)}", t0 + dt.timedelta(minutes=rng.randrange(30)), n * 100 + i) for i in range(6)]
        batch = spark.createDataFrame(rows, events.schema)
        many.put(batch, n)
        if n % 5 == 0:
            many.put(batch, n)
            many.put(spark.createDataFrame([("zz", later, 9)], events.schema), n)
        for k, t, v in sorted(rows, key=lambda r: (r[1], r[2])):
            if k not in state or (t, n, v) >= state[k]:
                state[k] = (t, n, v)
        most_files = max(most_files, sum(1 for _ in (tmp_path / "many").rglob("*.parquet")))
    assert {r.id: (r.ts, r.v) for r in many.read().collect()} == {k: (x[0], x[2]) for k, x in state.items()}
    # two versions of a base and at most four deltas, in two buckets each
    assert most_files <= 2 * 2 * (1 + 4) and len(many.versions()) == 2


def test_an_upsert_that_was_cut_off_is_done_again(spark, tmp_path, monkeypatch):
    t0 = dt.datetime(2024, 1, 1)
    kept = UpsertTable(spark, str(tmp_path / "t"), "id", "ts", buckets=2, most_deltas=1)
    rows = lambda v: spark.createDataFrame([("a", t0, v), ("b", t0, v)], "id string, ts timestamp, v int")
    kept.put(rows(1), 0)
    with monkeypatch.context() as m:
        m.setattr(kept, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.put(rows(2), 1)
    assert {r.v for r in kept.read().collect()} == {1}
    kept.put(rows(3), 1)
    assert {r.v for r in kept.read().collect()} == {3}


def test_source_stream_join(spark, tmp_path):
    """Any gap between send and play, in three triggers out of order; a late clock row releases the last plays."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", t0 + dt.timedelta(seconds=s), k, v) for s, k, v in ((1, "send", 5.0), (2, "play", 0.0), (3, "send", 9.0), (3, "play", 1.0), (300, "send", 50.0), (90_000, "play", 2.0), (90_001, "send", 60.0), (90_002, "play", 3.0))]
    rows += [("q", t0 + dt.timedelta(seconds=5), "play", 7.0)]
    df = spark.createDataFrame(rows, "run_id string, ts timestamp, kind string, x double")

    def make(s):
        sends = s.filter("kind = 'send'").select("run_id", F.col("ts").alias("sent_ts"), F.col("x").alias("sent_ms"))
        plays = s.filter("kind = 'play'").select("run_id", F.col("ts").alias("play_ts"), F.col("x").cast("long").alias("unit"))
        return X.source_as_of(sends, plays, "2 days")

    src, out = str(tmp_path / "asof-in"), str(tmp_path / "asof-out")
    random.Random(3).shuffle(rows)
    for part in (rows[:3], rows[3:6], rows[6:], [("clock", t0 + dt.timedelta(days=9), "send", 0.0)]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(src)
        live = make(spark.readStream.schema(df.schema).parquet(src))
        live.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "asof-cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.run_id, r.unit): r.source_ms for r in spark.read.parquet(out).collect()}
    batch = J.as_of(df.filter("kind = 'send'").withColumn("n", F.lit(0)), df.filter("kind = 'play'").withColumn("n", F.col("x").cast("int")), "run_id", "ts", "x", "n")
    assert got == {(r.run_id, r.n): r.x_as_of for r in batch.collect()} == {("r", 0): 5.0, ("r", 1): 9.0, ("r", 2): 50.0, ("r", 3): 60.0, ("q", 7): 0.0}


def test_lost_rows_are_given_up_by_the_clock(spark, tmp_path):
    """A gap holds back what follows until the watermark has passed it; then the buffer is empty and late rows are dropped."""
    t0 = dt.datetime(2024, 1, 1)
    kind = "run_id string, packet_index int, duration_ms double, sample_rate int, ts timestamp"
    row = lambda i, minute: ("a", i, 10.0, 16000, t0 + dt.timedelta(minutes=minute))
    parts = [[row(2, 2), row(1, 1)], [row(4, 4), row(5, 5)], [("b", 1, 1.0, 1, t0 + dt.timedelta(minutes=30))], [row(3, 31), row(6, 32)], [("b", 2, 1.0, 1, t0 + dt.timedelta(minutes=90))]]
    src, out, cp, held = str(tmp_path / "gap-in"), str(tmp_path / "gap-out"), str(tmp_path / "gap-cp"), []
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(src)
        live = X.packet_positions(spark.readStream.schema(kind).parquet(src), X.Clock("ts", "10 minutes"), first=1)
        q = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(120)
        held.append(sorted(r.packet_index for r in spark.read.schema(live.schema).parquet(out).filter("run_id = 'a'").collect()))
    assert held == [[1, 2], [1, 2], [1, 2, 4, 5], [1, 2, 4, 5, 6], [1, 2, 4, 5, 6]]
    got = {r.packet_index: (r.audio_end_ms, r.index_gap) for r in spark.read.schema(live.schema).parquet(out).filter("run_id = 'a'").collect()}
    assert got == {1: (10.0, False), 2: (20.0, False), 4: (30.0, True), 5: (40.0, False), 6: (50.0, False)}


def test_states_of_silent_sessions_go(spark, tmp_path):
    """With an expiry a session that comes back after its silence starts anew; without one it goes on."""
    t0 = dt.datetime(2024, 1, 1)
    row = lambda run, i, minute: (run, i, 1000.0 * i, 500.0, t0 + dt.timedelta(minutes=minute))
    parts = [[row("a", 0, 0), row("a", 1, 0)], [row("b", 0, 120)], [row("a", 2, 121)], [row("b", 1, 150)]]
    kind = "run_id string, packet_index int, arrival_ms double, cost_ms double, ts timestamp"

    def ends(expire, name):
        src, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
        for part in parts:
            df = spark.createDataFrame(part, kind).withColumns({"step": F.col("packet_index"), "budget_ms": F.lit(0.0)})
            df.coalesce(1).write.mode("append").parquet(src)
            live = X.running_backlog(spark.readStream.schema(df.schema).parquet(src), expire, first=0)
            live.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination(120)
        return {(r.run_id, r.step): r.backlog_ms for r in spark.read.parquet(out).collect()}

    assert ends(None, "kept")["a", 2] == 1500.0
    assert ends(("ts", "1 minute", 3_600_000), "gone") == {("a", 0): 500.0, ("a", 1): 1000.0, ("b", 0): 500.0, ("a", 2): 500.0, ("b", 1): 1000.0}


def state_rows(spark, tmp_path, df, make):
    """Rows of state that one trigger writes."""
    df.coalesce(1).write.parquet(str(tmp_path / "many"))
    live = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "many")))
    q = live.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "many-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [s["numRowsUpdated"] for p in q.recentProgress for s in p["stateOperators"]][0]


def test_waiting_lookups_are_one_state_a_session(spark, tmp_path):
    """the state is written once for a session in a trigger, not once for each of its rows."""
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"r{i % 2}", t0 + dt.timedelta(seconds=i), i, float(i)) for i in range(200)], "run_id string, ts timestamp, i long, x double")

    def make(s):
        return X.source_as_of(s.filter("i % 3 = 0").select("run_id", F.col("ts").alias("sent_ts"), F.col("x").alias("sent_ms")), s.filter("i % 3 > 0").select("run_id", F.col("ts").alias("play_ts"), F.col("i").alias("unit")), "2 days")

    assert state_rows(spark, tmp_path, df, make) == 2


def test_waiting_packets_are_one_state_a_session(spark, tmp_path):
    """none of the packets is in its place, so that all of them wait."""
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"r{i % 2}", i + 5, 10.0, 16000, t0 + dt.timedelta(seconds=i)) for i in range(200)], "run_id string, packet_index int, duration_ms double, sample_rate int, ts timestamp")
    assert state_rows(spark, tmp_path, df, lambda s: X.packet_positions(s, X.Clock("ts", "2 days"), first=1)) == 2


def twice(spark, tmp_path, kind, make):
    """A stream whose second trigger repeats the row that waits since the first."""
    for part in ([2, 3], [1, 2, 4]):
        spark.range(1).select(F.explode(F.array(*map(F.lit, part))).alias("i")).selectExpr(*kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = make(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")))
        live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(live.schema).parquet(str(tmp_path / "out")).collect()


def test_a_delta_that_comes_again_while_it_waits_counts_once(spark, tmp_path):
    """F5."""
    rows = twice(spark, tmp_path, ["'r' AS run_id", "i AS seq", "concat('w', i, ' ') AS text", "double(i) AS at_ms"], lambda s: X.word_emissions(s, first=1))
    assert sorted((r.unit, r.word) for r in rows) == [(0, "w1"), (1, "w2"), (2, "w3"), (3, "w4")]


def test_a_step_that_comes_again_while_it_waits_counts_once(spark, tmp_path):
    """F9."""
    rows = twice(spark, tmp_path, ["'r' AS run_id", "i AS step", "3D AS cost_ms", "1D AS budget_ms"], X.running_backlog)
    assert sorted((r.step, r.backlog_ms) for r in rows) == [(1, 2.0), (2, 4.0), (3, 6.0), (4, 8.0)]


def test_a_packet_that_comes_again_while_it_waits_counts_once(spark, tmp_path):
    """F10."""
    rows = twice(spark, tmp_path, ["'r' AS run_id", "i AS packet_index", "0D AS arrival_ms", "5D AS duration_ms"], X.playout)
    assert sorted((r.packet_index, r.playout_end_ms) for r in rows) == [(1, 5.0), (2, 10.0), (3, 15.0), (4, 20.0)]


def test_sessions_share_states(spark, tmp_path, monkeypatch):
    """a group of sessions is one state; each goes on where it was, waits for its own rows, and ends by its own silence."""
    monkeypatch.setattr(X, "BUCKETS", 3)
    rows = [(f"s{i}", k, "word " if k % 2 else "a ", float(k)) for i in range(40) for k in range(4)]
    kind = "run_id string, seq int, text string, at_ms double"
    came = []
    for nth in range(2):
        spark.createDataFrame([r for r in rows if (int(r[0][1:]) + r[1]) % 2 == nth], kind).write.mode("append").parquet(str(tmp_path / "in"))
        made = X.word_emissions(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
        q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        came.append(sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:]))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("unit", "word", "at_ms"))).alias("w")).collect()
    assert len(got) == 40 and all([tuple(w) for w in r.w] == [(0, "a", 0.0), (1, "word", 1.0), (2, "a", 2.0), (3, "word", 3.0)] for r in got)
    assert max(came) <= 3


def test_interval_files_in_shards(spark, tmp_path):
    """many small files in few, read back once; the names and the preferred tiers are kept."""
    tier = lambda name, text: f'class = "IntervalTier"\n name = "{name}"\n intervals [1]:\n xmin = 0\n xmax = 2\n text = "{text}"\n'
    texts = [(f"d{i}", tier("phones", "a") + tier("Words", f"w{i}\x1e\x1b1")) for i in range(30)] + [("empty", ""), ("phones", tier("phones", "b"))]
    files.write_shards(spark.createDataFrame(texts, "file string, value string").coalesce(2), str(tmp_path / "shards"))
    assert len(list((tmp_path / "shards").glob("part-*"))) == 2
    got = files.spoken_intervals(files.read_interval_shards(spark, str(tmp_path / "shards")))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([*((f"d{i}", f"w{i}\x1e\x1b1") for i in range(30)), ("phones", "b")])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
