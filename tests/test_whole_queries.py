"""Queries over all rows and whole texts: what the queries of the same operator with a smaller SQL leave out."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def got(spark, name):
    return entry.queries()[name](spark, SF).collect()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_ticks_of_all_documents(spark):
    assert {r.doc_id for r in got(spark, "text_ticks_whole")} == {r.doc_id for r in table(spark, "documents")}


def test_emissions_of_all_conversations(spark):
    rows = {r.conv_id: r for r in got(spark, "fitted_emissions_whole")}
    assert set(rows) == {r.conv_id for r in table(spark, "conversations")}
    assert all(r.total == 0 and r.warning == "trimmed" for i, r in rows.items() if i % 9 == 0)


def test_turns_are_carried_whole(spark):
    turns = {}
    for r in sorted(table(spark, "conversations"), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append(r)
    history = {(r.conv_id, r.turn): r.history for r in got(spark, "history_rows_whole")}
    context = {(r.conv_id, r.turn): r.context for r in got(spark, "context_windows_whole")}
    passage = {}
    for r in got(spark, "mid_passage_whole"):
        passage.setdefault(int(r.id.split("_")[0]), []).append(r)
    for conv, rows in turns.items():
        texts = [r.text for r in rows]
        for i, r in enumerate(rows):
            assert history[conv, r.turn] == "|".join(texts[: i + 1])
            assert context[conv, r.turn] == "|".join(texts[max(0, i - 2) : i + 1])
        for r in passage[conv]:
            assert r.turns == "|".join(texts[r.dropped :]) and r.id == (f"{conv}_mid{r.dropped}" if r.dropped else str(conv)) and 0 <= r.dropped <= min(len(texts) // 2, max(0, len(texts) - 4))
        assert sum(r.dropped == 0 for r in passage[conv]) == 1 and len(passage[conv]) <= 2
    assert any(r.dropped for rows in passage.values() for r in rows)


def test_places_of_sentences_count_all_characters(spark, tmp_path):
    """sentences that begin or end with the digits of their place keep them."""
    spark.createDataFrame([(1, "A b. 1 c 1. 22", "en", 14), (2, "0 a. b 1! c 2? 3", "de", 16)], "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.placed for r in entry.queries()["sentence_counts_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: 4 + 2 * 6 + 3 * 2, 2: 4 + 2 * 4 + 3 * 4 + 4 * 1}


def test_places_of_sentences_are_summed_row_by_row(spark, tmp_path):
    """as in the SQL, documents that share an id, or have none, keep a row each; those without sentences have none."""
    rows = [(1, "A b. C.", "en", 7), (1, "D! E f?", "en", 7), (None, "G.", "de", 2), (None, "H i.", "de", 4), (2, " ", "en", 1), (3, None, "en", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.placed) for r in entry.queries()["sentence_counts_whole"](spark, str(tmp_path)).collect()]
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = [(1, 4 + 2 * 2), (1, 2 + 2 * 4), (None, 2), (None, 4)]
    assert sorted(got, key=str) == sorted(con.execute(entry.oracle_sql()["sentence_counts_whole"]).fetchall(), key=str) == sorted(want, key=str)


def test_an_estimate_of_zero_is_one(spark, tmp_path):
    """where the SQL has an estimate of 0 the budget is the least there is, not the next one's; without an estimate it is."""
    rows = [(6, 7, 0.0), (16, 7, None), (26, 7, 3.0), (11, 7, 0.0), (2, 7, 0.0), (36, 7, -1.0), (46, 7, 1e-7)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.budget for r in entry.queries()["source_budgets"](spark, str(tmp_path)).collect()}
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(con.execute(entry.oracle_sql()["source_budgets"]).fetchall()) and got[6] == 1e-6 and got[16] == 7.0


def test_words_of_segments_are_not_dealt(spark):
    """documents are shuffled, and their words stay where they are cut."""
    plan = entry.queries()["merged_segments"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")
    physical = entry.queries()["merged_segments"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    full = entry.queries()["merged_segments"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange") == 1 and "Generate" in physical


def test_live_packets_wait_and_queue_across_runs(spark, tmp_path):
    """in the first run packets wait for those before them, and the second goes on with a packet that still plays; live_backlog has the same packets."""
    import datetime as dt

    import duckdb

    from rillstone.plans import more_queries as Q

    t0 = dt.datetime(2024, 1, 1)
    at = [0, 20, 25, *range(40, 800, 20)]
    rows = [(100 * u + i, t0 + dt.timedelta(seconds=s + (5 if u == 2 and i == 2 else 0)), u, "view", 10.0) for u in (1, 2) for i, s in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    parts = Q._live_packets(spark, str(tmp_path))
    first, second = ({(r.run_id, r.packet_index) for r in p.collect()} for p in parts)
    assert not first & second and first | second == {(str(u), k) for u in (1, 2) for k in range(1, len(at) + 1)}
    assert {("1", 1), ("1", 2)} <= first and ("1", 3) in second
    gap = {u: min(k for run, k in second if run == u) for u in ("1", "2")}
    assert all(any(run == u and k > gap[u] for run, k in first) for u in gap)
    # what has all before it is out after the first run, the rest of the first part waits
    out = {(r.run_id, r.packet_index) for r in Q._live(spark, parts[:1], Q.X.playout).collect()}
    assert out == {(run, k) for run, k in first if k < gap[run]} != first
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("live_playout", "live_backlog"):
        got = entry.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())
        if name == "live_playout":
            assert [(r.run_id, r.packet_index, r.queue_delay_ms) for r in got if r.queue_delay_ms > 0] == [("1", 3, 5000.0)]
