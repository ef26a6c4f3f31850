"""More of the library's operators over the given tables: records, gates, joins and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import records as R
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sampling as S
from ..operators import scoring as C
from ..operators import windows as W
from ..sources import files
from .queries import _BYTES, _PACKETS, _PAIRS, _SIGNALS, _TOK, _long, _signals, packets, pairs
from .registry import query, table

_EN = "regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')"


# records -------------------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, lang AS src_lang, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'zh' END AS tgt_lang, 185.0::DOUBLE AS max_target_wpm, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE greatest(0.0, n_chars / 15.0::DOUBLE - 1.0) END AS src_duration_s,
  concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'missing_tgt_lang' END, CASE WHEN doc_id % 7 = 0 THEN 'missing_source_text' END) AS reasons FROM documents""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical samples and rejects."""
    d = table(spark, sf_dir, "documents").select(
        F.lit("").alias("id"), F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("src_lang"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("zh").alias("tgt_lang"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("source_text"), F.lit("1.0").alias("src_start_s"), F.when(F.col("doc_id") % 3 == 0, "n/a").otherwise((F.col("n_chars") / 15.0).cast("string")).alias("src_end_s"),
    )
    good, bad = R.canonical_samples(d)
    out = good.withColumn("reasons", F.array().cast("array<string>")).unionByName(bad)
    return out.select("id", "src_lang", "tgt_lang", "max_target_wpm", "src_duration_s", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT doc_id, CASE WHEN lang IN ('fr', 'es', 'de') THEN lang END AS code, lang IN ('en', 'de') AS wanted FROM documents""")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with regions and capitals."""
    raw = F.concat(F.lit(" "), F.upper("lang"), F.lit("_XX "))
    return table(spark, sf_dir, "documents").select("doc_id", T.source_lang(raw).alias("code"), T.lang_matches(F.col("lang"), "en", {"en": ("de",)}).alias("wanted"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned FROM documents""")
def cleaned_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrapped around a text comes off again."""
    x = F.concat(F.lit("```Translation: "), F.col("text"), F.lit(" <|im_end|>```"))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_completion(x).alias("cleaned"))


@query(f"""WITH u AS (SELECT doc_id, len({_EN.format('text')}) AS n, n_chars FROM documents) SELECT doc_id AS id, n AS src_units, round_even(n_chars / 16.0::DOUBLE, 6) AS duration_s FROM u WHERE n >= 8 AND n_chars > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("src_text"), F.col("text").alias("tgt_text"), F.lit("en").alias("src_lang"), F.lit("de").alias("tgt_lang"), (F.col("n_chars") * 1000).cast("string").alias("n_frames"))
    _, kept = R.corpus_rows(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    return _long(kept.select("id", "src_units", F.bround("duration_s", 6).alias("duration_s")))


@query("""SELECT doc_id AS id, n_chars * 100 AS frames, round_even(n_chars * 100 / 16000.0::DOUBLE, 6) AS duration_s FROM documents WHERE lang = 'en' AND n_chars * 100 / 16000.0 BETWEEN 1.0 AND 30.0""")
def codec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, IO14."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/a:b/"), F.col("doc_id").cast("string"), F.lit(".wav:0:"), (F.col("n_chars") * 100).cast("string")).alias("audio"), F.lit("x").alias("src_text"), F.lit("y").alias("tgt_text"), F.col("lang").alias("src_lang"), F.lit("de").alias("tgt_lang"))
    return R.codec_rows(d, "en", "de").select("id", F.col("span.frames").alias("frames"), F.bround("duration_s", 6).alias("duration_s"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'unknown_duration' WHEN n_chars / 15.0 > 100 THEN 'too_long' ELSE 'kept' END AS fate FROM documents""")
def long_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the filter."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") / 15.0).alias("s"))
    keep, drop = R.long_targets(d, "s", 100.0)
    return keep.select("doc_id", F.lit("kept").alias("fate")).unionByName(drop.select("doc_id", F.col("reason").alias("fate")))


@query(f"""WITH {_PAIRS} SELECT id, id || '.wav' AS output, round_even(len({_EN.format('candidate')}) / 2.75::DOUBLE, 3) AS estimated_s FROM pairs""")
def voice_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16."""
    return R.tts_requests(pairs(spark, sf_dir).withColumn("lang", F.lit("en")), F.lit(2.75)).select("id", "output", "estimated_s")


@query("""SELECT d.doc_id AS id, l.quality AS audit_quality, l.toxic AS audit_toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def enriched_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested audit record as prefixed columns."""
    audit = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.struct("quality", "toxic").alias("s"))
    return J.enrich_manifest(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), audit, "s")


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS k FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object out of free text, and a field of it."""
    raw = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(T.json_object(raw), "$.k").cast("long").alias("k"))


@query("""SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS transcript, count(*) AS n_messages FROM events WHERE event_type <> 'error' AND event_id % 4 <> 0 GROUP BY user_id""")
def stable_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: errors are control messages, every fourth message is unstable."""
    m = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("message_id"), F.when(F.col("event_type") == "error", "control").otherwise("text").alias("kind"), (F.col("event_id") % 4 != 0).alias("stable"), F.col("event_type").alias("text"))
    return R.stable_transcript(m, "user_id")


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'a,b' ELSE 'b' END AS bad_fields FROM events WHERE event_id % 3 = 0""")
def timing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("value").cast("string")).otherwise("x").alias("a"), F.when(F.col("event_id") % 3 != 0, "1.5").alias("b"))
    return R.timing_faults(e, ["a", "b"]).select("event_id", F.array_join("bad_fields", ",").alias("bad_fields"))


@query("""WITH d AS (SELECT CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'a b/' || doc_id END AS id, doc_id % 4 = 0 AS silent, doc_id % 5 = 0 AS broken, n_chars * 1067 AS samples, doc_id FROM documents),
r AS (SELECT *, CASE WHEN id = '' THEN 'missing_id' WHEN silent THEN 'missing_audio' WHEN broken THEN CASE WHEN doc_id % 2 = 0 THEN 'exception:OSError' ELSE 'exception:Exception' END END AS reason FROM d)
SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 'root/source_wav/dev/' || regexp_replace(id, '[^A-Za-z0-9_.-]+', '_', 'g') || '.wav' END AS staged, CASE WHEN reason IS NULL THEN 16000 END AS packaged_sample_rate,
  CASE WHEN reason IS NULL THEN samples END AS packaged_num_samples, CASE WHEN reason IS NULL THEN round_even(samples / 16000.0::DOUBLE, 6) END AS packaged_duration_s FROM r""")
def staged_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records, some without an id, audio, or a span that can be read."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        i, F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("a b/"), i.cast("string"))).alias("id"), F.when(i % 4 != 0, "w").alias("audio"), F.when(i % 5 != 0, F.col("n_chars") * 1067).alias("samples"), F.when(i % 2 == 0, "OSError").alias("fault"),
    )
    return _long(R.staged_paths(d, "root/", "dev").select("doc_id", "reason", "staged", "packaged_sample_rate", "packaged_num_samples", "packaged_duration_s"))


# text ----------------------------------------------------------------------------------------------------------------------


@query(rf"""SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS coverage_units, length(regexp_replace(text, '[\p{{P}}\p{{S}}\s]', '', 'g')) AS alignment_units,
  len({_EN.format('text')}) AS english FROM documents""")
def unit_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5, T8."""
    x = F.col("text")
    return _long(table(spark, sf_dir, "documents").select("doc_id", F.size(T.coverage_units(x, F.lit("en"))).alias("coverage_units"), F.size(T.alignment_units(x)).alias("alignment_units"), F.size(T.english_words(x)).alias("english")))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents) SELECT doc_id, array_to_string(w[CAST(round_even(0.25 * len(w), 0) AS INT) + 1:CAST(round_even(0.5 * len(w), 0) AS INT)], ' ') AS part FROM w""")
def ratio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second quarter of each text's words."""
    units = F.filter(F.split(T.collapse(F.col("text")), " "), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", T.span_by_ratio(units, F.lit(0.25), F.lit(0.5)).alias("part"))


_JOINED = "ltrim(array_to_string(list_transform({0}, lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9]') THEN ' ' || t ELSE t END), ''))"
_TICKS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?|[^\s]') AS w, n_chars / 15.0::DOUBLE AS dur FROM documents), c AS (SELECT *, len(w) AS n, greatest(1, CAST(ceil(dur / 40.0::DOUBLE) AS BIGINT)) AS k FROM w),
t AS (SELECT *, unnest(range(0, k)) AS t FROM c WHERE n > 0), e AS (SELECT *, CAST(round_even(n * t / k::DOUBLE, 0) AS BIGINT) AS lo, CAST(round_even(n * (t + 1) / k::DOUBLE, 0) AS BIGINT) AS raw FROM t), f AS (SELECT *, CASE WHEN raw <= lo THEN least(n, lo + 1) ELSE raw END AS hi FROM e)"""


@query(_TICKS + f" SELECT doc_id, CAST(t AS BIGINT) AS tick, {_JOINED.format('w[lo + 1:hi]')} AS chunk, length({_JOINED.format('w[1:hi]')}) AS prefix_chars FROM f")
def text_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of forty seconds."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.text_ticks(F.col("text"), F.col("n_chars") / 15.0, 40.0)).alias("t"))
    return _long(t.select("doc_id", "t.tick", "t.chunk", F.length("t.prefix").alias("prefix_chars")))


@query(_TICKS + f" SELECT doc_id, CAST(t AS BIGINT) AS tick, round_even(t * 40.0::DOUBLE, 6) AS start_s, round_even(least(dur, (t + 1) * 40.0::DOUBLE), 6) AS end_s, sha256({_JOINED.format('w[1:hi]')}) AS prefix FROM f")
def text_ticks_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks' times and whole prefixes."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.text_ticks(F.col("text"), F.col("n_chars") / 15.0, 40.0)).alias("t"))
    return _long(t.select("doc_id", "t.tick", "t.start_s", "t.end_s", F.sha2("t.prefix", 256).alias("prefix")))


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'KIT-live' WHEN 'click' THEN 'Seed_AST' WHEN 'error' THEN 'gemini 3' WHEN 'signup' THEN 'GPT-rt' ELSE 'Other' END AS m FROM events)
SELECT event_id, 'r' || event_id || '||' || CASE m WHEN 'KIT-live' THEN 'kit' WHEN 'Seed_AST' THEN 'seed' WHEN 'gemini 3' THEN 'gemini' WHEN 'GPT-rt' THEN 'chatgpt' ELSE m END || '||960||' || CASE m WHEN 'Seed_AST' THEN 'seed_960' WHEN 'GPT-rt' THEN 'seed_ast_chunk960' ELSE 'seed_ast_chunk960' END AS key FROM e""")
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16."""
    name = F.when(F.col("event_type") == "view", "KIT-live").when(F.col("event_type") == "click", "Seed_AST").when(F.col("event_type") == "error", "gemini 3").when(F.col("event_type") == "signup", "GPT-rt").otherwise("Other")
    e = table(spark, sf_dir, "events").select("event_id", T.canonical_model(name).alias("m"), T.chunk_ms(F.lit(None).cast("string"), F.lit("chunk 0.96s")).alias("ms"))
    return e.select("event_id", T.row_key(F.concat(F.lit("r"), F.col("event_id").cast("string")), F.col("m"), F.col("ms"), F.lit("seed_ast_chunk960")).alias("key"))


# gates and scores ------------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_PAIRS}, {_SIGNALS}, d AS (SELECT id, len({_TOK.format('candidate')}) AS u, length(candidate) / 20.0::DOUBLE AS sp, length(reference) / 10.0::DOUBLE AS b, id % 5 = 0 AS styled FROM pairs),
g AS (SELECT d.*, CASE WHEN len(r) > 0 THEN round_even(lcs / len(r), 6) END AS recall, CASE WHEN len(r) > 0 THEN round_even(met / len(r), 6) END AS last, CASE WHEN sp > 0 AND b > 0 THEN round_even(sp / b, 6) END AS budget, CASE WHEN sp > 0 THEN round_even(u / 2.75 / sp, 6) END AS pressure FROM d JOIN s USING (id))
SELECT id, CASE WHEN sp > 0 THEN round_even(u / sp, 6) END AS units_per_s, budget AS duration_budget_ratio, pressure AS rate_pressure_ratio, recall, last AS last_matched, concat_ws(',', CASE WHEN budget > 1.05 THEN 'speech_over_budget' END, CASE WHEN pressure > 1.35 THEN 'speech_too_fast_for_text' END,
  CASE WHEN styled THEN 'text_style:stiff' END, CASE WHEN recall < 0.9 THEN 'low_asr_target_coverage' END, CASE WHEN last < 0.9 THEN 'early_stop_or_suffix_missing' END) AS reasons FROM g""")
def duration_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as speech, gated by duration, rate, style and what of the reference they cover; every fifth has a style fault."""
    p = _signals(pairs(spark, sf_dir)).withColumns({"u": T.token_count(F.col("candidate")), "sp": F.length("candidate") / 20.0, "b": F.length("reference") / 10.0})
    s = M.duration_signals(F.col("u"), F.col("sp"), F.col("b"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(2.75))
    p = p.withColumns({k: s[k] for k in ("units_per_s", "duration_budget_ratio", "rate_pressure_ratio")})
    styles = F.when(F.col("id") % 5 == 0, F.array(F.lit("stiff"))).otherwise(F.array().cast("array<string>"))
    why = M.gate_reasons(F.col("duration_budget_ratio"), F.col("rate_pressure_ratio"), styles, F.col("recall"), F.col("last_matched"))
    return p.select("id", "units_per_s", "duration_budget_ratio", "rate_pressure_ratio", "recall", "last_matched", F.array_join(why, ",").alias("reasons"))


@query("""WITH c AS (SELECT l_orderkey, list(l_quantity / nullif(l_tax * 500, 0) ORDER BY l_linenumber) AS r FROM lineitem GROUP BY l_orderkey), v AS (SELECT l_orderkey, list_filter(r, lambda x: x IS NOT NULL) AS v FROM c)
SELECT l_orderkey, len(v) AS valid_chunks, len(list_filter(v, lambda x: x > 1.0)) AS violation_count, round_even(list_max(v), 6) AS max_rtf, len(v) > 0 AND len(list_filter(v, lambda x: x > 1.0)) = 0 AS pass FROM v""")
def chunk_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as chunks."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_tax") * 500 != 0, F.col("l_quantity") / (F.col("l_tax") * 500)).alias("r")))), lambda x: x["r"]).alias("r"))
    g = li.select("l_orderkey", M.rtf_gate(F.col("r")).alias("g"))
    return _long(g.select("l_orderkey", "g.valid_chunks", "g.violation_count", "g.max_rtf", "g.pass"))


@query("""SELECT l_orderkey, count(*) FILTER (l_quantity > greatest(10.0, l_linenumber * 9.0)) AS runaway FROM lineitem GROUP BY l_orderkey""")
def runaway_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M21."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_linenumber")).alias("t"))
    return _long(li.select("l_orderkey", M.runaway_turns(F.transform("t", lambda x: x["l_quantity"]), F.transform("t", lambda x: x["l_linenumber"]), 10.0, 9.0).alias("runaway")))


@query(f"""WITH {_PAIRS}, g AS (SELECT id, {_BYTES.format('reference')} AS a, CASE WHEN id % 7 <> 0 THEN {_BYTES.format('candidate')} END AS b, CASE WHEN id % 7 <> 0 THEN length(candidate) / 15.0::DOUBLE END AS s, length(reference) / 15.0::DOUBLE AS r, length(reference) / 12.0::DOUBLE AS o FROM pairs)
SELECT id, b IS NULL AS missing, round_even(s / o, 6) AS rtf, coalesce(round_even(s / o, 6) > 1.0, false) AS rtf_violation, round_even(s / r, 6) AS duration_ratio, coalesce(round_even(s / r, 6) < 0.65, false) AS early_stop,
  round_even(CASE WHEN a <> '' THEN levenshtein(a, coalesce(b, '')) / length(a) WHEN b <> '' THEN 1.0 END, 6) AS cer FROM g""")
def evaluated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as predictions of the user turns before them; some are missing."""
    p = pairs(spark, sf_dir)
    gold = p.select("id", F.col("reference").alias("text"), (F.length("reference") / 12.0).alias("source_s"), (F.length("reference") / 15.0).alias("reference_s"))
    pred = p.filter("id % 7 <> 0").select("id", F.col("candidate").alias("text"), (F.length("candidate") / 15.0).alias("speech_s"))
    return C.evaluate_predictions(gold, pred)


@query("""SELECT d.doc_id AS id, l.quality AS judge_quality, round_even((l.quality * 3 + l.toxic) / 5.0::DOUBLE, 6) AS judge_overall_norm FROM documents d LEFT JOIN labels l USING (doc_id)""")
def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M22."""
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", (F.col("quality") * 3 + F.col("toxic")).alias("overall"))
    return C.merge_judge(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), judged).select("id", "judge_quality", "judge_overall_norm")


# joins ---------------------------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '__speed_1.5' ELSE '' END AS id, CAST(doc_id AS VARCHAR) AS base FROM documents), p AS (SELECT CAST(doc_id % 700 AS VARCHAR) AS id, arg_max(CAST(doc_id AS VARCHAR), doc_id) AS c FROM labels GROUP BY 1)
SELECT g.id, coalesce(a.c, b.c) AS candidate FROM g LEFT JOIN p a ON a.id = g.id LEFT JOIN p b ON b.id = g.base AND g.id LIKE '%\\_\\_speed\\_%' ESCAPE '\\'""")
def joined_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last prediction of an id, else of its base id."""
    gold = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "__speed_1.5").otherwise("")).alias("id"))
    pred = table(spark, sf_dir, "labels").select((F.col("doc_id") % 700).cast("string").alias("id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("candidate"))
    return C.join_predictions(gold, pred).select("id", "candidate")


@query(r"""SELECT d.doc_id AS row_key, l.quality / 2.0::DOUBLE AS score, CASE WHEN l.doc_id IS NOT NULL AND length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <> d.n_chars THEN d.n_chars END AS stale FROM documents d LEFT JOIN labels l USING (doc_id)""")
def attached_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the length of the text they were made for."""
    d = table(spark, sf_dir, "documents")
    scores = d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("row_key"), F.col("n_chars").alias("hypothesis_chars"), (F.col("quality") / 2.0).alias("score"))
    return J.attach_scores(d.select(F.col("doc_id").alias("row_key"), F.col("text").alias("candidate_text")), scores).select("row_key", "score", F.col("chars_mismatch.expected").alias("stale"))


@query("""SELECT d.doc_id AS id, coalesce(a.text, b.text) AS english FROM documents d LEFT JOIN benchmark a ON a.item_id = d.doc_id AND a.item_id % 2 = 0 LEFT JOIN benchmark b ON b.item_id = d.doc_id % 1000 AND b.item_id % 3 = 0""")
def parallel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id where there is one, else by position."""
    b = table(spark, sf_dir, "benchmark")
    english = b.filter("item_id % 2 = 0").select(F.col("item_id").alias("id"), F.lit(None).cast("long").alias("pos"), "text").unionByName(b.filter("item_id % 3 = 0").select(F.lit(None).cast("long").alias("id"), F.col("item_id").alias("pos"), "text"))
    return J.parallel_text(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 1000).alias("pos")), english).select("id", "english")


@query("""WITH s AS (SELECT event_id, coalesce(CASE WHEN event_id % 13 <> 0 THEN (event_id % 50) * 1.5::DOUBLE END, 0.0) AS a, CASE WHEN event_id % 11 <> 0 THEN (event_id % 50) * 1.5 + event_id % 30 END AS b0, CASE event_id % 3 WHEN 0 THEN 60.0 WHEN 1 THEN 0.0 END AS d FROM events), t AS (SELECT *, coalesce(b0, a) AS b, coalesce(d, 0.0) AS lim FROM s)
SELECT event_id, CAST(unnest(range(CAST(floor(a / 10) AS BIGINT), CAST(floor(greatest(a, greatest(a, CASE WHEN lim > 0 THEN least(b, lim) ELSE b END) - 1e-6) / 10) AS BIGINT) + 1)) AS BIGINT) AS window_index FROM t WHERE lim <= 0 OR a < lim""")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with and without an end of the evaluation, some without a start or an end."""
    i = F.col("event_id")
    a = (i % 50) * 1.5
    e = table(spark, sf_dir, "events").select(i, F.when(i % 13 != 0, a).alias("start_s"), F.when(i % 11 != 0, a + i % 30).alias("end_s"), F.when(i % 3 == 0, 60.0).when(i % 3 == 1, 0.0).alias("duration_s"))
    return _long(J.sentence_windows(e, 10.0).select("event_id", "window_index"))


@query("""SELECT d.doc_id AS id, CASE WHEN d.doc_id % 3 = 0 THEN 'missing_target_manifest' WHEN l.doc_id IS NULL THEN 'missing_textgrid' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)""")
def turn_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19's reasons."""
    d = table(spark, sf_dir, "documents")
    targets = d.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.lit("p").alias("path"))
    iv = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("n_intervals"))
    return J.turn_manifest(d.select(F.col("doc_id").alias("id"), F.lit(0).alias("turn"), F.lit("x").alias("text")), targets, iv).select("id", "reason")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'new' ELSE d.lang END AS lang, l.doc_id IS NOT NULL AS updated FROM documents d LEFT JOIN labels l USING (doc_id)""")
def updated_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20."""
    return J.update_trace(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("lang")), "doc_id", ["lang"])


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO4: what neither output holds."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    return J.resume(table(spark, sf_dir, "documents").select("doc_id"), [l.filter("quality = 1").select("doc_id"), l.filter("toxic = 1").select("doc_id")], ["doc_id"])


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS v FROM documents d LEFT JOIN labels l USING (doc_id)""")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO5."""
    return J.upsert(table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("v")), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("v")), "doc_id")


@query("""SELECT doc_id AS id, n_chars / 15.0::DOUBLE AS score FROM documents WHERE lang IN ('de', 'fr') AND n_chars / 15.0 >= 60 ORDER BY score, id LIMIT 40""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO8: the forty candidates of least score; the limit is the operator's own."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", (F.col("n_chars") / 15.0).alias("duration_s"), (F.col("n_chars") / 15.0).alias("score"))
    return files.best_candidates(d, ["de", "fr"], 60.0, 40).select("id", "score")


@query("""SELECT user_id AS id, arg_min(event_id, event_id % 5 * 1000000000 + event_id) AS first_event FROM events GROUP BY user_id""")
def shard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO12: the first row of an id by shard and line."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 5).alias("shard"), F.col("event_id").alias("line"))
    return files.union_shards(e, "id", "shard", "line").select("id", F.col("line").alias("first_event"))


@query("""WITH s AS (SELECT CAST(event_id % 5 AS BIGINT) AS shard, count(*) AS n FROM events GROUP BY 1) SELECT x AS shard, coalesce(n, 0) AS n, n IS NULL AS missing FROM (SELECT unnest(range(0, 7)) AS x) LEFT JOIN s ON s.shard = x""")
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO12: rows of the expected shards."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("shard"))
    return files.shard_counts(e, spark.range(7).withColumnRenamed("id", "shard"), "shard")


# summaries -------------------------------------------------------------------------------------------------------------------


@query("""SELECT l_shipmode AS run, count(*) AS groups, count(*) FILTER (a = 1 AND b = 1) AS one_to_one, count(*) FILTER (a > 1 AND b = 1) AS many_to_one, count(*) FILTER (a = 1 AND b > 1) AS one_to_many, count(*) FILTER (a > 1 AND b > 1) AS many_to_many, max(greatest(a, b)) AS largest,
  round_even(avg(q), 6) AS ending_mean, round_even(quantile_cont(q, 0.5), 6) AS ending_p50, round_even(quantile_cont(q, 0.9), 6) AS ending_p90, round_even(quantile_cont(f, 0.5), 6) AS first_p50, round_even(quantile_cont(w, 0.5), 6) AS span_p50
FROM (SELECT l_returnflag AS l_shipmode, 1 + l_orderkey % 3 AS a, 1 + l_partkey % 2 AS b, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS f, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_extendedprice AS DOUBLE) END AS w FROM lineitem) GROUP BY 1""")
def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as alignment groups of return flags, with three offsets."""
    some = lambda n: F.slice(F.array(*map(F.lit, (1, 2, 3))), F.lit(1), n.cast("int"))
    g = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run"), some(1 + F.col("l_orderkey") % 3).alias("source_ids"), some(1 + F.col("l_partkey") % 2).alias("hypothesis_ids"), F.col("l_quantity").cast("double").alias("ending_offset"), F.col("l_tax").cast("double").alias("first_offset"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice").cast("double")).alias("span"),
    )
    return _long(A.cell_summary(g, "run"))


@query("""WITH m AS (SELECT user_id AS run, min(event_id) AS lo, max(event_id) AS hi, sum(value) AS s FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT u.user_id AS run, round_even(lo - 10.0, 6) AS first_arrival_s, round_even(hi - 10.0, 6) AS last_arrival_s, round_even(s - 100.0, 6) AS duration_lag_s FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m ON m.run = u.user_id""")
def config_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, W30."""
    e = table(spark, sf_dir, "events")
    m = e.select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", "control").otherwise("audio").alias("kind"), F.col("event_id").cast("double").alias("arrival_s"), F.col("value").alias("duration_s"))
    return A.config_sweep(m, e.select(F.col("user_id").alias("run")).distinct().withColumns({"start_s": F.lit(10.0), "source_s": F.lit(100.0)}))


@query("""SELECT conv_id AS doc, min(turn) AS first_row, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id""")
def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return A.document_sources(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "turn", "text"), "doc", "turn", "text")


_MANIFEST = """o AS (SELECT l_orderkey AS id, count(*) AS n, round_even(sum(l_quantity), 6) AS s, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 4 END AS bounds, l_orderkey % 4 = 1 AS short,
  count(*) FILTER (l_linenumber = 5) AS missing, count(*) FILTER (l_linenumber <> 5 AND l_linenumber <> 3 AND l_quantity <= 3) AS corrupt, CASE WHEN l_orderkey % 2 = 0 THEN 100.0 END AS whole FROM lineitem GROUP BY l_orderkey),
i AS (SELECT id, s AS sum_s, missing, corrupt, concat_ws(',', CASE WHEN bounds > 0 AND bounds <> n THEN 'boundary_count_mismatch' END, CASE WHEN corrupt > 0 THEN 'corrupt_target_wav' END, CASE WHEN missing > 0 THEN 'missing_target_wav' END,
  CASE WHEN short THEN 'target_chunk_count_mismatch' END, CASE WHEN abs(whole - s) > 0.35 THEN 'target_chunk_duration_sum_delta' END) AS issues FROM o)"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples, their lines as target chunks: the fifth has no file, the third no path, small ones are corrupt."""
    q = F.col("l_quantity").cast("double")
    wav = F.when(F.col("l_linenumber") == 5, "missing").when(F.col("l_linenumber") == 3, F.lit(None)).when(q <= 3, "corrupt").otherwise("ok")
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct(wav.alias("w"), q.alias("q"))).alias("x"))
    o = o.withColumns({"wavs": F.transform("x", lambda x: x["w"]), "chunk_s": F.transform("x", lambda x: x["q"]), "n_boundaries": F.when(F.col("id") % 3 == 0, 0).otherwise(4)})
    o = o.withColumn("n_sources", F.when(F.col("id") % 4 == 1, F.col("n") + 1).otherwise(F.col("n")))
    return A.manifest_issues(o.withColumn("full_s", F.when(F.col("id") % 2 == 0, 100.0)))


@query(f"WITH {_MANIFEST.replace('bounds <> n', 'bounds <> n + CAST(short AS INT)')} SELECT id, sum_s, missing, corrupt, issues FROM i")
def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's faults."""
    return _long(_manifest(spark, sf_dir).withColumn("issues", F.array_join("issues", ",")))


@query(f"WITH {_MANIFEST.replace('bounds <> n', 'bounds <> n + CAST(short AS INT)')} SELECT count(*) AS rows, count(*) FILTER (issues <> '') AS issues, CAST(sum(missing) AS BIGINT) AS missing_wavs, CAST(sum(corrupt) AS BIGINT) AS corrupt_wavs FROM i")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the whole manifest."""
    return A.manifest_summary(_manifest(spark, sf_dir))


_STATS = "round_even(avg({0}), 6) AS mean, list_sort(list({0}))[count({0}) // 2 + 1] AS p50, list_sort(list({0}))[least(count({0}) - 1, CAST(floor(count({0}) * 0.9::DOUBLE) AS BIGINT)) + 1] AS p90"


@query(f"""WITH e AS (SELECT event_type AS run, user_id, CASE WHEN event_id % 9 <> 0 THEN value END AS v FROM events), c AS (SELECT run, count(*) AS n, count(v) AS ok, count(*) FILTER (v IS NULL) AS failed, count(*) FILTER (v <= 30) AS fit, count(*) FILTER (v > 30) AS missed, count(DISTINCT user_id) AS streams FROM e GROUP BY 1)
SELECT * FROM c JOIN (SELECT run, {_STATS.format('v')}, min(v) AS min, max(v) AS max FROM e WHERE v IS NOT NULL GROUP BY 1) USING (run)""")
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("user_id").alias("stream"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("latency_s"), F.lit(30.0).alias("budget_s"))
    return A.probe_summary(e, "run")


@query("""WITH v AS (SELECT value / 25.0::DOUBLE AS v FROM events WHERE event_id % 6 <> 0) SELECT count(*) AS n, round_even(avg(v), 6) AS mean, round_even(quantile_cont(v, 0.5), 6) AS p50, round_even(quantile_cont(v, 0.9), 6) AS p90, round_even(avg(CAST(v > 1.0 AS INT)), 6) AS violation_rate FROM v""")
def chunk_rtf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20's summary of all chunks' factors, some of them missing."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_agg(F.when(F.col("event_id") % 6 != 0, F.col("value") / 25.0)).alias("rtf"))
    return A.rtf_summary(e, "rtf")


@query("""WITH r AS (SELECT 'base' AS system, value AS v FROM events UNION ALL SELECT 'tuned', value * 2 FROM events) SELECT system, 'v' AS metric, count(*) AS n, round_even(avg(v), 6) AS mean, round_even(quantile_cont(v, 0.5), 6) AS p50, round_even(quantile_cont(v, 0.9), 6) AS p90, round_even(quantile_cont(v, 0.95), 6) AS p95, round_even(min(v), 6) AS min, round_even(max(v), 6) AS max FROM r GROUP BY 1""")
def system_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A22."""
    e = table(spark, sf_dir, "events").select(F.col("value").alias("v"))
    return A.system_summary(e, e.select((F.col("v") * 2).alias("v")), ["v"])


@query("""SELECT c.conv_id AS talk, count(*) AS sessions, count(*) FILTER (c.turn % 3 = 0) AS missing, round_even(coalesce(sum(length(text) / 20.0::DOUBLE) FILTER (turn % 3 <> 0), 0.0), 6) AS target_s, round_even(sum(length(text) / 20.0::DOUBLE) FILTER (turn % 3 <> 0) / sum(length(text) / 10.0::DOUBLE), 6) AS duration_ratio FROM conversations c GROUP BY 1""")
def talk_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third session is missing."""
    t = table(spark, sf_dir, "conversations").withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    return A.talk_assembly(t.select(F.col("conv_id").alias("talk"), "row_id", (F.length("text") / 10.0).alias("source_s")), t.filter("turn % 3 <> 0").select("row_id", (F.length("text") / 20.0).alias("target_s")), "talk")


# sequences -------------------------------------------------------------------------------------------------------------------


@query(f"""WITH n AS (SELECT conv_id, turn, len({_EN.format('text')}) AS n FROM conversations) SELECT conv_id, turn, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS BIGINT) AS word_start, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS word_end FROM n""")
def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    return W.word_spans(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "word_start", "word_end")


@query(f"""WITH {_PACKETS}, t AS (SELECT user_id, k, event_id, CAST(arrival_ms AS DOUBLE) AS s, CAST(arrival_ms + duration_ms AS DOUBLE) AS e FROM packets), m AS (SELECT *, coalesce((e + lead(s) OVER (PARTITION BY user_id ORDER BY k)) / 2, e) AS m FROM t)
SELECT event_id, max(m) OVER (PARTITION BY user_id ORDER BY k) AS cut_s FROM m""")
def cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    p = packets(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("o"), "event_id", F.col("arrival_ms").cast("double").alias("start_s"), (F.col("arrival_ms") + F.col("duration_ms")).cast("double").alias("end_s"))
    return W.cut_points(p, "user_id", "o").select("event_id", "cut_s")


@query("""WITH RECURSIVE r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) / 40.0::DOUBLE AS x FROM lineitem),
c AS (SELECT l_orderkey, k, greatest(1, CAST(round_even(x * 12.5, 0) AS BIGINT)) AS c FROM r WHERE k = 1 UNION ALL SELECT r.l_orderkey, r.k, greatest(c.c + 1, greatest(1, CAST(round_even(r.x * 12.5, 0) AS BIGINT))) FROM r JOIN c ON r.l_orderkey = c.l_orderkey AND r.k = c.k + 1)
SELECT l_orderkey, k, least(c, 60) AS frame_end FROM c""")
def frame_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6; the oracle is the recursion itself."""
    by = Window.partitionBy("l_orderkey").orderBy("o")
    li = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).select("l_orderkey", "o", F.row_number().over(by).alias("k"), (F.sum("l_quantity").over(by.rowsBetween(Window.unboundedPreceding, 0)) / 40.0).alias("cut_s"), F.lit(60).alias("total"))
    return _long(W.frame_cuts(li, "l_orderkey", "o", 12.5, "total").select("l_orderkey", "k", "frame_end"))


@query(f"""WITH {_PACKETS}, v AS (SELECT user_id, k, event_id, CASE WHEN event_id % 3 = 0 THEN CAST(arrival_ms - 1704067200000 AS DOUBLE) END AS v FROM packets),
n AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS va, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS ka, first_value(v IGNORE NULLS) OVER b AS vb, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS kb FROM v
  WINDOW a AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round_even(max(coalesce(v, va + (vb - va) * (k - ka) / greatest(1, kb - ka), va, vb)) OVER (PARTITION BY user_id ORDER BY k), 3) AS filled FROM n""")
def interpolated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three times are missing."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = packets(spark, sf_dir).select("user_id", "event_id", F.row_number().over(by).alias("k"), F.when(F.col("event_id") % 3 == 0, (F.col("arrival_ms") - 1704067200000).cast("double")).alias("v"))
    return W.interpolate(p, ["user_id"], "k", "v").select("event_id", F.bround("v_filled", 3).alias("filled"))


@query(f"""WITH {_PACKETS}, c AS (SELECT user_id, k, event_id, duration_ms, sum(duration_ms) OVER (PARTITION BY user_id ORDER BY k) AS cum FROM packets) SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN duration_ms ELSE greatest(0, cum - coalesce(max(cum) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) END AS DOUBLE) AS duration_ms FROM c""")
def filled_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other duration is missing."""
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    p = packets(spark, sf_dir).withColumn("cumulative_ms", F.sum("duration_ms").over(upto).cast("double")).withColumn("duration_ms", F.when(F.col("event_id") % 2 == 0, F.col("duration_ms").cast("double")))
    return W.fill_durations(p, ["user_id"], ["ts", "event_id"]).select("event_id", "duration_ms")


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn, turn * 1000 AS r, length(text) AS d, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS hi FROM conversations),
f AS (SELECT conv_id, k, turn, hi, r + d AS e FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, t.turn, t.hi, greatest(t.r, f.e) + t.d FROM t JOIN f ON t.conv_id = f.conv_id AND t.k = f.k + 1) SELECT conv_id, turn, CAST(hi AS BIGINT) AS audio_end_ms, CAST(e AS BIGINT) AS playout_end_ms FROM f""")
def cascade_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 1000).alias("ready_ms"), F.length("text").cast("long").alias("duration_ms"))
    return W.cascade_packets(t, "conv_id").select("conv_id", "turn", "audio_end_ms", "playout_end_ms")


@query("""SELECT doc_id, CAST(w AS BIGINT) AS window_index, w * 30.0::DOUBLE AS window_start_s, least(d, (w + 1) * 30.0::DOUBLE) AS window_end_s FROM (SELECT doc_id, n_chars / 15.0::DOUBLE AS d, unnest(range(0, CAST(floor((n_chars / 15.0::DOUBLE + 30.0 - 1e-9) / 30.0) AS BIGINT))) AS w FROM documents)""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W18."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 15.0).alias("d"))
    return _long(W.fixed_windows(d, "d", 30.0).select("doc_id", "window_index", "window_start_s", "window_end_s"))


@query("""WITH t AS (SELECT conv_id, list(turn * 10.0::DOUBLE ORDER BY turn) AS t FROM conversations GROUP BY 1), n AS (SELECT conv_id, t, CAST(conv_id % 9 AS INT) AS n FROM t)
SELECT conv_id, CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN len(t) >= n THEN list_sum(t[1:n]) ELSE list_sum(t) + (n - len(t)) * t[len(t)] END AS total, CASE WHEN len(t) > n THEN 'trimmed' WHEN len(t) < n THEN 'padded' END AS warning FROM n""")
def fitted_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W20."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list((F.col("turn") * 10.0))).alias("t")).withColumn("n", (F.col("conv_id") % 9).cast("int"))
    fitted, warning = W.fit_emissions(F.col("t"), F.col("n"))
    return t.select("conv_id", F.aggregate(fitted, F.lit(0.0), lambda a, x: a + x).alias("total"), warning.alias("warning"))


@query("""WITH t AS (SELECT conv_id, list(turn * 10.0::DOUBLE ORDER BY turn) AS t FROM conversations GROUP BY 1), n AS (SELECT conv_id, t, CAST(conv_id % 9 AS INT) AS n FROM t)
SELECT conv_id, CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN len(t) >= n THEN list_sum(t[1:n]) ELSE list_sum(t) + (n - len(t)) * t[len(t)] END AS total, CASE WHEN len(t) > n THEN 'trimmed' WHEN len(t) < n THEN 'padded' END AS warning FROM n""")
def fitted_emissions_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W20 on all conversations, those fitted to no emission too."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list((F.col("turn") * 10.0))).alias("t")).withColumn("n", (F.col("conv_id") % 9).cast("int"))
    fitted, warning = W.fit_emissions(F.col("t"), F.col("n"))
    return t.select("conv_id", F.aggregate(fitted, F.lit(0.0), lambda a, x: a + x).alias("total"), warning.alias("warning"))


@query("""SELECT event_id, value / 1.25::DOUBLE AS value, round_even(CAST(event_id AS DOUBLE) / 1.25, 6) AS at FROM events""")
def scaled_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W27."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.col("event_id").cast("double").alias("at"), F.lit(1.25).alias("speed"))
    return W.scale_times(e, ["value", "at"], "speed").select("event_id", "value", F.bround("at", 6).alias("at"))


@query("""SELECT doc_id, i AS unit, round_even(i / n::DOUBLE * (n_chars / 15.0::DOUBLE * 1000), 3) AS at_ms FROM (SELECT doc_id, n_chars, 5 AS n, unnest(range(1, 6)) AS i FROM documents)""")
def proxy_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spread times."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(W.proxy_times(F.lit(5), F.col("n_chars") / 15.0 * 1000)).alias("i", "at_ms"))
    return d.select("doc_id", (F.col("i") + 1).cast("long").alias("unit"), "at_ms")


@query(f"""WITH {_PACKETS}, i AS (SELECT user_id, k, event_id, event_id % 100 AS x, duration_ms % 2 AS r FROM packets) SELECT event_id, concat_ws(',', CASE WHEN x <> lag(x) OVER w + 1 THEN 'index_gap' END, CASE WHEN r <> lag(r) OVER w THEN 'rate_change' END) AS issues FROM i WINDOW w AS (PARTITION BY user_id ORDER BY k)""")
def packet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5 as a batch."""
    p = packets(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("o"), "event_id", (F.col("event_id") % 100).alias("x"), (F.col("duration_ms") % 2).alias("r"))
    return W.contiguous_check(p, ["user_id"], "o", "x", "r").select("event_id", F.array_join("issues", ",").alias("issues"))


# samples ---------------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS BIGINT) AS o_model, CASE WHEN doc_id % 2 = 0 THEN 999999.0::DOUBLE ELSE 1.5 END AS o_speed FROM documents""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as four systems."""
    model = F.when(F.col("lang") == "de", "chatgpt").when(F.col("lang") == "en", "gemini").when(F.col("lang") == "es", "seed").otherwise("kit")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 != 0, 1.5).alias("speed"), model.alias("model"), F.lit(960).alias("chunk_ms"), F.lit("x").alias("label"))
    return _long(S.report_rank(d).select("doc_id", "o_model", "o_speed"))


@query("""SELECT conv_id AS id, turn, 'seg_' || conv_id || '_' || lpad(CAST(turn - lo AS VARCHAR), 5, '0') AS segment_id FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS lo FROM conversations) WHERE length(text) > 200""")
def packaged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of up to 200 characters count as empty."""
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.length("text") > 200, F.col("text")).alias("x")))).alias("t"))
    t = t.select("id", F.transform("t", lambda x: x["turn"].cast("string")).alias("audios"), F.transform("t", lambda x: x["x"]).alias("texts"))
    return S.package_segments(t, "id", "audios", "texts", "seg").select("id", F.col("audio").cast("long").alias("turn"), "segment_id")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each id."""
    return S.first_of_each(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "event_id", "value")
