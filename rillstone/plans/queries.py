"""The library's operators over the given tables.

Stand-ins: a user turn is a reference and the assistant turn after it a candidate; documents are corpus rows, label rows and runs;
events of a user are the packets, sends and steps of a session.
"""

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
from .registry import query, table

SPEEDS = (1.0, 1.35, 1.7, 2.0)
RATIOS = (("train", 0.9), ("dev", 0.05), ("test", 0.05))

# pieces of the oracle's SQL
_TOK = "regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?|[一-鿿]')"
_NUM = r"regexp_extract_all(coalesce({0}, ''), '\b\d+(?:[.,:/-]\d+)*\b')"
_PAIRS = """pairs AS (SELECT a.conv_id * 100 + a.turn AS id, a.conv_id, a.text AS reference, b.text AS candidate FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""
_PACKETS = """packets AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS arrival_ms, CAST(round_even(value * 1000, 0) AS BIGINT) AS duration_ms,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""
_FOLDED = ("àâäáçèéêëîïíñôöóùûüúß¿¡", "aaaaceeeeiiinooouuuus??")
_FOLD = f"translate(lower({{0}}), '{_FOLDED[0]}', '{_FOLDED[1]}')"
#: letters beyond ASCII as unused codes of one byte, white space gone
_WIDE = "àâäáçèéêëîïíñôöóùûüúßÀÂÄÁÇÈÉÊËÎÏÍÑÔÖÓÙÛÜÚ"
_NARROW = "".join(chr(i) for i in range(1, 32) if i not in range(9, 14)) + "|~^`@[]_<>#$%&*+="
_BYTES = f"regexp_replace(translate(coalesce({{0}}, ''), '{_WIDE}', '{_NARROW[: len(_WIDE)]}'), '[ \\t\\n\\r\\f\\v]+', '', 'g')"
_UNIT = "(CAST(('0x' || substr(sha1({0}), 1, 16)) AS UBIGINT) / 18446744073709551616.0)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    a = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    b = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "reference", "candidate")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "ts", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival_ms"), F.bround(F.col("value") * 1000, 0).cast("long").alias("duration_ms"), F.to_date("ts").alias("day"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.posexplode(T.split_sentences(F.col("text"), F.col("lang"))).alias("pos", "sentence"))
    return d.withColumn("duration_s", F.col("n_chars") / 15.0)


def _long(df: DataFrame) -> DataFrame:
    """Counts as long, as the oracle has them."""
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint", "tinyint")})


# text and scores ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_PAIRS}
SELECT id, len({_TOK.format('candidate')}) AS tokens, length(regexp_replace(candidate, '[^一-鿿]', '', 'g')) AS cjk, len({_NUM.format('candidate')}) AS numbers,
  lower(array_to_string({_TOK.format('candidate')}, ' ')) AS normal, length(regexp_replace(candidate, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS spoken, len(string_split(trim(regexp_replace(candidate, '\\s+', ' ', 'g')), ' ')) AS words FROM pairs""")
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2, T3, T6, T7, T9, P7."""
    c = F.col("candidate")
    return _long(pairs(spark, sf_dir).select("id", T.token_count(c).alias("tokens"), T.cjk_count(c).alias("cjk"), F.size(T.numbers(c)).alias("numbers"), T.normalize(c).alias("normal"), T.spoken_chars(c).alias("spoken"), F.size(T.latency_units(c, F.lit("en"))).alias("words")))


_SCORES = f"""WITH {_PAIRS},
b AS (SELECT id, reference, candidate, list_transform({_TOK.format('reference')}, lambda x: lower(x)) AS r, list_transform({_TOK.format('candidate')}, lambda x: lower(x)) AS h,
  list_distinct({_NUM.format('reference')}) AS nr, {_NUM.format('candidate')} AS nh FROM pairs),
m AS (SELECT id, sum(least(cr, ch)) AS o FROM (SELECT id, t, count(*) AS cr FROM (SELECT id, unnest(r) AS t FROM b) GROUP BY ALL) x
  JOIN (SELECT id, t, count(*) AS ch FROM (SELECT id, unnest(h) AS t FROM b) GROUP BY ALL) y USING (id, t) GROUP BY id),
s AS (SELECT b.id, len(h) AS candidate_tokens, len(r) AS reference_tokens, len(h) / greatest(1, len(r)) AS compression_ratio, len(h) / 20.0 AS target_budget_ratio,
  CASE WHEN reference = '' THEN NULL WHEN coalesce(o, 0) = 0 THEN 0.0 ELSE 2.0 * o / (len(r) + len(h)) END AS f1,
  CASE WHEN len(nr) > 0 THEN len(list_intersect(nr, nh)) / len(nr) END AS number_recall, len(h) / 0.5 AS wpm FROM b LEFT JOIN m USING (id)),
p AS (SELECT *, greatest(0.0, target_budget_ratio - 1.0) AS budget_penalty, greatest(0.0, (wpm - 185.0) / 185.0) AS listenability_penalty FROM s),
heur AS (SELECT id, candidate_tokens, reference_tokens, round_even(compression_ratio, 6) AS compression_ratio, target_budget_ratio > 1.0 AS target_budget_violation, round_even(f1, 6) AS bag_f1, round_even(number_recall, 6) AS number_recall,
  round_even(wpm, 6) AS wpm, round_even(budget_penalty, 6) AS budget_penalty, round_even(listenability_penalty, 6) AS listenability_penalty,
  round_even(0.3 * coalesce(f1, 1.0) + 0.25 + 0.2 * coalesce(number_recall, 1.0) + 0.05 * (1.0 - least(1.0, budget_penalty)) + 0.1 * (1.0 - least(1.0, listenability_penalty)) + 0.1, 6) AS heuristic_aggregate FROM p)"""


@query(_SCORES + " SELECT * FROM heur")
def heuristic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 to M7."""
    given = pairs(spark, sf_dir).withColumns({
        "lang": F.lit("en"), "source_text": F.col("reference"), "terms": F.array().cast("array<string>"), "budget": F.lit(20.0), "duration_s": F.lit(30.0), "max_wpm": F.lit(185.0), "rate": F.lit(2.75),
        "budget_s": F.lit(None).cast("double"), "rtf_threshold": F.lit(1.0), "end_lag": F.lit(None).cast("double"), "max_lag": F.lit(1.5),
    })
    r = lambda c: F.bround(c, 6)
    out = C.heuristic_scores(given).select(
        "id", "candidate_tokens", "reference_tokens", r("compression_ratio").alias("compression_ratio"), "target_budget_violation", r("bag_f1_vs_reference").alias("bag_f1"), r("number_recall").alias("number_recall"),
        r("estimated_target_wpm").alias("wpm"), r("budget_penalty").alias("budget_penalty"), r("listenability_penalty").alias("listenability_penalty"), "heuristic_aggregate",
    )
    return _long(out)


@query(_SCORES + """, l AS (UNPIVOT (SELECT id, CAST(candidate_tokens AS DOUBLE) AS candidate_tokens, compression_ratio, bag_f1, number_recall, wpm FROM heur) ON candidate_tokens, compression_ratio, bag_f1, number_recall, wpm INTO NAME metric VALUE v)
SELECT metric, count(*) AS n, round_even(avg(v), 6) AS mean, round_even(quantile_cont(v, 0.5), 6) AS p50, round_even(quantile_cont(v, 0.9), 6) AS p90, round_even(quantile_cont(v, 0.95), 6) AS p95, round_even(min(v), 6) AS min, round_even(max(v), 6) AS max FROM l GROUP BY metric""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over M7."""
    out = A.metric_summary(heuristic_scores(spark, sf_dir), ["candidate_tokens", "compression_ratio", "bag_f1", "number_recall", "wpm"])
    return out


@query(_SCORES + " SELECT 'target_budget_violation' AS metric, round_even(avg(CAST(target_budget_violation AS INT)), 6) AS rate FROM heur")
def flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1's rates."""
    return A.flag_rates(heuristic_scores(spark, sf_dir), ["target_budget_violation"])


@query(f"""WITH {_PAIRS}, v AS (SELECT id, len({_TOK.format('candidate')}) AS v FROM pairs), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM v)
SELECT 'tokens' AS metric, max(n) AS n, round_even(avg(v), 6) AS mean, CAST(max(v) FILTER (i = n // 2) AS DOUBLE) AS p50, CAST(max(v) FILTER (i = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))) AS DOUBLE) AS p90, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max FROM r""")
def nearest_rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return A.nearest_rank(pairs(spark, sf_dir).select("id", T.token_count(F.col("candidate")).alias("tokens")), ["tokens"])


@query(f"""WITH {_PAIRS} SELECT id, round_even(CASE WHEN a <> '' THEN levenshtein(a, b) / length(a) WHEN b <> '' THEN 1.0 END, 6) AS cer FROM (SELECT id, {_BYTES.format('reference')} AS a, {_BYTES.format('candidate')} AS b FROM pairs)""")
def character_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: CER; the oracle's distance counts bytes, so that its accented letters are given codes of one byte."""
    return pairs(spark, sf_dir).select("id", F.bround(M.cer(F.col("reference"), F.col("candidate")), 6).alias("cer"))


#: one row of the table after another: the distances, or the common subsequences, of one more unit of the first list to all places of the second
_ROWS = """{0} AS (SELECT id, 0 AS i, {1} AS row FROM t UNION ALL SELECT {0}.id, i + 1, list_transform(list_reduce(list_prepend([{2}], list_transform(range(1, len(h) + 1), lambda j: [j])), lambda acc, x: list_append(acc, {3})), lambda z: CAST(z AS BIGINT))
  FROM {0} JOIN t USING (id) WHERE i < len(r))"""
_EDITS = _ROWS.format("e", "range(0, len(h) + 1)", "CAST(i + 1 AS BIGINT)", "least(row[x[1] + 1] + 1, acc[len(acc)] + 1, row[x[1]] + CASE WHEN r[i + 1] = h[x[1]] THEN 0 ELSE 1 END)")
_COMMON = _ROWS.format("e", "list_transform(range(0, len(h) + 1), lambda z: CAST(0 AS BIGINT))", "CAST(0 AS BIGINT)", "greatest(row[x[1] + 1], acc[len(acc)], row[x[1]] + CASE WHEN r[i + 1] = h[x[1]] THEN 1 ELSE 0 END)")


@query(f"""WITH RECURSIVE {_PAIRS}, t AS (SELECT id, list_transform({_TOK.format('reference')}, lambda x: lower(x)) AS r, list_transform({_TOK.format('candidate')}, lambda x: lower(x)) AS h FROM pairs), {_EDITS}
SELECT id, round_even(CASE WHEN len(r) > 0 THEN row[len(h) + 1] / len(r) WHEN len(h) > 0 THEN 1.0 END, 6) AS wer FROM e JOIN t USING (id) WHERE i = len(r)""")
def word_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: WER."""
    return pairs(spark, sf_dir).select("id", F.bround(M.wer(F.col("reference"), F.col("candidate")), 6).alias("wer"))


@query(f"""WITH {_PAIRS}, t AS (SELECT id, list_transform({_TOK.format('reference')}, lambda x: lower(x)) AS r, list_transform({_TOK.format('candidate')}, lambda x: lower(x)) AS h FROM pairs),
m AS (SELECT id, sum(least(cr, ch)) AS o FROM (SELECT id, t, count(*) AS cr FROM (SELECT id, unnest(r) AS t FROM t) GROUP BY ALL) x JOIN (SELECT id, t, count(*) AS ch FROM (SELECT id, unnest(h) AS t FROM t) GROUP BY ALL) y USING (id, t) GROUP BY id),
s AS (SELECT id, CASE WHEN coalesce(o, 0) = 0 THEN 0.0 ELSE 2.0 * o / (len(r) + len(h)) END AS f1, CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda x: list_contains(h, x))) / len(r) ELSE 0.0 END AS rc FROM t LEFT JOIN m USING (id))
SELECT id, round_even(f1, 6) AS f1, round_even(rc, 6) AS recall, CASE WHEN rc >= 0.75 OR f1 >= 0.5 THEN 'covered' WHEN rc >= 0.35 OR f1 >= 0.2 THEN 'partial' ELSE 'missed' END AS status FROM s""")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 by counts and join, M11."""
    s = C.bag_scores(pairs(spark, sf_dir), "id", "reference", "candidate")
    return s.select("id", F.bround("f1", 6).alias("f1"), F.bround("recall", 6).alias("recall"), M.coverage_status(F.col("recall"), F.col("f1")).alias("status"))


_COVER = r"list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
#: the place of the last unit met in order, from 1
_ORDERED = """list_reduce(list_prepend([0, 1], list_transform(range(1, len(h) + 1), lambda j: [j, 0])), lambda acc, x: CASE WHEN acc[2] = 1 AND coalesce(list_position(r[acc[1] + 1:], h[x[1]]), 0) > 0
  THEN [acc[1] + list_position(r[acc[1] + 1:], h[x[1]]), 1] ELSE [acc[1], 0] END)[1]"""
_SIGNALS = f"""t AS (SELECT id, {_COVER.format('reference')} AS r, {_COVER.format('candidate')} AS h FROM pairs), {_COMMON},
b AS (SELECT id, sum(least(x.c, y.c)) AS bag FROM (SELECT id, u, count(*) AS c FROM (SELECT id, unnest(r) AS u FROM t) GROUP BY ALL) x JOIN (SELECT id, u, count(*) AS c FROM (SELECT id, unnest(h) AS u FROM t) GROUP BY ALL) y USING (id, u) GROUP BY id),
s AS (SELECT id, r, h, row[len(h) + 1] AS lcs, {_ORDERED} AS met, coalesce(bag, 0) AS bag FROM e JOIN t USING (id) LEFT JOIN b USING (id) WHERE i = len(r))"""


@query(f"""WITH RECURSIVE {_PAIRS}, {_SIGNALS}
SELECT id, CASE WHEN len(r) > 0 THEN round_even(lcs / len(r), 6) END AS recall, CASE WHEN len(h) > 0 THEN round_even(lcs / len(h), 6) END AS precision, CASE WHEN len(r) > 0 THEN round_even(met / len(r), 6) END AS last_matched, len(r) - met AS suffix_units,
  CASE WHEN len(r) > 0 THEN round_even(bag / len(r), 6) END AS bag_recall FROM s""")
def coverage_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequence, ordered match and bag overlap."""
    p = _signals(pairs(spark, sf_dir))
    return _long(p.select("id", "recall", M.share(F.col("lcs"), F.size("h")).alias("precision"), "last_matched", (F.size("t") - F.col("greedy")).alias("suffix_units"), M.share(F.col("bag"), F.size("t")).alias("bag_recall")))


def _signals(p: DataFrame) -> DataFrame:
    from ..functions.arrow import lcs_length, ordered_match

    t, h = T.coverage_units(F.col("reference"), F.lit("en")), T.coverage_units(F.col("candidate"), F.lit("en"))
    p = p.withColumns({"t": t, "h": h}).withColumns({"lcs": lcs_length("t", "h"), "greedy": ordered_match("t", "h"), "bag": M.bag_overlap(F.col("t"), F.col("h"))})
    return p.withColumns({"recall": M.share(F.col("lcs"), F.size("t")), "last_matched": M.share(F.col("greedy"), F.size("t"))})


_GRAMS = """{0} AS (SELECT id, n, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT id, {1} AS w FROM pairs) x, (SELECT unnest([1, 2, 3, 4]) AS n) y WHERE len(w) >= n) GROUP BY ALL)"""
_CHARS = "string_split(regexp_replace({0}, '\\s', '', 'g'), '')"


@query(f"""WITH {_PAIRS}, {_GRAMS.format('h', _CHARS.format('candidate'))}, {_GRAMS.format('r', _CHARS.format('reference'))},
s AS (SELECT h.n, sum(least(h.c, coalesce(r.c, 0))) AS m, sum(h.c) AS t FROM h LEFT JOIN r USING (id, n, g) GROUP BY h.n),
l AS (SELECT sum(length(regexp_replace(candidate, '\\s', '', 'g'))) AS hl, sum(length(regexp_replace(reference, '\\s', '', 'g'))) AS rl FROM pairs)
SELECT CAST(hl AS BIGINT) AS hyp_len, CAST(rl AS BIGINT) AS ref_len, round_even(100 * CASE WHEN hl >= rl THEN 1.0 ELSE exp(1 - rl / hl) END * exp((SELECT sum(ln(m / t)) FROM s) / 4), 4) AS bleu FROM l""")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 over characters: n-gram counts of the corpus, then the ratios."""
    out = C.corpus_bleu(pairs(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], "id", "char")
    return out.select(F.col("hyp_len").cast("long").alias("hyp_len"), F.col("ref_len").cast("long").alias("ref_len"), F.bround("bleu", 4).alias("bleu"))


@query()
def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, M10 with word tokens, and chrF; tested against plain code."""
    return C.corpus_metrics(pairs(spark, sf_dir).withColumn("run", F.col("conv_id") % 4), "run", "id")


@query(f"""WITH {_PAIRS}, x AS (SELECT conv_id, id, regexp_replace(lower(reference), '\\s+', '', 'g') AS a, regexp_replace(lower(candidate), '\\s+', '', 'g') AS b FROM pairs),
n AS (SELECT DISTINCT conv_id, id, substr(a, i, 4) AS g FROM (SELECT conv_id, id, a, unnest(range(1, length(a) - 2)) AS i FROM x WHERE length(a) >= 4)),
h AS (SELECT DISTINCT conv_id, substr(b, i, 4) AS g FROM (SELECT conv_id, b, unnest(range(1, length(b) - 2)) AS i FROM x WHERE length(b) >= 4))
SELECT n.conv_id AS doc, n.id AS seg, round_even(count(h.g) / count(*), 6) AS recall FROM n LEFT JOIN h USING (conv_id, g) GROUP BY ALL""")
def content_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M24."""
    p = pairs(spark, sf_dir)
    return C.content_recall(p.select(F.col("conv_id").alias("doc"), F.col("id").alias("seg"), F.col("reference").alias("text")), p.select(F.col("conv_id").alias("doc"), F.col("candidate").alias("text")))


# training set --------------------------------------------------------------------------------------------------------------


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("n_chars > 0").select("doc_id", (F.col("n_chars") / 15.0).alias("duration_s"), T.token_count(F.col("text")).alias("target_units"))
    d = d.withColumn("split", S.assign_split(S.unit_interval(F.col("doc_id"), 1234), RATIOS)).withColumn("rate", F.lit(2.75))
    return S.speed_decision(S.expand_speeds(d, "doc_id", SPEEDS))


_DECIDE = f"""WITH d AS (SELECT doc_id, n_chars / 15.0 AS duration_s, len({_TOK.format('text')}) AS target_units, {_UNIT.format("'1234:' || CAST(doc_id AS VARCHAR)")} AS u FROM documents WHERE n_chars > 0),
x AS (SELECT doc_id, speed, target_units, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.9 + 0.05 THEN 'dev' ELSE 'test' END AS split, greatest(1e-6, duration_s / speed) AS playback FROM d, (SELECT unnest([1.0::DOUBLE, 1.35, 1.7, 2.0]) AS speed)),
y AS (SELECT *, greatest(1, CAST(floor(playback * 2.75) AS BIGINT)) AS max_target_units, round_even(target_units / 2.75 / playback, 6) AS s2s_rtf FROM x),
z AS (SELECT *, target_units > max_target_units AS needs, max_target_units / greatest(1, target_units) AS ratio FROM y)"""


@query(_DECIDE + """ SELECT doc_id, speed, split, max_target_units, s2s_rtf, needs AS needs_compression, CASE WHEN NOT needs THEN 'faithful' WHEN ratio >= 0.62 THEN 'concise' ELSE 'very_concise' END AS mode,
  CASE WHEN needs THEN round_even(greatest(0.35, least(0.95, ratio)), 3) ELSE 1.0 END AS target_ratio FROM z""")
def rtf_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, S1, S18."""
    return _long(decisions(spark, sf_dir).select("doc_id", "speed", "split", "max_target_units", "s2s_rtf", "needs_compression", "mode", "target_ratio"))


@query(_DECIDE + """ SELECT split, speed, count(*) AS total, count(*) FILTER (NOT needs) AS pass_through, count(*) FILTER (needs) AS needs_compression, round_even(avg(CAST(needs AS INT)), 6) AS compression_rate, round_even(avg(s2s_rtf), 6) AS rtf_mean,
  min(s2s_rtf) AS rtf_min, max(s2s_rtf) AS rtf_max, round_even(avg(ratio), 6) AS budget_ratio_mean FROM z GROUP BY CUBE (split, speed)""")
def rtf_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split and speed, by each, and overall."""
    s = A.decision_stats(decisions(spark, sf_dir))
    return s.select("split", "speed", "total", "pass_through", "needs_compression", "compression_rate", "rtf_mean", "rtf_min", "rtf_max", "budget_ratio_mean")


@query(_DECIDE + """ SELECT speed, CASE WHEN s2s_rtf <= 0.5 THEN '<= 0.5' WHEN s2s_rtf <= 0.75 THEN '(0.5, 0.75]' WHEN s2s_rtf <= 1 THEN '(0.75, 1]' WHEN s2s_rtf <= 1.25 THEN '(1, 1.25]' WHEN s2s_rtf <= 1.5 THEN '(1.25, 1.5]'
  WHEN s2s_rtf <= 2 THEN '(1.5, 2]' WHEN s2s_rtf <= 3 THEN '(2, 3]' ELSE '> 3' END AS bin, count(*) AS n FROM z GROUP BY ALL""")
def rtf_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6's histogram."""
    return A.decision_histogram(decisions(spark, sf_dir))


@query(f"""SELECT doc_id, CASE WHEN {_UNIT.format("CAST(doc_id AS VARCHAR)")} < 0.8 THEN 'train' WHEN {_UNIT.format("CAST(doc_id AS VARCHAR)")} < 0.9 THEN 'dev' ELSE 'test' END AS split FROM documents""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2."""
    return table(spark, sf_dir, "documents").select("doc_id", S.assign_split(S.unit_interval(F.col("doc_id")), (("train", 0.8), ("dev", 0.1), ("test", 0.1))).alias("split"))


@query(f"""WITH s AS (SELECT DISTINCT source AS b, CASE WHEN {_UNIT.format("CAST(doc_id AS VARCHAR)")} < 0.8 THEN 'train' WHEN {_UNIT.format("CAST(doc_id AS VARCHAR)")} < 0.9 THEN 'dev' ELSE 'test' END AS split FROM documents),
n AS (SELECT DISTINCT split FROM s), p AS (SELECT a.split AS l, b.split AS r FROM n a, n b WHERE a.split < b.split),
j AS (SELECT x.split AS l, y.split AS r, x.b, row_number() OVER (PARTITION BY x.split, y.split ORDER BY x.b) AS i FROM s x JOIN s y ON x.b = y.b AND x.split < y.split)
SELECT p.l AS "left", p.r AS "right", count(b) AS shared, coalesce(string_agg(b, ',' ORDER BY b) FILTER (i <= 10), '') AS examples, count(b) = 0 AS disjoint FROM p LEFT JOIN j USING (l, r) GROUP BY ALL""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    d = hash_split(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return A.split_overlap(d, "split", "source")


@query(f"""SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {_UNIT.format("'7:' || CAST(doc_id AS VARCHAR)")}, doc_id) AS i FROM documents) WHERE i <= 3""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each language and source; the limit is the operator's own."""
    return S.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 3, "doc_id", 7)


@query(f"""SELECT doc_id FROM documents WHERE {_UNIT.format("'5:' || CAST(doc_id AS VARCHAR)")} < 0.2""")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5."""
    return S.keep_share(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2, 5)


@query(f"""SELECT doc_id FROM documents ORDER BY {_UNIT.format("'3:' || CAST(doc_id AS VARCHAR)")}, doc_id LIMIT 100""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents in hash order."""
    return S.sample_n(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 3)


@query(f"""WITH r AS (SELECT source, row_number() OVER (ORDER BY {_UNIT.format("'11:' || source")}, source) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT source, CASE WHEN i <= round_even(n * 0.8, 0) THEN 'train' WHEN i <= round_even(n * 0.9, 0) THEN 'dev' ELSE 'test' END AS split FROM r""")
def count_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3."""
    out = S.split_by_counts(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", (("train", 0.8), ("dev", 0.1), ("test", 0.1)), 11)
    return out.select("source", "split")


@query(f"""WITH a AS (SELECT d.doc_id, coalesce(l.quality = 1 AND l.toxic = 0, false) AS ok, {_UNIT.format("'9:' || CAST(d.doc_id AS VARCHAR)")} AS u FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, sum(CAST(ok AS INT)) OVER (ORDER BY u, doc_id) AS c FROM a) SELECT doc_id, ok FROM r WHERE c - CAST(ok AS INT) < 150 AND c <= 150""")
def assembled_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in hash order up to the 150th accepted one."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("ok"))
    return S.assemble(d, "doc_id", "ok", 150, 9)


@query(f"""SELECT doc_id, 'primary' AS source, CAST(c AS BIGINT) AS copy FROM documents, (SELECT unnest([1, 2]) AS c) WHERE lang = 'de' UNION ALL
SELECT doc_id, 'aux', 1 FROM (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY {_UNIT.format("'2:' || CAST(doc_id AS VARCHAR)")}, doc_id LIMIT 50)""")
def mixed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return _long(S.mix(d.filter("lang = 'de'").select("doc_id"), d.filter("lang = 'fr'").select("doc_id"), 2, 50, "doc_id", 2).drop("u"))


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) SELECT doc_id, CASE (i - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.5 ELSE 2.0 END AS speed FROM s""")
def cycled_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6."""
    return S.cycle_speeds(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", (1.0, 1.5, 2.0)).select("doc_id", "speed")


@query(f"""WITH {_PAIRS}, e AS (SELECT id, speed, greatest(1, len({_TOK.format('reference')})) / 155.0::DOUBLE * 60.0 / speed + 1.5 AS most, greatest(1, len({_TOK.format('candidate')})) / 185.0::DOUBLE * 60.0 AS said FROM pairs, (SELECT unnest([1.0::DOUBLE, 1.5]) AS speed))
SELECT id, speed, round_even(most, 3) AS max_target_s, round_even(least(1.0, most / greatest(said, 0.1)), 3) AS target_ratio, CASE WHEN least(1.0, most / greatest(said, 0.1)) >= 0.85 THEN 'faithful' WHEN least(1.0, most / greatest(said, 0.1)) >= 0.65 THEN 'concise' ELSE 'very_concise' END AS mode,
  greatest(4, CAST(floor(185.0 * most / 60.0) AS BIGINT)) AS max_target_words FROM e""")
def stress_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S19, J5."""
    p = pairs(spark, sf_dir).select("id", F.col("reference").alias("source_text"), F.col("candidate").alias("reference"), F.lit(None).cast("double").alias("duration_s"))
    return _long(S.stress_targets(S.expand_speeds(p, "id", (1.0, 1.5))).select("id", "speed", "max_target_s", "target_ratio", "mode", "max_target_words"))


# labels --------------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id % 500 AS id, doc_id AS seq, quality FROM labels), f AS (SELECT id, arg_min(quality, seq) AS quality, min(seq) AS label_seq, count(*) AS n_labels FROM l GROUP BY id)
SELECT d.doc_id AS id, quality, label_seq, coalesce(n_labels, 0) AS n_labels FROM documents d LEFT JOIN f ON f.id = d.doc_id""")
def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First label of each request, duplicates and missing ones told."""
    requests = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") % 500).alias("id"), F.col("doc_id").alias("seq"), "quality")
    return J.merge_labels(requests, labels).select("id", "quality", "label_seq", "n_labels")


@query("""WITH l AS (SELECT doc_id % 500 AS id, max(doc_id) AS seq FROM labels WHERE quality = 1 AND toxic = 0 GROUP BY 1) SELECT d.doc_id AS id, CASE WHEN d.doc_id % 3 = 0 THEN 'own' ELSE CAST(l.seq AS VARCHAR) END AS candidate FROM documents d LEFT JOIN l ON l.id = d.doc_id""")
def policy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass-through rows keep their reference, others the last accepted label."""
    policy = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "pass_through").otherwise("compression").alias("kind"), F.lit("own").alias("reference"))
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") % 500).alias("id"), F.col("doc_id").alias("seq"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accepted"), F.col("doc_id").cast("string").alias("text"))
    return J.policy_candidates(policy, labels).select("id", "candidate")


_SUMMARY = ", ".join(f"count({c}) AS {c}_count, round_even(avg({c}), 4) AS {c}_mean, round_even(quantile_cont({c}, 0.5), 4) AS {c}_p50, round_even(quantile_cont({c}, 0.9), 4) AS {c}_p90, round_even(max({c}), 4) AS {c}_max" for c in A.LABEL_NUMBERS)


@query(f"""WITH j AS (SELECT source AS file, quality = 1 AND toxic = 0 AS ok, CAST(len({_TOK.format('text')}) AS DOUBLE) AS output_units, CASE WHEN doc_id % 3 <> 0 THEN len({_TOK.format('text')}) / (50 + doc_id % 50) END AS output_over_budget_ratio, len({_TOK.format('text')}) / 100.0::DOUBLE AS output_reference_ratio
  FROM labels JOIN documents USING (doc_id))
SELECT file, count(*) AS records, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected, round_even(avg(CAST(ok AS INT)), 4) AS acceptance_rate, {_SUMMARY} FROM j GROUP BY GROUPING SETS ((file), ())""")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: labelled documents by source and overall."""
    units = T.token_count(F.col("text"))
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("source").alias("file"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accepted"), units.alias("output_units"),
        F.when(F.col("doc_id") % 3 != 0, units / (50 + F.col("doc_id") % 50)).alias("output_over_budget_ratio"), (units / 100.0).alias("output_reference_ratio"),
    )
    return A.label_summary(j, "file")


@query(f"""WITH {_PAIRS}, n AS (SELECT id, candidate, len(regexp_extract_all(candidate, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) AS n, len(regexp_extract_all(reference, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')) AS m FROM pairs)
SELECT id, concat_ws(',', CASE WHEN candidate = '' THEN 'empty' END, CASE WHEN n > 100 THEN 'over_budget' END, CASE WHEN m > 0 AND n >= m THEN 'not_compressed' END) AS reasons FROM n""")
def label_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15."""
    r = M.label_reasons(F.col("candidate"), F.col("reference"), F.lit("en"), F.lit(100), F.lit("concise"))
    return pairs(spark, sf_dir).select("id", F.array_join(r, ",").alias("reasons"))


@query("""WITH r AS (SELECT source, concat_ws(',', CASE WHEN text LIKE '%idiot%' OR text LIKE '%moron%' THEN 'rude' END, CASE WHEN regexp_matches(text, '[A-Z]{4,}') THEN 'shouted' END, CASE WHEN n_chars < 40 THEN 'short' END) AS reasons FROM documents)
SELECT source, reasons, count(*) AS n FROM r GROUP BY ALL""")
def style_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and rejected documents by rules for this corpus, with all reasons of each (P11's own rules are in spoken_style)."""
    x = F.coalesce("text", F.lit(""))
    rude = F.exists(F.array(F.lit("idiot"), F.lit("moron")), lambda w: F.contains(x, w))
    kept, rejected = J.rejects(table(spark, sf_dir, "documents"), ((rude, "rude"), (x.rlike("[A-Z]{4,}"), "shouted"), (F.col("n_chars") < 40, "short")))
    both = kept.select("source", F.lit("").alias("reasons")).unionByName(rejected.select("source", F.array_join("reasons", ",").alias("reasons")))
    return both.groupBy("source", "reasons").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT unnest(list_filter([CASE WHEN n_chars > 2000 THEN 'too_long' END, CASE WHEN text LIKE '%idiot%' THEN 'style' END, CASE WHEN lang <> 'en' THEN 'language' END], lambda x: x IS NOT NULL)) AS reason, source FROM documents) SELECT source, reason, count(*) AS n FROM r GROUP BY ALL""")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows' reasons."""
    _, bad = J.rejects(table(spark, sf_dir, "documents"), ((F.col("n_chars") > 2000, "too_long:2000"), (F.contains(F.col("text"), F.lit("idiot")), "style"), (F.col("lang") != "en", "language")))
    return A.reason_histogram(bad, "reasons", ["source"])


@query("""WITH s AS (SELECT doc_id AS id, count(*) AS e FROM documents GROUP BY 1), a AS (SELECT doc_id AS id FROM labels WHERE quality = 1), r AS (SELECT doc_id AS id FROM labels WHERE toxic = 1),
j AS (SELECT id, coalesce(e, 0) AS e, (SELECT count(*) FROM a WHERE a.id = s.id) AS a, (SELECT count(*) FROM r WHERE r.id = s.id) AS r FROM s),
f AS (SELECT id, unnest(list_filter([CASE WHEN e > 0 AND a + r = 0 THEN 'missing' END, CASE WHEN a > 0 AND r > 0 THEN 'overlap' END, CASE WHEN r > 0 THEN 'rejected_speakable' END], lambda x: x IS NOT NULL)) AS fault FROM j),
k AS (SELECT *, row_number() OVER (PARTITION BY fault ORDER BY id) AS i FROM f)
SELECT fault, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (i <= 20) AS examples FROM k GROUP BY fault""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16, J18."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    status = J.status_join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(True).alias("speakable")), l.filter("quality = 1").select(F.col("doc_id").alias("id")), l.filter("toxic = 1").select(F.col("doc_id").alias("id")))
    return J.coverage_gate(status)


# timing --------------------------------------------------------------------------------------------------------------------

_FIFO = f"""WITH RECURSIVE {_PACKETS},
f AS (SELECT user_id, k, event_id, arrival_ms, duration_ms, arrival_ms + duration_ms AS e FROM packets WHERE k = 1 UNION ALL
  SELECT p.user_id, p.k, p.event_id, p.arrival_ms, p.duration_ms, greatest(p.arrival_ms, f.e) + p.duration_ms FROM packets p JOIN f ON p.user_id = f.user_id AND p.k = f.k + 1)"""


def playout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.fifo_playout(packets(spark, sf_dir), ["user_id"], ["ts", "event_id"], block="day")


@query(_FIFO + " SELECT event_id, e - duration_ms AS playout_start_ms, e AS playout_end_ms, e - duration_ms - arrival_ms AS queue_delay_ms FROM f")
def fifo_playout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11; the oracle is the recursion itself."""
    return playout(spark, sf_dir).select("event_id", "playout_start_ms", "playout_end_ms", "queue_delay_ms")


@query(_FIFO + """, s AS (SELECT user_id, max(e) AS playout_end, max(arrival_ms) AS last_arrival, sum(duration_ms) AS audio_ms, max(arrival_ms) - min(arrival_ms) AS len, min(arrival_ms) AS t0 FROM f GROUP BY user_id)
SELECT user_id % 10 AS run, count(*) AS talks, round_even(avg(playout_end - t0 - len), 6) AS final_offset, round_even(avg(playout_end - last_arrival), 6) AS queue_tail, round_even(avg(audio_ms - len), 6) AS trailing_audio, round_even(avg(playout_end - t0 - len), 6) AS delay_offset, round_even(avg(last_arrival - t0 - len), 6) AS elapsed_offset FROM s GROUP BY 1""")
def playout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, A13."""
    t = playout(spark, sf_dir).groupBy("user_id").agg(F.max("playout_end_ms").alias("e"), F.max("arrival_ms").alias("hi"), F.min("arrival_ms").alias("lo"), F.sum("duration_ms").alias("audio_ms"))
    c = F.col
    talks = t.select((c("user_id") % 10).alias("run"), (c("hi") - c("lo")).alias("source_length"), (c("e") - c("lo")).alias("playout_end"), (c("hi") - c("lo")).alias("last_arrival"), "audio_ms", (c("e") - c("lo")).alias("last_delay"), (c("hi") - c("lo")).alias("last_elapsed"))
    out = A.timing_summary(talks, "run")
    return out.select("run", "talks", "final_offset", "queue_tail", "trailing_audio", "delay_offset", "elapsed_offset")


@query(f"""WITH RECURSIVE {_PACKETS}, b AS (SELECT user_id, k, event_id, greatest(0, duration_ms - 25000) AS backlog FROM packets WHERE k = 1 UNION ALL
  SELECT p.user_id, p.k, p.event_id, greatest(0, b.backlog + p.duration_ms - 25000) FROM packets p JOIN b ON p.user_id = b.user_id AND p.k = b.k + 1) SELECT event_id, CAST(backlog AS BIGINT) AS backlog, backlog > 0 AS miss FROM b""")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16; the oracle is the recursion itself."""
    out = W.backlog(packets(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("duration_ms"), F.lit(25_000), block="day")
    return out.select("event_id", F.col("backlog").cast("long").alias("backlog"), "miss")


@query("""WITH c AS (SELECT user_id, (epoch_us(ts) // 1000) / 1000.0 - 1704067200 AS a, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events),
g AS (SELECT user_id, CAST(w AS BIGINT) AS w, w * 86400 / 2.0::DOUBLE AS ws, least(2592000, (w + 1) * 86400) / 2.0::DOUBLE AS we FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 30)) AS w))
SELECT g.user_id, w AS window_index, round_even(coalesce(max(v) FILTER (a < ws), 0.0), 4) AS emitted_start_s, round_even(coalesce(max(v) FILTER (a <= we), 0.0), 4) AS emitted_end_s, round_even(greatest(0.0, we - coalesce(max(v) FILTER (a <= we), 0.0)), 4) AS backlog_s FROM g JOIN c USING (user_id) GROUP BY g.user_id, w, ws, we""")
def window_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 as a batch: day windows at double speed."""
    from pyspark.sql import Window

    p = packets(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    chunks = p.select("user_id", (F.col("arrival_ms") / 1000.0 - 1704067200).alias("arrival_s"), F.sum("value").over(upto).alias("cumulative_s"))
    runs = p.select("user_id").distinct().withColumns({"duration_s": F.lit(2592000.0), "speed": F.lit(2.0)})
    out = W.window_backlog(chunks, runs, "user_id", 86400.0)
    return _long(out.select("user_id", "window_index", *[F.bround(c, 4).alias(c) for c in ("emitted_start_s", "emitted_end_s", "backlog_s")]))


@query("""SELECT u.event_id, coalesce(s.value, 0.0) AS value_as_of FROM (SELECT * FROM events WHERE event_type <> 'click') u ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'click') s ON u.user_id = s.user_id AND u.ts >= s.ts""")
def source_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are sends, all other events look up the last one."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return J.as_of(e.filter("event_type = 'click'"), e.filter("event_type <> 'click'"), "user_id", "ts", "value", "event_id", block=F.to_date).select("event_id", "value_as_of")


@query(f"""WITH {_PACKETS}, p AS (SELECT user_id, k, sum(duration_ms) OVER (PARTITION BY user_id ORDER BY k) AS hi, sum(duration_ms) OVER (PARTITION BY user_id) AS tot FROM packets),
q AS (SELECT DISTINCT user_id, u, CAST(tot * (2 * u + 1) // 20 AS BIGINT) AS pos FROM p, (SELECT unnest(range(0, 10)) AS u))
SELECT q.user_id, CAST(u AS BIGINT) AS unit, pos AS position_ms, coalesce(min(k) FILTER (hi >= pos), max(k)) AS packet_index FROM q JOIN p USING (user_id) GROUP BY ALL""")
def packet_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten units of each user on the packet that covers them."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = packets(spark, sf_dir).select("user_id", F.row_number().over(by).alias("packet_index"), F.sum("duration_ms").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("audio_end_ms"))
    q = p.groupBy("user_id").agg(F.max("audio_end_ms").alias("tot")).select("user_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("unit"), "tot")
    q = q.select("user_id", "unit", F.expr("tot * (2 * unit + 1) div 20").alias("position_ms"))
    return _long(J.packet_at(p, q, "user_id"))


@query(f"""WITH {_PACKETS}, s AS (SELECT user_id, list(CAST(arrival_ms - t0 AS DOUBLE) ORDER BY k) AS d, CAST(max(arrival_ms) - min(t0) AS DOUBLE) * 0.8 AS src FROM (SELECT *, min(arrival_ms) OVER (PARTITION BY user_id) AS t0 FROM packets) GROUP BY user_id),
u AS (SELECT user_id, src, len(d) AS n, greatest(1, len(d) - 3) AS ref, i - 1 AS i, d[i] AS x FROM (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM s)),
o AS (SELECT *, coalesce(max(CAST(x >= src AS INT)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS op, max(x - i * src / n) OVER (PARTITION BY user_id ORDER BY i) AS held FROM u)
SELECT user_id, round_even(avg(x - i * src / ref) FILTER (op), 3) AS al, round_even(avg(x - i * src / greatest(n, ref)) FILTER (op), 3) AS laal, round_even(sum(x) / (max(src) * count(*)), 6) AS ap, round_even(avg(held), 3) AS dal FROM o GROUP BY user_id HAVING max(src) > 0""")
def emission_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average, length-adaptive and differentiable lagging and proportion of each user's arrivals as emissions; users of one arrival have no source."""
    p = packets(spark, sf_dir).groupBy("user_id").agg(F.min("arrival_ms").alias("lo"), F.max("arrival_ms").alias("hi"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "arrival_ms"))).alias("a"))
    t = p.select(F.col("user_id").alias("run"), F.transform("a", lambda x: (x["arrival_ms"] - F.col("lo")).cast("double")).alias("delays"), ((F.col("hi") - F.col("lo")).cast("double") * 0.8).alias("source_length"), F.greatest(F.lit(1), F.size("a") - 3).alias("reference_length"))
    r3 = lambda c: F.bround(c, 3).alias(c)
    return C.emission_latency(t.filter("source_length > 0")).select(F.col("run").alias("user_id"), r3("al"), r3("laal"), F.bround("ap", 6).alias("ap"), r3("dal"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS g FROM e) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, g""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9 as a batch: sessions that a gap of six hours closes."""
    from ..streaming.sessions import sessions

    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours", "1 hour")


@query("""WITH e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM events)
SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS "group" FROM e""")
def consecutive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types."""
    return W.consecutive_groups(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "group")


# alignment and paired statistics --------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT user_id, max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id), d AS (SELECT b - a AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS n, round_even(avg(d), 6) AS mean_diff, round_even(stddev_samp(d) / sqrt(count(*)), 6) AS stderr, round_even(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) FILTER (d > 0.05) AS win, count(*) FILTER (d < -0.05) AS lose, count(*) FILTER (abs(d) <= 0.05) AS tie FROM d""")
def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views against clicks of the same user."""
    e = table(spark, sf_dir, "events")
    p = J.pair_runs(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id"], "value").filter("value_a is not null and value_b is not null")
    out = A.paired_stats(p, "value_a", "value_b")
    return out.select("n", "mean_diff", "stderr", "t", "win", "lose", "tie")


@query("""WITH g AS (SELECT user_id % 20 AS run, event_id, CASE event_type WHEN 'error' THEN 'under_translation' WHEN 'signup' THEN 'over_translation' END AS nt, value / 500 AS score FROM events)
SELECT run, count(*) AS n, count(*) FILTER (nt = 'over_translation') AS over, count(*) FILTER (nt = 'under_translation') AS under, round_even(avg(CASE WHEN nt IS NULL THEN score ELSE 0.0 END), 6) AS mean_all, round_even(avg(score) FILTER (nt IS NULL), 6) AS mean_non_null,
  round_even((1 - count(nt) / count(*)) * avg(score) FILTER (nt IS NULL), 6) AS decomposed, round_even(count(*) FILTER (nt = 'under_translation') / 500.0::DOUBLE, 6) AS under_ratio FROM g GROUP BY run""")
def run_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8, A9."""
    kind = F.when(F.col("event_type") == "error", "under_translation").when(F.col("event_type") == "signup", "over_translation")
    g = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), kind.alias("null_type"), F.array("event_id").alias("source_ids"), (F.col("value") / 500).alias("score"), F.lit(500).alias("n_source"))
    out = A.run_quality(g, "run")
    return out.select("run", "n", "over", "under", "mean_all", "mean_non_null", "decomposed", "under_ratio")


@query("""WITH s AS (SELECT source, doc_id, n_chars AS w, CASE WHEN doc_id % 97 <> 0 OR source <> 'src3' THEN (doc_id % 17) / 17.0::DOUBLE END AS x FROM documents)
SELECT source, count(*) AS n, count(x) AS scored, CASE WHEN count(*) = count(x) THEN round_even(sum(w * x) / sum(w), 6) END AS weighted, CASE WHEN count(*) = count(x) THEN round_even(25 - sum(w * x) / sum(w), 6) END AS inverted FROM s GROUP BY source""")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: complete runs only."""
    d = table(spark, sf_dir, "documents")
    seg = d.select("source", "doc_id", F.col("n_chars").alias("weight"))
    scores = d.filter("doc_id % 97 <> 0 or source <> 'src3'").select("doc_id", ((F.col("doc_id") % 17) / 17.0).alias("score"))
    out = A.weighted_scores(seg, scores, "source", "doc_id")
    return out.select("source", "n", "scored", "weighted", "inverted")


@query("""WITH i AS (SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) + CASE WHEN source = 'src5' THEN 1 ELSE 0 END AS i FROM documents), n AS (SELECT source AS doc, count(*) AS n FROM documents GROUP BY 1)
SELECT n.doc, n.n, count(i) AS found, count(i) = n.n AND count(DISTINCT i) = n.n AND min(i) = 1 AND max(i) = n.n AS covered FROM n LEFT JOIN i USING (doc) GROUP BY n.doc, n.n""")
def id_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "doc_id")
    ids = d.withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy("doc_id")) + F.when(F.col("doc") == "src5", 1).otherwise(0))
    return A.id_coverage(ids, "doc", "i", d.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), 1)


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'left' ELSE 'right' END AS missing_in FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def key_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    return J.key_integrity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH s AS (SELECT user_id AS i, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 1.25 ELSE 1.5 END AS speed, max(value) AS v FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL),
f AS (SELECT i, speed, v, v * 2 AS e, CASE WHEN i % 11 <> 0 THEN v / 4 END AS p, i % 7 = 0 AND speed = 1.25 AS gone FROM s), w AS (SELECT i FROM f GROUP BY i HAVING count(*) = 3),
d AS (SELECT b.speed, CASE WHEN ok THEN b.v - a.v END AS v, CASE WHEN ok THEN b.e - a.e END AS e, CASE WHEN ok THEN b.p - a.p END AS p FROM (SELECT b.*, NOT b.gone AND b.p IS NOT NULL AND i IN (SELECT i FROM w) AS ok FROM f b) b JOIN f a ON a.i = b.i AND a.speed = 1.0 AND b.speed > 1.0)
SELECT 0 AS run, CAST(speed AS DOUBLE) AS speed, (SELECT count(*) FROM w) AS common, count(v) AS n, round_even(avg(v), 6) AS score_delta, round_even(avg(e), 6) AS end_delta_ms, round_even(quantile_cont(e, 0.5), 6) AS end_delta_p50_ms, round_even(quantile_cont(e, 0.9), 6) AS end_delta_p90_ms, round_even(quantile_cont(p, 0.5), 6) AS first_delta_p50_ms FROM d GROUP BY speed""")
def speed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three event types as three speeds; some ids aren't aligned at the second, some have no first speech."""
    speed = F.when(F.col("event_type") == "view", 1.0).when(F.col("event_type") == "click", 1.25).otherwise(1.5)
    s = table(spark, sf_dir, "events").filter("event_type in ('view', 'click', 'error')").groupBy("user_id", speed.alias("speed")).agg(F.max("value").alias("score"))
    s = s.select(F.lit(0).alias("run"), F.col("user_id").alias("source_id"), "speed", "score", (F.col("score") * 2).alias("end_ms"), F.when(F.col("user_id") % 11 != 0, F.col("score") / 4).alias("first_ms"), F.when((F.col("user_id") % 7 == 0) & (F.col("speed") == 1.25), "over_translation").alias("null_type"))
    return J.speed_pairs(s, ["run"], (1.0, 1.25, 1.5))


@query("""WITH l AS (SELECT unnest(['en', 'de', 'fr', 'es', 'zh']) AS lang), s AS (SELECT DISTINCT source FROM documents), r AS (SELECT lang, source, count(*) AS n, avg(n_chars) FILTER (n_chars > 4000) AS long_mean FROM documents GROUP BY ALL)
SELECT l.lang, s.source, n, round_even(long_mean, 4) AS long_mean, CASE WHEN n IS NULL THEN 'not_run' WHEN long_mean IS NULL THEN 'partial' ELSE 'complete' END AS status FROM l CROSS JOIN s LEFT JOIN r ON r.lang = l.lang AND r.source = s.source""")
def result_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    d = table(spark, sf_dir, "documents")
    langs = d.select(F.explode(F.array(*map(F.lit, ("en", "de", "fr", "es", "zh")))).alias("lang")).distinct()
    r = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(F.when(F.col("n_chars") > 4000, F.col("n_chars"))), 4).alias("long_mean"))
    return A.result_grid([d.select("source").distinct(), langs], r, ["lang", "source"], ["n", "long_mean"]).select("lang", "source", "n", "long_mean", "status")


# dialogues and sequences -----------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, role, text, sum(CAST(role = 'assistant' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS k, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS hi FROM conversations)
SELECT a.conv_id, a.turn, CAST(a.k AS BIGINT) AS target_index, CAST(a.hi - length(a.text) AS BIGINT) AS span_start, CAST(a.hi AS BIGINT) AS span_end,
  coalesce((SELECT arg_max(u.text, u.turn) FROM c u WHERE u.conv_id = a.conv_id AND u.role = 'user' AND u.turn < a.turn AND u.k = a.k - 1), '') AS source_text FROM c a WHERE a.role = 'assistant'""")
def dialogue_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    return _long(W.dialogue_spans(table(spark, sf_dir, "conversations"), "conv_id", "turn"))


@query("""SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::VARCHAR AS history FROM conversations""".replace("list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::VARCHAR", "array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '|')"))
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W25."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("x"))
    return W.history_rows(t, "conv_id", "turn", "x").select("conv_id", "turn", F.array_join("history", "|").alias("history"))


@query("""WITH c AS (SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '|') AS context, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, context, CASE WHEN n < 4 THEN 0 ELSE n - (2 + (n - 4) % 2) END AS soft_start FROM c""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns, and where a context that shrinks from four to two begins."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("x"))
    out = W.context_window(t, "conv_id", "turn", "x", 3).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return out.select("conv_id", "turn", F.array_join("context", "|").alias("context"), W.soft_window_start(F.col("n"), 4, 2).cast("long").alias("soft_start"))


@query("""WITH p AS (SELECT a.conv_id, a.turn, a.text AS u, b.text AS v FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
n AS (SELECT *, length(u) || '/' || length(v) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM p)
SELECT conv_id, turn, coalesce(array_to_string(list(x) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' '), '') AS sliding,
  CASE WHEN n = 1 THEN '' ELSE trim(first(x) OVER (PARTITION BY conv_id ORDER BY turn) || ' ' || coalesce(array_to_string(list_filter(list([x, CAST(n AS VARCHAR)]) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), lambda y: y[2] <> '1').list_transform(lambda y: y[1]), ' '), '')) END AS pinned FROM n""")
def pair_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns with the two before them, and with the first and the two before them."""
    p = pairs(spark, sf_dir).select("conv_id", (F.col("id") % 100).alias("turn"), F.length("reference").alias("user"), F.length("candidate").alias("assistant"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("/", x["user"].cast("string"), x["assistant"].cast("string"))), " ")
    out = W.pair_context(p, "conv_id", "turn", 3).withColumn("sliding", said("context"))
    return W.pinned_context(out, "conv_id", "turn", 4).select("conv_id", "turn", "sliding", said("context").alias("pinned"))


@query("""SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '|') AS history FROM conversations""")
def history_rows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W25 with whole turns."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return W.history_rows(t, "conv_id", "turn", "text").select("conv_id", "turn", F.array_join("history", "|").alias("history"))


@query("""WITH c AS (SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '|') AS context, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, context, CASE WHEN n < 4 THEN 0 ELSE n - (2 + (n - 4) % 2) END AS soft_start FROM c""")
def context_windows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W24 with whole turns."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = W.context_window(t, "conv_id", "turn", "text", 3).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return out.select("conv_id", "turn", F.array_join("context", "|").alias("context"), W.soft_window_start(F.col("n"), 4, 2).cast("long").alias("soft_start"))


_SENT = r"""WITH t AS (SELECT doc_id, lang, n_chars / 15.0::DOUBLE AS dur, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents),
w AS (SELECT *, string_split(x, ' ') AS w FROM t),
sent AS (SELECT doc_id, lang, dur, CASE WHEN len(s) <= 1 AND length(x) > 800 AND len(w) > 1 THEN list_transform(range(0, CAST(ceil(len(w) / 80.0::DOUBLE) AS BIGINT)), lambda i: array_to_string(w[i * 80 + 1:i * 80 + 80], ' ')) ELSE s END AS s FROM w)"""


@query(_SENT + " SELECT doc_id, len(s) AS n, length(array_to_string(s, '')) AS chars FROM sent")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10, the texts that are cut by length too."""
    s = table(spark, sf_dir, "documents").withColumn("s", T.split_sentences(F.col("text"), F.col("lang")))
    return _long(s.select("doc_id", F.size("s").alias("n"), F.length(F.array_join("s", "")).alias("chars")))


@query(_SENT + " SELECT doc_id, list_sum(list_transform(range(1, len(s) + 1), lambda i: i * length(s[i])))::BIGINT AS placed FROM sent WHERE len(s) > 0")
def sentence_counts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the sentences are, each weighted by its place."""
    some = F.filter(F.array(T.split_sentences(F.col("text"), F.col("lang"))), lambda s: F.size(s) > 0)
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(some).alias("s"))
    return s.select("doc_id", F.aggregate(F.transform("s", lambda x, i: (i + 1) * F.length(x)), F.lit(0).cast("long"), lambda a, n: a + n).alias("placed"))


@query(_SENT + f""", u AS (SELECT doc_id, dur, i - 1 AS pos, greatest(1, len({_TOK.format('s[i]')})) AS n FROM (SELECT doc_id, dur, s, unnest(range(1, len(s) + 1)) AS i FROM sent)),
h AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS hi, sum(n) OVER (PARTITION BY doc_id) AS tot FROM u)
SELECT doc_id, pos, round_even((hi - n) / tot::DOUBLE * dur, 3) AS start_s, round_even(hi / tot::DOUBLE * dur, 3) AS end_s FROM h""")
def sentence_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 over T10."""
    return _long(W.sentence_times(sentences(spark, sf_dir), ["doc_id"], ["pos"], "sentence", F.col("lang"), "duration_s").select("doc_id", "pos", "start_s", "end_s"))


@query(r"""WITH w AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, x FROM (SELECT doc_id, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS x FROM documents)),
s AS (SELECT doc_id, i, x[i] AS t, regexp_matches(x[i], '[\p{L}\p{N}]') AS sp FROM w), g AS (SELECT *, greatest(1, sum(CAST(sp AS INT)) OVER (PARTITION BY doc_id ORDER BY i)) AS g FROM s)
SELECT doc_id, CAST(g AS BIGINT) AS segment, count(*) AS parts, string_agg(t, '' ORDER BY i) AS text FROM g GROUP BY doc_id, g""")
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W21 over words: those without a letter or digit join the one before."""
    # texts are dealt by document before they are cut, so that words needn't be
    w = table(spark, sf_dir, "documents").repartition("doc_id").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("i", "t"))
    return _long(W.merge_unspoken(w, ["doc_id"], "i", "t").drop("first"))


_MID = f"""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS turns, count(*) AS n FROM conversations GROUP BY conv_id), h AS (SELECT *, least(n // 2, n - 4) AS high FROM c),
d AS (SELECT *, CAST(1 + floor({_UNIT.format("'4:' || CAST(conv_id AS VARCHAR) || ':k'")} * high) AS BIGINT) AS k FROM h WHERE n - 1 >= 4 AND n // 2 >= 1 AND high >= 1 AND {_UNIT.format("'4:' || CAST(conv_id AS VARCHAR) || ':take'")} < 0.5),
m AS (SELECT conv_id || '_mid' || k AS id, k AS dropped, array_to_string(turns[k + 1:n], '|') AS turns FROM d)"""


def _mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return _long(S.drop_lead(t, "id", "turns", 4).select("id", "dropped", F.array_join("turns", "|").alias("turns")))


@query(_MID + " SELECT * FROM m")
def mid_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies that begin in the middle."""
    return _mid(spark, sf_dir).filter("dropped > 0")


@query(_MID + " SELECT * FROM m UNION ALL SELECT CAST(conv_id AS VARCHAR), 0, array_to_string(turns, '|') FROM c")
def mid_passage_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and the copies."""
    return _mid(spark, sf_dir)


@query()
def loop_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17; a fold over turns with draws in it, tested against plain code."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.split(x["text"], " ")).alias("turns"))
    return S.loop_corruption(t, "conv_id", "turns", 6).select("conv_id", "context_only", F.transform("turns", lambda u: F.array_join(u, " ")).alias("turns"))


@query(f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS total, conv_id FROM conversations),
r AS (SELECT *, n * (1 + turn % 3) AS m, turn % 5 = 4 AS runaway FROM t WHERE conv_id % 4 <> 3 AND conv_id % 5 <> 0 AND {_UNIT.format("'0:row:' || id")} < 0.8),
s AS (SELECT *, k < total - 1 AND n > 0 AND m > 0 AND NOT runaway AND m / n BETWEEN 0.5 AND 2.0 AND {_UNIT.format("'0:turn:' || id || ':' || k")} < 0.6 AS swap FROM r)
SELECT id || '_v4self' AS id, id AS source_id, count(*) FILTER (swap) AS swapped, count(*) AS total, string_agg(CASE WHEN swap THEN m || '*' ELSE CAST(n AS VARCHAR) END, ',' ORDER BY turn) AS frames FROM s GROUP BY id HAVING count(*) FILTER (swap) > 0""")
def substituted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of conversations with self-generated turns, some of which are too long, run away or are missing."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"), "conv_id")
    turns = lambda df, *fields: df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", *fields))).alias("turns"))
    rows = turns(t, F.col("n").alias("frames"), F.lit("given").alias("codes"))
    given = t.filter("conv_id % 4 <> 3").withColumn("last", F.max("turn").over(Window.partitionBy("id"))).filter("conv_id % 5 <> 0 or turn < last")
    made = turns(given, (F.col("n") * (1 + F.col("turn") % 3)).cast("int").alias("frames"), F.lit("made").alias("codes"), (F.col("turn") % 5 == 4).alias("runaway"))
    out = J.self_history_copies(rows, made, 0.8, 0.6, 2.0)
    said = F.transform("turns", lambda x: F.concat(x["frames"].cast("string"), F.when(x["context_only"], "*").otherwise("")))
    return _long(out.select("id", "source_id", "swapped", "total", F.array_join(said, ",").alias("frames")))


_JSON_TEXT = r"""'"' || replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '"'"""


@query(f"""WITH t AS (SELECT conv_id AS id, count(*) AS n_turns, trim(coalesce(arg_max(text, turn), '')) AS target, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS said FROM conversations GROUP BY conv_id)
SELECT id, n_turns, '{{"id":' || id || ',"messages":[{{"role":"system","content":"You \\"translate\\"."}},{{"role":"user","content":' || {_JSON_TEXT.format('said')} || '}},{{"role":"assistant","content":' || {_JSON_TEXT.format('target')} || '}}]}}' AS record FROM t WHERE target <> ''""")
def chat_training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a prompt with its last turn as the answer, message by message as JSON."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("x")))), lambda t: t["x"])
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("n_turns"), F.max_by("text", "turn").alias("target"), F.array_join(turns, " ").alias("said"))
    return R.chat_records(t, 'You "translate".', F.col("said"), F.col("target")).select("id", "n_turns", "record")


@query("""WITH s AS (SELECT doc_id, n_chars / 15.0 AS dur FROM documents) SELECT doc_id, CAST(c AS BIGINT) AS chunk, 'x' || doc_id || '__chunk_' || lpad(CAST(c AS VARCHAR), 4, '0') AS chunk_id, round_even(c * 20.0::DOUBLE, 6) AS chunk_start_s,
  round_even(CASE WHEN c = n - 1 THEN least(dur, (c + 1) * 20.0::DOUBLE) ELSE (c + 1) * 20.0::DOUBLE END, 6) AS chunk_end_s FROM (SELECT doc_id, dur, least(8, greatest(1, CAST(floor(dur / 20.0) AS BIGINT))) AS n, unnest(range(0, least(8, greatest(1, CAST(floor(dur / 20.0) AS BIGINT))))) AS c FROM s)""")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W28."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 15.0).alias("dur"), F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("key"))
    return _long(W.fixed_chunks(d, "key", "dur", 20.0, 8).select("doc_id", "chunk", "chunk_id", "chunk_start_s", "chunk_end_s"))


@query("""WITH w AS (SELECT user_id, w, w * 3600.0::DOUBLE * 24 AS lo, (w + 1) * 3600.0::DOUBLE * 24 AS hi FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 31)) AS w)),
i AS (SELECT user_id, event_id AS pos, (epoch_us(ts) // 1000) / 1000.0 - 1704067200 AS s, (epoch_us(ts) // 1000) / 1000.0 - 1704067200 + value AS e, event_type AS text FROM events)
SELECT w.user_id, CAST(w.w AS BIGINT) AS window_index, count(*) AS n_units, round_even(min(s), 3) AS first_s, string_agg(text, ' ' ORDER BY pos) AS text FROM w JOIN i ON w.user_id = i.user_id AND (s + e) / 2 >= lo AND (s + e) / 2 < hi GROUP BY ALL""")
def window_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals, days as windows, by midpoint."""
    e = table(spark, sf_dir, "events").withColumn("start_s", F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0 - 1704067200)
    i = e.select("user_id", F.col("event_id").alias("pos"), "start_s", (F.col("start_s") + F.col("value")).alias("end_s"), F.col("event_type").alias("text"))
    w = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("window_index"))
    w = w.withColumns({"lo": F.col("window_index") * 86400.0, "hi": (F.col("window_index") + 1) * 86400.0})
    return _long(J.window_intervals(w, i, "user_id", 86400.0).select("user_id", "window_index", "n_units", F.bround("first_s", 3).alias("first_s"), "text"))


@query("""WITH b AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?|[一-鿿]'), lambda x: lower(x))) AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?|[一-鿿]'), lambda x: lower(x))) AS w FROM documents),
bt AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM b), dt AS (SELECT doc_id, unnest(w) AS t FROM d), o AS (SELECT item_id, doc_id, n, count(*) AS c FROM bt JOIN dt USING (t) GROUP BY ALL)
SELECT item_id, count(*) FILTER (c / n >= 0.75) AS covered, count(*) FILTER (c / n >= 0.35 AND c / n < 0.75) AS partial, max(round_even(c / n, 6)) AS best FROM o GROUP BY item_id""")
def benchmark_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 at scale: benchmark sentences against all documents over distinct tokens, by an inverted index of the sentences."""
    cut = lambda df, key, name: df.select(F.col(key).alias(name), F.array_distinct(T.tokenize(F.col("text"))).alias("w"))
    b, d = cut(table(spark, sf_dir, "benchmark"), "item_id", "item"), cut(table(spark, sf_dir, "documents"), "doc_id", "doc")
    r = F.col("c") / F.col("n")
    found = J.containment_join(b, d).groupBy("item")
    return found.agg(F.count_if(r >= 0.75).alias("covered"), F.count_if((r >= 0.35) & (r < 0.75)).alias("partial"), F.max(F.bround(r, 6)).alias("best")).withColumnRenamed("item", "item_id")


@query(r"""SELECT doc_id, CASE WHEN position('__speed_' IN v) > 0 THEN split_part(v, '__speed_', 1) WHEN position('__chunk_' IN v) > 0 THEN split_part(v, '__chunk_', 1) ELSE v END AS base, regexp_replace(v, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe
FROM (SELECT doc_id, 'a b' || doc_id || CASE doc_id % 3 WHEN 0 THEN '__speed_1.5' WHEN 1 THEN '__chunk_0003__speed_2' ELSE '__chunk_0001' END AS v FROM documents)""")
def base_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, P6."""
    v = F.concat(F.lit("a b"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "__speed_1.5").when(F.col("doc_id") % 3 == 1, "__chunk_0003__speed_2").otherwise("__chunk_0001"))
    return table(spark, sf_dir, "documents").select("doc_id", T.base_id(v).alias("base"), T.safe_id(v).alias("safe"))


@query("""WITH o AS (SELECT o_orderpriority AS name, CAST(avg(o_totalprice) AS DECIMAL(18, 2)) AS v FROM orders GROUP BY 1),
j AS (SELECT name, CAST(v AS VARCHAR) AS value_a, CAST(CAST(v + CASE left(name, 1) WHEN '1' THEN 0.005 WHEN '2' THEN 0.006 WHEN '3' THEN -0.005 WHEN '4' THEN 1 ELSE 0 END AS DECIMAL(18, 3)) AS VARCHAR) AS value_b FROM o
  UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR), CAST(count(*) + 0.5 AS VARCHAR) FROM orders UNION ALL SELECT 'note', 'text', 'text' UNION ALL SELECT 'gone', CAST(count(*) AS VARCHAR), NULL FROM orders)
SELECT name, value_a, value_b, value_a IS DISTINCT FROM value_b AS changed, round_even(TRY_CAST(value_b AS DOUBLE) - TRY_CAST(value_a AS DOUBLE), 6) AS delta,
  coalesce(abs(TRY_CAST(value_a AS DECIMAL(38, 9)) - TRY_CAST(value_b AS DECIMAL(38, 9))) <= CASE WHEN position('.' IN value_a) > 0 THEN 0.005 ELSE 0.5 END, false) AS agrees FROM j""")
def compared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored aggregates against recomputed ones, name by name; they agree up to half a unit of the last stored decimal."""
    orders = table(spark, sf_dir, "orders")
    first = F.substring("name", 1, 1)
    shift = F.when(first == "1", 0.005).when(first == "2", 0.006).when(first == "3", -0.005).when(first == "4", 1.0).otherwise(0.0).cast("decimal(18,3)")
    o = orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").cast("decimal(18,2)").alias("v"))
    n = orders.agg(F.count(F.lit(1)).alias("n"))
    text = lambda x: x.cast("string").alias("value")
    a = o.select("name", text(F.col("v"))).unionByName(n.select(F.explode(F.array(F.struct(F.lit("count").alias("name"), text(F.col("n"))), F.struct(F.lit("gone").alias("name"), text(F.col("n"))), F.struct(F.lit("note").alias("name"), F.lit("text").alias("value")))).alias("x")).select("x.*"))
    b = o.select("name", text((F.col("v") + shift).cast("decimal(18,3)"))).unionByName(n.select(F.explode(F.array(F.struct(F.lit("count").alias("name"), F.concat(F.col("n").cast("string"), F.lit(".5")).alias("value")), F.struct(F.lit("note").alias("name"), F.lit("text").alias("value")))).alias("x")).select("x.*"))
    return J.compare_values(a, b)
