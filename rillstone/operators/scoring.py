"""Rows scored against references: predictions joined to gold, heuristic scores, labels, gates, and corpus n-gram metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..functions.arrow import TOKEN_END, edit_distance, ngram_overlap


def heuristic_scores(df: DataFrame) -> DataFrame:
    """M7 over columns id, lang, source_text, reference, candidate, terms, budget, duration_s, max_wpm, rate, budget_s, rtf_threshold, end_lag, max_lag."""
    c = F.col
    ref = F.coalesce(c("reference"), F.lit(""))
    # each text is cut once; everything else is counted from these columns
    cut = df.withColumns({
        "__ct": T.tokenize(c("candidate")), "__rt": T.tokenize(ref), "__cc": T.cjk_count(c("candidate")), "__rc": T.cjk_count(ref),
        "__cn": T.numbers(c("candidate")), "__rn": F.array_distinct(T.numbers(F.coalesce(F.nullif(ref, F.lit("")), c("source_text")))),
    })
    units = lambda cjk, tokens: F.when(T.is_cjk(c("lang")) & (c(cjk) > 0), c(cjk)).otherwise(F.size(tokens))
    counted = cut.withColumns({
        "candidate_tokens": F.size("__ct"), "reference_tokens": F.size("__rt"), "candidate_units": units("__cc", "__ct"), "reference_units": units("__rc", "__rt"), "__overlap": M.bag_overlap(c("__rt"), c("__ct")),
        "must_keep_term_recall": M.term_share(c("terms"), F.array_join("__ct", " ")), "number_recall": M.number_share(c("__rn"), c("__cn")),
    }).drop("__ct", "__rt", "__cc", "__rc", "__cn", "__rn")
    some = ref != ""
    given = counted.withColumns({
        "compression_ratio": F.when(some, M.ratio(c("candidate_tokens"), c("reference_tokens"))), "target_unit_reference_ratio": F.when(some, M.ratio(c("candidate_units"), c("reference_units"))),
        "target_budget_ratio": F.when(c("budget") > 0, c("candidate_units") / c("budget")), "bag_f1_vs_reference": F.when(some, M.f1_of(c("__overlap"), c("reference_tokens"), c("candidate_tokens"))),
        "estimated_target_wpm": M.per_minute(c("candidate_tokens"), c("duration_s")), "estimated_target_units_per_minute": M.per_minute(c("candidate_units"), c("duration_s")),
        "estimated_target_speech_s": F.when(c("rate") > 0, c("candidate_units") / c("rate")),
    }).drop("__overlap")
    given = given.withColumn("s2s_rtf", F.when(c("budget_s") > 0, c("estimated_target_speech_s") / c("budget_s")))
    given = given.withColumns({
        "budget_penalty": M.budget_penalty(c("target_budget_ratio")), "listenability_penalty": M.over(c("estimated_target_wpm"), c("max_wpm")), "lag_penalty": M.over(c("end_lag"), c("max_lag")),
        "target_budget_violation": F.coalesce(c("target_budget_ratio") > 1.0, F.lit(False)), "s2s_rtf_violation": F.coalesce(c("s2s_rtf") > c("rtf_threshold"), F.lit(False)),
    })
    score = M.aggregate_score(c("bag_f1_vs_reference"), c("must_keep_term_recall"), c("number_recall"), c("budget_penalty"), c("listenability_penalty"), c("lag_penalty"))
    return given.withColumn("heuristic_aggregate", score).drop("source_text", "reference", "candidate", "terms", "duration_s", "max_wpm", "rate", "budget_s", "max_lag")


def last_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key; rows without a key are left out."""
    row = F.struct(*order, *[x for x in df.columns if x not in (key, *order)])
    return df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.max(row).alias("__row")).select(key, "__row.*")


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    row = F.struct(*order, *[x for x in df.columns if x not in (key, *order)])
    return df.groupBy(key).agg(F.min(row).alias("__row"), F.count(F.lit(1)).alias("n_rows")).select(key, "__row.*", "n_rows")


def prediction_text(df: DataFrame, fields: Sequence[str]) -> Column:
    """The first field that isn't empty."""
    return F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields if f in df.columns])


def join_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """J1.  gold: id; predictions: id, seq, candidate.  The last prediction of an id counts; a speed variant falls back to its base id."""
    known = last_per_key(predictions.filter("candidate is not null"), "id", ["seq"]).select("id", "candidate")
    own = gold.join(known, "id", "left").withColumn("__base", F.when(F.col("id").contains("__speed_"), T.base_id(F.col("id"), chunks=False)))
    base = known.select(F.col("id").alias("__base"), F.col("candidate").alias("__other"))
    return own.join(base, "__base", "left").withColumn("candidate", F.coalesce("candidate", "__other")).drop("__base", "__other")


def evaluate_predictions(gold: DataFrame, predictions: DataFrame, most_rtf: float = 1.0) -> DataFrame:
    """M20.  gold: id, text, source_s, reference_s; predictions: id, text, speech_s.  Ratios, RTF violation, early stop below .65, CER, missing flag."""
    pred = predictions.select("id", F.col("text").alias("said"), "speech_s")
    out = gold.join(pred, "id", "left")
    ratio, rtf = M.share(F.col("speech_s"), F.col("reference_s")), M.share(F.col("speech_s"), F.col("source_s"))
    return out.select(
        "id", F.col("said").isNull().alias("missing"), rtf.alias("rtf"), F.coalesce(rtf > most_rtf, F.lit(False)).alias("rtf_violation"), ratio.alias("duration_ratio"),
        F.coalesce(ratio < 0.65, F.lit(False)).alias("early_stop"), F.bround(M.cer(F.col("text"), F.col("said")), 6).alias("cer"),
    )


def merge_judge(rows: DataFrame, judged: DataFrame, key: str = "id") -> DataFrame:
    """The judge's columns with a prefix, and its overall mark out of five as a share."""
    named = judged.select(key, *[F.col(c).alias(f"judge_{c}") for c in judged.columns if c != key])
    return rows.join(named, key, "left").withColumn("judge_overall_norm", F.bround(F.col("judge_overall") / 5.0, 6))


def bag_scores(df: DataFrame, key: str, ref: str, cand: str) -> DataFrame:
    """M6 for long texts: tokens counted per row on both sides and joined; f1 and recall per row."""
    side = lambda name, out: df.select(key, F.explode(T.tokenize(F.col(name))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias(out))
    both = side(ref, "r").join(side(cand, "h"), [key, "token"], "full").fillna(0, ["r", "h"])
    sums = both.groupBy(key).agg(F.sum(F.least("r", "h")).alias("overlap"), F.sum("r").alias("n_ref"), F.sum("h").alias("n_cand"), F.sum(F.when(F.col("h") > 0, F.col("r")).otherwise(0)).alias("held"))
    out = df.select(key).join(sums, key, "left").fillna(0, ["overlap", "n_ref", "n_cand", "held"])
    return out.select(key, "overlap", "n_ref", "n_cand", M.f1_of(F.col("overlap"), F.col("n_ref"), F.col("n_cand")).alias("f1"), F.when(F.col("n_ref") > 0, F.col("held") / F.col("n_ref")).otherwise(0.0).alias("recall"))


def bleu_tokens(x: Column, kind: str) -> Column:
    """M8's tokenisers.  ``char``: every character but white space; ``zh``: CJK characters apart, the rest by 13a; ``13a``: punctuation apart from words."""
    if kind == "char":
        return T.latency_units(x, F.lit("zh"))
    spaced = T.collapse(x)
    if kind == "zh":
        spaced = F.regexp_replace(spaced, r"([一-鿿　-〿＀-￯])", " $1 ")
    spaced = F.regexp_replace(F.concat(F.lit(" "), spaced, F.lit(" ")), r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    spaced = F.regexp_replace(spaced, r"([^0-9])([\.,])", "$1 $2 ")
    spaced = F.regexp_replace(spaced, r"([\.,])([^0-9])", " $1 $2")
    spaced = F.regexp_replace(spaced, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != "")


def _clipped(df: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Per group and order: matched, hypothesis and reference n-grams.  Clipping is a row's own, so that only four counts of each row leave it."""
    joined = lambda c: F.array_join(c, TOKEN_END)
    rows = df.select(*keys, F.explode(ngram_overlap(joined("h"), joined("r"), F.lit(order))).alias("c")).select(*keys, "c.*")
    return rows.groupBy(*keys, "n").agg(F.sum("matched").alias("matched"), F.sum("hyp").alias("hyp"), F.sum("ref").alias("ref")).filter("hyp > 0 or ref > 0")


def corpus_bleu(df: DataFrame, keys: Sequence[str], row: str, kind: str = "13a", order: int = 4) -> DataFrame:
    """M8.  df: keys, row, reference, candidate.  Counts are summed over the corpus before any ratio.

    Score 0 to 100 with brevity penalty; an order without a match counts half as much as the one before (exponential
    smoothing); without any match, or an empty candidate, the score is 0."""
    keys = list(keys)
    cut = df.select(*keys, row, bleu_tokens(F.col("candidate"), kind).alias("h"), bleu_tokens(F.col("reference"), kind).alias("r"))
    lengths = cut.groupBy(*keys).agg(F.sum(F.size("h")).alias("hyp_len"), F.sum(F.size("r")).alias("ref_len"))
    stats = _clipped(cut, keys, order)
    by = stats.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "matched", "hyp"))).alias("orders"))
    start = F.struct(F.lit(0.0).alias("logs"), F.lit(1.0).alias("smooth"), F.lit(0).alias("n"))

    def step(s: Column, o: Column) -> Column:
        smooth = F.when((o["matched"] == 0) & (o["hyp"] > 0), s["smooth"] * 2).otherwise(s["smooth"])
        p = F.when(o["matched"] > 0, o["matched"] / o["hyp"]).otherwise(1.0 / (smooth * o["hyp"]))
        used = o["hyp"] > 0
        return F.struct(F.when(used, s["logs"] + F.log(p)).otherwise(s["logs"]).alias("logs"), smooth.alias("smooth"), F.when(used, s["n"] + 1).otherwise(s["n"]).alias("n"))

    out = lengths.join(by, keys, "left").withColumn("f", F.aggregate("orders", start, step))
    bp = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).when(F.col("hyp_len") > 0, F.exp(1 - F.col("ref_len") / F.col("hyp_len"))).otherwise(0.0)
    any_match = F.exists("orders", lambda o: o["matched"] > 0)
    bleu = F.when(any_match & (F.col("hyp_len") > 0), 100 * bp * F.exp(F.col("f.logs") / order)).otherwise(0.0)
    return out.select(*keys, "hyp_len", "ref_len", F.coalesce(bleu, F.lit(0.0)).alias("bleu"))


def corpus_chrf(df: DataFrame, keys: Sequence[str], row: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """M8: F-score of character n-grams without white space, precision and recall averaged over the orders that occur on both sides."""
    keys = list(keys)
    cut = df.select(*keys, row, T.latency_units(F.col("candidate"), F.lit("zh")).alias("h"), T.latency_units(F.col("reference"), F.lit("zh")).alias("r"))
    stats = _clipped(cut, keys, order).filter("hyp > 0 and ref > 0")
    by = stats.groupBy(*keys).agg(F.avg(F.col("matched") / F.col("hyp")).alias("p"), F.avg(F.col("matched") / F.col("ref")).alias("r"))
    b = beta * beta
    score = F.when(F.col("p") + F.col("r") > 0, 100 * (1 + b) * F.col("p") * F.col("r") / (b * F.col("p") + F.col("r"))).otherwise(0.0)
    return df.select(*keys).distinct().join(by.withColumn("chrf", score).select(*keys, "chrf"), keys, "left").fillna(0.0, ["chrf"])


def corpus_metrics(df: DataFrame, run: str, row: str, kind: str = "13a") -> DataFrame:
    """BLEU, chrF, WER, CER and unit counts of a run: edits of all its texts over all their units."""
    ref, cand = F.col("reference"), F.col("candidate")
    plain = lambda x: T.without_spaces(x)
    own = df.select(
        run, edit_distance(T.tokenize(ref), T.tokenize(cand)).alias("w"), F.levenshtein(plain(ref), plain(cand)).alias("c"), F.length(plain(ref)).alias("chars"), T.token_count(ref).alias("r"), T.token_count(cand).alias("h"),
    ).groupBy(run).agg(
        F.bround(F.sum("w") / F.greatest(F.lit(1), F.sum("r")), 6).alias("wer"), F.bround(F.sum("c") / F.greatest(F.lit(1), F.sum("chars")), 6).alias("cer"),
        F.sum("h").alias("candidate_units"), F.sum("r").alias("reference_units"),
    )
    return own.join(corpus_bleu(df, [run], row, kind).select(run, "bleu"), run).join(corpus_chrf(df, [run], row), run)


def run_text_metrics(texts: DataFrame, run: str) -> DataFrame:
    """M10.  texts: run, target_lang, candidate, reference, the whole texts of each run.  WER over tokens, CER, units by language, BLEU (Chinese characters apart for zh, all
    characters for ja and ko, words else) and chrF."""
    low = F.lower(F.coalesce("target_lang", F.lit("")))
    given = texts.select(run, F.coalesce("candidate", F.lit("")).alias("candidate"), F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("target_lang", F.lit("")).alias("target_lang"))
    given = given.withColumn("bleu_tokenizer", F.when(low.startswith("zh"), "zh").when(low.startswith("ja") | low.startswith("ko"), "char").otherwise("13a"))
    bleu = None
    for kind in ("13a", "zh", "char"):
        part = corpus_bleu(given.filter(F.col("bleu_tokenizer") == kind).withColumn("__row", F.lit(1)), [run], "__row", kind).select(run, F.bround("bleu", 6).alias("bleu"))
        bleu = part if bleu is None else bleu.unionByName(part)
    ref, cand, lang = F.col("reference"), F.col("candidate"), F.col("target_lang")
    own = given.select(
        run, "bleu_tokenizer", F.bround(M.wer(ref, cand), 6).alias("wer"), F.bround(M.cer(ref, cand), 6).alias("cer"), T.unit_count(cand, lang).alias("candidate_units"), T.unit_count(ref, lang).alias("reference_units"),
    ).fillna(0.0, ["wer", "cer"])
    return own.join(bleu, run).join(corpus_chrf(given.withColumn("__row", F.lit(1)), [run], "__row").withColumn("chrf", F.bround("chrf", 6)), run)


#: fixed value: what a voice says when it is done
END_OF_SPEECH = "TTS-finish"


def sweep_scores(messages: DataFrame, references: DataFrame, kind: str = "zh") -> DataFrame:
    """A16's text metrics.  messages: run, message_id, text, unstable; references: run, reference.

    A run's text is its stable messages with something to say, in order; the scores are those of the one text of each run."""
    said = messages.filter(~F.coalesce("unstable", F.lit(False)) & ~F.trim(F.coalesce("text", F.lit(""))).isin("", END_OF_SPEECH))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("message_id", F.lit(0)).alias("i"), "text"))), lambda m: m["text"]), "")
    both = references.join(said.groupBy("run").agg(joined.alias("candidate")), "run", "left").withColumn("candidate", F.coalesce("candidate", F.lit(""))).withColumn("__row", F.lit(1))
    return corpus_metrics(both, "run", "__row", kind).join(both.select("run", F.length("candidate").alias("candidate_chars")), "run")


def document_bleu(refs: DataFrame, hyps: DataFrame, kind: str = "char") -> DataFrame:
    """M23.  refs: doc, seg, text; hyps: doc, text.  References joined in order; no white space in the candidate."""
    whole = refs.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "text"))), lambda s: s["text"]), "").alias("reference"))
    both = whole.join(hyps.select("doc", T.without_spaces(F.col("text")).alias("candidate")), "doc")
    return corpus_bleu(both.withColumn("all", F.lit(1)), ["all"], "doc", kind).drop("all")


def content_recall(refs: DataFrame, hyps: DataFrame, size: int = 4) -> DataFrame:
    """M24.  Share of each reference sentence's distinct character n-grams that occur anywhere in the document's transcript."""
    chars = lambda x: T.without_spaces(F.lower(x))
    # a group within a lookahead gives the run at every place in one pass over the text
    grams = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
    need = refs.select("doc", "seg", chars(F.col("text")).alias("x")).filter(F.length("x") >= size).select("doc", "seg", F.explode(grams(F.col("x"))).alias("g"))
    have = hyps.select("doc", chars(F.col("text")).alias("x")).filter(F.length("x") >= size).select("doc", F.explode(grams(F.col("x"))).alias("g")).distinct().withColumn("hit", F.lit(1))
    return need.join(have, ["doc", "g"], "left").groupBy("doc", "seg").agg(F.bround(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


def emission_latency(trace: DataFrame) -> DataFrame:
    """M25.  trace: run, delays array<double>, source_length, reference_length.  AL, LAAL, AP and DAL; null for runs without units."""
    u = trace.select("run", "source_length", "reference_length", F.size("delays").alias("n"), F.posexplode("delays").alias("i", "d"))
    by_run = Window.partitionBy("run").orderBy("i")
    before = by_run.rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("open", F.coalesce(F.max(F.col("d") >= F.col("source_length")).over(before), F.lit(False)) == F.lit(False))
    step = lambda n: F.col("source_length") / n
    laal_n = F.greatest("n", "reference_length")
    per = F.col("source_length") / F.col("n")
    u = u.withColumn("dal", F.max(F.col("d") - F.col("i") * per).over(by_run) + F.col("i") * per)
    lag = lambda n: F.avg(F.when(F.col("open"), F.col("d") - F.col("i") * step(n)))
    return u.groupBy("run").agg(
        lag(F.col("reference_length")).alias("al"), lag(laal_n).alias("laal"), (F.sum("d") / (F.first("source_length") * F.count(F.lit(1)))).alias("ap"),
        F.avg(F.col("dal") - F.col("i") * per).alias("dal"),
    )
