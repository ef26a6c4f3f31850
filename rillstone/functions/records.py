"""Records in and out: aliases and defaults, chunked samples, training records, parsed labels, packages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from . import text as T

#: fixed values: what a compression keeps and may leave out
PRESERVE = ("named_entities", "numbers", "terminology", "negation", "modality", "causality", "contrast")
COMPRESSIBLE = ("discourse_fillers", "repeated_explanations", "redundant_modifiers", "low_information_examples", "self_repairs")

#: fixed values: the system message of compression requests and the parts of a request, in their order
SYSTEM_COMPRESSION = """You are a professional simultaneous interpreter.
Your task is budget-aware streaming speech translation.
Preserve all core claims, entities, numbers, terminology, negation, modality,
speaker intent, and causal or contrastive relations. Compress or omit only
repetitions, fillers, self-repairs, redundant modifiers, and non-critical
examples. If the faithful translation fits the timing/length budget, keep it
faithful and do not shorten unnecessarily. Do not add information.
Use natural modern spoken language that a TTS system can read aloud smoothly.
For Chinese, avoid classical/literary shorthand such as 其, 之, 乃, 遂, 皆,
足证, or telegraphic noun piles. Prefer clear contemporary wording even if it
costs a few more characters."""
PROMPT_SOURCE_LANG, PROMPT_TARGET_LANG, PROMPT_SOURCE, PROMPT_REFERENCE = "Source language: ", "Target language: ", "Source transcript:", "Reference translation:"
PROMPT_LENGTH = "Hard length budget:"
PROMPT_CHARS = "Use no more than {} target-language CJK characters. Count every Chinese/Japanese/Korean character."
PROMPT_WORDS = "Use no more than {} target-language words."
PROMPT_STYLE = (
    "Style requirements:",
    "Use natural modern spoken target-language phrasing suitable for speech output. Do not use archaic/classical compression or telegram-like fragments.",
    "Budget policy:",
    "If a faithful translation can fit the hard length/timing budget, keep the meaning complete and do not compress just to be shorter. Only compact when the budget would otherwise be exceeded.",
)
PROMPT_LIMITS, PROMPT_END = "Compression constraints as JSON:", "Return only the target-language translation."
#: fixed values: the limits that a request states as JSON
LIMITS = (
    "mode", "target_ratio", "max_target_chars", "max_target_words", "max_target_duration_s", "max_target_wpm", "max_end_lag_s", "streaming_decision_policy", "s2s_rtf", "rtf_threshold",
    "playback_budget_s", "reference_tts_duration_s", "needs_compression", "must_keep_terms", "core_meanings",
)


def first_given(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns there are that is neither null nor empty."""
    there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def canonical_samples(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples under their canonical names, and the rows that lack an id, a language or a source text, with the reason."""
    num = lambda *n: M.number(first_given(df, n))
    whole = lambda n: num(n).cast("int")
    out = df.select(
        first_given(df, ["id", "sample_id"]).alias("id"), first_given(df, ["src_lang", "source_language"]).alias("src_lang"), first_given(df, ["tgt_lang", "target_language"]).alias("tgt_lang"),
        first_given(df, ["source_text"]).alias("source_text"), first_given(df, ["reference_translation"]).alias("reference"), first_given(df, ["compressed_translation"]).alias("compressed"),
        first_given(df, ["candidate_translation", "prediction"]).alias("candidate"), first_given(df, ["audio_path", "audio"]).alias("audio_path"),
        F.coalesce(first_given(df, ["mode"]), F.lit("faithful")).alias("mode"), F.coalesce(num("max_target_wpm"), F.lit(185.0)).alias("max_target_wpm"), F.coalesce(num("max_end_lag_s"), F.lit(1.5)).alias("max_end_lag_s"),
        whole("max_target_chars").alias("max_target_chars"), whole("max_target_words").alias("max_target_words"), F.coalesce(num("src_start_s"), F.lit(0.0)).alias("src_start_s"), num("src_end_s").alias("src_end_s"),
        num("tgt_start_s").alias("tgt_start_s"), num("tgt_end_s").alias("tgt_end_s"),
    )
    span = lambda a, b: F.greatest(F.lit(0.0), F.col(b) - F.col(a))
    out = out.withColumns({"src_duration_s": F.when(F.col("src_end_s").isNotNull(), span("src_start_s", "src_end_s")), "tgt_duration_s": F.when(F.col("tgt_start_s").isNotNull() & F.col("tgt_end_s").isNotNull(), span("tgt_start_s", "tgt_end_s"))})
    why = M.reasons(*[(F.col(c).isNull(), f"missing_{c}") for c in ("id", "src_lang", "tgt_lang", "source_text")])
    out = out.withColumn("reasons", why)
    return out.filter(F.size("reasons") == 0).drop("reasons"), out.filter(F.size("reasons") > 0)


def chunked_samples(df: DataFrame, flat: str) -> DataFrame:
    """P2.  df: sample_id, src_lang, and a flat array of audio paths.  Samples with chunks by position; languages not supported are null."""
    chunks = F.transform(F.filter(flat, lambda a: F.coalesce(a, F.lit("")) != ""), lambda a, i: F.struct(i.alias("chunk_index"), a.alias("source_audio")))
    return df.select(T.safe_id(F.col("sample_id")).alias("sample_id"), T.source_lang(F.col("src_lang")).alias("src_lang"), chunks.alias("chunks"), F.size(chunks).alias("n_chunks"))


def chat_records(df: DataFrame, system: str, prompt: Column, target: Column) -> DataFrame:
    """Messages and their JSON for rows that have a target; the others give none."""
    turn = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    said = F.nullif(F.trim(F.coalesce(target, F.lit(""))), F.lit(""))
    out = df.withColumn("messages", F.array(turn("system", F.lit(system)), turn("user", prompt), turn("assistant", said))).filter(said.isNotNull())
    return out.withColumn("record", F.to_json(F.struct(F.col("id"), F.col("messages"))))


def json_double(x: Column) -> Column:
    """A double as JSON writes it: plain from 0.0001 up to 10 ** 16, else with an exponent of two digits at least; the digits are Spark's."""
    given = x.cast("string")
    sign, body = F.when(given.startswith("-"), "-").otherwise(""), F.ltrim(given, F.lit("-"))
    mantissa, e = F.substring_index(body, "E", 1), F.substring_index(body, "E", -1).cast("int")
    digits = F.rtrim(F.replace(mantissa, F.lit(".")), F.lit("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    whole = F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, F.lit("0"))
    rest = F.substring(digits, e + 2, F.length(digits))
    large = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    power = F.concat(F.rtrim(F.rtrim(mantissa, F.lit("0")), F.lit(".")), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    plain = F.when((e < 0) & (e >= -4), small).when((e >= 0) & (e < 16), large).otherwise(power)
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
    return F.coalesce(special, F.when(F.contains(body, F.lit("E")), F.concat(sign, plain)).otherwise(given))


def _json_value(df: DataFrame, name: str) -> Column:
    """A column as JSON with a space behind commas; null where it is null or isn't there, except lists, which are empty then."""
    text = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    kind = dict(df.dtypes).get(name)
    if name in LIMITS[-2:]:
        items = F.coalesce(F.col(name), F.array().cast("array<string>")) if kind else F.array().cast("array<string>")
        return F.concat(F.lit("["), F.array_join(F.transform(items, text), ", "), F.lit("]"))
    if not kind:
        return F.lit("null")
    return F.coalesce(text(F.col(name)) if kind == "string" else json_double(F.col(name)) if kind in ("double", "float") else F.col(name).cast("string"), F.lit("null"))


def compression_prompt(df: DataFrame, reference: bool = False) -> Column:
    """The request of a compressed translation.  df: src_lang, tgt_lang, source_text, and of LIMITS (and reference_translation) what there is.

    The hard budget is in characters where these are limited, else in words, else left out."""
    given = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    limits = [F.concat(F.lit(f'"{n}": '), _json_value(df, n)) for n in LIMITS]
    budget = [F.when(given(n).isNotNull(), F.concat_ws("\n", F.lit(PROMPT_LENGTH), F.format_string(said.replace("{}", "%s"), given(n).cast("string")))) for n, said in (("max_target_chars", PROMPT_CHARS), ("max_target_words", PROMPT_WORDS))]
    known = F.when(F.coalesce(given("reference_translation"), F.lit("")) != "", F.concat_ws("\n", F.lit(PROMPT_REFERENCE), given("reference_translation"))) if reference else F.lit(None).cast("string")
    return F.concat_ws(
        "\n", F.concat(F.lit(PROMPT_SOURCE_LANG), "src_lang"), F.concat(F.lit(PROMPT_TARGET_LANG), "tgt_lang"), F.lit(PROMPT_SOURCE), F.coalesce("source_text", F.lit("")), known, F.coalesce(*budget),
        *[F.lit(x) for x in PROMPT_STYLE], F.lit(PROMPT_LIMITS), F.concat(F.lit("{"), F.concat_ws(", ", *limits), F.lit("}")), F.lit(PROMPT_END),
    )


def completion_records(df: DataFrame, system: str, prompt: Column, target: Column) -> DataFrame:
    """Prompt and completion as two texts for rows that have a target; the others give none."""
    said = F.nullif(F.trim(F.coalesce(target, F.lit(""))), F.lit(""))
    asked = F.concat_ws("\n\n", F.lit(f"System:\n{system}"), F.concat(F.lit("User:\n"), prompt), F.lit("Assistant:\n"))
    out = df.withColumns({"prompt": asked, "completion": said}).filter(F.col("completion").isNotNull())
    return out.withColumn("record", F.to_json(F.struct("id", "prompt", "completion")))


def tts_requests(df: DataFrame, rate: Column) -> DataFrame:
    """What a voice is asked to say, with the estimated duration."""
    units = T.builder_units(F.col("candidate"), F.col("lang"))
    return df.select("id", F.concat(F.col("id").cast("string"), F.lit(".wav")).alias("output"), F.col("candidate").alias("text"), F.bround(units / rate, 3).alias("estimated_s"))


def chunk_labels(df: DataFrame, raw: str) -> DataFrame:
    """The chunk texts of a labelling answer, and the full text, taken from the chunks where its words differ from theirs."""
    kind = "struct<chunks:array<struct<chunk_index:int,text:string>>,full_text:string>"
    got = df.withColumn("__j", F.from_json(T.json_object(F.col(raw)), kind))
    chunks = F.transform(F.array_sort(F.coalesce("__j.chunks", F.array().cast("array<struct<chunk_index:int,text:string>>"))), lambda c: T.collapse(c["text"]))
    joined = T.collapse(F.array_join(chunks, " "))
    stated = T.collapse(F.col("__j.full_text"))
    same = F.array_join(T.english_words(stated), " ") == F.array_join(T.english_words(joined), " ")
    return got.withColumns({"parsed": F.col("__j").isNotNull(), "chunk_texts": chunks, "full_text": F.when(same & (stated != ""), stated).otherwise(joined)}).drop("__j")


def chunk_label_reasons(df: DataFrame, max_wps: float = 3.0) -> DataFrame:
    """M16.  df: id, chunk_texts, sources, budgets (arrays by chunk).  Reasons with the chunk they are about."""
    short = F.lit(r"\b(?:approx|govt|dept|intl|mgmt|info|etc)\b\.?")
    one = F.transform(
        F.arrays_zip("chunk_texts", "sources", "budgets"),
        lambda z, i: F.transform(
            M.reasons(
                (F.size(T.english_words(z["chunk_texts"])) > F.floor(F.coalesce(z["budgets"], F.lit(0.0)) * max_wps), "estimated_over_budget"),
                (F.size(F.array_except(T.chunk_numbers(z["sources"]), T.chunk_numbers(z["chunk_texts"]))) > 0, "missing_numbers"),
                (F.rlike(F.lower(F.coalesce(z["chunk_texts"], F.lit(""))), short), "forbidden_abbreviation"),
            ),
            lambda r: F.concat(r, F.lit(":"), i.cast("string")),
        ),
    )
    count = M.reasons((F.size("chunk_texts") != F.size("sources"), "chunk_count_mismatch"))
    return df.withColumn("reasons", F.concat(count, F.flatten(one)))


def stable_transcript(messages: DataFrame, session: str) -> DataFrame:
    """P20.  messages: session, message_id, kind, stable, text.  Stable text in order of its ids, without control and finish messages."""
    kept = messages.filter("stable and coalesce(kind, '') not in ('control', 'finish', 'marker')")
    return kept.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_id", "text"))), lambda m: m["text"]), "").alias("transcript"), F.count(F.lit(1)).alias("n_messages"))


def timing_faults(chunks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of which a required timing isn't a number, and which."""
    why = M.reasons(*[(F.col(f).cast("string").try_cast("double").isNull(), f) for f in fields])
    return chunks.withColumn("bad_fields", why).filter(F.size("bad_fields") > 0)


def staged_paths(df: DataFrame, root: str, split: str, rate: int = 16000, suffix: str = ".wav") -> DataFrame:
    """P22.  df: id, audio, samples (of the decoded span; null if it can't be read), fault (the exception's name, then).  Where each row's audio is staged and what is packaged, or why it isn't."""
    why = F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", "missing_id").when(F.coalesce("audio", F.lit("")) == "", "missing_audio")
    why = why.when(F.col("samples").isNull(), F.concat(F.lit("exception:"), F.coalesce("fault", F.lit("Exception"))))
    key = F.col("id").cast("string")
    path = F.concat_ws("/", F.lit(root.rstrip("/")), F.lit("source_wav"), F.lit(split), F.concat(T.safe_id(key), F.lit(suffix)))
    ok = lambda x: F.when(why.isNull(), x)
    return df.withColumns({"reason": why, "staged": ok(path), "packaged_sample_rate": ok(F.lit(rate)), "packaged_num_samples": ok(F.col("samples")), "packaged_duration_s": ok(F.bround(F.col("samples") / rate, 6))})


def clean_rows(df: DataFrame, turns: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a context-only turn, and the others."""
    mixed = F.coalesce(F.exists(turns, lambda t: F.coalesce(t["context_only"], F.lit(False))), F.lit(False))
    return df.filter(~mixed), df.filter(mixed)


def long_targets(df: DataFrame, duration: str, most_s: float) -> tuple[DataFrame, DataFrame]:
    """Targets of known duration within the limit, and the others with the reason."""
    why = F.when(F.col(duration).isNull(), "unknown_duration").when(F.col(duration) > most_s, "too_long")
    named = df.withColumn("reason", why)
    return named.filter(why.isNull()).drop("reason"), named.filter(why.isNotNull())


def corpus_rows(df: DataFrame, excluded: DataFrame, sample_rate: float = 16000.0, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """P9.  df: id, src_text, tgt_text, src_lang, tgt_lang, n_frames; excluded: id.  Usable rows, and those of them not excluded."""
    src, tgt = T.collapse(F.col("src_text")), T.collapse(F.col("tgt_text"))
    rows = df.withColumns({"src_text": src, "tgt_text": tgt, "src_units": T.builder_units(src, F.col("src_lang")), "target_units": T.builder_units(tgt, F.col("tgt_lang")), "duration_s": F.col("n_frames").try_cast("double") / sample_rate})
    usable = rows.filter(f"src_text <> '' and tgt_text <> '' and src_units >= {least} and target_units >= {least} and duration_s > 0")
    return usable, usable.join(excluded.select("id").distinct(), "id", "left_anti")


def codec_rows(df: DataFrame, src_lang: str, tgt_lang: str, least_s: float = 1.0, most_s: float = 30.0, rate: float = 16000.0) -> DataFrame:
    """P10.  df: id, audio (path:offset:frames), texts and languages.  Rows of the pair with both texts, a span, and 1 to 30 seconds."""
    out = df.withColumn("span", T.audio_span(F.col("audio"))).withColumn("duration_s", F.col("span.frames") / rate)
    return out.filter((F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang)).filter(f"trim(src_text) <> '' and trim(tgt_text) <> '' and span.frames is not null and duration_s between {least_s} and {most_s}")
