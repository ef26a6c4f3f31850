"""Scores of one row as Column expressions: ratios, recalls, rates, penalties, edit distances, coverage and gates.

Nulls: a score whose denominator is missing is null; penalties of missing values are 0.  Rounding is half to even.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .arrow import bag_counts, edit_distance

# Weights of the aggregate score; thresholds of the gates; marks of a leaked prompt.
WEIGHTS = {"f1": 0.3, "terms": 0.25, "numbers": 0.2, "budget": 0.05, "speed": 0.1, "lag": 0.1}
GATES = {"max_budget": 1.05, "min_recall": 0.9, "min_last": 0.9, "max_pressure": 1.35}
PROMPT_MARKS = ("Source language:", "Reference translation:", "Compression constraints")
# Phrases that a spoken style avoids.
HIGH_RISK_ZH = (
    "足证", "他熊", "极有趣", "深研", "此拟声", "其拟声", "或为偶然", "岂不", "遇一小童", "小童",
    "称将即刻", "将即刻", "以指覆目", "半阖", "众酋长", "主酋长", "尔等", "尔辈", "吾", "汝",
)
BOOKISH_ZH = ("乃", "遂", "亦", "皆", "若", "尚", "即刻", "未果", "定会", "不明所以", "以为和平", "褫夺")
CLASSICAL_ZH = "视.{1,8}如(?:兄弟|己出|珍宝|草芥)"
MIXED_NAME = "[一-鿿][A-Z]{2,}|[A-Z]{2,}[一-鿿]"
CLASSICAL_NAME = "视X如Y"


def _given(x: Column) -> Column:
    """Null for empty text, which counts as missing."""
    return F.nullif(x, F.lit(""))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def number(x: Column) -> Column:
    """A double, or null for what isn't one."""
    return F.nullif(x.cast("string"), F.lit("")).try_cast("double")


# M1
def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


def compression_ratio(cand: Column, ref: Column) -> Column:
    return F.when(_given(ref).isNotNull(), ratio(T.token_count(cand), T.token_count(ref)))


def target_unit_ratio(cand: Column, ref: Column, lang: Column) -> Column:
    return F.when(_given(ref).isNotNull(), ratio(T.unit_count(cand, lang), T.unit_count(ref, lang)))


def budget_ratio(cand: Column, lang: Column, budget: Column) -> Column:
    return F.when(budget > 0, T.unit_count(cand, lang) / budget)


# M2, M3
def term_share(terms: Column, norm: Column) -> Column:
    """Share of required terms whose normalised form stands in the normalised text; an empty form always does."""
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(norm, T.normalize(t)))) / F.size(terms))


def term_recall(terms: Column, cand: Column) -> Column:
    return once(T.normalize(cand), lambda norm: term_share(terms, norm))


def number_share(need: Column, said: Column) -> Column:
    """Of two arrays of numbers, the first without repeats: the share of the first that the second holds."""
    return F.when(F.size(need) > 0, F.size(F.array_intersect(need, said)) / F.size(need))


def number_recall(required: Column, cand: Column) -> Column:
    return number_share(F.array_distinct(T.numbers(required)), T.numbers(cand))


# M4, M5
def per_minute(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / (seconds / 60.0))


def speech_seconds(cand: Column, lang: Column, rate: Column) -> Column:
    return F.when(rate > 0, T.unit_count(cand, lang) / rate)


def real_time_factor(cand: Column, lang: Column, rate: Column, budget_s: Column) -> Column:
    return F.when(budget_s > 0, speech_seconds(cand, lang, rate) / budget_s)


def over(value: Column, most: Column) -> Column:
    """How far above the limit, as a share of it."""
    return F.coalesce(F.when((most > 0) & value.isNotNull(), F.greatest(F.lit(0.0), (value - most) / most)), F.lit(0.0))


def budget_penalty(x: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.when(x.isNotNull(), x - 1.0)), F.lit(0.0))


# M6 for texts of a row
def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return bag_counts(a, b)["overlap"]


def f1_of(overlap: Column, n_ref: Column, n_cand: Column) -> Column:
    """Harmonic mean of precision and recall; 0 without overlap."""
    return F.when(overlap > 0, 2.0 * overlap / (n_ref + n_cand)).otherwise(F.lit(0.0))


def bag_f1(ref: Column, cand: Column) -> Column:
    a, b = T.tokenize(ref), T.tokenize(cand)
    return F.when(_given(ref).isNotNull(), f1_of(bag_overlap(a, b), F.size(a), F.size(b)))


# M7
def aggregate_score(f1: Column, terms: Column, numbers: Column, budget_pen: Column, speed_pen: Column, lag_pen: Column) -> Column:
    left = lambda p: 1.0 - F.least(F.lit(1.0), p)
    one = lambda x: F.coalesce(x, F.lit(1.0))
    w = WEIGHTS
    return F.bround(w["f1"] * one(f1) + w["terms"] * one(terms) + w["numbers"] * one(numbers) + w["budget"] * left(budget_pen) + w["speed"] * left(speed_pen) + w["lag"] * left(lag_pen), 6)


# M9
def cer(ref: Column, cand: Column) -> Column:
    a, b = T.without_spaces(ref), T.without_spaces(cand)
    return F.when(a != "", F.levenshtein(a, b) / F.length(a)).when(b != "", F.lit(1.0))


def wer(ref: Column, cand: Column) -> Column:
    """Edit distance over tokens."""
    a, b = T.tokenize(ref), T.tokenize(cand)
    return F.when(F.size(a) > 0, edit_distance(a, b) / F.size(a)).when(F.size(b) > 0, F.lit(1.0))


# M11
def token_recall(ref: Column, cand: Column) -> Column:
    """Share of the reference's tokens, each as often as it occurs, that the candidate holds."""
    a, b = T.tokenize(ref), T.tokenize(cand)
    return F.when(F.size(a) > 0, bag_counts(a, b)["held"] / F.size(a)).otherwise(F.lit(0.0))


def coverage_status(recall: Column, f1: Column) -> Column:
    f1 = F.coalesce(f1, F.lit(0.0))
    return F.when((recall >= 0.75) | (f1 >= 0.5), "covered").when((recall >= 0.35) | (f1 >= 0.2), "partial").otherwise("missed")


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.bround(a / b, 6))


# P11
def style_violations(x: Column, lang: Column) -> Column:
    """Reasons why a Chinese text isn't in a spoken style; empty for other languages."""
    said = F.coalesce(x, F.lit(""))
    hits = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(said, w))
    risky, bookish = hits(HIGH_RISK_ZH), hits(BOOKISH_ZH)
    first = F.when(F.size(risky) > 0, F.concat(F.lit("archaic_or_classical_style:"), F.array_join(risky, ",")))
    first = first.when(said.rlike(CLASSICAL_ZH), F.lit("archaic_or_classical_style:" + CLASSICAL_NAME))
    first = first.when(F.size(bookish) >= 2, F.concat(F.lit("bookish_written_style:"), F.array_join(bookish, ",")))
    mixed = F.when(said.rlike(MIXED_NAME), F.lit("mixed_cjk_latin_name"))
    return F.when(T.is_cjk(lang, ("zh",)), F.array_compact(F.array(first, mixed))).otherwise(F.array().cast("array<string>"))


# M13, M14
def duration_signals(units: Column, speech_s: Column, budget_s: Column, reference_s: Column, source_s: Column, rate: Column) -> dict[str, Column]:
    fine = lambda a, b: F.when((speech_s > 0) & (b > 0), F.bround(a / b, 6))
    return {
        "units_per_s": F.when(speech_s > 0, F.bround(units / speech_s, 6)), "units_per_min": F.when(speech_s > 0, F.bround(units / speech_s * 60.0, 6)),
        "duration_budget_ratio": fine(speech_s, budget_s), "duration_reference_ratio": fine(speech_s, reference_s), "speech_s2s_rtf": fine(speech_s, source_s),
        "estimated_default_s": fine(units, rate), "rate_pressure_ratio": F.when((speech_s > 0) & (rate > 0), F.bround(units / rate / speech_s, 6)),
    }


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, n if isinstance(n, Column) else F.lit(n)) for c, n in pairs]))


def gate_reasons(budget: Column, pressure: Column, styles: Column, recall: Column, last: Column, gates: dict[str, float] = GATES) -> Column:
    before = reasons((budget > gates["max_budget"], "speech_over_budget"), (pressure > gates["max_pressure"], "speech_too_fast_for_text"))
    after = reasons((recall < gates["min_recall"], "low_asr_target_coverage"), (last < gates["min_last"], "early_stop_or_suffix_missing"))
    return F.concat(before, F.transform(styles, lambda s: F.concat(F.lit("text_style:"), s)), after)


# M15
def label_reasons(out: Column, ref: Column, lang: Column, budget: Column, mode: Column, most: float = 1.0) -> Column:
    n, m, said = T.builder_units(out, lang), T.builder_units(ref, lang), F.coalesce(out, F.lit(""))
    leaked = F.exists(F.array(*map(F.lit, PROMPT_MARKS)), lambda p: F.contains(said, p))
    first = reasons((said == "", "empty"), (leaked, "prompt_leak"), (n > budget * most, "over_budget"), ((m > 0) & (n >= m) & (F.coalesce(mode, F.lit("")) != "faithful"), "not_compressed"))
    return F.concat(first, style_violations(out, lang))


# M17
def final_reasons(out: Column, lang: Column, budget: Column) -> Column:
    n = T.builder_units(out, lang)
    return F.concat(reasons((F.trim(F.coalesce(out, F.lit(""))) == "", "empty_target")), style_violations(out, lang), reasons((n > budget, "over_budget")))


# M18
def code_reasons(codes: Column, rms: Column, n_quantizers: int, low: int, high: int, min_rms: float, expected: Column, tolerance: int) -> Column:
    """codes: array (quantizers) of arrays (frames)."""
    flat = F.flatten(codes)
    sizes = F.transform(codes, F.size)
    frames = F.coalesce(F.array_max(sizes), F.lit(0))
    return reasons(
        (codes.isNull() | (F.size(flat) == 0), "empty_codes"), (F.size(codes) != n_quantizers, "quantizer_count"), (F.array_min(sizes) != F.array_max(sizes), "ragged_codes"),
        ((F.array_min(flat) < low) | (F.array_max(flat) > high), "code_out_of_range"), (rms < min_rms, "silent_audio"), (F.abs(frames - expected) > tolerance, "length_mismatch"),
    )


# M19
def rtf_gate(values: Column, threshold: float = 1.0) -> Column:
    """values: array of ratios, nulls for chunks without one."""
    valid = F.array_compact(values)
    n, bad = F.size(valid), F.size(F.filter(valid, lambda v: v > threshold))
    return F.struct(
        n.alias("valid_chunks"), bad.alias("violation_count"), F.when(n > 0, F.bround(bad / n, 6)).alias("violation_rate"),
        F.bround(F.array_max(valid), 6).alias("max_rtf"), ((n > 0) & (bad == 0)).alias("pass"),
    )


def chunk_rtf(target_s: Column, source_s: Column) -> Column:
    return F.zip_with(target_s, source_s, lambda t, s: F.when(s > 0, F.bround(t / s, 6)))


def duration_budgets(source_s: Column, threshold: float = 1.0, slack: float = 0.0) -> Column:
    return F.transform(source_s, lambda d: F.bround(F.greatest(F.lit(0.0), F.coalesce(d, F.lit(0.0))) * threshold + slack, 6))


# M21
def runaway_turns(durations: Column, chars: Column, floor_s: float, per_char: float) -> Column:
    return F.size(F.filter(F.zip_with(durations, chars, lambda d, c: d > F.greatest(F.lit(floor_s), c * per_char)), lambda x: x))


# S19
def estimate_seconds(x: Column, wpm: float = 155.0) -> Column:
    return F.greatest(F.lit(1), T.token_count(x)) / wpm * 60.0


def stress_mode(r: Column) -> Column:
    return F.when(r >= 0.85, "faithful").when(r >= 0.65, "concise").otherwise("very_concise")
