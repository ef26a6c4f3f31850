"""Whole jobs: a training set from corpus rows, and scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import records as R
from ..operators import aggregates as A
from ..operators import sampling as S
from ..operators import scoring as C


def decisions(corpus: DataFrame, excluded: DataFrame, speeds: Sequence[float], ratios: Sequence[tuple[str, float]], seed: int, zh_rate: float = 5.0, word_rate: float = 2.75) -> DataFrame:
    """Filter, split, cross with speeds and decide: one row per corpus row and speed."""
    _, kept = R.corpus_rows(corpus, excluded)
    rate = F.when(F.lower("tgt_lang").startswith("zh"), F.lit(zh_rate)).otherwise(F.lit(word_rate))
    kept = kept.withColumn("rate", rate).withColumn("split", S.assign_split(S.unit_interval(F.col("id"), seed), ratios))
    return S.speed_decision(S.expand_speeds(kept, "id", speeds))


def training_set(decided: DataFrame, limits: dict[str, int], seed: int) -> DataFrame:
    """A uniform sample of each split and kind; below 0 all, 0 none."""
    kind = F.when(F.col("needs_compression"), "compression").otherwise("pass_through")
    cap = F.coalesce(*[F.when(F.col("split") == k, F.lit(v)) for k, v in limits.items()], F.lit(0))
    return S.stratified_sample(decided.withColumn("kind", kind), ["split", "kind"], cap, "variant_id", seed)


def summary(decided: DataFrame) -> DataFrame:
    return A.decision_stats(decided)


def score_predictions(gold: DataFrame, predictions: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored rows, their summary, and the gold ids without a prediction."""
    joined = C.join_predictions(gold, predictions)
    rows = C.heuristic_scores(joined.filter(F.col("candidate").isNotNull()))
    return rows, A.metric_summary(rows, names), joined.filter(F.col("candidate").isNull()).select("id")


def accepted_labels(labels: DataFrame) -> DataFrame:
    """labels: id, text, reference, lang, budget, mode.  Rows with their reasons and whether they are accepted."""
    out = labels.withColumn("reasons", M.label_reasons(F.col("text"), F.col("reference"), F.col("lang"), F.col("budget"), F.col("mode")))
    return out.withColumn("accepted", F.size("reasons") == 0)
