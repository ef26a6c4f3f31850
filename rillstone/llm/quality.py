"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text becomes a few dozen statistics of its bytes, words and lines.  Standardised, they are turned into ``FEATURES``
random Fourier features, whose inner products approximate a Gaussian kernel.  Every partition sums the normal
equations of its labelled rows, the sums are added up in Spark row block by row block, and one solve gives the ridge
scores.  Pool-adjacent-violators over the labelled rows kept back for it turns scores into probabilities.

Only the text is an input.  Null texts count as empty; empty texts get the score of their statistics like any other.
Documents labelled more than once count once with the mean label; null labels and null ids are left out of the fit.
Without a labelled row, or with a single label, every score is the mean label (0.5 without any).  Repeated rows get
the same score; an empty table gives an empty table.  Columns besides id and text don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .scratch import Scratch

FEATURES = 192
RIDGE = 1e-3
#: labelled rows for the fit and the calibration at most, those of smallest hash; enough for the statistics used
MAX_FIT_ROWS = 200_000
#: of five parts of the labelled rows, the one for calibration
FOLDS = 5
BINS = 1000
#: scores from here on count as good
THRESHOLD = 0.3
STATS = 24


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def held_out(key: Column) -> Column:
    return F.coalesce(fold(key) == 0, F.lit(False))


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts x STATS: shares and logarithms that don't depend on which words a text holds."""
    n = len(offs) - 1
    length = np.diff(offs)
    w = tb.words(data, offs, tb.NOT_SPACE)
    bounds = w.bounds(n)
    count = np.diff(bounds)
    cum = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    per_byte = lambda flags: np.diff(cum(flags)[offs]) / np.maximum(length, 1)
    per_word = lambda flags: np.diff(cum(flags)[bounds]) / np.maximum(count, 1)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, high = (data >= 48) & (data <= 57), data >= 128
    space = ~tb.NOT_SPACE[data]
    line = data == 10
    mark = ~(upper | lower | digit | high | space)
    ordinary = np.isin(data, np.frombuffer(b".,;:'\"-()", np.uint8))
    odd = mark & ~ordinary
    again = np.zeros(len(data), bool)
    again[1:] = (data[1:] == data[:-1]) & mark[1:]
    size = w.end - w.start
    last = data[w.end - 1] if len(w.end) else np.empty(0, np.uint8)
    first = data[w.start] if len(w.start) else np.empty(0, np.uint8)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    second = np.zeros(len(w.hash), bool)
    second[2:] = (w.hash[2:] == w.hash[:-2]) & (w.doc[2:] == w.doc[:-2])
    letters = cum(upper | lower | high)
    bare = letters[w.end] == letters[w.start]
    capital = cum(upper)
    shouted = (capital[w.end] - capital[w.start] >= 2) & (cum(lower)[w.end] == cum(lower)[w.start])
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) if n else np.empty(0)
    mean = np.diff(cum(size)[bounds]) / np.maximum(count, 1)
    square = np.diff(np.concatenate(([0.0], np.cumsum(size.astype(np.float64) ** 2)))[bounds]) / np.maximum(count, 1)
    lines = np.diff(cum(line)[offs]) + 1
    columns = [
        np.log1p(length), np.log1p(count), per_byte(upper), per_byte(lower), per_byte(digit), per_byte(high), per_byte(space),
        per_byte(line), per_byte(mark), per_byte(odd), per_byte(ordinary), per_byte(again), per_word(odd[w.end - 1] if len(last) else last),
        per_word(bare), per_word(shouted), per_word(same), per_word(second), distinct / np.maximum(count, 1), mean / 10, np.sqrt(np.maximum(0, square - mean**2)) / 10,
        per_word(last == 46), per_word((first >= 65) & (first <= 90)), np.log1p(count / lines), (count == 0).astype(float),
    ]
    return np.stack(columns, 1).astype(np.float64)


def document_statistics(docs: DataFrame) -> DataFrame:
    """k, stats array<double> of columns k and t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in tb.groups(batch.column(1)):
                x = statistics(data, offs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATS, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), lists], ["k", "stats"])

    return docs.select("k", "t").mapInArrow(run, "k long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps_at: np.ndarray
    steps: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.concatenate((np.ones((len(x), 1)), waves), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps_at, self.steps), 0, 1)


def isotonic(at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean place, level) of each block of equal level, in order."""
    blocks: list[list[float]] = []
    for p, v, w in zip(at, y, weight, strict=True):
        blocks.append([p * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    made = np.array(blocks)
    return made[:, 0] / made[:, 2], made[:, 1] / made[:, 2]


def _constant(value: float) -> Model:
    return Model(np.zeros(STATS), np.ones(STATS), np.zeros((STATS, 1)), np.zeros(1), np.zeros(2), np.array([0.0]), np.array([value]))


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, max_rows: int = MAX_FIT_ROWS, seed: int = 7) -> Model:
    """stats: k, stats; labels: k, y.  Labelled rows whose fold is 0 are never read into the fit."""
    spark = stats.sparkSession
    disk = Scratch(spark, "quality")
    y = labels.filter("k is not null and y is not null").filter(fold(F.col("k")) != 0).groupBy("k").agg(F.avg("y").alias("y"))
    total = y.count()
    if total > max_rows:
        y = y.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    # at most ``max_rows`` ids; only their statistics are shuffled
    y = disk.save(y, "labels")
    first = stats.join(F.broadcast(y.select("k")), "k", "left_semi").groupBy("k").agg(F.min("stats").alias("stats"))
    rows = disk.save(first.join(y, "k").select("stats", "y", (fold(F.col("k")) == 1).alias("calibrate")), "fit")
    sums = [f(F.expr(f"stats[{i}]")).alias(f"{n}{i}") for i in range(STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.min("y").alias("lo"), F.max("y").alias("hi"), *sums).first()
    if not top["n"] or top["lo"] == top["hi"]:
        return _constant(0.5 if top["y"] is None else float(top["y"]))
    rng = np.random.Generator(np.random.PCG64(seed))
    model = Model(
        np.array([top[f"m{i}"] for i in range(STATS)]), np.array([max(top[f"s{i}"], 1e-3) for i in range(STATS)]),
        rng.normal(0, 1 / np.sqrt(2 * STATS), (STATS, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]),
    )

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Row i of the partition's sum of features' outer products, with the product with the label at its end."""
        size = features + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column(0)))
                total += z.T @ np.concatenate((z, batch.column(1).to_numpy(zero_copy_only=False)[:, None]), 1)
        if total[0, 0]:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, size + 1, dtype=np.int32)), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), lists], ["i", "row"])

    parts = rows.filter("not calibrate").select("stats", "y").mapInArrow(normal, "i int, row array<double>")
    summed = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not summed:
        return _constant(float(top["y"]))
    system = np.zeros((features + 1, features + 2))
    for i, j, v in summed:
        system[i, j] = v
    gram = system[:, :-1] + ridge * system[0, 0] * np.diag([0.0, *[1.0] * features])
    model = model._replace(weights=np.linalg.solve(gram, system[:, -1]))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.clip(np.floor((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * BINS), 0, BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(1)], ["cell", "y"])

    cells = rows.filter("calibrate").select("stats", "y").mapInArrow(raw, "cell int, y double").groupBy("cell").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    if not cells:
        return model._replace(steps_at=np.array([0.0, 1.0]), steps=np.array([0.0, 1.0]))
    at, level = isotonic(np.array([(r.cell + 0.5) * 2 / BINS - 0.5 for r in cells]), np.array([r.y for r in cells]), np.array([float(r.n) for r in cells]))
    return model._replace(steps_at=at, steps=level)


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """k, score (0 to 1, higher: label 1 likelier)."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.score(_matrix(batch.column(1))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["k", "score"])

    return stats.select("k", "stats").mapInArrow(run, "k long, score double")


def append_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "__score") -> DataFrame:
    """docs with the score of each row's text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(column: pa.Array) -> list[pa.Array]:
        parts = [sent.value.score(statistics(data, offs)) for _, _, data, offs in tb.groups(column)]
        return [pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())]

    return tb.append(docs, text, [(name, T.DoubleType())], make)


def fit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> tuple[DataFrame, Model]:
    """The statistics of all documents, and the model learnt from the labelled ones that are not held out."""
    disk = Scratch(docs.sparkSession, "quality-statistics")
    stats = disk.save(document_statistics(docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))), "stats")
    return stats, fit(stats, labels.select(labels[key].cast("long").alias("k"), labels[label].cast("double").alias("y")), max_rows=max_rows)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """key, held_out, score, predicted, for each row of docs; learnt from the labels of its rows that are not held out."""
    stats, model = fit_documents(docs, labels, key, text, label, max_rows)
    scored = score_statistics(stats, model)
    return scored.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
