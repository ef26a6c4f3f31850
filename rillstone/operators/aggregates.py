"""Summaries: metric tables, decision statistics, weighted means, paired statistics, validations and grids.

Every grouping is by a key of the rows with partial sums; nothing gathers a whole table.  Exact percentiles and ranks are
found by cells of a metric's values.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M

#: fixed values: upper edges of the histogram's bins, the last one open
RTF_EDGES = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)


def unpivot_numbers(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, metric, value as double."""
    return df.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(list(keys), list(names), "metric", "value")


#: groups whose brackets are sent to all tasks at most; more are joined by group
MOST_GROUPS = 20_000
#: approximate quantiles are off by less than one place in so many; brackets are ten times as wide to either side
ACCURACY = 10_000


def values_at(long: DataFrame, keys: Sequence[str], places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """long: keys, metric, value.  keys, metric, n, mean, min, max and the value at each of ``places`` (of n, from 0) in rising order.

    Two passes over the rows.  The first takes approximate quantiles of each group, which bracket every wanted place: their error is
    bounded.  The second counts the rows between the brackets and, value by value, those inside, a few in a thousand; tasks add up their own
    counts before the shuffle.  The running counts of a group then tell its values exactly.  A group with all rows of a table is never in one task."""
    wide = 10 / ACCURACY
    long = long.withColumn("__g", F.struct(*keys, "metric"))
    stats = long.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), *_brackets(places, wide))
    groups = stats.select("__g", F.struct("n", "mean", "min", "max", *[at(F.col("n")).cast("long").alias(f"at_{p}") for p, at in places.items()]).alias("__s"), *[_bracket(p, at, wide) for p, at in places.items()])
    few = groups.limit(MOST_GROUPS + 1).toArrow()
    if few.num_rows <= MOST_GROUPS:
        groups = F.broadcast(long.sparkSession.createDataFrame(few, groups.schema))
    both = long.select("__g", "value").join(groups, "__g")
    inside = lambda p: F.col("value").between(F.col(f"__b_{p}.lo"), F.col(f"__b_{p}.hi"))
    kept = F.when(reduce(operator.or_, [inside(p) for p in places]), F.col("value"))
    # rows outside all brackets count behind the last bracket that ends before them
    past = [F.when(F.col(f"__b_{p}.hi") < F.col("value"), F.col(f"__b_{p}.hi")) for p in places]
    cut = both.withColumns({"__v": kept, "__after": F.when(kept.isNull(), F.greatest(*past) if len(past) > 1 else past[0])})
    held = cut.groupBy("__g", "__v", "__after").agg(F.count(F.lit(1)).alias("__c"), F.any_value("__s").alias("__s"))
    order = Window.partitionBy("__g").orderBy(F.asc_nulls_first(F.coalesce("__v", "__after")), F.col("__v").isNull())
    ranked = held.withColumn("__upto", F.sum("__c").over(order))
    ranked = ranked.withColumn("__lo", F.col("__upto") - F.col("__c"))
    at = lambda p: (F.col("__lo") <= F.col(f"__s.at_{p}")) & (F.col(f"__s.at_{p}") < F.col("__upto"))
    found = ranked.groupBy("__g").agg(F.any_value("__s").alias("__s"), *[F.max(F.when(at(p), F.coalesce("__v", F.raise_error(F.lit(f"{p} lies outside its bracket")).cast("double")))).alias(p) for p in places])
    return found.select("__g.*", "__s.n", "__s.mean", "__s.min", "__s.max", *places)


def _brackets(places: dict[str, Callable[[Column], Column]], wide: float) -> list[Column]:
    """Approximate quantiles in steps of the brackets' width."""
    return [F.percentile_approx("value", [i * wide for i in range(round(1 / wide) + 1)], ACCURACY).alias("__q")]


def _bracket(name: str, at: Callable[[Column], Column], wide: float) -> Column:
    """The quantiles a step below and a step above the place, the least and the greatest value at the ends."""
    step = at(F.col("n")) / F.col("n") / wide
    lo, hi = F.floor(step).cast("int") - 1, F.ceil((at(F.col("n")) + 1) / F.col("n") / wide).cast("int") + 1
    return F.struct(F.when(lo < 1, F.col("min")).otherwise(F.get("__q", lo)).alias("lo"), F.when(hi >= round(1 / wide), F.col("max")).otherwise(F.get("__q", hi)).alias("hi")).alias(f"__b_{name}")


def interpolated(long: DataFrame, keys: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """long: keys, metric, value.  keys, metric, n, mean, min, max and the interpolated percentile of each share under its name."""
    places = {}
    for name, q in shares.items():
        places[f"__lo_{name}"] = lambda n, q=q: F.floor((n - 1) * q)
        places[f"__hi_{name}"] = lambda n, q=q: F.ceil((n - 1) * q)

    def between(name: str, q: float) -> Column:
        at, lo, hi = (F.col("n") - 1) * q, F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return F.when(F.floor(at) == F.ceil(at), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name)

    return values_at(long, keys, places).select(*keys, "metric", "n", "mean", "min", "max", *[between(*x) for x in shares.items()])


def metric_summary(df: DataFrame, names: Sequence[str], keys: Sequence[str] = (), p95: bool = True) -> DataFrame:
    """A1, A2: count, mean, interpolated percentiles, least and greatest of each metric that has a value; rounded to 6."""
    long = unpivot_numbers(df, keys, names).filter("value is not null")
    out = interpolated(long, keys, {"p50": 0.5, "p90": 0.9} | ({"p95": 0.95} if p95 else {}))
    return out.select(*keys, "metric", "n", *[F.bround(c, 6).alias(c) for c in ["mean", "p50", "p90", *(["p95"] if p95 else []), "min", "max"]])


def flag_rates(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A1: share of rows whose flag holds; a null flag counts as false."""
    long = df.select(*keys, *[F.coalesce(F.col(n).cast("int"), F.lit(0)).alias(n) for n in names]).unpivot(list(keys), list(names), "metric", "flag")
    return long.groupBy(*keys, "metric").agg(F.bround(F.avg("flag"), 6).alias("rate"))


def nearest_rank(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A3: p50 is the value at place n // 2, p90 the one at min(n - 1, int(.9 n)), from 0, without interpolation."""
    long = unpivot_numbers(df, keys, names).filter("value is not null")
    out = values_at(long, keys, {"p50": lambda n: F.floor(n / 2), "p90": lambda n: F.least(n - 1, F.floor(n * 0.9))})
    return out.select(*keys, "metric", "n", F.bround("mean", 6).alias("mean"), "p50", "p90", "min", "max")


LABEL_NUMBERS = ("output_units", "output_over_budget_ratio", "output_reference_ratio")


def label_summary(df: DataFrame, file: str) -> DataFrame:
    """A4.  df: file, accepted, output_units, output_over_budget_ratio, output_reference_ratio.  By file and overall (null file): records, accepted, rejected,
    acceptance rate, and of each of the three numbers count, mean, p50, p90 and max of the values there are; all rounded to 4."""
    both = df.select(F.explode(F.array(F.col(file).cast("string"), F.lit(None).cast("string"))).alias(file), "accepted", *LABEL_NUMBERS)
    fine = F.coalesce("accepted", F.lit(False))
    counts = both.groupBy(file).agg(F.count(F.lit(1)).alias("records"), F.count_if(fine).alias("accepted"), F.count_if(~fine).alias("rejected"), F.bround(F.avg(fine.cast("int")), 4).alias("acceptance_rate"))
    long = interpolated(unpivot_numbers(both, [file], LABEL_NUMBERS).filter("value is not null"), [file], {"p50": 0.5, "p90": 0.9})
    of = lambda n, s: F.max(F.when(F.col("metric") == n, F.bround(s, 4) if s != "n" else F.col("n"))).alias(f"{n}_{'count' if s == 'n' else s}")
    wide = long.groupBy(file).agg(*[of(n, s) for n in LABEL_NUMBERS for s in ("n", "mean", "p50", "p90", "max")])
    wide = wide.withColumnRenamed(file, "__file")
    out = counts.join(wide, counts[file].eqNullSafe(wide["__file"]), "left").drop("__file")
    return out.fillna(0, [f"{n}_count" for n in LABEL_NUMBERS])


def reason_histogram(df: DataFrame, reasons: str, keys: Sequence[str] = ()) -> DataFrame:
    """How often each reason occurs, without what follows its colon."""
    return df.select(*keys, F.explode(reasons).alias("r")).groupBy(*keys, F.substring_index("r", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def weighted_scores(segments: DataFrame, scores: DataFrame, run: str, seg: str) -> DataFrame:
    """A5.  Weighted mean of each run's segment scores, plain where the weights sum to nothing; null unless all segments have a score.

    segments: run, seg, weight; scores: seg, score.  Also 25 - mean, for error scales."""
    both = segments.join(scores.select(seg, F.col("score").cast("double").alias("score")), seg, "left")
    per = both.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.sum("weight").alias("w"), F.sum(F.col("score") * F.col("weight")).alias("ws"), F.avg("score").alias("plain"))
    mean = F.when(F.col("n") == F.col("scored"), F.when(F.col("w") > 0, F.col("ws") / F.col("w")).otherwise(F.col("plain")))
    return per.select(run, "n", "scored", F.bround(mean, 6).alias("weighted"), F.bround(25 - mean, 6).alias("inverted"))


def rtf_bin(x: Column) -> Column:
    """Bins (lo, hi], the first up to .5, the last above 3."""
    out = F.when(x <= RTF_EDGES[0], f"<= {RTF_EDGES[0]:g}")
    for lo, hi in zip(RTF_EDGES, RTF_EDGES[1:], strict=False):
        out = out.when(x <= hi, f"({lo:g}, {hi:g}]")
    return out.when(x.isNotNull(), f"> {RTF_EDGES[-1]:g}")


def decision_stats(df: DataFrame) -> DataFrame:
    """A6.  df: split, speed, s2s_rtf, needs_compression, max_target_units, target_units.  By split and speed, by each, and overall."""
    rows = df.withColumn("budget_ratio", F.col("max_target_units") / F.greatest(F.lit(1), "target_units"))
    c, bad = F.count(F.lit(1)), F.count_if(F.col("needs_compression"))
    r = lambda x: F.bround(x, 6)
    return rows.cube("split", "speed").agg(
        c.alias("total"), (c - bad).alias("pass_through"), bad.alias("needs_compression"), r(1 - bad / c).alias("pass_through_rate"), r(bad / c).alias("compression_rate"),
        r(F.avg("s2s_rtf")).alias("rtf_mean"), F.min("s2s_rtf").alias("rtf_min"), F.max("s2s_rtf").alias("rtf_max"),
        r(F.avg("budget_ratio")).alias("budget_ratio_mean"), r(F.min("budget_ratio")).alias("budget_ratio_min"), r(F.max("budget_ratio")).alias("budget_ratio_max"),
    )


def decision_histogram(df: DataFrame) -> DataFrame:
    """Counts by speed and bin."""
    return df.groupBy("speed", rtf_bin(F.col("s2s_rtf")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def null_type(source: Column, hypothesis: Column) -> Column:
    """Empty source: over-translation; empty hypothesis: under-translation; else null."""
    empty = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    return F.when(empty(source), "over_translation").when(empty(hypothesis), "under_translation")


def run_quality(df: DataFrame, run: str) -> DataFrame:
    """A7, A8, A9.  df: run, null_type, source_ids array, score, n_source.  Null groups score 0 in the mean over all."""
    ids = df.select(run, F.explode(F.when(F.col("null_type") == "under_translation", F.col("source_ids"))).alias("i")).distinct().groupBy(run).agg(F.count(F.lit(1)).alias("lost"))
    full = F.when(F.col("null_type").isNotNull(), F.lit(0.0)).otherwise(F.col("score"))
    nulls = F.count_if(F.col("null_type").isNotNull())
    own = df.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("null_type") == "over_translation").alias("over"), F.count_if(F.col("null_type") == "under_translation").alias("under"),
        F.bround(F.avg(full), 6).alias("mean_all"), F.bround(F.avg(F.when(F.col("null_type").isNull(), F.col("score"))), 6).alias("mean_non_null"),
        F.bround((1 - nulls / F.count(F.lit(1))) * F.coalesce(F.avg(F.when(F.col("null_type").isNull(), F.col("score"))), F.lit(0.0)), 6).alias("decomposed"), F.max("n_source").alias("n_source"),
    )
    return own.join(ids, run, "left").withColumn("under_ratio", F.bround(F.coalesce("lost", F.lit(0)) / F.col("n_source"), 6)).drop("lost", "n_source")


def paired_stats(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = (), margin: float = 0.05) -> DataFrame:
    """A10: mean difference b - a, its standard error and t, and wins, losses and ties at the margin."""
    d = F.col(b) - F.col(a)
    n, se = F.count(d), F.stddev_samp(d) / F.sqrt(F.count(d).cast("double"))
    return pairs.groupBy(*keys).agg(
        n.alias("n"), F.bround(F.avg(d), 6).alias("mean_diff"), F.bround(se, 6).alias("stderr"), F.bround(F.when(se > 0, F.avg(d) / se), 6).alias("t"),
        F.count_if(d > margin).alias("win"), F.count_if(d < -margin).alias("lose"), F.count_if(F.abs(d) <= margin).alias("tie"),
    )


def cell_summary(groups: DataFrame, run: str) -> DataFrame:
    """A11.  groups: run, source_ids, hypothesis_ids, ending_offset, first_offset, span.  Alignment shapes and offset percentiles."""
    s, h = F.size("source_ids"), F.size("hypothesis_ids")
    names = ["ending_offset", "first_offset", "span"]
    ranks = interpolated(unpivot_numbers(groups, [run], names).filter("value is not null"), [run], {"p50": 0.5, "p90": 0.9})
    p = lambda metric, c, name: F.bround(F.max(F.when(F.col("metric") == metric, F.col(c))), 6).alias(name)
    ranks = ranks.groupBy(F.col(run).alias("__run")).agg(p("ending_offset", "p50", "ending_p50"), p("ending_offset", "p90", "ending_p90"), p("first_offset", "p50", "first_p50"), p("span", "p50", "span_p50"))
    shapes = groups.groupBy(run).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if((s == 1) & (h == 1)).alias("one_to_one"), F.count_if((s > 1) & (h == 1)).alias("many_to_one"), F.count_if((s == 1) & (h > 1)).alias("one_to_many"),
        F.count_if((s > 1) & (h > 1)).alias("many_to_many"), F.max(F.greatest(s, h)).alias("largest"), F.bround(F.avg("ending_offset"), 6).alias("ending_mean"),
    )
    return shapes.join(ranks, shapes[run].eqNullSafe(ranks["__run"]), "left").drop("__run")


def timing_summary(talks: DataFrame, run: str) -> DataFrame:
    """A12, A13.  talks: run, last_delay, last_elapsed, source_length, last_arrival, playout_end, audio_ms."""
    m = lambda x: F.bround(F.avg(x), 6)
    c = F.col
    return talks.groupBy(run).agg(
        F.count(F.lit(1)).alias("talks"), m(c("last_delay") - c("source_length")).alias("delay_offset"), m(c("last_elapsed") - c("source_length")).alias("elapsed_offset"),
        m(c("playout_end") - c("source_length")).alias("final_offset"), m(c("playout_end") - c("last_arrival")).alias("queue_tail"), m(c("audio_ms") - c("source_length")).alias("trailing_audio"),
    )


def final_timing(chunks: DataFrame, run: str) -> DataFrame:
    """W12.  chunks: run, seq, arrival_s, audio_duration_s, cumulative_audio_duration_s.  run, final_arrival_s (the last arrival), playback_end_s (null without audio).

    Chunks without an arrival are left out; the others play in the order of arrival, ties by seq, each when it has arrived and the one before has ended.  A missing duration is what
    the cumulative duration adds to the audio before.  That is carried on as the greatest cumulative duration, or by the duration where
    there is none: both are a running maximum over running sums."""
    c, upto = F.col, Window.partitionBy(run).orderBy("arrival_s", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(run).orderBy("arrival_s", "seq").rowsBetween(Window.unboundedPreceding, -1)
    cum, own = c("cumulative_audio_duration_s"), c("audio_duration_s")
    rows = chunks.filter("arrival_s is not null").withColumn("__add", F.when((own > 0) & cum.isNull(), own).otherwise(0.0))
    rows = rows.withColumn("__sum", F.sum("__add").over(upto)).withColumn("__level", F.when(own.isNull() | (own > 0), cum) - c("__sum"))
    held = F.coalesce(F.sum("__add").over(before), F.lit(0.0)) + F.greatest(F.lit(0.0), F.coalesce(F.max("__level").over(before), F.lit(0.0)))
    rows = rows.withColumn("__d", F.greatest(F.lit(0.0), F.coalesce(own, cum - held, F.lit(0.0))))
    heard = F.when(c("__d") > 0, c("arrival_s") - (F.sum("__d").over(upto) - c("__d")))
    ends = rows.withColumn("__late", heard).groupBy(run).agg(F.max("arrival_s").alias("final_arrival_s"), (F.sum("__d") + F.greatest(F.lit(0.0), F.max("__late"))).alias("playback_end_s"), F.sum("__d").alias("__total"))
    return ends.select(run, "final_arrival_s", F.when(c("__total") > 0, c("playback_end_s")).alias("playback_end_s"))


def run_metrics(runs: DataFrame, timeline: DataFrame, coverage: DataFrame, timing: DataFrame, run: str, most_deficit: float = 0.5) -> DataFrame:
    """A14.  runs: run, source_stream_duration_s, generated_duration_s (and others, which stay); timeline: run, backlog, queue, deficit, violation; coverage: run, status; timing: as of final_timing.

    A run without a timeline has zeros, one without sentences null rates; lags need a source duration above 0."""
    r6 = lambda x: F.bround(x, 6)
    rate = lambda x: r6(F.avg(F.coalesce(x, F.lit(False)).cast("int")))
    names = ("backlog", "queue", "deficit")
    t = timeline.groupBy(run).agg(*[r6(f(n)).alias(f"{label}_{n}_s") for n in names for label, f in (("max", F.max), ("mean", F.avg))], rate(F.col("violation")).alias("backlog_violation_rate"), rate(F.col("deficit") > most_deficit).alias("deficit_violation_rate"))
    s = coverage.groupBy(run).agg(rate(F.col("status") == "missed").alias("missed_sentence_rate"), rate(F.col("status") == "partial").alias("partial_sentence_rate"), F.count(F.lit(1)).alias("sentence_count"))
    out = runs.join(t, run, "left").fillna(0.0, [c for c in t.columns if c != run]).join(s, run, "left").fillna(0, ["sentence_count"]).join(timing, run, "left")
    source, made = F.coalesce("source_stream_duration_s", F.lit(0.0)), F.col("generated_duration_s")
    timed = lambda x: F.when(source > 0, r6(x))
    return out.withColumns({
        "full_s2s_rtf": timed(made / source), "end_lag_s": r6(made - source), "duration_end_lag_s": r6(made - source), "final_target_arrival_s": r6(F.col("final_arrival_s")), "final_arrival_lag_s": timed(F.col("final_arrival_s") - source),
        "wall_clock_playback_end_s": r6(F.col("playback_end_s")), "wall_clock_end_delay_s": F.when(F.col("playback_end_s").isNotNull(), timed(F.greatest(F.lit(0.0), F.col("playback_end_s") - source))),
    }).drop("final_arrival_s", "playback_end_s")


def result_grid(dims: Sequence[DataFrame], results: DataFrame, keys: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """Every combination of the dimension tables (small by their nature) with its result and what is missing of it."""
    grid = dims[0]
    for d in dims[1:]:
        grid = grid.crossJoin(F.broadcast(d))
    out = grid.join(results.withColumn("__there", F.lit(1)), list(keys), "left")
    lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]), lambda x: x.isNotNull())
    status = F.when(F.col("__there").isNull(), "not_run").when(F.size(lacks) == 0, "complete").when(F.size(lacks) == len(needed), "no_scores").otherwise("partial")
    return out.withColumn("status", status).drop("__there")


def config_sweep(messages: DataFrame, starts: DataFrame) -> DataFrame:
    """A16, W30.  messages: run, kind, arrival_s, duration_s; starts: run, start_s, source_s.  Arrivals of content relative to the start."""
    m = messages.filter("kind <> 'control' and arrival_s is not null").groupBy("run").agg(F.min("arrival_s").alias("lo"), F.max("arrival_s").alias("hi"), F.sum("duration_s").alias("audio_s"))
    r = lambda c: F.bround(c, 6)
    return starts.join(m, "run", "left").select("run", r(F.col("lo") - F.col("start_s")).alias("first_arrival_s"), r(F.col("hi") - F.col("start_s")).alias("last_arrival_s"), r(F.col("audio_s") - F.col("source_s")).alias("duration_lag_s"))


def document_sources(rows: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Each document's text in order, and the documents' order by first appearance."""
    return rows.groupBy(doc).agg(
        F.min(order).alias("first_row"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), " ").alias("joined"),
    )


def id_coverage(ids: DataFrame, doc: str, i: str, expected: DataFrame, first: int) -> DataFrame:
    """Whether a document's ids are exactly first .. first + n - 1.  expected: doc, n."""
    seen = ids.groupBy(doc).agg(F.count(i).alias("c"), F.count_distinct(i).alias("d"), F.min(i).alias("lo"), F.max(i).alias("hi"))
    fine = (F.col("c") == F.col("n")) & (F.col("d") == F.col("n")) & (F.col("lo") == first) & (F.col("hi") == first + F.col("n") - 1)
    return expected.join(seen, doc, "left").select(doc, "n", F.coalesce("c", F.lit(0)).alias("found"), F.coalesce(fine, F.col("n") == 0).alias("covered"))


def split_overlap(df: DataFrame, split: str, base: str, shown: int = 10) -> DataFrame:
    """For each pair of splits, how many base ids they share, the first few, and whether none is."""
    own = df.select(F.col(split).alias("s"), F.col(base).alias("b")).distinct()
    names = own.select("s").distinct()
    pairs = names.select(F.col("s").alias("left")).crossJoin(F.broadcast(names.select(F.col("s").alias("right")))).filter("left < right")
    both = own.select(F.col("s").alias("left"), "b").join(own.select(F.col("s").alias("right"), "b"), "b").filter("left < right")
    first = Window.partitionBy("left", "right").orderBy("b")
    few = both.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= shown).groupBy("left", "right").agg(F.array_join(F.array_sort(F.collect_list(F.col("b").cast("string"))), ",").alias("examples"))
    counts = both.groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(counts, ["left", "right"], "left").join(few, ["left", "right"], "left")
    return out.select("left", "right", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("examples", F.lit("")).alias("examples"), F.col("shared").isNull().alias("disjoint"))


def manifest_issues(df: DataFrame, most_delta_s: float = 0.35) -> DataFrame:
    """A20.  df: id, n_sources, n_boundaries, wavs array<string> (of each target chunk ok, missing, corrupt, or null where there is no path), chunk_s array<double>, full_s (null: no file).
    Issues of each row by name; empty lists aren't compared."""
    total = F.aggregate("chunk_s", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    has = lambda what: F.exists("wavs", lambda w: F.coalesce(w == what, F.lit(False)))
    why = M.reasons(
        (F.coalesce("n_boundaries", F.lit(0)).between(1, 2**31 - 1) & (F.col("n_boundaries") != F.col("n_sources")), "boundary_count_mismatch"), (has("corrupt"), "corrupt_target_wav"), (has("missing"), "missing_target_wav"),
        (some("wavs") & (F.size("wavs") != F.col("n_sources")), "target_chunk_count_mismatch"), (F.col("full_s").isNotNull() & some("chunk_s") & (F.abs(F.col("full_s") - total) > most_delta_s), "target_chunk_duration_sum_delta"),
    )
    count = lambda what: F.size(F.filter("wavs", lambda w: w == what))
    return df.select("id", F.bround(total, 6).alias("sum_s"), F.greatest(F.lit(0), count("missing")).alias("missing"), F.greatest(F.lit(0), count("corrupt")).alias("corrupt"), why.alias("issues"))


def manifest_summary(issues: DataFrame) -> DataFrame:
    """Rows, rows with issues, missing and corrupt files, of the rows of manifest_issues."""
    return issues.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("issues") > 0).alias("issues"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_wavs"), F.coalesce(F.sum("corrupt"), F.lit(0)).alias("corrupt_wavs"))


def rtf_summary(df: DataFrame, ratios: str) -> DataFrame:
    """Mean, interpolated p50 and p90, and share above 1 of all chunks' real-time factors, rounded to 6.  ratios: an array column; nulls don't count."""
    values = df.select(F.explode(ratios).alias("rtf")).filter("rtf is not null")
    over = values.groupBy(F.lit("rtf").alias("metric")).agg(F.bround(F.avg((F.col("rtf") > 1.0).cast("int")), 6).alias("violation_rate"))
    return metric_summary(values, ["rtf"], p95=False).join(over, "metric").select("n", "mean", "p50", "p90", "violation_rate")


def probe_summary(df: DataFrame, run: str) -> DataFrame:
    """A21.  df: run, stream, latency_s (null: failed), budget_s.  Counts, and the nearest-rank statistics of the latencies."""
    fits = F.col("latency_s") <= F.col("budget_s")
    counts = df.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), F.count("latency_s").alias("ok"), F.count_if(F.col("latency_s").isNull()).alias("failed"), F.count_if(fits).alias("fit"),
        F.count_if(F.col("latency_s") > F.col("budget_s")).alias("missed"), F.count_distinct("stream").alias("streams"),
    )
    stats = nearest_rank(df, ["latency_s"], [run]).drop("metric", "n")
    return counts.join(stats, run, "left")


def system_summary(base: DataFrame, tuned: DataFrame, names: Sequence[str]) -> DataFrame:
    """The summary of each of two systems' rows."""
    both = base.withColumn("system", F.lit("base")).unionByName(tuned.withColumn("system", F.lit("tuned")), allowMissingColumns=True)
    return metric_summary(both, names, ["system"])


def talk_assembly(sessions: DataFrame, made: DataFrame, talk: str) -> DataFrame:
    """A23.  sessions: talk, row_id, source_s; made: row_id, target_s.  Missing sessions are counted, not skipped."""
    both = sessions.join(made, "row_id", "left")
    return both.groupBy(talk).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("target_s").isNull()).alias("missing"), F.bround(F.coalesce(F.sum("target_s"), F.lit(0.0)), 6).alias("target_s"),
        F.bround(F.sum("target_s") / F.sum("source_s"), 6).alias("duration_ratio"),
    )
