"""Ordered sequences: playout queues, backlogs, spans, cuts, histories and merges, each within the key of its run.

Recursions are closed forms over running sums, maxima and minima, so that they stay inside Spark's window operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import arrow
from ..functions import text as T
from .running import nearby, running


def _upto(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


# W11 - W16
def fifo_playout(df: DataFrame, keys: Sequence[str], order: Sequence[str], arrival: str = "arrival_ms", duration: str = "duration_ms", block: str | None = None) -> DataFrame:
    """Each packet starts when it is there and the one before has ended.  End = total so far + the greatest of arrival less total before.

    ``block``: see ``running``; for sessions too long for one task."""
    out = running(df, keys, order, F.col(duration), "sum", "__total", block)
    out = running(out, keys, order, F.col(arrival) - (F.col("__total") - F.col(duration)), "max", "__late", block)
    out = out.withColumn("playout_end_ms", F.col("__total") + F.col("__late"))
    out = out.withColumn("playout_start_ms", F.col("playout_end_ms") - F.col(duration))
    return out.withColumn("queue_delay_ms", F.col("playout_start_ms") - F.col(arrival)).drop("__total", "__late")


def fill_durations(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A missing duration is what the cumulative duration adds to the greatest before."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    grown = F.greatest(F.lit(0.0), F.col("cumulative_ms") - F.coalesce(F.max("cumulative_ms").over(before), F.lit(0.0)))
    return df.withColumn("duration_ms", F.coalesce("duration_ms", grown))


def backlog(df: DataFrame, keys: Sequence[str], order: Sequence[str], cost: Column, budget: Column, block: str | None = None) -> DataFrame:
    """b = max(0, b + cost - budget), as the running sum less its running minimum below 0; a miss is a backlog above 0."""
    out = running(df, keys, order, cost - budget, "sum", "__s", block)
    out = running(out, keys, order, F.col("__s"), "min", "__least", block)
    out = out.withColumn("backlog", F.col("__s") - F.least(F.lit(0.0), F.col("__least")))
    return out.withColumn("miss", F.col("backlog") > 0).drop("__s", "__least")


def cascade_packets(turns: DataFrame, run: str) -> DataFrame:
    """W15.  turns: run, turn, ready_ms, duration_ms.  Packets with audio positions and playout."""
    upto = _upto([run], ["turn"])
    out = turns.withColumn("audio_end_ms", F.sum("duration_ms").over(upto)).withColumn("audio_start_ms", F.col("audio_end_ms") - F.col("duration_ms"))
    return fifo_playout(out, [run], ["turn"], "ready_ms", "duration_ms")


def unit_playout(packets: DataFrame, units: DataFrame, run: str) -> DataFrame:
    """W13.  packets: run, packet_index, audio_start_ms, audio_end_ms, playout_start_ms; units: run, unit, packet_index, position_ms."""
    out = units.join(packets, [run, "packet_index"])
    inside = F.least(F.greatest(F.col("position_ms") - F.col("audio_start_ms"), F.lit(0.0)), F.col("audio_end_ms") - F.col("audio_start_ms"))
    return out.select(run, "unit", "position_ms", (F.col("playout_start_ms") + inside).alias("elapsed_ms"))


def proportional_units(chunks: DataFrame, run: str, n_units: str) -> DataFrame:
    """W14.  chunks: run, chunk, arrival_ms, duration_ms, n_units.  Unit i of n sounds at share (i + .5) / n; it is there when its chunk is, and not before the unit before."""
    upto = _upto([run], ["chunk"])
    held = chunks.withColumn("hi", F.sum("duration_ms").over(upto)).withColumn("lo", F.col("hi") - F.col("duration_ms"))
    held = held.withColumn("total", F.sum("duration_ms").over(Window.partitionBy(run))).withColumn("late", F.max("arrival_ms").over(upto))
    n = F.col(n_units)
    first, last = F.ceil(F.col("lo") / F.col("total") * n - 0.5), F.ceil(F.col("hi") / F.col("total") * n - 0.5) - 1
    rows = held.filter((n > 0) & (F.col("total") > 0)).filter(first <= last)
    return rows.select(run, F.explode(F.sequence(F.greatest(F.lit(0), first.cast("int")), F.least(n - 1, last.cast("int")))).alias("unit"), F.col("late").alias("unit_ms"))


def source_budget(rate_key: Column, estimate: Column, rtf: Column, meta: Column, target: Column, timing: Column) -> Column:
    """The first that isn't null or 0 of an explicit budget, estimate over factor, metadata, target and timing; at least a millionth."""
    truthy = lambda x: F.when(x != 0, x)
    return F.greatest(F.lit(1e-6), F.coalesce(truthy(rate_key), F.when(rtf > 0, truthy(estimate) / rtf), truthy(meta), truthy(target), truthy(timing), F.lit(1e-6)))


# W18, W28, ST2 grid
def fixed_windows(df: DataFrame, duration: str, size: float) -> DataFrame:
    """Windows of at most ``size``, the last as long as is left; without a size (0 or below) the whole is one window."""
    whole = F.col(duration)
    n = F.floor((whole + size - 1e-9) / size) if size > 0 else (whole > 0).cast("int")
    out = df.filter(n >= 1).withColumn("window_index", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    end = F.least(whole, (F.col("window_index") + 1) * size) if size > 0 else whole
    return out.withColumns({"window_start_s": F.col("window_index") * float(max(0, size)), "window_end_s": end})


def grouped_windows(df: DataFrame, ends: str, size: float) -> DataFrame:
    """Windows that end where a chunk ends, as long as they can be without passing ``size``.  ends: sorted array of chunk ends of a run."""
    return df.withColumn("windows", arrow.spans_to_ends(size)(F.col(ends).cast("array<double>")))


def fixed_chunks(df: DataFrame, key: str, duration: str, length: float, cap: int) -> DataFrame:
    """n = min(cap, max(1, floor(duration / length))) chunks with ids ``a__chunk_0003``."""
    n = F.least(F.lit(cap), F.greatest(F.lit(1), F.floor(F.col(duration) / length).cast("int")))
    out = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    end = F.when(F.col("chunk") == n - 1, F.least(F.col(duration), (F.col("chunk") + 1) * length)).otherwise((F.col("chunk") + 1) * length)
    return out.withColumns({"chunk_id": F.concat(F.col(key).cast("string"), F.format_string("__chunk_%04d", "chunk")), "chunk_start_s": F.bround(F.col("chunk") * length, 6), "chunk_end_s": F.bround(end, 6)})


def window_backlog(chunks: DataFrame, runs: DataFrame, run: str, window_s: float, threshold: float = 0.5) -> DataFrame:
    """ST2.  chunks: run, arrival_s, cumulative_s; runs: run, duration_s, speed.  Emitted audio at each source window's start (arrivals before it) and end (up to it).

    A chunk is put to the first window it can count for, and running maxima carry it on."""
    grid = fixed_windows(runs, "duration_s", window_s)
    grid = grid.withColumns({"wall_start_s": F.col("window_start_s") / F.col("speed"), "wall_end_s": F.col("window_end_s") / F.col("speed")})
    near = chunks.join(runs.select(run, "speed", "duration_s"), run).withColumn("__at", F.col("arrival_s") * F.col("speed"))
    # the cell whose end is the first not before the arrival; a neighbour each way takes up rounding
    cell = F.greatest(F.lit(0), F.ceil(F.col("__at") / window_s).cast("int") - 1)
    near = near.withColumn("window_index", F.explode(F.array_distinct(F.array(F.greatest(F.lit(0), cell - 1), cell, cell + 1))))
    met = near.join(grid.select(run, "window_index", "wall_start_s", "wall_end_s"), [run, "window_index"])
    by = met.groupBy(run, "window_index").agg(F.max(F.when(F.col("arrival_s") < F.col("wall_start_s"), F.col("cumulative_s"))).alias("__s"), F.max(F.when(F.col("arrival_s") <= F.col("wall_end_s"), F.col("cumulative_s"))).alias("__e"))
    upto = _upto([run], ["window_index"])
    out = grid.join(by, [run, "window_index"], "left")
    end = F.greatest(F.coalesce(F.max("__e").over(upto), F.lit(0.0)), F.lit(0.0))
    before = F.max("__e").over(Window.partitionBy(run).orderBy("window_index").rowsBetween(Window.unboundedPreceding, -2))
    start = F.greatest(F.lit(0.0), F.coalesce(F.greatest(F.max("__s").over(upto), before), F.lit(0.0)))
    out = out.withColumns({"emitted_start_s": start, "emitted_end_s": end})
    out = out.withColumns({"queue_s": F.greatest(F.lit(0.0), F.col("emitted_end_s") - F.col("wall_end_s")), "backlog_s": F.greatest(F.lit(0.0), F.col("wall_end_s") - F.col("emitted_end_s"))})
    return out.withColumn("violation", F.col("backlog_s") > threshold).select(run, "window_index", "window_start_s", "window_end_s", "wall_start_s", "wall_end_s", "emitted_start_s", "emitted_end_s", "queue_s", "backlog_s", "violation")


# W1, W2, W24, W25
def dialogue_spans(df: DataFrame, conv: str, turn: str) -> DataFrame:
    """Assistant turns with their number, half-open character span in the joined target, and the user text since the assistant turn before."""
    upto = _upto([conv], [turn])
    said = F.col("role") == "assistant"
    rows = df.withColumn("__block", F.sum(said.cast("int")).over(upto) - said.cast("int"))
    rows = rows.withColumn("__hi", F.sum(F.when(said, F.length("text")).otherwise(0)).over(upto))
    in_block = Window.partitionBy(conv, "__block").orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("source_text", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(in_block))
    return rows.filter(said).select(conv, turn, (F.col("__block") + 1).alias("target_index"), (F.col("__hi") - F.length("text")).alias("span_start"), F.col("__hi").alias("span_end"), F.coalesce("source_text", F.lit("")).alias("source_text"))


def word_spans(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """Half-open spans in words of the chunks' texts laid end to end."""
    n = F.size(T.english_words(F.col(text)))
    out = df.withColumn("__n", n).withColumn("word_end", F.sum("__n").over(_upto(keys, order)))
    return out.withColumn("word_start", F.col("word_end") - F.col("__n")).drop("__n")


def history_rows(df: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Each turn with all texts up to it."""
    return df.withColumn("history", F.collect_list(text).over(_upto([conv], [turn])))


def context_window(df: DataFrame, conv: str, turn: str, text: str, size: int) -> DataFrame:
    """Each turn with the last ``size`` texts, itself included."""
    return df.withColumn("context", F.collect_list(text).over(Window.partitionBy(conv).orderBy(turn).rowsBetween(-(size - 1), 0)))


def pair_context(df: DataFrame, conv: str, turn: str, size: int) -> DataFrame:
    """W24, constant length: each turn with the last ``size`` - 1 turns before it, and the conversation's system text, which always stays.

    df: conv, turn, role, user, assistant (a pair of texts), system.  context: array<struct<user, assistant>> of the turns before."""
    own = Window.partitionBy(conv).orderBy(turn)
    past = F.collect_list(F.struct("user", "assistant")).over(own.rowsBetween(-max(1, size - 1), -1))
    return df.withColumn("context", F.when(F.lit(size > 1), past).otherwise(F.slice(past, 1, 0)))


def pinned_context(df: DataFrame, conv: str, turn: str, size: int) -> DataFrame:
    """W24, pinned: each turn with the conversation's first turn and the last ``size`` - 2 turns before it that aren't the first."""
    own = Window.partitionBy(conv).orderBy(turn)
    pair = F.struct("user", "assistant")
    n = F.row_number().over(own)
    first, past = F.first(pair).over(own), F.collect_list(pair).over(own.rowsBetween(-max(1, size - 2), -1))
    rows = df.withColumns({"__n": n, "__first": first, "__past": past})
    # the turns before the n-th are n - 1; the first one is among the last size - 2 as long as n <= size - 1
    recent = F.when(F.lit(size <= 2), F.slice("__past", 1, 0)).when(F.col("__n") <= size - 1, F.slice("__past", 2, size)).otherwise(F.col("__past"))
    return rows.withColumn("context", F.when(F.col("__n") == 1, F.slice("__past", 1, 0)).otherwise(F.concat(F.array("__first"), recent))).drop("__n", "__first", "__past")


def soft_window_start(n: Column, cap: int, keep: int) -> Column:
    """W24, ST7: how many leading turns are gone after n turns when the context shrinks to ``keep`` each time it reaches ``cap``."""
    held = F.when(n < cap, n).otherwise(keep + (n - cap) % (cap - keep))
    return (n - held).cast("int")


# W3 - W8
def chunk_times(spans: DataFrame, intervals: DataFrame, key: str, least_s: float = 0.08, mismatch: float = 0.1) -> DataFrame:
    """W3.  spans: key, chunk, word_start, word_end, n_words; intervals: key, start_s, end_s, silences gone.  The k-th word is the k-th interval.

    Empty and too short spans have null times; a document whose counts differ too much, or whose spans run out of intervals, has a reason."""
    ranked = intervals.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy("start_s", "end_s")) - 1)
    counts = intervals.groupBy(key).agg(F.count(F.lit(1)).alias("n_intervals"))
    first = ranked.select(key, F.col("__k").alias("word_start"), F.col("start_s"))
    last = ranked.select(key, (F.col("__k") + 1).alias("word_end"), F.col("end_s"))
    out = spans.join(counts, key, "left").join(first, [key, "word_start"], "left").join(last, [key, "word_end"], "left").fillna(0, ["n_intervals"])
    usable = F.least("n_intervals", "n_words")
    filled = F.col("word_end") > F.col("word_start")
    why = F.when(F.abs(F.col("n_intervals") - F.col("n_words")) / F.greatest(F.lit(1), "n_words") > mismatch, "interval_word_mismatch")
    why = why.when(filled & (F.col("word_end") > usable), "span_out_of_range").when(filled & (F.col("end_s") <= F.col("start_s")), "non_monotonic")
    long = filled & (F.col("end_s") - F.col("start_s") >= least_s) & why.isNull()
    return out.select(key, "chunk", "word_start", "word_end", F.when(long, F.col("start_s")).alias("start_s"), F.when(long, F.col("end_s")).alias("end_s"), why.alias("reason"))


def edge_silence(df: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    """The first chunk with times begins at 0, the last ends with the audio."""
    timed = F.col("start_s").isNotNull()
    ends = Window.partitionBy(key)
    out = df.withColumns({"__lo": F.min(F.when(timed, F.col(order))).over(ends), "__hi": F.max(F.when(timed, F.col(order))).over(ends)})
    return out.withColumns({
        "start_s": F.when(timed & (F.col(order) == F.col("__lo")), F.lit(0.0)).otherwise(F.col("start_s")), "end_s": F.when(timed & (F.col(order) == F.col("__hi")), F.col(duration)).otherwise(F.col("end_s")),
    }).drop("__lo", "__hi")


def cut_points(df: DataFrame, key: str, order: str, block: str | None = None) -> DataFrame:
    """Between neighbours the middle of the gap, never before an earlier cut.  ``block``: see ``running``."""
    out = nearby(df, [key], [order], F.col("start_s"), "after", "__next", block)
    out = out.withColumn("__mid", F.coalesce((F.col("end_s") + F.col("__next")) / 2, F.col("end_s")))
    return running(out, [key], [order], F.col("__mid"), "max", "cut_s", block).drop("__mid", "__next")


def frame_cuts(df: DataFrame, key: str, order: str, fps: float, total: str) -> DataFrame:
    """Cuts in frames with a frame at least for each turn, as k + running max of (cut - k); a reason where frames run out or the rate is off."""
    upto = _upto([key], [order])
    out = df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    out = out.withColumn("frame_end", F.col("__k") + F.max(F.greatest(F.lit(1), F.bround(F.col("cut_s") * fps, 0).cast("int")) - F.col("__k")).over(upto))
    out = out.withColumn("__over", F.max((F.col("frame_end") > F.col(total)).cast("int")).over(Window.partitionBy(key)))
    why = F.when((F.lit(fps) < 10) | (F.lit(fps) > 15), "fps_out_of_range").when(F.col("__over") == 1, "frame_budget_exhausted")
    out = out.withColumn("reason", why).withColumn("frame_end", F.least("frame_end", total))
    return out.withColumn("frame_start", F.coalesce(F.lag("frame_end").over(Window.partitionBy(key).orderBy(order)), F.lit(0))).drop("__k", "__over")


def sentence_times(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, lang: Column, duration: str) -> DataFrame:
    """The source's duration dealt to sentences by their units, at least one each."""
    out = df.withColumn("__u", F.greatest(F.lit(1), T.unit_count(F.col(text), lang)))
    out = out.withColumn("__hi", F.sum("__u").over(_upto(keys, order))).withColumn("__all", F.sum("__u").over(Window.partitionBy(*keys)))
    at = lambda x: F.bround(x / F.col("__all") * F.col(duration), 3)
    return out.withColumns({"start_s": at(F.col("__hi") - F.col("__u")), "end_s": at(F.col("__hi"))}).drop("__u", "__hi", "__all")


def timed_units(words: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Each alignment unit of a word with an even share of its time."""
    rows = words.withColumn("__n", F.size(T.alignment_units(F.col(text)))).select("*", F.posexplode(T.alignment_units(F.col(text))).alias("unit_in_word", "unit"))
    at = lambda i: F.col("start_s") + (F.col("end_s") - F.col("start_s")) * i / F.col("__n")
    return rows.select(*keys, "unit_in_word", "unit", at(F.col("unit_in_word")).alias("unit_start_s"), at(F.col("unit_in_word") + 1).alias("unit_end_s"))


def interpolate(df: DataFrame, keys: Sequence[str], order: str, value: str, block: str | None = None) -> DataFrame:
    """Missing values on a line between their matched neighbours, beyond them the nearest; never falling.  ``block``: see ``running``."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    out = running(df, keys, [order], known, "last", "__left", block)
    out = nearby(out, keys, [order], known, "ahead", "__right", block)
    line = F.col("__left.v") + (F.col("__right.v") - F.col("__left.v")) * (F.col(order) - F.col("__left.o")) / F.greatest(F.lit(1), F.col("__right.o") - F.col("__left.o"))
    out = out.withColumn("__x", F.coalesce(F.col(value), line, F.col("__left.v"), F.col("__right.v")))
    return running(out, keys, [order], F.col("__x"), "max", f"{value}_filled", block).drop("__left", "__right", "__x")


# W19 - W22, W26, W27, W29
def word_emissions(fragments: DataFrame, key: str, order: str, text: str, time: str) -> DataFrame:
    """The words of the joined fragments, each with the time of the fragment that brought its last character."""
    upto = _upto([key], [order])
    frag = fragments.withColumn("hi", F.sum(F.length(text)).over(upto)).filter(F.length(text) > 0)
    whole = frag.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), "").alias("whole"))
    spaces = F.transform(F.split("whole", r"(?<=\s)(?=\S)"), lambda p: F.struct(F.length(p).alias("all"), F.rtrim(F.regexp_replace(p, r"\s+$", "")).alias("word")))
    words = whole.select(key, F.posexplode(spaces).alias("i", "p")).select(key, "i", F.col("p.all").alias("all"), F.col("p.word").alias("word"))
    words = words.withColumn("end", F.sum("all").over(_upto([key], ["i"])) - F.col("all") + F.length("word")).filter(F.length("word") > 0)
    a = frag.select(key, F.col("hi").alias("at"), F.lit(1).alias("side"), F.col(time).alias("t"), F.lit(None).cast("string").alias("word"), F.lit(-1).alias("i"))
    b = words.select(key, F.col("end").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(fragments.schema[time].dataType).alias("t"), "word", "i")
    ahead = Window.partitionBy(key).orderBy("at", "side").rowsBetween(0, Window.unboundedFollowing)
    out = a.unionByName(b).withColumn("emitted", F.first("t", ignorenulls=True).over(ahead)).filter("side = 0")
    return out.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("i")) - 1).alias("unit"), "word", F.col("emitted").alias(time))


def fit_emissions(times: Column, n: Column) -> tuple[Column, Column]:
    """As many times as units: cut, or the last one again, or zeros; and a warning."""
    have = F.size(times)
    last = F.coalesce(F.try_element_at(times, F.lit(-1)), F.lit(0.0))
    fitted = F.when(have >= n, F.slice(times, F.lit(1), n)).otherwise(F.concat(times, F.array_repeat(last, n - have)))
    return fitted, F.when(have > n, "trimmed").when((have < n) & (have > 0), "padded").when((have == 0) & (n > 0), "zeros")


def merge_unspoken(df: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Segments without a letter or digit join the one before; leading ones the first spoken one."""
    upto = _upto(keys, [order])
    out = df.withColumn("__g", F.greatest(F.lit(1), F.sum(T.has_spoken(F.col(text)).cast("int")).over(upto)))
    return out.groupBy(*keys, F.col("__g").alias("segment")).agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), "").alias("text"),
    )


def greedy_groups(sizes: Column, ends: Column, cap: int = 400, soft: float = 0.7) -> Column:
    """Places of segments in groups of at most ``cap`` characters, closed early after a sentence's end from ``soft`` of it on.

    sizes: array<int>; ends: array<boolean>, whether a segment ends a sentence.  One walk along each array."""
    return arrow.greedy_groups(cap, soft)(sizes, ends)


def consecutive_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: str | None = None) -> DataFrame:
    """A number for each run of equal values.  ``block``: see ``running``."""
    out = nearby(df, keys, order, F.struct(F.col(value).alias("x")), "before", "__before", block)
    change = F.col("__before").isNull() | ~F.col(value).eqNullSafe(F.col("__before.x"))
    return running(out, keys, order, change.cast("int"), "sum", "group", block).drop("__before")


def proxy_times(n: Column, source_ms: Column) -> Column:
    """Evenly spread emission times, which real ones can't be compared with."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.bround(i / n * source_ms, 3))).otherwise(F.array().cast("array<double>"))


def scale_times(df: DataFrame, columns: Sequence[str], speed: str) -> DataFrame:
    """W27."""
    return df.withColumns({c: F.col(c) / F.col(speed) for c in columns})


def contiguous_check(df: DataFrame, keys: Sequence[str], order: str, index: str, rate: str) -> DataFrame:
    """ST5: packets whose index isn't the one after the packet before's, or whose sample rate changes; with the cumulative audio position."""
    by = Window.partitionBy(*keys).orderBy(order)
    gap = F.coalesce(F.col(index) != F.lag(index).over(by) + 1, F.lit(False))
    turned = F.coalesce(F.col(rate) != F.lag(rate).over(by), F.lit(False))
    return df.withColumn("issues", M.reasons((gap, "index_gap"), (turned, "rate_change")))
