"""Joins: labels and statuses by id, intervals by range, times as of, pairs of runs, trace updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from .aggregates import interpolated, unpivot_numbers
from .running import nearby, running
from .sampling import unit_interval
from .scoring import first_per_key, last_per_key


def merge_labels(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """J2.  requests: id, seq; labels: id, seq, label columns.  The first label of an id counts; n_labels tells duplicates, 0 missing ones."""
    first = first_per_key(labels.withColumnRenamed("seq", "label_seq"), "id", ["label_seq"]).withColumnRenamed("n_rows", "n_labels")
    return requests.join(first, "id", "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0)))


def policy_candidates(policy: DataFrame, labels: DataFrame) -> DataFrame:
    """J3.  policy: id, kind, reference; labels: id, seq, accepted, text.  Pass-through rows say their reference, others the last accepted label."""
    last = last_per_key(labels.filter("accepted").select("id", "seq", "text"), "id", ["seq"]).select("id", F.col("text").alias("__label"))
    return policy.join(last, "id", "left").withColumn("candidate", F.when(F.col("kind") == "pass_through", F.col("reference")).otherwise(F.col("__label"))).drop("__label")


def attach_scores(rows: DataFrame, scores: DataFrame, text: str = "candidate_text") -> DataFrame:
    """J4.  rows: row_key, text; scores: row_key, hypothesis_chars, score.  Rows keep their text; a stored length that isn't the text's is told."""
    given = scores.select("row_key", "hypothesis_chars", "score")
    out = rows.join(given, "row_key", "left")
    actual = F.length(T.collapse(F.col(text)))
    stale = F.col("hypothesis_chars").isNotNull() & F.col(text).isNotNull() & (F.col("hypothesis_chars") != actual)
    return out.withColumn("chars_mismatch", F.when(stale, F.struct(F.col("hypothesis_chars").cast("long").alias("expected"), actual.cast("long").alias("actual"))))


def parallel_text(source: DataFrame, english: DataFrame) -> DataFrame:
    """J7.  source: id, pos; english: id, pos, text.  By id, else by position; of a repeated id the first by position counts, of a repeated position the first by id."""
    by_id = english.groupBy("id").agg(F.min(F.struct("pos", "text")).alias("__r")).select("id", F.col("__r.text").alias("__a"))
    by_pos = english.groupBy("pos").agg(F.min(F.struct("id", "text")).alias("__r")).select("pos", F.col("__r.text").alias("__b"))
    out = source.join(by_id, "id", "left").join(by_pos, "pos", "left")
    return out.withColumn("english", F.coalesce("__a", "__b")).drop("__a", "__b")


def _own_level(lo: Column, hi: Column, cell_s: float) -> Column:
    """The least level whose cells (``cell_s`` times two to the level) are as long as the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log2((hi - lo) / cell_s))).cast("int")


def _cells(df: DataFrame, lo: Column, hi: Column, levels: Sequence[int], cell_s: float, side: str) -> DataFrame:
    """Each interval in the two cells (or one) that it touches on its own level and on each coarser one of ``levels``."""
    hi = F.greatest(lo, hi)
    own = F.coalesce(_own_level(lo, hi, cell_s), F.lit(0))
    on = lambda level, x: F.floor(x / (cell_s * F.pow(F.lit(2.0), level)))
    rows = df.withColumn(f"__own_{side}", own).withColumn("__level", F.explode(F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col(f"__own_{side}"))))
    rows = rows.withColumn(f"__first_{side}", on(F.col("__level"), lo))
    return rows.withColumn("__cell", F.explode(F.sequence(F.col(f"__first_{side}"), on(F.col("__level"), hi))))


def window_intervals(windows: DataFrame, intervals: DataFrame, run: str, cell_s: float, midpoint: bool = True) -> DataFrame:
    """J8.  windows: run, window_index, lo, hi; intervals: run, pos, start_s, end_s, text.  Those whose middle lies in [lo, hi), or that overlap it.

    Windows and intervals meet in cells, so that the join is on equal keys.  Cells have levels, each twice as wide as the one below: whatever its length, an
    interval lies in two cells of its own level and of each coarser one that occurs, and a pair meets on the coarser of its two levels."""
    lo, hi = (F.col("lo"), F.col("hi"))
    at = (F.col("start_s") + F.col("end_s")) / 2
    given = intervals.withColumn("__mid", at)
    a, b = (F.col("__mid"), F.col("__mid")) if midpoint else (F.col("start_s"), F.col("end_s"))
    level = lambda df, x, y: df.select(F.coalesce(_own_level(x, F.greatest(x, y), cell_s), F.lit(0)).alias("n")).distinct()
    # levels are logarithms of lengths: some dozens at most
    levels = sorted(r.n for r in level(windows, lo, hi).unionByName(level(given, a, b)).distinct().collect())
    w, i = _cells(windows, lo, hi, levels, cell_s, "w"), _cells(given, a, b, levels, cell_s, "i")
    met = w.join(i, [run, "__level", "__cell"]).filter("(__own_w = __level or __own_i = __level) and __cell = greatest(__first_w, __first_i)")
    met = met.filter("__mid >= lo and __mid < hi" if midpoint else "start_s < hi and end_s > lo")
    return met.groupBy(run, "window_index").agg(
        F.count(F.lit(1)).alias("n_units"), F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


#: tokens of items that are looked up inside the tasks at most; more are joined
MOST_INDEXED = 2_000_000
#: (document, item) meetings that a task counts at a time
MEETINGS = 1 << 22


def containment_join(items: DataFrame, docs: DataFrame, least: float = 0.0, depth: int = 3, most_indexed: int = MOST_INDEXED) -> DataFrame:
    """M11 at scale.  items: item, w array<string> without repeats; docs: doc, w likewise.  item, doc, n (size of the item's w), c (how many of them the
    document holds) of all pairs with c >= least * n and c > 0.

    Documents stay where they are: every task has the items' tokens as an inverted index, whose size is checked, and counts its
    documents' meetings.  Items of more tokens than that are joined by their rarest ones."""
    known = items.filter(F.size("w") > 0).withColumn("n", F.size("w"))
    known = known.withColumn("k", F.greatest(F.lit(1), F.ceil(F.bround(F.lit(least) * F.col("n"), 9)).cast("int")))
    if known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] > most_indexed:
        return _joined_by_rare_tokens(known, docs, depth)
    index = known.select("item", "w", "n", "k").toArrow().combine_chunks()
    lists = index["w"].combine_chunks() if index.num_rows else pa.array([], pa.list_(pa.string()))
    tokens = pc.unique(lists.flatten())
    at = pc.index_in(lists.flatten(), tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    order = np.argsort(at, kind="stable")
    owner, start = owner[order], np.searchsorted(at[order], np.arange(len(tokens) + 1))
    names, n, k = (index[c].combine_chunks() if index.num_rows else pa.array([], index.schema.field(c).type) for c in ("item", "n", "k"))
    least_of = k.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column("w")
            row = np.repeat(np.arange(len(w)), pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False))
            ids = pc.index_in(w.flatten(), tokens)
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            ids, row = ids.drop_null().to_numpy(zero_copy_only=False), row[there]
            meet = start[ids + 1] - start[ids]
            upto = np.cumsum(meet)
            lo = 0
            while lo < len(row):
                # whole documents at a time
                hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MEETINGS, side="right"))
                hi = max(hi, lo + 1)
                hi = int(np.searchsorted(row, row[hi - 1], side="right")) if hi >= len(row) or row[hi - 1] == row[lo] else int(np.searchsorted(row, row[hi - 1]))
                many = meet[lo:hi]
                place = np.repeat(start[ids[lo:hi]] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                pair, c = np.unique(np.repeat(row[lo:hi], many) * len(names) + owner[place], return_counts=True)
                item = pair % len(names) if len(names) else pair
                kept = c >= least_of[item]
                item, c, doc = item[kept], c[kept], pair[kept] // len(names) if len(names) else pair
                yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), b.column("doc").take(pa.array(doc)), n.take(pa.array(item)).cast(pa.int32()), pa.array(c, pa.int32())], ["item", "doc", "n", "c"])
                lo = hi

    kinds = (items.schema["item"].dataType.simpleString(), docs.schema["doc"].dataType.simpleString())
    return docs.select("doc", "w").mapInArrow(run, f"item {kinds[0]}, doc {kinds[1]}, n int, c int")


def _joined_by_rare_tokens(known: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
    """A document that holds k of an item's n tokens holds ``depth`` of any n - k + ``depth`` of them (k of all, if k is smaller), so that only the
    rarest so many are looked up; pairs that pass are counted whole.  How rare a token is among the items decides on speed only."""
    tokens = known.select("item", "n", "k", F.explode("w").alias("t"))
    seen = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ranked = tokens.join(seen, "t").withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("f", "t")))
    prefix = ranked.withColumn("need", F.least(F.lit(depth), F.col("k"))).filter("r <= n - k + need").select("item", "need", "t")
    met = docs.select("doc", F.explode("w").alias("t")).join(prefix, "t").groupBy("doc", "item", "need").agg(F.count(F.lit(1)).alias("m")).filter("m >= need")
    pairs = met.select("doc", "item").join(known.select("item", "n", "k", F.col("w").alias("__w")), "item").join(docs.select("doc", "w"), "doc")
    return pairs.withColumn("c", F.size(F.array_intersect("__w", "w"))).filter("c >= k").select("item", "doc", "n", "c")


def sentence_windows(sentences: DataFrame, window_s: float) -> DataFrame:
    """J9.  sentences: start_s, end_s, duration_s.  One row per window a sentence touches; sentences from the end of the evaluation on are left out.

    A missing start is 0, a missing end the start; without a duration (null or 0) nothing is left out."""
    limit = F.coalesce("duration_s", F.lit(0.0))
    out = sentences.withColumn("start_s", F.coalesce("start_s", F.lit(0.0))).withColumn("end_s", F.coalesce("end_s", "start_s"))
    out = out.filter((limit <= 0) | (F.col("start_s") < limit))
    end = F.greatest("start_s", F.when(limit > 0, F.least("end_s", limit)).otherwise(F.col("end_s")))
    first, last = F.floor(F.col("start_s") / window_s), F.floor(F.greatest(F.col("start_s"), end - 1e-6) / window_s)
    return out.withColumn("window_index", F.explode(F.sequence(first.cast("int"), last.cast("int"))))


def as_of(events: DataFrame, lookups: DataFrame, key: str, time: str, value: str, tie: str, default: float = 0.0, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """J10, ST6.  lookups with the value of the last event of their key up to their time, equal times included; ``default`` before the first.

    Both sides are one sorted stream per key, with events before lookups at equal times; ``block`` makes a block of a time (see ``running``)."""
    side = lambda df, rank, v: df.select(key, F.col(time).alias("__t"), F.lit(rank).alias("__side"), F.col(tie).alias("__tie"), v.alias("__x"), F.lit(rank == 1).alias("__ask"))
    both = side(events, 0, F.col(value).cast("double")).unionByName(side(lookups, 1, F.lit(None).cast("double")))
    if block is not None:
        both = both.withColumn("__block", block(F.col("__t")))
    out = running(both, [key], ["__t", "__side", "__tie"], F.col("__x"), "last", "__found", "__block" if block is not None else None).filter("__ask")
    return out.select(key, F.col("__t").alias(time), F.col("__tie").alias(tie), F.coalesce("__found", F.lit(default)).alias(f"{value}_as_of"))


def packet_at(packets: DataFrame, positions: DataFrame, run: str, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """J11.  packets: run, packet_index, audio_end_ms; positions: run, unit, position_ms.  The first packet that ends behind the position, else the last.

    ``block`` makes a block of a position (see ``running``)."""
    p = packets.select(run, F.col("audio_end_ms").alias("__t"), F.lit(1).alias("__side"), F.lit(-1).alias("__tie"), F.col("packet_index").alias("__v"))
    q = positions.select(run, F.col("position_ms").alias("__t"), F.lit(0).alias("__side"), F.col("unit").alias("__tie"), F.lit(None).cast("int").alias("__v"))
    both = p.unionByName(q)
    if block is not None:
        both = both.withColumn("__block", block(F.col("__t")))
    # at equal times positions come first: one on a packet's end is in that packet
    met = nearby(both, [run], ["__t", "__side", "__tie"], F.col("__v"), "ahead", "__next", "__block" if block is not None else None).filter("__side = 0")
    last = packets.groupBy(run).agg(F.max("packet_index").alias("__last"))
    return met.join(last, run, "left").select(run, F.col("__tie").alias("unit"), F.col("__t").alias("position_ms"), F.coalesce("__next", "__last").alias("packet_index"))


def key_integrity(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side lacks, and which."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(1)), right.select(*keys).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, list(keys), "full")
    return both.filter("__l is null or __r is null").select(*keys, F.when(F.col("__l").isNull(), "left").otherwise("right").alias("missing_in"))


def speed_pairs(scores: DataFrame, keys: Sequence[str], speeds: Sequence[float]) -> DataFrame:
    """J13.  scores: keys, source_id, speed, score, end_ms, first_ms, null_type.  For each speed but the first: common (ids that all speeds have), n (those of
    them aligned and timed at both), and the differences to the first speed: mean score, mean, p50 and p90 of the ends, p50 of the first speech."""
    keys = list(keys)
    aligned = F.coalesce("null_type", F.lit("")) == ""
    fine = F.when(aligned & F.col("end_ms").isNotNull() & F.col("first_ms").isNotNull(), F.struct("score", "end_ms", "first_ms"))
    wide = scores.groupBy(*keys, "source_id").agg(*[F.max(F.when(F.col("speed") == s, F.lit(1))).alias(f"__h{i}") for i, s in enumerate(speeds)], *[F.max(F.when(F.col("speed") == s, fine)).alias(f"__s{i}") for i, s in enumerate(speeds)])
    everywhere = F.lit(True)
    for i in range(len(speeds)):
        everywhere = everywhere & F.col(f"__h{i}").isNotNull()
    rows = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("speed"), F.col(f"__s{i}").alias("x")) for i, s in enumerate(speeds) if i]))
    wide = wide.withColumn("__all", everywhere).withColumn("__p", rows)
    both = F.col("__all") & F.col("__s0").isNotNull() & F.col("__p.x").isNotNull()
    delta = lambda f: F.when(both, F.col(f"__p.x.{f}").cast("double") - F.col(f"__s0.{f}")).alias(f"{f}_delta")
    pairs = wide.select(*keys, F.col("__p.speed").alias("speed"), "__all", delta("score"), delta("end_ms"), delta("first_ms"))
    own = [*keys, "speed"]
    counts = pairs.groupBy(*own).agg(F.count_if("__all").alias("common"), F.count("score_delta").alias("n"), F.bround(F.avg("score_delta"), 6).alias("score_delta"))
    long = unpivot_numbers(pairs, own, ["end_ms_delta", "first_ms_delta"]).filter("value is not null")
    ranks = interpolated(long, own, {"p50": 0.5, "p90": 0.9})
    of = lambda metric, stat: F.max(F.when(F.col("metric") == metric, F.bround(stat, 6)))
    ranks = ranks.groupBy(*own).agg(of("end_ms_delta", "mean").alias("end_delta_ms"), of("end_ms_delta", "p50").alias("end_delta_p50_ms"), of("end_ms_delta", "p90").alias("end_delta_p90_ms"), of("first_ms_delta", "p50").alias("first_delta_p50_ms"))
    return counts.join(ranks, own, "left")


def pair_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of either run with the best value of each; null on the side that lacks the key."""
    best = lambda df, name: df.groupBy(*keys).agg(F.max(value).alias(name))
    return best(a, "value_a").join(best(b, "value_b"), list(keys), "full")


def self_history_copies(rows: DataFrame, made: DataFrame, fraction: float, replace: float, most_drift: float, seed: str = "0", suffix: str = "_v4self") -> DataFrame:
    """J15.  rows: id, turns array<struct<frames, codes, ...>>; made: id, turns array<struct<frames, codes, runaway>>.  Marked copies of rows with some
    of their turns' codes replaced by self-generated ones: id with the suffix, source_id, turns (with context_only), swapped, total.

    A drawn ``fraction`` of the rows is tried.  A turn but the last is replaced with probability ``replace``, if the generated one isn't a runaway and neither is more than
    ``most_drift`` times as long as the other.  Rows with too few generated turns and copies without a replaced turn are left out.
    Draws are hashes of seed, id and place."""
    m = made.select("id", F.col("turns").alias("__made"))
    drawn = rows.filter(unit_interval(F.col("id"), f"{seed}:row") < fraction).join(m, "id").filter(F.size("__made") >= F.size("turns"))
    fields = rows.schema["turns"].dataType.elementType.names
    whole = lambda x: F.coalesce(x, F.lit(0))

    def turn(t: Column, k: Column) -> Column:
        new = F.get("__made", k)
        ratio = whole(new["frames"]) / whole(t["frames"])
        fits = (whole(t["frames"]) > 0) & (whole(new["frames"]) > 0) & (ratio >= 1.0 / most_drift) & (ratio <= most_drift) & ~F.coalesce(new["runaway"], F.lit(False))
        luck = unit_interval(F.concat(F.col("id").cast("string"), F.lit(":"), k.cast("string")), f"{seed}:turn") < replace
        swap = (k < F.size("turns") - 1) & fits & luck
        kept = [F.when(swap, new[f]).otherwise(t[f]).alias(f) if f in ("codes", "frames") else t[f].alias(f) for f in fields if f != "context_only"]
        given = F.coalesce(t["context_only"], F.lit(False)) if "context_only" in fields else F.lit(False)
        return F.struct(*kept, (swap | given).alias("context_only"), swap.alias("__swap"))

    out = drawn.withColumn("__turns", F.transform("turns", turn)).withColumn("swapped", F.size(F.filter("__turns", lambda t: t["__swap"]))).filter("swapped > 0")
    names = [f for f in fields if f != "context_only"]
    plain = F.transform("__turns", lambda t: F.struct(*[t[f].alias(f) for f in names], t["context_only"].alias("context_only")))
    return out.withColumns({"source_id": F.col("id"), "turns": plain, "total": F.size("turns")}).withColumn("id", F.concat(F.col("id").cast("string"), F.lit(suffix))).drop("__made", "__turns")


def status_join(expected: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """J16, J18.  expected: id, speakable; the others: id.  Each id's counts on all sides."""
    n = lambda df, name: df.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    e = expected.groupBy("id").agg(F.count(F.lit(1)).alias("n_expected"), F.max("speakable").alias("speakable"))
    return e.join(n(accepted, "n_accepted"), "id", "full").join(n(rejected, "n_rejected"), "id", "full").fillna(0, ["n_expected", "n_accepted", "n_rejected"])


def coverage_gate(status: DataFrame, shown: int = 20) -> DataFrame:
    """For each fault, how many ids show it and the first few; a gate holds if every count is 0."""
    c = F.col
    faults = {
        "missing": (c("n_expected") > 0) & (c("n_accepted") + c("n_rejected") == 0), "unexpected": c("n_expected") == 0, "overlap": (c("n_accepted") > 0) & (c("n_rejected") > 0),
        "duplicate": (c("n_accepted") > 1) | (c("n_rejected") > 1), "rejected_speakable": (c("n_rejected") > 0) & F.coalesce(c("speakable"), F.lit(False)),
    }
    long = status.select("id", F.explode(F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in faults.items()]))).alias("fault"))
    first = Window.partitionBy("fault").orderBy("id")
    few = long.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= shown).groupBy("fault").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return long.groupBy("fault").agg(F.count(F.lit(1)).alias("n")).join(few, "fault", "left")


def compare_values(a: DataFrame, b: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """J17.  a: key, value as stored text; b: key, value.  Names of either side with both values, whether they differ, by how much, and whether they agree:
    a number agrees with a stored one if it differs by no more than half a unit of the last decimal that is written out."""
    x, y = a.select(key, F.col(value).cast("string").alias("value_a")), b.select(key, F.col(value).cast("string").alias("value_b"))
    out = x.join(y, key, "full")
    exact = lambda c: F.col(c).try_cast("decimal(38,18)")
    decimals = F.length(F.substring_index("value_a", ".", -1)) * F.contains("value_a", F.lit(".")).cast("int")
    half = F.concat(F.lit("0."), F.repeat(F.lit("0"), decimals), F.lit("5")).cast("decimal(38,18)")
    return out.withColumns({
        "changed": ~F.col("value_a").eqNullSafe(F.col("value_b")), "delta": F.bround(F.col("value_b").try_cast("double") - F.col("value_a").try_cast("double"), 6),
        "agrees": F.coalesce(F.abs(exact("value_a") - exact("value_b")) <= half, F.lit(False)),
    })


def turn_manifest(rows: DataFrame, targets: DataFrame, intervals: DataFrame) -> DataFrame:
    """J19.  rows: id, turn, text; targets: id, path; intervals: id, n_intervals.  Accepted turns, or the reason of the rejection."""
    out = rows.join(targets, "id", "left").join(intervals, "id", "left")
    why = F.when(F.col("path").isNull(), "missing_target_manifest").when(F.col("n_intervals").isNull(), "missing_textgrid").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text")
    return out.withColumn("reason", why).withColumn("accepted", why.isNull())


def update_trace(trace: DataFrame, fixed: DataFrame, index: str, fields: Sequence[str]) -> DataFrame:
    """Recomputed fields replace the old ones where there are any."""
    new = fixed.select(index, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__hit"))
    out = trace.join(new, index, "left")
    return out.withColumns({**{f: F.coalesce(f"__{f}", f) for f in fields}, "updated": F.coalesce("__hit", F.lit(False))}).drop("__hit", *[f"__{f}" for f in fields])


def enrich_manifest(manifest: DataFrame, audit: DataFrame, nested: str, key: str = "id", prefix: str = "audit_") -> DataFrame:
    """The fields of a nested struct as columns with a prefix, joined to the manifest."""
    fields = audit.schema[nested].dataType.names
    return manifest.join(audit.select(key, *[F.col(f"{nested}.{f}").alias(prefix + f) for f in fields]), key, "left")


def resume(todo: DataFrame, done: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """IO4: rows whose key no earlier output holds; null keys of outputs count for nothing."""
    for d in done:
        todo = todo.join(d.select(*key).dropna().distinct(), list(key), "left_anti")
    return todo


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """IO5: new rows replace old ones of their key; sorted by key where it is written out."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max(F.struct("__age", *rest)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*old.columns)


def rejects(df: DataFrame, rules: Sequence[tuple]) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the others with their reasons."""
    named = df.withColumn("reasons", M.reasons(*rules))
    return named.filter(F.size("reasons") == 0).drop("reasons"), named.filter(F.size("reasons") > 0)
