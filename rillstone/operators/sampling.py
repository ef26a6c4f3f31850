"""Splits, samples, caps, mixes and the speed decision: all pure functions of ids and seeds, so that a task run again gives the same rows.

Ranks within a group that may hold a large part of all rows are taken from a hash threshold first, so that few rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T


def unit_interval(x: Column, seed: str | int = "") -> Column:
    """The first 64 bits of sha1 of "seed:x" (of x alone without a seed) as a share of 2 ** 64."""
    key = F.concat(F.lit(f"{seed}:"), x.cast("string")) if seed != "" else x.cast("string")
    return F.conv(F.substring(F.sha1(key), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def assign_split(u: Column, ratios: Sequence[tuple[str, float]]) -> Column:
    """Names by cumulative share; negative shares count as none, the last name with a share takes the rest."""
    total = sum(max(0.0, r) for _, r in ratios)
    raw = sum(r for _, r in ratios)
    if raw <= 0 or total <= 0:
        raise ValueError("the shares must sum to more than nothing")
    given = [(n, max(0.0, r) / raw) for n, r in ratios if r > 0]
    out, upto = None, 0.0
    for name, r in given[:-1]:
        upto += r
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(given[-1][0]) if out is None else out.otherwise(given[-1][0])


def split_by_counts(df: DataFrame, key: str, order: str, shares: Sequence[tuple[str, float]], seed: int) -> DataFrame:
    """S3: distinct keys in hash order, cut at rounded counts; the last row of a key counts.

    A key's place is found from counts of hash cells of bounded size, not by one sort of all keys."""
    last = df.groupBy(key).agg(F.max(F.struct(order, *[c for c in df.columns if c not in (key, order)])).alias("__r")).select(key, "__r.*")
    ranked = global_rank(last.withColumn("__u", unit_interval(F.col(key), seed)), "__u", key)
    total = last.agg(F.count(F.lit(1)).alias("__n"))
    out = ranked.crossJoin(F.broadcast(total))
    chosen, upto = None, 0.0
    for name, r in shares[:-1]:
        upto += r
        edge = F.bround(F.col("__n") * upto, 0)
        chosen = F.when(F.col("__rank") <= edge, name) if chosen is None else chosen.when(F.col("__rank") <= edge, name)
    return out.withColumn("split", F.lit(shares[-1][0]) if chosen is None else chosen.otherwise(shares[-1][0])).drop("__u", "__rank", "__n", "__cell")


def global_rank(df: DataFrame, u: str, tie: str, cells: int = 4096) -> DataFrame:
    """__rank from 1 by u in [0, 1), then tie: rank within a cell of u plus the counts of the cells before it."""
    cut = df.withColumn("__cell", F.floor(F.col(u) * cells).cast("int"))
    counts = cut.groupBy("__cell").agg(F.count(F.lit(1)).alias("c"))
    # at most ``cells`` rows
    before = counts.select("__cell", (F.sum("c").over(Window.orderBy("__cell")) - F.col("c")).alias("__before"))
    own = Window.partitionBy("__cell").orderBy(u, tie)
    out = cut.withColumn("__own", F.row_number().over(own)).join(F.broadcast(before), "__cell")
    return out.withColumn("__rank", F.col("__own") + F.col("__before")).drop("__own", "__before", "__cell")


def stratified_sample(df: DataFrame, keys: Sequence[str], limit: Column | int, key: str, seed: int) -> DataFrame:
    """The ``limit`` rows of smallest hash of each group; below 0 all, 0 none.  Spark keeps no more of a group in a task before the shuffle."""
    cap = limit if isinstance(limit, Column) else F.lit(limit)
    order = Window.partitionBy(*keys).orderBy(unit_interval(F.col(key), seed), key)
    ranked = df.withColumn("__i", F.row_number().over(order))
    return ranked.filter((cap < 0) | (F.col("__i") <= cap)).drop("__i")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows whose key is null or empty are all kept."""
    blank = F.col(key).isNull() | (F.col(key).cast("string") == "")
    rest = [c for c in df.columns if c not in (key, order)]
    one = df.filter(~blank).groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__r")).select(key, "__r.*")
    return one.select(*df.columns).unionByName(df.filter(blank))


def keep_share(df: DataFrame, key: str, p: float, seed: int) -> DataFrame:
    """S5."""
    return df.filter(unit_interval(F.col(key), seed) < p)


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """S6."""
    return df.orderBy(unit_interval(F.col(key), seed), key).limit(n)


def assemble(df: DataFrame, key: str, accepted: str, size: int, seed: int) -> DataFrame:
    """In hash order, rows up to the size-th accepted one; rejected rows behind it aren't reported."""
    ranked = df.withColumn("__u", unit_interval(F.col(key), seed))
    fine = global_rank(ranked.filter(accepted), "__u", key).filter(F.col("__rank") <= size)
    edge = fine.agg(F.max(F.struct("__u", key)).alias("__edge"), F.count(F.lit(1)).alias("__n"))
    out = ranked.crossJoin(F.broadcast(edge)).filter((F.col("__n") < size) | (F.struct("__u", key) <= F.col("__edge")))
    return out.drop("__u", "__edge", "__n")


def mix(primary: DataFrame, aux: DataFrame, repeat: int, cap: int, key: str, seed: int) -> DataFrame:
    """The primary rows so many times each, at most ``cap`` auxiliary ones, with their source; order by hash is in column u."""
    a = primary.withColumn("source", F.lit("primary")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat)))) if repeat > 0 else primary.limit(0).withColumns({"source": F.lit("primary"), "copy": F.lit(1)})
    b = (sample_n(aux, key, cap, seed) if cap >= 0 else aux).withColumns({"source": F.lit("aux"), "copy": F.lit(1)})
    out = a.unionByName(b, allowMissingColumns=True)
    return out.withColumn("u", unit_interval(F.concat_ws(":", "source", F.col(key).cast("string"), F.col("copy").cast("string")), seed))


def report_rank(df: DataFrame) -> DataFrame:
    """S14.  df: speed, model, chunk_ms, label.  Columns to order a report by; missing numbers come last."""
    rank = F.coalesce(*[F.when(F.col("model") == m, F.lit(i)) for i, m in enumerate(("chatgpt", "gemini", "seed", "kit"))], F.lit(99))
    return df.withColumns({"o_speed": F.coalesce("speed", F.lit(999999.0)), "o_model": rank, "o_chunk": F.coalesce("chunk_ms", F.lit(999999))})


# S18, S19, J5, J6
def expand_speeds(df: DataFrame, key: str, speeds: Sequence[float]) -> DataFrame:
    """Every row at every speed (the speeds are a short list), with ids like ``a__speed_1.35``."""
    rows = [F.struct(F.lit(float(s)).alias("speed"), F.lit(f"{s:g}").alias("speed_name")) for s in speeds]
    out = df.withColumn("__s", F.explode(F.array(*rows))).select("*", "__s.speed", "__s.speed_name").drop("__s")
    return out.withColumn("variant_id", F.concat(F.col(key).cast("string"), F.lit("__speed_"), "speed_name"))


def cycle_speeds(df: DataFrame, order: str, speeds: Sequence[float]) -> DataFrame:
    """One speed per row, in turn by the row's place."""
    ranked = global_rank(df.withColumn("__u", F.lit(0.0) + _place(df, order)), "__u", order)
    table = F.array(*[F.lit(float(s)) for s in speeds])
    return ranked.withColumn("speed", F.element_at(table, ((F.col("__rank") - 1) % len(speeds) + 1).cast("int"))).drop("__u", "__rank", "__lo", "__hi")


def _place(df: DataFrame, order: str) -> Column:
    """A numeric order column as a share of its range, so that rank cells hold neighbours."""
    edge = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if edge.lo is None or edge.hi == edge.lo:
        return F.lit(0.0)
    return F.least(F.lit(0.9999999), (F.col(order) - F.lit(edge.lo)) / F.lit(float(edge.hi - edge.lo) * 1.0000001))


def speed_decision(df: DataFrame, threshold: float = 1.0, slack: float = 0.0) -> DataFrame:
    """S18.  df: duration_s, speed, target_units, rate.  Whether the target fits the time the source takes at this speed."""
    wall = F.col("duration_s") / F.col("speed")
    playback = F.greatest(F.lit(1e-6), wall + slack)
    allowed = F.greatest(F.lit(1e-6), playback * threshold)
    units = F.greatest(F.lit(1), F.floor(allowed * F.col("rate")).cast("int"))
    speech = F.col("target_units") / F.col("rate")
    out = df.withColumns({
        "source_wall_s": F.bround(wall, 3), "playback_budget_s": F.bround(playback, 3), "allowed_speech_s": F.bround(allowed, 3), "reference_speech_s": F.bround(speech, 3),
        "max_target_units": units, "s2s_rtf": F.bround(speech / playback, 6),
    })
    ratio = F.col("max_target_units") / F.greatest(F.lit(1), "target_units")
    need = F.col("target_units") > F.col("max_target_units")
    return out.withColumns({
        "needs_compression": need, "mode": F.when(~need, "faithful").when(ratio >= 0.62, "concise").otherwise("very_concise"),
        "target_ratio": F.when(need, F.bround(F.greatest(F.lit(0.35), F.least(F.lit(0.95), ratio)), 3)).otherwise(1.0),
    })


def stress_targets(df: DataFrame, max_lag: float = 1.5, wpm: float = 185.0) -> DataFrame:
    """S19.  df: source_text, reference, duration_s (null: estimated), speed.  The target of a sped-up source."""
    source = F.coalesce(F.col("duration_s"), M.estimate_seconds(F.col("source_text"))) / F.col("speed")
    most = source + max_lag
    ratio = F.least(F.lit(1.0), most / F.greatest(M.estimate_seconds(F.col("reference"), wpm), F.lit(0.1)))
    return df.withColumns({
        "max_target_s": F.bround(most, 3), "target_ratio": F.bround(ratio, 3), "mode": M.stress_mode(ratio), "max_target_words": F.greatest(F.lit(4), F.floor(wpm * most / 60.0).cast("int")),
    })


# S15 - S17
def _drawn(key: str, seed: int, name: Column | str, low: Column | int, high: Column | int) -> Column:
    """A whole number from low to high, by the hash of the id and of what it is for."""
    what = F.lit(name) if isinstance(name, str) else name
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (low + F.floor(unit_interval(F.concat_ws(":", F.col(key).cast("string"), what), seed) * (high - low + 1))).cast("int")


def _chosen(key: str, seed: int, fraction: float) -> Column:
    return unit_interval(F.concat_ws(":", F.col(key).cast("string"), F.lit("take")), seed) < fraction


def drop_lead(df: DataFrame, key: str, turns: str, seed: int, least: int = 4, share: float = 0.5, fraction: float = 0.5, suffix: str = "_mid") -> DataFrame:
    """All rows, and for a share of those long enough a copy that starts k turns later, k drawn from 1 to ``share`` of
    the turns, so that ``least`` remain.  Copies have an id of their own, which ends in k, and ``dropped`` = k."""
    n = F.size(turns)
    most = F.floor(n * share).cast("int")
    high = F.least(most, n - least)
    fine = (n - 1 >= least) & (most >= 1) & (high >= 1) & _chosen(key, seed, fraction)
    named = df.withColumn(key, F.col(key).cast("string"))
    late = named.filter(fine).withColumn("dropped", _drawn(key, seed, "k", 1, high))
    late = late.withColumns({turns: F.slice(turns, F.col("dropped") + 1, F.greatest(F.lit(0), n - F.col("dropped"))), key: F.concat(key, F.lit(suffix), F.col("dropped").cast("string"))})
    return named.withColumn("dropped", F.lit(0)).unionByName(late)


def _with_span(units: Column, at: Column, size: Column, times: Column | int) -> Column:
    """The units with the span at that place (from 0) said so many more times right behind it."""
    times = F.lit(times) if isinstance(times, int) else times
    span, end = F.slice(units, at + 1, size), at + size
    return F.concat(F.slice(units, F.lit(1), end), F.flatten(F.array_repeat(span, times)), F.slice(units, end + 1, F.greatest(F.lit(0), F.size(units) - end)))


def repeat_inside(df: DataFrame, key: str, turns: str, seed: int, times: int = 2, least: int = 8, most: int = 24, fraction: float = 0.2, suffix: str = "_repeated") -> DataFrame:
    """All rows, and for a share of those with a turn but the last of twice the least span a copy in which a span of
    one such turn is said ``times`` more.  turns: array of arrays of units.

    Copies have an id of their own and the turn (from 0) in ``context_only``, as it is context and not to be learnt."""
    none = F.array().cast("array<int>")
    named = df.withColumn(key, F.col(key).cast("string"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(turns) - 2)), lambda i: (i < F.size(turns) - 1) & (F.size(F.get(turns, i)) >= 2 * least))
    made = named.withColumn("__places", places).filter((F.size("__places") > 0) & _chosen(key, seed, fraction))
    made = made.withColumn("__k", F.get("__places", _drawn(key, seed, "turn", 0, F.size("__places") - 1)))
    made = made.withColumn("__n", F.size(F.get(turns, F.col("__k"))))
    made = made.withColumn("__size", _drawn(key, seed, "size", least, F.least(F.lit(most), F.floor(F.col("__n") / 2).cast("int"))))
    made = made.withColumn("__at", _drawn(key, seed, "at", 0, F.col("__n") - F.col("__size")))
    said = F.transform(turns, lambda u, i: F.when(i == F.col("__k"), _with_span(u, F.col("__at"), F.col("__size"), times)).otherwise(u))
    made = made.withColumns({turns: said, "context_only": F.array("__k"), key: F.concat(key, F.lit(suffix))}).drop("__places", "__k", "__n", "__size", "__at")
    return named.withColumn("context_only", none).unionByName(made)


def loop_corruption(df: DataFrame, key: str, turns: str, seed: int, least: int = 8, most: int = 32, fraction: float = 0.5, suffix: str = "_looped") -> DataFrame:
    """All rows, and for a share of them a copy in which one to three turns but the last loop.  turns: array of arrays of units.

    A turn is drawn to say a span of its own one to three times more (intra), to begin with the end of the turn before once or
    twice (carry), or to be the turn before with its own first quarter behind it (replay); one whose units don't suffice stays.
    The turn before counts as it has become, so that the copy is a fold over the turns.  ``context_only``: the turns changed, from 0;
    copies without any are left out."""
    kind = df.schema[turns].dataType.simpleString()
    none = F.array().cast("array<int>")
    named = df.withColumn(key, F.col(key).cast("string"))
    draw = lambda name, i, low, high: _drawn(key, seed, F.concat(F.lit(name), i.cast("string")), low, high)
    fit = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(turns) - 2)), lambda i: (i < F.size(turns) - 1) & (F.size(F.get(turns, i)) >= least))
    made = named.withColumn("__fit", fit).filter((F.size("__fit") > 0) & _chosen(key, seed, fraction))
    ranked = F.sort_array(F.transform("__fit", lambda i: F.struct(unit_interval(F.concat_ws(":", F.col(key), F.lit("pick"), i.cast("string")), seed).alias("u"), i.alias("i"))))
    made = made.withColumn("__picks", F.transform(F.slice(ranked, F.lit(1), F.least(F.size("__fit"), _drawn(key, seed, "turns", 1, 3))), lambda r: r["i"]))
    start = F.struct(F.array().cast(kind).alias("done"), none.alias("marked"))

    def step(s: Column, i: Column) -> Column:
        own = F.get(turns, i)
        before = F.coalesce(F.get(s["done"], i - 1), F.slice(own, F.lit(1), F.lit(0)))
        mode = F.when(F.size(before) > 0, draw("mode", i, 0, 2)).otherwise(F.lit(0))
        half = F.floor(F.size(own) / 2).cast("int")
        size = draw("size", i, least, F.least(F.lit(most), half))
        intra = F.when(F.size(own) >= 2 * least, _with_span(own, draw("at", i, F.lit(0), F.size(own) - size), size, draw("times", i, 1, 3)))
        tail = draw("tail", i, least, F.least(F.lit(most), F.size(before)))
        carry = F.when(F.size(before) >= least, F.concat(F.flatten(F.array_repeat(F.slice(before, F.size(before) - tail + 1, tail), draw("carried", i, 1, 2))), own))
        replay = F.concat(before, F.slice(own, F.lit(1), F.floor(F.size(own) / 4).cast("int")))
        new = F.when(F.array_contains("__picks", i), F.when(mode == 0, intra).when(mode == 1, carry).otherwise(replay))
        return F.struct(F.concat(s["done"], F.array(F.coalesce(new, own))).alias("done"), F.when(new.isNotNull(), F.concat(s["marked"], F.array(i))).otherwise(s["marked"]).alias("marked"))

    made = made.withColumn("__f", F.aggregate(F.sequence(F.lit(0), F.size(turns) - 1), start, step)).filter(F.size("__f.marked") > 0)
    made = made.withColumns({turns: F.col("__f.done"), "context_only": F.col("__f.marked"), key: F.concat(key, F.lit(suffix))}).drop("__f", "__fit", "__picks")
    return named.withColumn("context_only", none).unionByName(made)


def union_copies(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Clean, long and altered copies together, each row with where it is from."""
    out = frames[0][1].withColumn("copy_kind", F.lit(frames[0][0]))
    for name, df in frames[1:]:
        out = out.unionByName(df.withColumn("copy_kind", F.lit(name)), allowMissingColumns=True)
    return out


def package_segments(df: DataFrame, key: str, audios: str, texts: str, prefix: str) -> DataFrame:
    """One row per audio with its text, without those of empty text, with ids by position."""
    rows = df.select(key, F.posexplode(F.arrays_zip(audios, texts)).alias("pos", "z"))
    rows = rows.select(key, "pos", F.col(f"z.{audios}").alias("audio"), F.col(f"z.{texts}").alias("text")).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.withColumn("segment_id", F.format_string(f"{prefix}_%s_%05d", F.col(key).cast("string"), "pos"))


def qe_segments(df: DataFrame, key: str, sentences: str, candidate: str) -> DataFrame:
    """The candidate's words dealt to the manifest's sentences in proportion of their length; the weight is the sentence's characters."""
    words = F.filter(F.split(T.collapse(F.col(candidate)), " "), lambda w: w != "")
    sizes = F.transform(sentences, F.length)
    total = F.greatest(F.lit(1), F.aggregate(sizes, F.lit(0), lambda s, x: s + x))
    rows = df.withColumns({"__w": words, "__t": total}).select(key, "__w", "__t", F.posexplode(sentences).alias("segment", "source"))
    upto = F.sum(F.length("source")).over(Window.partitionBy(key).orderBy("segment"))
    rows = rows.withColumn("__hi", F.floor(upto * F.size("__w") / F.col("__t")).cast("int")).withColumn("__lo", F.floor((upto - F.length("source")) * F.size("__w") / F.col("__t")).cast("int"))
    return rows.select(key, "segment", "source", F.array_join(F.slice("__w", F.col("__lo") + 1, F.col("__hi") - F.col("__lo")), " ").alias("hypothesis"), F.length("source").alias("weight_chars"))


def paired_segments(df: DataFrame, key: str, sentences: str) -> DataFrame:
    """A segment for each of the manifest's sentences that has both sides.  sentences: array<struct<source, target>>.

    White space is collapsed; the weight is the characters of both sides, 1 at least.  Rows without a whole pair give no segment.
    Segments are numbered in order from 0 and know how many there are."""
    tidy = F.transform(sentences, lambda x: F.struct(T.collapse(x["source"]).alias("source"), T.collapse(x["target"]).alias("hypothesis")))
    pairs = F.filter(tidy, lambda x: (x["source"] != "") & (x["hypothesis"] != ""))
    rows = df.select(key, pairs.alias("__p")).select(key, F.size("__p").alias("segments"), F.posexplode("__p").alias("segment", "__s"))
    weight = F.greatest(F.lit(1), F.length("__s.source") + F.length("__s.hypothesis"))
    name = F.concat(F.col(key).cast("string"), F.lit("||seg="), F.lpad(F.col("segment").cast("string"), F.greatest(F.lit(3), F.length(F.col("segment").cast("string"))), F.lit("0")))
    return rows.select(name.alias("qe_id"), key, "segment", "segments", F.col("__s.source").alias("source"), F.col("__s.hypothesis").alias("hypothesis"), weight.alias("weight_chars"))
