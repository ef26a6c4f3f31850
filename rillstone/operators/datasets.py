"""Training rows out of segments: long sessions, grouped requests, trajectories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow import list_literal
from .running import running
from .sampling import expand_speeds, unit_interval
from .windows import greedy_groups

def _session_walk(turns: np.ndarray, want: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """Where sessions begin in a block that ``left`` turns of an open session enter (0: none is open), and what the last one still wants."""
    upto = np.cumsum(turns)
    begins, at, need, before = np.zeros(len(turns), bool), 0, left, 0
    while at < len(turns):
        if need <= 0:
            begins[at] = True
            need = int(want[at])
        # the first row with which the session has enough
        end = int(np.searchsorted(upto, before + need, side="left"))
        if end >= len(turns):
            return begins, need - int(upto[-1] - before)
        at, before, need = end + 1, int(upto[end]), 0
    return begins, need


def long_sessions(df: DataFrame, stream: str, order: str, turns: str, seed: int, low: int = 20, high: int = 35, block: str | None = None) -> DataFrame:
    """W23.  Consecutive rows of a stream are one session until it has a drawn number of turns (low to high, by seed, stream and first row).

    stream, order, turns, session (its first row's order) and ``kept``: whether the session has ``low`` turns, which only a stream's
    last can lack.  Null and negative numbers of turns count as 0.  ``block`` (see ``running``): a column that never falls along
    the order; its blocks are walked apart, once for each of the ``high + 1`` ways in which a session may enter one, and joined by what each is
    entered with, so that sessions cross blocks and a long stream is no one task's work."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    u = unit_interval(F.concat_ws(":", F.col(stream).cast("string"), F.col(order).cast("string")), seed)
    rows = df.select(stream, order, turns, (F.col(block) if block else F.lit(0)).alias("__blk")).withColumns({
        "__n": F.greatest(F.lit(0), F.coalesce(F.col(turns), F.lit(0))).cast("int"), "__want": (low + F.floor(u * (high - low + 1))).cast("int"),
    })

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        n, want = pdf["__n"].to_numpy(), pdf["__want"].to_numpy()
        return pd.DataFrame({stream: pdf[stream].iloc[:1], "__blk": pdf["__blk"].iloc[:1], "out": [[_session_walk(n, want, left)[1] for left in range(high + 1)]]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        begins, _ = _session_walk(pdf["__n"].to_numpy(), pdf["__want"].to_numpy(), int(pdf["__left"].iloc[0]))
        return pdf[[stream, order, turns, "__blk", "__n"]].assign(__begins=begins)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """What each block is entered with, in one walk along a stream's blocks."""
        pdf, left, at = pdf.sort_values("__blk", kind="stable", na_position="first"), [], 0
        for out in pdf["out"]:
            left.append(at)
            at = int(out[at])
        return pd.DataFrame({"__s": pdf[stream], "__eb": pdf["__blk"], "__left": left})

    b_kind = rows.schema["__blk"].dataType.simpleString()
    if block:
        # one short row for each block of a stream
        each = rows.groupBy(stream, "__blk").applyInPandas(ways, f"`{stream}` {kinds[stream]}, `__blk` {b_kind}, `out` array<int>")
        links = each.groupBy(stream).applyInPandas(link, f"`__s` {kinds[stream]}, `__eb` {b_kind}, `__left` int")
        entered = rows.join(links, F.col(stream).eqNullSafe(F.col("__s")) & F.col("__blk").eqNullSafe(F.col("__eb"))).drop("__s", "__eb")
    else:
        entered = rows.withColumn("__left", F.lit(0))
    marked = entered.groupBy(stream, "__blk").applyInPandas(walk, f"`{stream}` {kinds[stream]}, `{order}` {kinds[order]}, `{turns}` {kinds[turns]}, `__blk` {b_kind}, `__n` int, `__begins` boolean")
    out = running(marked, [stream], [order], F.when(F.col("__begins"), F.col(order)), "last", "session", "__blk" if block else None)
    size = out.groupBy(stream, "session").agg(F.sum("__n").alias("__size")).select(F.col(stream).alias("__s"), F.col("session").alias("__e"), "__size")
    out = out.join(size, F.col(stream).eqNullSafe(F.col("__s")) & F.col("session").eqNullSafe(F.col("__e")))
    return out.select(stream, order, turns, "session", (F.col("__size") >= low).alias("kept"))


def row_requests(df: DataFrame, keys: Sequence[str], order: str, text: str, cap: int = 400) -> DataFrame:
    """Segments without speech joined to their neighbours, then groups of at most ``cap`` characters.

    One row per key: texts, groups (places in texts), full_text, spoken_chars."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumn("__g", F.greatest(F.lit(1), F.sum(T.has_spoken(F.col(text)).cast("int")).over(upto)))
    merged = held.groupBy(*keys, "__g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), "").alias("t"))
    rows = merged.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__g", "t"))), lambda r: r["t"]).alias("texts"))
    ends = F.transform("texts", lambda t: F.rlike(F.rtrim(t), F.lit(r"[.!?。！？]$")))
    rows = rows.withColumn("groups", greedy_groups(F.transform("texts", F.length), ends, cap)).withColumn("full_text", F.array_join("texts", ""))
    return rows.withColumn("spoken_chars", T.spoken_chars(F.col("full_text")))


def trajectory_rows(df: DataFrame, key: str, raw: str, most: int = 400, dirty: Column | None = None) -> DataFrame:
    """The segments of a list literal, or why a row has none: unreadable, dirty, too_long, no_turns."""
    out = df.withColumn("segments", list_literal(F.col(raw)))
    whole = F.array_join("segments", "")
    bad = dirty if dirty is not None else whole.rlike(r"[<>{}\[\]]")
    why = F.when(F.col("segments").isNull(), "unreadable").when(F.size("segments") == 0, "no_turns").when(bad, "dirty").when(F.length(whole) > most, "too_long").when(~T.has_spoken(whole), "no_turns")
    return out.withColumn("reason", why)


def reason_counts(df: DataFrame) -> DataFrame:
    """S21's counters; accepted rows have a null reason."""
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def turn_rows(turns: DataFrame, targets: DataFrame, spans: DataFrame, faults: DataFrame, speeds: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """J19.  Training rows of spoken turns, each at every speed, and the sessions that give none.

    turns: id, turn, audio, source_s, text; targets: id, path; spans: id, turn, start_s, end_s in the target's audio (rows of null
    spans for turns without speech); faults: id, error of sessions whose intervals couldn't be read.  A session must have a target
    and spans; its reason otherwise comes back as (id, reason).  A row holds the sped-up audios up to its turn, the
    source's duration at its speed, the span, and the target's duration over the source's."""
    why = F.when(F.col("path").isNull(), "missing_target_manifest").when(F.col("error").isNotNull(), F.concat(F.lit("textgrid_exception:"), "error")).when(F.col("timed").isNull(), "missing_textgrid")
    known = turns.select("id").distinct().join(targets, "id", "left").join(faults, "id", "left").join(spans.select("id").distinct().withColumn("timed", F.lit(True)), "id", "left")
    known = known.withColumn("reason", why)
    rows = turns.join(known.filter("reason is null").select("id", F.col("path").alias("target_path")), "id").join(spans, ["id", "turn"], "left")
    rows = expand_speeds(rows, "id", speeds)
    at = F.concat("variant_id", F.lit("__chunk_"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    rows = rows.withColumns({"chunk_id": at, "source_audio": F.concat(at, F.lit(".wav")), "current_source_s": F.bround(F.col("source_s") / F.col("speed"), 6)})
    rows = rows.withColumn("audios", F.collect_list("source_audio").over(Window.partitionBy("id", "speed").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    said = F.coalesce("text", F.lit("")) != ""
    length = F.when(said, F.bround(F.col("end_s") - F.col("start_s"), 6))
    rows = rows.withColumns({"expected_empty": ~said, "target_s": length}).withColumn("rtf", F.bround(F.col("target_s") / F.greatest(F.lit(1e-6), "current_source_s"), 6))
    out = rows.select(F.col("chunk_id").alias("id"), F.col("id").alias("row_id"), "turn", "speed", "audios", "current_source_s", "text", "expected_empty", "target_path", "start_s", "end_s", "target_s", "rtf")
    return out, known.filter("reason is not null").select("id", "reason")
