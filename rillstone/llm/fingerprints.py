"""Document fingerprints: randomised edit embedding, bit sampling, banding, verification.

A walk reads a text character by character and writes the character it stands on in every step.  Whether it then moves on
is a random bit of the step and the character, shared by all texts.  Two walks on texts that differ by few edits fall into step again soon
after each, so that the written sequences differ in few places (Chakraborty, Goldenberg and Koucky, 2016): edit distance
becomes Hamming distance.  The walk covers the whole text, in about twice as many steps as characters.

A fingerprint samples the written sequence at 256 steps and keeps four hash bits of each.  Every slot samples uniformly among all
steps of the walk, however long, and by the same draws for all texts: the slot's step is the last of a series of shared record
steps that the walk has reached, so that walks of nearly equal length sample nearly the same steps.  Likeness is the estimated
share of steps with the same character, 1 - Hamming distance: a slot that sampled another step counts as different (steps beyond the shorter
walk's end differ), and equal bits by chance are discounted.  Fingerprints are written as the number of steps and a hexadecimal digit for each slot.

``edit_classes`` finds near copies: slots in bands, buckets of texts that agree on a band, and each pair's edit distance measured on
whole texts.  Copies are one class, and only classes meet.  Buckets are compared with their smallest member first; only members that are
then still in different components meet each other.

Null texts are empty; an empty text takes no step and is like empty texts only.  Random bits repeat after 4096 steps, and characters beyond
ASCII share 128 rows of them (what is written stays the whole character).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import edits
from . import textbytes as tb
from .components import connected
from .scratch import Scratch

SLOTS, BITS = 256, 4
#: bands of slots: texts alike in 80 % of their steps miss all bands with a probability of (1 - 0.8 ** 8) ** 32, 1 in 360
BANDS = 32
#: characters walked at a time
BLOCK = 1 << 16
PERIOD, ROWS = 4096, 128
#: no text is longer than half of this many steps
REACH = 1 << 44
U64 = np.uint64


def _bits(*parts: np.ndarray | int) -> np.ndarray:
    x = np.zeros(1, U64)
    for p in parts:
        x = tb.mix(x * U64(0x9E3779B97F4A7C15) + np.asarray(p).astype(U64) + U64(1))
    return x


def _walk_table() -> list[list[int]]:
    """By row of characters and step (modulo PERIOD), the step at which the walk moves on to the next character."""
    stay = (_bits(np.arange(ROWS)[:, None], np.arange(PERIOD)[None, :], 77) >> U64(40)) & U64(1)
    stay[:, ::64] = 0
    steps = list(range(PERIOD))
    out = []
    for row in stay.astype(bool):
        goes = np.flatnonzero(~row)
        after = goes[np.searchsorted(goes, np.arange(PERIOD)) % len(goes)] + 1
        out.append([steps[x % PERIOD] for x in after.tolist()])
    return out


def _records() -> tuple[np.ndarray, np.ndarray]:
    """Record steps of all slots in order, and their slots.  After a record at step j the next one is beyond m with probability (j + 1) / (m + 1),
    so that the last one before any step n is equally likely to be each step before n."""
    at, slot = [], []
    step, live, i = np.zeros(SLOTS, np.int64), np.arange(SLOTS), 0
    while len(live):
        at.append(step)
        slot.append(live)
        u = ((_bits(live, i, 5) >> U64(11)).astype(np.float64) + 0.5) / 2.0**53
        further = (step + 1) / u
        keep = further < REACH
        step, live, i = further[keep].astype(np.int64), live[keep], i + 1
    at_, slot_ = np.concatenate(at), np.concatenate(slot)
    order = np.lexsort((slot_, at_))
    return at_[order], slot_[order]


_tables: dict[str, object] = {}


def _table(name: str):
    if not _tables:
        _tables["walk"] = _walk_table()
        _tables["at"], _tables["slot"] = _records()
    return _tables[name]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Walk:
    """A walk over a text that is fed in parts; what it has sampled so far."""

    __slots__ = ("steps", "seen", "last", "digits")

    def __init__(self) -> None:
        self.steps, self.seen = 0, 0
        self.last, self.digits = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.uint8)

    def copy(self) -> Walk:
        other = Walk()
        other.steps, other.seen, other.last, other.digits = self.steps, self.seen, self.last.copy(), self.digits.copy()
        return other

    def feed(self, chars: np.ndarray) -> Walk:
        for lo in range(0, len(chars), BLOCK):
            self._block(chars[lo : lo + BLOCK])
        return self

    def _block(self, chars: np.ndarray) -> None:
        table, at, slot = _table("walk"), _table("at"), _table("slot")
        s = self.steps % PERIOD
        kinds = ((chars ^ (chars >> np.uint32(7))) & np.uint32(ROWS - 1)).astype(np.uint8).tobytes()
        states = np.array([s := table[c][s] for c in kinds], np.int64)
        leaves = self.steps + np.cumsum(np.diff(states, prepend=self.steps % PERIOD) % PERIOD)
        end = int(leaves[-1])
        lo, hi = self.seen, int(np.searchsorted(at, end))
        if hi > lo:
            self.last[slot[lo:hi]] = np.arange(lo, hi)
            new = np.flatnonzero(self.last >= lo)
            step = at[self.last[new]]
            written = chars[np.searchsorted(leaves, step, side="right")]
            self.digits[new] = (_bits(new, step, written) >> U64(60)).astype(np.uint8)
        self.steps, self.seen = end, hi


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of steps of two walks (their steps and digits) that write the same."""
    if a[0] == 0 or b[0] == 0:
        return float(a[0] == b[0])
    lo, hi = sorted((a[0], b[0]))
    at, slot = _table("at"), _table("slot")
    beyond = np.zeros(SLOTS, bool)
    beyond[slot[np.searchsorted(at, lo) : np.searchsorted(at, hi)]] = True
    same, agree = int((~beyond).sum()), int(((a[1] == b[1]) & ~beyond).sum())
    return max(0.0, ((1 << BITS) * agree - same) / (((1 << BITS) - 1) * SLOTS))


def packed(digits: np.ndarray) -> bytes:
    return (digits[::2] << 4 | digits[1::2]).astype(np.uint8).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    pairs = np.frombuffer(raw, np.uint8)
    return np.stack((pairs >> 4, pairs & 15), 1).ravel()


def written(steps: Column, digits: Column) -> Column:
    """A fingerprint as a string."""
    return F.concat(F.lower(F.hex(steps)), F.lit("-"), F.lower(F.hex(digits)))


RESULT = "n_chars long, edited_sha256 binary, steps long, digits binary, edited_steps long, edited_digits binary, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in RESULT.split(", ")]


class Pending:
    """A text whose successor isn't known yet."""

    def __init__(self, key: object, text: str):
        self.key, self.text = key, text
        chars = code_points(text)
        self.n, self.cut = len(chars), len(chars) // 3
        self.kept = Walk().feed(chars[: self.n - self.cut])
        self.whole = self.kept.copy().feed(chars[self.n - self.cut :])
        self.edited_walk = self.kept if self.cut else self.whole

    def result(self, successor: Pending, first: str | None = None) -> tuple:
        """The row of a text whose last third is replaced by as many characters of its successor (or all it has)."""
        other = (successor.text if first is None else first)[: self.cut]
        edited = self.edited_walk.copy().feed(code_points(other))
        sha = hashlib.sha256((self.text[: self.n - self.cut] + other).encode(errors="surrogatepass")).digest()
        mine = (self.whole.steps, self.whole.digits)
        return (
            self.key, self.n, sha, mine[0], packed(mine[1]), edited.steps, packed(edited.digits),
            likeness(mine, (edited.steps, edited.digits)), likeness(mine, (successor.whole.steps, successor.whole.digits)),
        )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Rows follow each other by descending key (null keys last; rows of one key by a hash of their texts), and the last is followed by the first.
    Texts are dealt out in ranges of that order once, and each task walks its range from row to row.  Of each range only the first
    and last text are handed on, for the pair across the border.  Rows of one key may span ranges."""
    spark = docs.sparkSession
    disk = Scratch(spark, "fingerprints")
    given = docs.select(docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
    order = [F.desc_nulls_last("k"), F.asc("h"), F.asc("salt")]
    dealt = given.withColumns({"h": F.xxhash64("t"), "salt": F.rand(11)}).repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")
    kind = given.schema["k"].dataType.simpleString()
    schema = f"k {kind}, {RESULT}, part int, border string, t string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, out, arrow = TaskContext.get().partitionId(), None, [], None
        blank = (None,) * len(_NAMES)
        for b in batches:
            if arrow is None:
                types = [b.schema.field("k").type, pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
                arrow = pa.schema(list(zip(["k", *_NAMES, "part", "border", "t"], types, strict=True)))
            for k, t in zip(b.column("k").to_pylist(), b.column("t"), strict=True):
                now = Pending(k, t.as_py())
                if before is None:
                    out.append((k, *blank, part, "first", now.text))
                else:
                    out.append((*before.result(now), part, None, None))
                before = now
            yield _batch(out, arrow)
            out = []
        if before is not None:
            yield _batch([(before.key, *blank, part, "last", before.text)], arrow)

    made = disk.save(dealt.mapInArrow(walk, schema), "ranges")
    firsts = made.filter("border = 'first'").select("part", F.col("t").alias("first"))
    lasts = made.filter("border = 'last'").select("part", "k", "t")
    # one row for each range of the shuffle, however many rows the table has
    parts = made.filter("border = 'first'").select("part").withColumn("following", F.lead("part").over(Window.orderBy("part")))
    parts = parts.withColumn("following", F.coalesce("following", F.first("part").over(Window.orderBy("part"))))
    met = lasts.join(parts, "part").join(firsts.withColumnRenamed("part", "following"), "following").select("k", "t", "first")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field("k").type, pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.float64(), pa.float64()]
            rows = [Pending(k, t).result(Pending(None, first)) for k, t, first in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if rows:
                yield _batch(rows, pa.schema(list(zip(["k", *_NAMES], types, strict=True))))

    borders = met.mapInArrow(across, f"k {kind}, {RESULT}")
    rows = made.filter("border is null").select("k", *_NAMES).unionByName(borders)
    return rows.select(
        F.col("k").alias(key), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), written(F.col("steps"), F.col("digits")).alias("fingerprint"),
        written(F.col("edited_steps"), F.col("edited_digits")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, steps, digits, copy (a hash of the text), bands of every row, without a shuffle."""
    given = docs.select(docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
    per = SLOTS // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, steps, digits, copies, bands = [], [], [], [], []
            for t in b.column("t"):
                raw = t.as_py()
                chars = code_points(raw)
                made = Walk().feed(chars)
                n.append(len(chars))
                steps.append(made.steps)
                digits.append(packed(made.digits))
                copies.append(hashlib.sha256(raw.encode(errors="surrogatepass")).digest()[:16])
                sampled = _bits(made.last, made.digits).reshape(BANDS, per)
                acc = np.arange(BANDS).astype(U64)
                for i in range(per):
                    acc = tb.mix(acc * U64(0xC6A4A7935BD1E995) + sampled[:, i])
                bands.append(acc.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), pa.array(n, pa.int64()), pa.array(steps, pa.int64()), pa.array(digits, pa.binary()), pa.array(copies, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["k", "n_chars", "steps", "digits", "copy", "bands"],
            )

    return given.mapInArrow(run, f"k {given.schema['k'].dataType.simpleString()}, n_chars long, steps long, digits binary, copy binary, bands array<long>")


def close_pairs(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose texts (k, t) have an edit distance of at most 100 - percent percent of the longer one."""
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("ta"), b.column("tb")
            close = [100 * edits(u, v) <= (100 - percent) * max(len(u), len(v)) for u, v in ((p.as_py(), q.as_py()) for p, q in zip(x, y, strict=True))]
            yield b.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def edit_classes(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (smallest key reachable over links, itself included), kept: texts that share a band and whose edit distance
    is at most 100 - percent percent of the longer text are linked.  Repeated rows are reported each; null keys have no class; empty texts are one class."""
    spark = docs.sparkSession
    disk = Scratch(spark, "edit-classes")
    named = docs.select(docs[key].cast("long").alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
    drawn = disk.save(fingerprints(named, "k", "t").select("k", "n_chars", "copy", "bands"), "drawn")
    classes = drawn.filter("k is not null").groupBy("copy").agg(F.min("k").alias("k"), F.first("n_chars").alias("n"), F.first("bands").alias("bands"))
    classes = disk.save(classes, "classes")
    # each class by its number, so that an id with several texts has several
    nodes = classes.select(F.xxhash64("copy").alias("node"), "copy", "k", "n")
    rows = classes.filter("n > 0").select(F.xxhash64("copy").alias("node"), "n", F.explode("bands").alias("bucket"))
    crowd = disk.save(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("centre")).filter("c > 1").select("bucket", "centre"), "crowd")
    member = disk.save(rows.join(crowd.select("bucket"), "bucket", "left_semi"), "member")
    busy = member.select("node").distinct()
    texts = named.withColumn("copy", F.unhex(F.substring(F.sha2("t", 256), 1, 32))).groupBy("copy").agg(F.min("t").alias("t")).select(F.xxhash64("copy").alias("k"), "t")
    texts = disk.save(texts.join(busy.withColumnRenamed("node", "k"), "k", "left_semi"), "texts")
    sizes = member.select(F.col("node").alias("centre"), F.col("n").alias("n_b")).distinct()
    like = f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)"
    tried = disk.save(member.join(crowd, "bucket").filter("node <> centre").select("node", "centre", "n").distinct().join(sizes, "centre").filter(like).select(F.col("centre").alias("a"), F.col("node").alias("b")), "tried")
    links = disk.save(close_pairs(tried, texts, percent), "links")

    def labels(found: DataFrame, name: str) -> DataFrame:
        joined = connected(found, disk, name)
        return disk.save(busy.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), f"{name}-labels")

    label = labels(links, "first")
    held = member.join(label, "node")
    mixed = held.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    held = disk.save(held.join(mixed, "bucket", "left_semi"), "held")
    if not held.isEmpty():
        other = held.select("bucket", F.col("node").alias("node_b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
        more = held.join(other, "bucket").filter("node < node_b and comp <> comp_b").filter(like).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
        more = disk.save(close_pairs(more, texts, percent), "more")
        label = labels(links.unionByName(more), "second")
    joined = nodes.join(label, "node", "left").select("copy", "k", F.coalesce("comp", "node").alias("comp"))
    least = joined.groupBy("comp").agg(F.min("k").alias("class_id"))
    given = disk.save(joined.join(least, "comp").select("copy", "class_id"), "given")
    out = drawn.select("k", "copy").join(given, "copy", "left").withColumn("class_id", F.when(F.col("k").isNotNull(), F.col("class_id")))
    return out.select(F.col("k").alias(key), "class_id", F.coalesce(F.col("k") == F.col("class_id"), F.lit(False)).alias("kept"))
