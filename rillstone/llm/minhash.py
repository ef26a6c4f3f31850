"""Near-duplicates: fast similarity sketches, banding, exact verification, components.

The sketch of a text's set of word shingles has ``bands * rows`` coordinates.  In round i every shingle is hashed to a
coordinate and a value, and coordinates that earlier rounds left empty take the least value that falls on them; after
as many rounds as there are coordinates, round i sends all shingles to coordinate i, so that each is filled at last.
Two sets agree on a coordinate with a probability equal to their similarity, and the share on which they agree is
concentrated as with independent ones.

Texts with the same set are one class, known by a 128-bit hash, and only the class's smallest document is banded.  A
bucket is the documents that agree on all coordinates of a band.  In each bucket all documents are compared with the
smallest one, and these links are joined to components.  Pairs of a component bring nothing new, so that a bucket of n
copies takes n comparisons.  Documents of a bucket that are still in different components are searched exactly, without
listing the bucket's pairs (see ``remaining_pairs``), so that no two different texts that share a bucket and pass the
test stay apart.  Every link is confirmed by intersecting the full shingle sets of both texts.

Null and empty texts, and those without words, have an empty set and no link; a text with fewer words than a shingle has its
whole sequence as one.  An id names one text; repeated rows are each reported with the same answer; null ids get a component of null.  An
empty table gives an empty table.  Columns besides the id and the text don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import connected
from .scratch import Scratch

#: of the texts' shingles, where a contract doesn't say otherwise
WORDS, PERCENT = 5, 80
#: a pair at 80 % similarity fails to share any bucket with a probability of (1 - 0.8 ** 7) ** 48, 1 in 80,000
BANDS, ROWS = 48, 7
U64 = np.uint64
SKETCH_SCHEMA = "k long, n long, set_a long, set_b long, bands array<long>"


def sketch(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Sketches (sets x size) of sets of 64-bit hashes laid end to end; each set has a value at least."""
    n = len(bounds) - 1
    out = np.full((n, size), np.iinfo(np.uint64).max, U64)
    open_ = np.ones((n, size), bool)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    live_values, live_owner = values, owner
    for i in range(2 * size):
        h = tb.mix(live_values ^ tb.mix(np.array([i + 1], U64) * U64(0x9E3779B97F4A7C15)))
        if i < size:
            at = (((h >> U64(32)) * U64(size)) >> U64(32)).astype(np.int64)
        else:
            at = np.full(len(h), i - size)
        cell = live_owner * size + at
        fresh = open_.ravel()[cell]
        np.minimum.at(out.ravel(), cell[fresh], h[fresh])
        open_.ravel()[cell[fresh]] = False
        waiting = open_.any(1)
        if not waiting.any():
            break
        if i % 4 == 0 or i >= size:
            keep = waiting[live_owner]
            live_values, live_owner = live_values[keep], live_owner[keep]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketches.reshape(len(sketches), bands, rows)
    acc = np.broadcast_to(tb.mix(np.arange(1, bands + 1, dtype=U64)), (len(sketches), bands)).copy()
    for r in range(rows):
        acc = tb.mix(acc * U64(0xC6A4A7935BD1E995) + parts[:, :, r])
    return acc.view(np.int64)


def sketches(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As SKETCH_SCHEMA, of columns k and t: set size, hash of the set, bucket keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in tb.groups(batch.column(1)):
                sets, bounds = tb.shingles(tb.words(data, offs, tb.NOT_SPACE), hi - lo, words)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                starts = bounds[:-1][some]
                hash_a, hash_b = np.zeros(hi - lo, U64), np.zeros(hi - lo, U64)
                keys: list[list[int] | None] = [None] * (hi - lo)
                if len(some):
                    hash_a[some] = np.add.reduceat(tb.mix(sets + U64(11)), starts)
                    hash_b[some] = np.add.reduceat(tb.mix(sets ^ U64(0x5851F42D4C957F2D)), starts)
                    made = band_keys(sketch(sets, np.append(starts, len(sets)), bands * rows), bands, rows)
                    for d, row in zip(some, made.tolist(), strict=True):
                        keys[d] = row
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(size), pa.array(hash_a.view(np.int64)), pa.array(hash_b.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                    ["k", "n", "set_a", "set_b", "bands"],
                )

    return docs.select("k", "t").mapInArrow(run, SKETCH_SCHEMA)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """k, shingles: the sorted full sets of columns k and t, as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in tb.groups(batch.column(1)):
                sets, bounds = tb.shingles(tb.words(data, offs, tb.NOT_SPACE), hi - lo, words)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), lists], ["k", "shingles"])

    return docs.select("k", "t").mapInArrow(run, "k long, shingles array<long>")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * intersection >= percent * union of their full sets."""
    left = sets.select(F.col("k").alias("a"), F.col("shingles").alias("u"))
    right = sets.select(F.col("k").alias("b"), F.col("shingles").alias("v"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("u", "v")))
    return both.filter(f"100L * common >= {percent}L * (size(u) + size(v) - common)").select("a", "b")


def remaining_pairs(mixed: DataFrame, sets: DataFrame, percent: int, disk: Scratch) -> DataFrame:
    """Pairs (a, b) that hold every possible link between the components of a group, and few others.

    mixed: k, comp, grp, where grp is a member of the group too.  With C the set of grp, D = set - C plus C - set and d its size,
    two texts are linked if and only if (100 + p) |D1 - D2 plus D2 - D1| <= (100 - p) (n1 + n2).  With s = (100 - p) n - (100 + p) d that
    needs the D to share o >= -(s1 + s2) / (2 (100 + p)) elements.
    Where s1 + s2 >= 0 none needs to be shared, and both texts are linked to the group's text of greatest s as well: pairs with it
    are enough.  All others share an element among the d - o + 1 of each D that are rarest in the group, and are found by it."""
    plus, minus = 100 + percent, 100 - percent
    own = mixed.join(sets, "k").join(sets.select(F.col("k").alias("grp"), F.col("shingles").alias("base")), "grp")
    parts = F.concat(F.array_except("shingles", "base"), F.array_except("base", "shingles"))
    own = own.select("grp", "k", "comp", F.size("shingles").alias("n"), parts.alias("parts")).withColumn("d", F.size("parts"))
    own = disk.save(own.withColumn("s", minus * F.col("n").cast("long") - plus * F.col("d").cast("long")), "differences")
    top = own.groupBy("grp").agg(F.max(F.struct("s", F.col("k").alias("star"))).alias("t")).select("grp", F.col("t.star").alias("star"))
    top = disk.save(top, "stars")
    second = own.join(top, "grp").filter("k <> star").groupBy("grp").agg(F.max("s").alias("s_most"))
    second = disk.save(second, "seconds")
    star = own.select("grp", "k").join(top, "grp").filter("k <> star").select(F.least("k", "star").alias("a"), F.greatest("k", "star").alias("b"))

    cut = own.select("grp", "k", F.explode("parts").alias("e"))
    counts = disk.save(cut.groupBy("grp", "e").agg(F.count(F.lit(1)).alias("f")), "counts")
    placed = cut.join(counts, ["grp", "e"]).withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("f", "e"))).filter("f > 1")
    facts = own.select("k", "comp", "n", "d", "s", "grp").join(second, "grp").drop("grp")
    placed = placed.join(facts, "k").filter(f"rank <= d + 1 - greatest(1, ceil(-(s + s_most) / {2 * plus}))")
    placed = disk.save(placed.select("grp", "e", "k", "comp", "n", "d", "s", "rank"), "postings")
    other = placed.select("grp", "e", *[F.col(c).alias(f"{c}_b") for c in ("k", "comp", "n", "d", "s", "rank")])
    share = f"greatest(1, ceil(-(s + s_b) / {2 * plus}))"
    met = (
        (placed["grp"] == other["grp"]) & (placed["e"] == other["e"]) & (F.col("k") < F.col("k_b")) & (F.col("comp") != F.col("comp_b"))
        & F.expr(f"100L * least(n, n_b) >= {percent}L * greatest(n, n_b) and rank <= d + 1 - {share} and rank_b <= d_b + 1 - {share}")
    )
    found = placed.join(other, met).select(F.col("k").alias("a"), F.col("k_b").alias("b"))
    return star.unionByName(found).distinct()


def _labels(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """k, comp of all nodes: those without a link are alone."""
    return nodes.join(joined, nodes["k"] == joined["node"], "left").select("k", F.coalesce("component", "k").alias("comp"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable over links, itself included), kept (key = component_id)."""
    spark = docs.sparkSession
    disk = Scratch(spark, "minhash")
    source = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))
    drawn = disk.save(sketches(source, words, bands, rows), "sketches")

    # classes of texts with the same set; the bands of its smallest document stand for the class
    own = drawn.filter("n > 0 and k is not null")
    classes = disk.save(own.groupBy("set_a", "set_b", "n").agg(F.min(F.struct("k", "bands")).alias("least")).select("set_a", "set_b", "n", F.col("least.k").alias("k"), F.col("least.bands").alias("bands")), "classes")
    rows_ = classes.select("k", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    crowd = disk.save(rows_.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("centre")).filter("c > 1").select("bucket", "centre"), "buckets")
    member = disk.save(rows_.join(crowd.select("bucket"), "bucket", "left_semi"), "members")
    # one set for each text that shares a bucket
    busy = member.select("k").distinct()
    sets = disk.save(shingle_sets(source.join(busy, "k", "left_semi").groupBy("k").agg(F.min("t").alias("t")), words), "sets")

    centres = crowd.join(classes.select(F.col("k").alias("centre"), F.col("n").cast("int").alias("n_b")), "centre")
    centres = disk.save(centres, "centres")
    near = member.join(centres, "bucket").filter(f"k <> centre and 100L * least(n, n_b) >= {percent}L * greatest(n, n_b)")
    tried = disk.save(near.select(F.col("centre").alias("a"), F.col("k").alias("b")).distinct(), "pairs-of-centres")
    links = disk.save(verify(tried, sets, percent), "links-of-centres")
    label = disk.save(_labels(busy, connected(links, disk, "first")), "labels-of-centres")

    # buckets that still hold several components; those that share a document are searched as one group
    held = member.join(label, "k")
    left = held.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("k").alias("centre")).filter("lo < hi")
    left = disk.save(left.select("bucket", "centre"), "mixed")
    if not left.isEmpty():
        within = disk.save(member.select("bucket", "k").join(left, "bucket").select(F.col("k").alias("a"), F.col("centre").alias("b")).distinct(), "within")
        groups = connected(within, disk, "groups").withColumnsRenamed({"node": "k", "component": "grp"})
        pairs = remaining_pairs(groups.join(label, "k"), sets, percent, disk)
        pairs = disk.save(pairs.join(tried, ["a", "b"], "left_anti"), "pairs-of-groups")
        more = disk.save(verify(pairs, sets, percent), "links-of-groups")
        label = disk.save(_labels(busy, connected(links.unionByName(more), disk, "second")), "labels")

    named = classes.select("set_a", "set_b", "n", "k").join(label, "k", "left").select("set_a", "set_b", "n", F.coalesce("comp", "k").alias("comp"))
    named = disk.save(named, "named")
    disk.drop_all_but("sketches", "named")
    out = drawn.select("k", "n", "set_a", "set_b").join(named, ["set_a", "set_b", "n"], "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce("comp", "k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.coalesce(F.col("k") == component, F.lit(False))).alias("kept"))
