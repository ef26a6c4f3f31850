"""Benchmark decontamination over a distributed positional inverted index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the texts with A-Z lower-cased, known by a 64-bit hash.  A window is a
run of ``size`` words of an item, or a shorter item as a whole.

1. One pass over the corpus counts every word that occurs in an item.
2. Each window is looked up by its ``RAREST`` rarest words.  A second pass stores the postings (term, document,
   positions) of these words alone, as a table in the shared folder.
3. Postings are joined with the items' positions of the term and adjusted by them: equal values of document position
   minus item position line up on one alignment (document, item, shift).  An alignment stays only where the lists of
   all looked-up words of some window meet on it.
4. The texts of the documents that stay are compared with the item word by word along each alignment.
5. For near matches the shifts may differ by ``slop``: documents in which two looked-up words of a window stand so are
   compared with all words of each of the item's windows.

Item tables are broadcast only up to ``BROADCAST_WORDS`` words; larger ones are joined by a shuffle and, in the passes
over the corpus, cut into parts of that size which are passed one after the other.

Null texts have no words.  Repeated documents each get their own row and the same answer; an item id with several texts
stands for all of them, equal texts are reported under each of their ids; null item ids are left out.  Empty tables give no hit, or no row.  Columns besides id and
text don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .scratch import Scratch

SIZE = 10
RAREST = 2
#: words of all items together that are sent to every executor at once
BROADCAST_WORDS = 2_000_000
#: alignments and near candidates (an item's name and a number each) that are sent to every executor at most
BROADCAST_FOUND = 1_000_000
_JOINT = "\0"


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item string, words array<long>: the distinct items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, kept = batch.column(0).to_pylist(), [], []
            for lo, hi, data, offs in tb.groups(batch.column(1)):
                w = tb.words(data, offs, tb.ALNUM)
                bounds = w.bounds(hi - lo)
                for d in range(hi - lo):
                    if bounds[d + 1] > bounds[d]:
                        kept.append(ids[lo + d])
                        out.append(w.hash[bounds[d] : bounds[d + 1]].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(out, pa.list_(pa.int64()))], ["item", "words"])

    rows = items.filter(items[key].isNotNull()).select(items[key].cast("string").alias("item"), items[text].alias("t"))
    return rows.mapInArrow(run, "item string, words array<long>").distinct()


def _part(rows: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items laid end to end: words; per distinct word, sorted, where its positions begin in the list that follows."""
    flat = np.array([x for _, ws in rows for x in ws], np.int64).view(np.uint64)
    order = np.argsort(flat, kind="stable")
    terms, begin = np.unique(flat[order], return_index=True)
    return flat, terms, begin, order


def _lookup(terms: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in terms of each hash that is there, and which are."""
    if not len(terms):
        return np.empty(0, np.int64), np.zeros(len(h), bool)
    i = np.searchsorted(terms, h)
    i[i == len(terms)] = 0
    there = terms[i] == h
    return i[there], there


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """term long, n long: how often each of the words occurs in column ``t`` of docs; words that don't are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for _, _, data, offs in tb.groups(batch.column(0)):
                i, _ = _lookup(sent.value, tb.words(data, offs, tb.ALNUM).hash)
                total += np.bincount(i, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[some].view(np.int64)), pa.array(total[some])], ["term", "n"])

    return docs.select("t").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """term long, doc long, positions array<int> of the given words in columns ``k`` and ``t`` of docs: the index."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, data, offs in tb.groups(batch.column(1)):
                w = tb.words(data, offs, tb.ALNUM)
                i, there = _lookup(sent.value, w.hash)
                if not len(i):
                    continue
                doc = w.doc[there]
                at = np.flatnonzero(there) - w.bounds(hi - lo)[doc]
                order = np.lexsort((at, i, doc))
                doc, i, at = doc[order], i[order], at[order]
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (i[1:] != i[:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[i[first]].view(np.int64)), pa.array(ids[lo + doc[first]].tolist(), pa.int64()), lists], ["term", "doc", "positions"])

    return docs.select("k", "t").mapInArrow(run, "term long, doc long, positions array<int>")


def windows(items: DataFrame, counts: DataFrame, size: int = SIZE, rarest: int = RAREST) -> DataFrame:
    """counts: term, n_corpus.  Gives item, pos (first word), need: the item positions of the window's rarest words, fewest in the corpus first.

    Windows of which a word occurs nowhere are left out."""
    words = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    known = words.join(counts, "term", "left").withColumn("count", F.coalesce("n_corpus", F.lit(0)))
    first = F.greatest(F.lit(0), F.col("at") - (size - 1))
    last = F.greatest(F.lit(0), F.least(F.col("at"), F.col("n") - size))
    held = known.select("item", "at", "count", F.explode(F.sequence(F.least(first, last), last)).alias("pos"))
    # (count, at) of each word of a window: the first few of the sorted list are its rarest
    by = held.groupBy("item", "pos").agg(F.slice(F.array_sort(F.collect_list(F.struct("count", "at"))), 1, rarest).alias("few"))
    return by.filter(F.col("few")[0]["count"] > 0).select("item", "pos", F.array_sort(F.transform("few", lambda x: x["at"])).alias("need"))


def alignments(index: DataFrame, items: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """doc, item, shift: where the offset-adjusted lists of all looked-up words of some window meet.

    An item position matters only as one of a window's looked-up words."""
    hint = F.broadcast if small else (lambda df: df)
    anchors = wins.select("item", F.explode("need").alias("at")).distinct()
    words = items.select("item", F.posexplode("words").alias("at", "term"))
    anchors = words.join(anchors, ["item", "at"]).select("item", "at", "term")
    needs = wins.groupBy("item").agg(F.collect_set("need").alias("needs"))
    met = index.join(hint(anchors), "term").select("doc", "item", "at", F.explode("positions").alias("p"))
    met = met.groupBy("doc", "item", (F.col("p") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("met"))
    met = met.join(hint(needs), "item")
    return met.filter(F.exists("needs", lambda need: F.size(F.array_except(need, F.col("met"))) == 0)).select("doc", "item", "shift")


def near_candidates(index: DataFrame, items: DataFrame, wins: DataFrame, slop: int, small: bool) -> DataFrame:
    """doc, item where two looked-up words of a window stand within twice ``slop`` of their distance in the window; all words are compared afterwards.

    Shifts (document position minus item position) are put into cells of ``slop`` + 1; two within ``slop`` of each other lie in a cell or in it and the next.
    Windows mostly share their looked-up words, so that the pairs of an item are taken once.  Rows are counted, never listed."""
    hint = F.broadcast if small else (lambda df: df)
    words = items.select("item", F.posexplode("words").alias("at", "term"))
    pairs = wins.filter(F.size("need") == 2).select("item", F.col("need")[0].alias("a"), F.col("need")[1].alias("b")).distinct()
    sides = pairs.select("item", "a", "b", F.explode(F.array("a", "b")).alias("at")).join(words, ["item", "at"])
    met = index.join(hint(sides), "term").select("doc", "item", "a", "b", "at", F.explode("positions").alias("p"))
    cell = F.floor((F.col("p") - F.col("at")) / (slop + 1))
    met = met.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    both = met.groupBy("doc", "item", "a", "b", "cell").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo < hi")
    return both.select("doc", "item").distinct()


def near_windows(doc: np.ndarray, item: np.ndarray, size: int, slop: int) -> list[tuple[int, int]]:
    """(first word of the window in the item, least shift) of the windows whose words all stand in the document with shifts within ``slop`` of each other."""
    size = min(size, len(item))
    order = np.argsort(doc, kind="stable")
    lo, hi = (np.searchsorted(doc[order], item, side=s) for s in ("left", "right"))
    shifts = [np.sort(order[a:b]) - i for i, (a, b) in enumerate(zip(lo, hi, strict=True))]
    missing = np.concatenate(([0], np.cumsum(hi == lo)))
    out = []
    for pos in range(len(item) - size + 1):
        if missing[pos + size] > missing[pos]:
            continue
        own = shifts[pos : pos + size]
        # the least shift of a match is a shift of one of its words; the rarest words' neighbourhood is enough to try
        few = min(own, key=len)
        low = np.unique(np.concatenate([x[(np.searchsorted(few, x - slop) < np.searchsorted(few, x + slop, side="right"))] for x in own]))
        for x in own:
            if not len(low):
                break
            i = np.searchsorted(x, low)
            there = i < len(x)
            there[there] = x[i[there]] <= low[there] + slop
            low = low[there]
        if len(low):
            out.append((pos, int(low[0])))
    return out


def _sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _compare(doc: np.ndarray, item: np.ndarray, shift: int, size: int) -> list[tuple[int, int]]:
    """Spans of document positions in which windows of the item lie on this alignment."""
    size = min(size, len(item))
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < size:
        return []
    same = np.concatenate(([False], doc[lo + shift : hi + shift] == item[lo:hi], [False]))
    edge = np.flatnonzero(same[1:] != same[:-1])
    return [(lo + shift + a, lo + shift + b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= size]


HITS = "array<struct<item:string,start:int,end:int>>"
NEAR = "array<struct<item:string,pos:int,shift:int>>"
#: how many words apart from its place in the window a word may stand, in a near match
SLOP = 2


def find_benchmark(docs: DataFrame, items: DataFrame, size: int = SIZE, rarest: int = RAREST, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", keep: bool = False, slop: int | None = None) -> DataFrame:
    """doc, n_words, n_hit, spans array<struct<item string, start int, end int>>: hit words are those within spans.

    With ``keep``, all columns of docs instead of doc, and the others as __n_words, __n_hit, __spans.  With ``slop``, near too, array<struct<item
    string, pos int, shift int>>: the windows (first word in the item) all of whose words stand in the document, each shifted from its place in the window
    by at least ``shift`` words and at most ``slop`` more.  Exact occurrences are among them."""
    spark: SparkSession = docs.sparkSession
    disk = Scratch(spark, "decontam")
    rows = docs.select(docs[doc_key].cast("long").alias("k"), docs[text].alias("t"))
    # an id that comes with several texts is as many items, which are reported under the one id
    named = item_words(items, item_key, text).withColumn("item", F.concat("item", F.lit(_JOINT), F.xxhash64("words").cast("string")))
    words = disk.save(named, "items")
    n_words = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    small = n_words <= BROADCAST_WORDS
    parts = max(1, -(-n_words // BROADCAST_WORDS))

    def vocabulary(df: DataFrame) -> Iterator[np.ndarray]:
        """Distinct words in sorted parts of a bounded size."""
        for i in range(parts):
            part = df.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == i) if parts > 1 else df
            yield np.sort(np.array([r[0] for r in part.select("term").distinct().collect()], np.int64).view(np.uint64))

    terms = words.select(F.explode("words").alias("term"))
    frames = [term_counts(rows, v) for v in vocabulary(terms)]
    counts = frames[0]
    for x in frames[1:]:
        counts = counts.unionByName(x)
    counts = disk.save(counts.select("term", F.col("n").alias("n_corpus")), "counts")
    wins = disk.save(windows(words, counts, size, rarest), "windows")
    wanted = words.select("item", F.posexplode("words").alias("at", "term")).join(wins.select("item", F.explode("need").alias("at")).distinct(), ["item", "at"]).select("term")
    frames = [postings(rows, v) for v in vocabulary(wanted)]
    index = frames[0]
    for x in frames[1:]:
        index = index.unionByName(x)
    index = disk.save(index, "index")
    lined = disk.save(alignments(index, words, wins, small), "alignments")
    # the words of an aligned item go along with the alignment where all of them can't be sent to every executor
    per_doc = lined if small else lined.join(words, "item")
    fields = ["item", "shift"] if small else ["item", "shift", "words"]
    per_doc = per_doc.groupBy("doc").agg(F.collect_list(F.struct(*fields)).alias("lined"))
    if slop is not None:
        close = disk.save(near_candidates(index, words, wins, slop, small), "near")
        # every exact occurrence is a near one
        close = close.unionByName(lined.select("doc", "item")).distinct()
        close = close if small else close.join(words, "item")
        close = close.groupBy("doc").agg(F.collect_list(F.struct(*[f for f in fields if f != "shift"])).alias("close"))
        per_doc = per_doc.join(close, "doc", "full")
    sent = spark.sparkContext.broadcast({r.item: np.array(r.words, np.int64).view(np.uint64) for r in words.collect()} if small else {})

    kind = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    near_kind = pa.list_(pa.struct([("item", pa.string()), ("pos", pa.int32()), ("shift", pa.int32())]))

    def scan(column: pa.Array, found: pa.Array, close: pa.Array | None) -> list[pa.Array]:
        n, hits, spans, near = [], [], [], []
        for lo, hi, data, offs in tb.groups(column):
            w = tb.words(data, offs, tb.ALNUM)
            bounds = w.bounds(hi - lo)
            for d in range(hi - lo):
                h = w.hash[bounds[d] : bounds[d + 1]]
                mark, own = np.zeros(len(h), bool), []
                for x in found[lo + d].as_py() or []:
                    item = np.array(x["words"], np.int64).view(np.uint64) if "words" in x else sent.value[x["item"]]
                    for a, b in _compare(h, item, x["shift"], size):
                        mark[a:b] = True
                        own.append({"item": x["item"].rpartition(_JOINT)[0], "start": a, "end": b})
                if close is not None:
                    words_of = lambda x: np.array(x["words"], np.int64).view(np.uint64) if "words" in x else sent.value[x["item"]]
                    near.append([{"item": x["item"].rpartition(_JOINT)[0], "pos": p, "shift": s} for x in close[lo + d].as_py() or [] for p, s in near_windows(h, words_of(x), size, slop)])
                n.append(len(h))
                hits.append(int(mark.sum()))
                spans.append(own)
        return [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, kind), *([pa.array(near, near_kind)] if close is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, column, found = batch.columns[: len(batch.columns) - (slop is not None)]
            yield pa.RecordBatch.from_arrays([*own, *scan(column, found, batch.columns[-1] if slop is not None else None)], names)

    own = docs.select("*") if keep else docs.select(docs[doc_key].cast("long").alias("doc"))
    given = docs.select(*([docs[c] for c in docs.columns] if keep else [docs[doc_key].cast("long").alias("doc")]), docs[doc_key].cast("long").alias("__k"), docs[text].alias("__t"))
    per_doc = per_doc.withColumnRenamed("doc", "__doc")
    if slop is not None:
        # what was found is far smaller than the texts, which stay where they are as long as it can be sent to all of them
        per_doc = disk.save(per_doc, "found")
        entries = per_doc.agg(F.coalesce(F.sum(F.size(F.coalesce("lined", F.array())) + F.size(F.coalesce("close", F.array()))), F.lit(0))).first()[0]
        per_doc = F.broadcast(per_doc) if small and entries <= BROADCAST_FOUND else per_doc
    joined = given.join(per_doc, given["__k"].eqNullSafe(per_doc["__doc"]), "left").select(*own.columns, "__t", F.col("lined").alias("__lined"), *([F.col("close").alias("__close")] if slop is not None else []))
    mark = "__" if keep else ""
    schema = T.StructType([*own.schema.fields, T.StructField(f"{mark}n_words", T.LongType()), T.StructField(f"{mark}n_hit", T.LongType()), T.StructField(f"{mark}spans", T._parse_datatype_string(HITS)), *([T.StructField(f"{mark}near", T._parse_datatype_string(NEAR))] if slop is not None else [])])
    names = [f.name for f in schema]
    return joined.mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with near matches, n_near (items with one) too."""
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    near = [F.size(F.array_distinct(F.transform("near", lambda s: s["item"]))).cast("long").alias("n_near")] if "near" in found.columns else []
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *near,
    )
