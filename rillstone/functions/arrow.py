"""The few functions that are sequential or lack a built-in form, over Arrow batches."""

from __future__ import annotations

import ast
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: traditional characters and their simplified forms; more can be given as a map
SIMPLE = {"們": "们", "個": "个", "這": "这", "為": "为", "來": "来", "時": "时", "國": "国", "會": "会", "對": "对", "說": "说", "學": "学", "過": "过", "語": "语", "聲": "声", "點": "点", "還": "还"}
#: whole texts that are Python's at a time
AT_ONCE = 64


def _places(a: Sequence) -> dict:
    """Of each unit, a number whose bit i is set where it stands at i."""
    bits: dict = {}
    for i, x in enumerate(a):
        bits[x] = bits.get(x, 0) | (1 << i)
    return bits


def lcs(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence; a whole row of the table is one number, a step of which takes a few operations."""
    bits, full = _places(a), (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & bits.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def edits(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance; the steps up and down of a whole row are two numbers."""
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a):
        return len(b)
    bits, full, last, found = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for x in b:
        same = bits.get(x, 0)
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(level | up)), up & level
        found += bool(rise & last) - bool(fall & last)
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(same | down | rise)), rise & (same | down)
    return found


def _listed(x: list | None) -> list:
    return [] if x is None else list(x)


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """M9: Levenshtein distance of two arrays; null counts as empty."""
    return pd.Series([edits(_listed(x), _listed(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


@F.pandas_udf(T.StructType([T.StructField("overlap", T.IntegerType()), T.StructField("held", T.IntegerType())]))
def bag_counts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """M6: of two token arrays, the size of the multiset intersection, and how many tokens of a occur in b; null counts as empty.

    A fold over sorted structs does the same without Python, at a tenth of the speed."""
    overlap, held = [], []
    for x, y in zip(a, b, strict=True):
        ours, theirs = Counter(_listed(x)), Counter(_listed(y))
        both = ours.keys() & theirs.keys()
        overlap.append(sum(min(ours[t], theirs[t]) for t in both))
        held.append(sum(ours[t] for t in both))
    return pd.DataFrame({"overlap": pd.array(overlap, "int32"), "held": pd.array(held, "int32")})


#: no token holds it, as all tokenisers cut at white space
TOKEN_END = "\n"


def _tokens(x: str | None) -> list[str]:
    return x.split(TOKEN_END) if x else []


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in ("matched", "hyp", "ref")]])))
def ngram_overlap(hyp: pd.Series, ref: pd.Series, order: pd.Series) -> pd.Series:
    """M8: n-grams of both sides and how many match, each at most as often as the reference has it, by length up to the order.

    Both sides are tokens joined by ``TOKEN_END``, so that a batch holds texts, and lists of tokens only of the row at hand."""

    def count(h: list, r: list, most: int) -> list[tuple[int, int, int, int]]:
        out = []
        for n in range(1, most + 1):
            a, b = (Counter(zip(*[x[i:] for i in range(n)], strict=False)) for x in (h, r))
            out.append({"n": n, "matched": sum(min(k, b[g]) for g, k in a.items() if g in b), "hyp": max(0, len(h) - n + 1), "ref": max(0, len(r) - n + 1)})
        return out

    return pd.Series([count(_tokens(h), _tokens(r), int(n)) for h, r, n in zip(hyp, ref, order, strict=True)])


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays; null counts as empty."""
    return pd.Series([lcs(_listed(x), _listed(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


@F.pandas_udf(T.IntegerType())
def ordered_match(target: pd.Series, heard: pd.Series) -> pd.Series:
    """Last target place reached, from 1, when each heard unit is sought behind the one before; the first that isn't there ends it.

    One walk along the target; null counts as empty."""

    def walk(target: list, heard: list) -> int:
        ahead, at = enumerate(target, 1), 0
        for unit in heard:
            found = next((i for i, x in ahead if x == unit), None)
            if found is None:
                break
            at = found
        return at

    return pd.Series([walk(_listed(x), _listed(y)) for x, y in zip(target, heard, strict=True)], dtype="int64")


@F.arrow_udf(T.ArrayType(T.StringType()))
def split_parts(texts: pa.Array, parts: pa.Array) -> pa.Array:
    """So many parts near even cuts, each cut moved behind the nearest sentence mark, else comma or space, within 120 characters.

    A cut depends on the one before; fewer parts come back where a text is too short.  A few texts at a time are Python's."""

    def cut(text: str, n: int) -> list[str]:
        out, at = [], 0
        for left in range(n, 1, -1):
            want = at + round((len(text) - at) / left)
            lo, hi = max(at + 1, want - 120), min(len(text) - 1, want + 120)
            place = want
            for marks in (".!?。！？", ",;:，；：、", " "):
                found = [i + 1 for i in range(lo - 1, hi) if text[i] in marks]
                if found:
                    place = min(found, key=lambda i: (abs(i - want), i))
                    break
            if place <= at or place >= len(text):
                continue
            out.append(text[at:place].strip())
            at = place
        return [p for p in [*out, text[at:].strip()] if p]

    def some(lo: int) -> pa.Array:
        pairs = zip(texts[lo : lo + AT_ONCE].to_pylist(), parts[lo : lo + AT_ONCE].to_pylist(), strict=True)
        return pa.array([cut(" ".join((t or "").split()), int(max(1, n or 1))) for t, n in pairs], pa.list_(pa.string()))

    made = [some(lo) for lo in range(0, len(texts), AT_ONCE)]
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """NFKC, case folded, simplified, letters and digits only."""
    table = str.maketrans(SIMPLE)
    return x.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "").casefold().translate(table) if c.isalnum()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def list_literal(x: pd.Series) -> pd.Series:
    """The strings of a list written in Python's or JSON's way, white space collapsed, empty ones gone; null for anything else."""

    def read(raw: str | None) -> list[str] | None:
        try:
            value = ast.literal_eval(raw or "")
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        if not isinstance(value, list):
            return None
        return [t for t in (" ".join(str(v).split()) for v in value) if t]

    return x.map(read)


def greedy_groups(cap: int, soft: float):
    """A function of sizes (array<int>) and ends (array<boolean>, whether a segment ends a sentence) that gives the places of segments in groups."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def walk(sizes: pd.Series, ends: pd.Series) -> pd.Series:
        def groups(sizes: list, ends: list) -> list[list[int]]:
            done, open_, size = [], [], 0
            for i, (n, end) in enumerate(zip(sizes, ends, strict=False)):
                if open_ and size + n > cap:
                    done.append(open_)
                    open_, size = [], 0
                open_.append(i)
                size += n
                if end and size >= soft * cap:
                    done.append(open_)
                    open_, size = [], 0
            return [*done, open_] if open_ else done

        return pd.Series([None if x is None or y is None else groups(x, y) for x, y in zip(sizes, ends, strict=True)])

    return walk


def spans_to_ends(size: float):
    """A function of sorted chunk ends (array<double>) that gives windows which end where a chunk ends, as long as they can be without passing ``size``."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])))
    def walk(ends: pd.Series) -> pd.Series:
        def spans(ends: list) -> list[dict[str, float]]:
            done, lo, hi = [], 0.0, 0.0
            for end in map(float, ends):
                if end - lo > size and hi > lo:
                    done.append({"lo": lo, "hi": hi})
                    lo = hi
                hi = end
            return [*done, {"lo": lo, "hi": hi}] if hi > lo else done

        return pd.Series([None if x is None else spans(x) for x in ends])

    return walk


def _longest_by_places(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest common run (place in a, place in b, size), the earliest of equal ones, by all meetings of equal units."""
    places: dict = {}
    for j in range(blo, bhi):
        places.setdefault(b[j], []).append(j)
    i_best, j_best, size, runs = alo, blo, 0, {}
    for i in range(alo, ahi):
        new = {}
        for j in places.get(a[i], ()):
            new[j] = k = runs.get(j - 1, 0) + 1
            if k > size:
                i_best, j_best, size = i - k + 1, j - k + 1, k
        runs = new
    return i_best, j_best, size


def _longest_by_suffixes(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The same by the automaton of all runs of b, in steps that grow with the lengths alone."""
    step: list[dict] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for j in range(blo, bhi):
        x, here = b[j], len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(j)
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = here
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    i_best, j_best, size, v, n = alo, blo, 0, 0, 0
    for i in range(alo, ahi):
        x = a[i]
        while v and x not in step[v]:
            v = link[v]
            n = length[v]
        if x in step[v]:
            v, n = step[v][x], n + 1
            if n > size:
                i_best, j_best, size = i - n + 1, first[v] - n + 1, n
    return i_best, j_best, size


def matching_blocks(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal units: the longest common run first (the earliest of equal ones), then left and right of it.

    Where equal units would meet too often a range's longest run is found by the automaton of its suffixes."""
    todo, out = [(0, len(a), 0, len(b))], []
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        counts = Counter(b[blo:bhi])
        meetings = sum(counts.get(x, 0) for x in a[alo:ahi])
        if not meetings:
            continue
        find = _longest_by_places if meetings <= 8 * (ahi - alo + bhi - blo) else _longest_by_suffixes
        i, j, size = find(a, b, alo, ahi, blo, bhi)
        out += [(i + t, j + t) for t in range(size)]
        todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return sorted(out)


def align_units(df, key: str):
    """W10.  df: key, hyp array<string>, heard array<string>, heard_s array<double>.  One row per unit of hyp with the time of its match, or null, and the share matched."""
    name, kind = key, df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, units, at, shares = [], [], [], []
            for r in batch.itertuples(index=False):
                hyp, heard, times = (list(x) if x is not None else [] for x in (r.hyp, r.heard, r.heard_s))
                found = dict(matching_blocks(hyp, heard))
                ids += [getattr(r, name)] * len(hyp)
                units += range(len(hyp))
                at += [times[found[i]] if i in found else None for i in range(len(hyp))]
                shares += [len(found) / len(hyp)] * len(hyp) if hyp else []
            yield pd.DataFrame({name: ids, "unit": units, "unit_s": pd.Series(at, dtype="float64"), "coverage": shares})

    return df.select(key, "hyp", "heard", "heard_s").mapInPandas(run, f"{key} {kind}, unit int, unit_s double, coverage double")
