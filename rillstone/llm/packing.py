"""Sum-of-squares online packing of token sequences.

A map over the partitions of the input: each task tokenises its texts, cuts full windows off the front of long
documents, and places the rest of each (or the whole of a short one) into an open window of the level (tokens in
it so far) for which the sum over levels of the squared count of open windows becomes smallest.  Counts are kept in
a level array; the windows of a level are a stack of (number) entries.  Every piece stays where it was placed: at the end of
a task its open windows, of which there are few on every level, are cut where they stand into sequences whose lengths are
powers of two (the bits of the fill), which need no padding.

Nothing is shuffled and nothing depends on other partitions: a lost task is run again with the same result, since
sequence numbers are the partition's number and a count within it.  Null and empty texts are one end token.  Repeated
rows are packed once each.  An empty table gives no piece.  Columns besides the id and the text don't matter.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 1024
#: windows of one partition at most
PER_PARTITION = 1 << 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: runs of white space from here on are cut off by a plain search; the regular expression would recurse once for each character
LONG_SPACE = 1000
#: fixed values: characters of white space, and how a text is cut before the merges
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def best_level(count: np.ndarray, size: int, window: int) -> int:
    """The level (0: a new window) whose choice gives the smallest sum of squared counts of partially filled windows.

    Taking level h to h + size changes the sum by 1 - 2 count[h] for the window that leaves h (none for a new one) and
    by 1 + 2 count[h + size] for the one that arrives (none where it is full).  Ties go to the fullest."""
    levels = np.arange(0, window - size + 1)
    change = np.zeros(len(levels), np.int64)
    change[1:] += 1 - 2 * count[1 : window - size + 1]
    change[:-1] += 1 + 2 * count[levels[:-1] + size]
    change[1:][count[1 : window - size + 1] == 0] = np.iinfo(np.int64).max
    return int(len(change) - 1 - np.argmin(change[::-1]))


class SumOfSquares:
    """Open windows by level.  ``place`` returns (window, offset) for a piece of at most a window's size."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.stacks: dict[int, list[int]] = {}
        self.opened = 0

    def place(self, size: int) -> tuple[int, int]:
        level = best_level(self.count, size, self.window) if size < self.window else 0
        if level:
            number = self.stacks[level].pop()
            self.count[level] -= 1
        else:
            number, self.opened = self.opened, self.opened + 1
        if level + size < self.window:
            self.stacks.setdefault(level + size, []).append(number)
            self.count[level + size] += 1
        return number, level


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary files of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str, end_id: int) -> Callable[[str], bytes]:
    """Ids of a text as little-endian unsigned 32-bit numbers, by the byte-level BPE in the file, with the end id.

    The ids are those that the tokenizers library gives for the file without special tokens added (tests compare
    them); tiktoken's merger runs on the file's own vocabulary, in which an id is a merge's rank, four times as fast."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    symbols = _byte_symbols()
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    ranks = {bytes(symbols[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    made = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    spaces = re.compile(f"[{WHITE}]{{{LONG_SPACE},}}")

    def ordinary(text: str) -> list[int]:
        """A run of white space is one piece but for its last character, which belongs to what follows."""
        if len(text) < LONG_SPACE:
            return made.encode_ordinary(text)
        ids, at = [], 0
        for run in spaces.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += made.encode_ordinary(text[at : run.start()])
            ids += made._encode_single_piece(text[run.start() : end].encode())
            at = end
        return ids + made.encode_ordinary(text[at:]) if at else made.encode_ordinary(text)

    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def encode(text: str) -> bytes:
        if cut and any(x in text for x in special):
            ids = [i for part in cut.split(text) for i in ([special[part]] if part in special else ordinary(part))]
        else:
            ids = ordinary(text)
        ids.append(end_id)
        return np.array(ids, "<u4").tobytes() if sys.byteorder != "little" else array("I", ids).tobytes()

    return encode


class Packer:
    """Pieces of one partition: (doc, start, length, crc32 of the ids, tokens of the document, window, offset)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.boxes = window, SumOfSquares(window)
        self.held: dict[int, list[tuple]] = {}
        self.ids: dict[int, list[bytes]] = {}

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        n, w = len(ids) // 4, self.window
        for start in range(0, n, w):
            size = min(w, n - start)
            part = ids[4 * start : 4 * (start + size)]
            number, offset = self.boxes.place(size)
            if size == w:
                yield doc, start, size, zlib.crc32(part), n, number, 0
                continue
            self.held.setdefault(number, []).append((doc, start, size, n))
            self.ids.setdefault(number, []).append(part)
            if offset + size == w:
                at = 0
                for (d, s, k, total), x in zip(self.held.pop(number), self.ids.pop(number), strict=True):
                    yield d, s, k, zlib.crc32(x), total, number, at
                    at += k

    def close(self) -> Iterator[tuple]:
        """The open windows, each cut where it stands into sequences of powers of two, the longest first."""
        number = self.boxes.opened
        for window in sorted(self.held):
            at, left = 0, sum(p[2] for p in self.held[window])
            room = 0
            for (doc, start, size, total), x in zip(self.held[window], self.ids[window], strict=True):
                taken = 0
                while taken < size:
                    if not room:
                        room, at, number = 1 << (left.bit_length() - 1), 0, number + 1
                    k = min(room, size - taken)
                    yield doc, start + taken, k, zlib.crc32(x[4 * taken : 4 * (taken + k)]), total, number - 1, at
                    taken, room, at, left = taken + k, room - k, at + k, left - k


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces as in SCHEMA.  ``tokenizer``: a byte-level BPE file of the tokenizers library, in the same place on all executors.

    Each id of each document, and the end id after them, lies in exactly one piece.  A sequence is as long as its
    pieces: ``window``, or a power of two below it."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer, end_id), Packer(window)
        first = TaskContext.get().partitionId() * PER_PARTITION
        out: list[tuple] = []

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            columns[5] = [first + x for x in columns[5]]
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            out.clear()
            return made

        for batch in batches:
            for doc, x in zip(batch.column(0), batch.column(1), strict=True):
                out += packer.add(doc.as_py(), encode(x.as_py() or ""))
                if len(out) >= 20_000:
                    yield ready()
        out += packer.close()
        if out:
            yield ready()

    return df.select(df[key].cast("long").alias("k"), df[text].alias("t")).mapInArrow(run, SCHEMA)
