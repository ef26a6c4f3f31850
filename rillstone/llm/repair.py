"""Conversation structure repair: the cheapest edits that make a conversation's roles read ``(s?(ua)+)?``.

Rows are kept (0), given another role (1) or deleted (2), and empty rows are inserted (5); blank rows and repeats must go, and
a truncated row that stays costs 5 more.  The repaired role initials are accepted by an automaton of four states (nothing yet,
after s, after u, after a), so that the edits are a Viterbi search over the rows in order.  Its survivors, one for each state
at most, are leaves of a tree of backpointers whose nodes count their references: what no survivor descends from is freed at once, and as
soon as all survivors share an ancestor the edits up to it are emitted, with their texts, and forgotten.  A survivor that another
one beats whatever follows (it could do the same for less) is dropped, which lets the others coalesce.

Among edits of equal cost those whose initials (D, I, K, R) come first in ASCII order are taken.  An insertion belongs to the row before which it stands, so that two
ways to the same row are never a prefix of each other, and differ first right below their last common ancestor; that is found
over jump pointers, in steps that grow with the logarithm of what is unresolved.  Where the choice stays open (all rows of one role, say)
everything unresolved is held, since the rows to come decide on all of it.

Rows are dealt out by conversation, sorted on disk, and streamed: a task holds one batch and what is unresolved.  The audit and the hash are by
definition one sequence for each conversation, so that one conversation isn't split.

Nulls in role and text count as one space, null turns come first, rows of one turn follow role and text; a null id is a
conversation.  An empty table gives an empty table.  Columns besides the four named don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values of the contract: costs of the edits, white space, ends of sentences
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
LONG = 2**63
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: state after an inserted or given role, which is the only one that may follow
FOLLOWS = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: what it takes at most to do from the second state what can be done from the first: missing rows are inserted, a system row is deleted
MIMIC = {
    (NONE, SYSTEM): 2 * INSERT, (NONE, USER): INSERT + DELETE, (NONE, ASSISTANT): DELETE, (SYSTEM, NONE): 0, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 0,
    (USER, NONE): INSERT, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT, (ASSISTANT, NONE): 0, (ASSISTANT, SYSTEM): 2 * INSERT, (ASSISTANT, USER): INSERT,
}
#: insertions and the state after them at the end, by state
ENDING = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Sink = Callable[[str, str, str], None]


def steps(initial: str, must_go: bool, truncated: bool) -> dict[int, list[tuple[int, int, str]]]:
    """From each state, (state, cost, label) of the cheapest way to every other over a row of this kind."""
    out = {}
    for state in FOLLOWS:
        best: dict[int, tuple[int, str]] = {}
        here = state
        for k in range(3):
            ways = [(here, DELETE, "D")]
            if not must_go:
                ways.append((FOLLOWS[here], RETYPE + TRUNCATED * truncated, "R"))
                if (here, initial) in KEPT:
                    ways.append((KEPT[here, initial], TRUNCATED * truncated, "K"))
            for to, cost, edit in ways:
                way = (cost + INSERT * k, "I" * k + edit)
                best[to] = min(best.get(to, way), way)
            here = FOLLOWS[here]
        out[state] = [(to, cost, label) for to, (cost, label) in best.items()]
    return out


STEPS = {(i, gone, cut): steps(i, gone, cut) for i in ("s", "u", "a", "") for gone in (False, True) for cut in (False, True)}


class Node:
    """A way to a row: its last edits, and where they come from.  refs: children, and one if it survives."""

    __slots__ = ("parent", "label", "row", "depth", "jump", "refs", "kids")

    def __init__(self, parent: Node | None, label: str, row: tuple[str, str] | None):
        self.parent, self.label, self.row, self.refs, self.kids = parent, label, row, 0, []
        self.depth = parent.depth + 1 if parent else 0
        far = parent.jump if parent else None
        level = far is not None and far.jump is not None and parent.depth - far.depth == far.depth - far.jump.depth
        self.jump = far.jump if level else parent


class Repair:
    """One conversation's search; ``sink(edit, role, text)`` gets every edit in order, D with what was deleted."""

    def __init__(self, sink: Sink):
        self.sink = sink
        self.root = Node(None, "", None)
        self.root.refs = 1
        self.alive: dict[int, tuple[int, Node]] = {NONE: (0, self.root)}
        self.state, self.held, self.most_held = NONE, 1, 1

    def before(self, a: Node, b: Node) -> bool:
        """Whether the edits of a come before those of b, both of the same row and different."""
        while a.parent is not b.parent:
            u, v = a.jump, b.jump
            if u is not v and u is not None and v is not None and u.depth == v.depth and u.depth > self.root.depth:
                a, b = u, v
            else:
                a, b = a.parent, b.parent
        return a.label < b.label

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        ways = STEPS[initial, must_go, truncated and not must_go]
        best: dict[int, tuple[int, Node, str]] = {}
        for state, (cost, node) in self.alive.items():
            for to, more, label in ways[state]:
                total, held = cost + more, best.get(to)
                if held is None or total < held[0] or (total == held[0] and (label < held[2] if node is held[1] else self.before(node, held[1]))):
                    best[to] = (total, node, label)
        kept = {q: x for q, x in best.items() if not any(p != q and x[0] > y[0] + MIMIC[q, p] for p, y in best.items())}
        row, old = (role, text), [node for _, node in self.alive.values()]
        self.alive = {}
        for state, (total, parent, label) in kept.items():
            child = Node(parent, label, row)
            child.refs = 1
            parent.refs += 1
            parent.kids.append(child)
            self.held += 1
            self.alive[state] = (total, child)
        self.most_held = max(self.most_held, self.held)
        for node in old:
            self.release(node)
        while self.root.refs == 1 and self.root.kids:
            self.emit(self.root.kids[0])

    def release(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            parent = node.parent
            parent.kids.remove(node)
            parent.refs -= 1
            self.held -= 1
            node = parent

    def emit(self, node: Node) -> None:
        """The root's only child becomes the root; nothing before it is reachable any more."""
        role, text = node.row
        for edit in node.label:
            if edit == "D":
                self.sink(edit, role, text)
            elif edit == "K":
                self.state = KEPT[self.state, role[:1]]
                self.sink(edit, role, text)
            else:
                self.state = FOLLOWS[self.state]
                self.sink(edit, NAMES[self.state], text if edit == "R" else "")
        past, self.root = self.root, node
        past.kids, past.parent, past.jump, past.row = [], None, None, None
        node.parent, node.jump, node.row = None, None, None
        self.held -= 1

    def finish(self) -> int:
        """Emits what is left; the cost of all edits."""
        best = None
        for state, (cost, node) in self.alive.items():
            total = cost + INSERT * len(ENDING[state])
            if best is None or total < best[0] or (total == best[0] and self.before(node, best[1])):
                best = (total, node, ENDING[state])
        total, node, ending = best
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node)
        for edit in ending:
            self.state = FOLLOWS[self.state]
            self.sink(edit, NAMES[self.state], "")
        return total


class Conversation:
    """Counts, edits and hash of one conversation, row by row."""

    FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def __init__(self, sink: Sink | None = None):
        self.low = self.high = self.turn = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit: list[str] = []
        self.sha, self.first, self.sink = hashlib.sha256(), True, sink
        self.search = Repair(self.edited)

    def edited(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode(errors="surrogatepass"))
            self.first = False
        if self.sink:
            self.sink(edit, role, text)

    def add(self, turn: int | None, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None:
            self.turns += turn != self.turn or self.low is None
            self.low, self.high, self.turn = (turn if self.low is None else self.low), turn, turn
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not again and not blank
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.search.add(role, text, blank or again, cut)

    def result(self) -> tuple:
        cost = self.search.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps if gaps < LONG else None, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.sha.hexdigest())


def damage(rows: DataFrame) -> DataFrame:
    """The contract's faults, by a hash of conversation and turn; dropped rows stay with ``live`` false."""
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    given = rows.withColumn("fault", fault)
    hurt = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    made = given.select("conv", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), hurt.alias("text"), (F.col("fault") != 0).alias("live"), copies.alias("copy"))
    return made.drop("copy")


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, live of a table of turns."""
    space = lambda name: F.coalesce(df[name], F.lit(" "))
    return df.select(df[conv].alias("conv"), df[turn].cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(True).alias("live"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order, with their faults: one shuffle, by conversation."""
    body: Column = F.rtrim(F.col("text"), F.lit(SPACE))
    again = F.row_number().over(Window.partitionBy("conv", "live", "role", "text").orderBy("turn")) > 1
    facts = rows.withColumn("body", body).select("conv", "turn", "role", "text", "live", (F.col("body") == "").alias("blank"), (~F.substring("body", -1, 1).isin(*ENDS)).alias("cut"))
    return facts.repartition("conv").withColumn("again", again).sortWithinPartitions("conv", "turn", "role", "text", "again")


def _conversations(batches: Iterator[pa.RecordBatch], make: Callable[[], Conversation]) -> Iterator[tuple[object, Conversation, bool]]:
    """(id, conversation, whether it has ended): ended ones as they end, and an open one after each batch."""
    key, now = None, None
    for b in batches:
        for conv, turn, role, text, live, blank, cut, again in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "live", "blank", "cut", "again")), strict=True):
            if now is None or conv != key:
                if now is not None:
                    yield key, now, True
                key, now = conv, make()
            if live:
                now.add(turn, role, text, blank, again, cut)
        if now is not None:
            yield key, now, False
    if now is not None:
        yield key, now, True


def structure_report(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of conv, turn, role, text, live.

    The first fault of a row counts; gaps are missing turns between the least and the greatest; illegal are neighbours whose
    initials aren't su, ua or au.  A conversation without live rows has zeros, an empty audit and an empty string's hash."""
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", *[f.split()[0] for f in Conversation.FIELDS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        arrow = None

        def told(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal arrow
            arrow = b.schema.field("conv").type
            return b

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *[pa.array(c, pa.int64()) for c in columns[1:7]], *[pa.array(c, pa.string()) for c in columns[7:]]], names)

        for key, found, ended in _conversations(map(told, batches), Conversation):
            if ended:
                done.append((key, *found.result()))
            elif done:
                yield batch()
                done = []
        if done:
            yield batch()

    return _in_order(rows).mapInArrow(run, f"conv {kind}, {Conversation.FIELDS}")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv, place (from 1), edit, role, text: every edit of each conversation in order, deleted rows (D) with what they were."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        arrow, place, of = None, 0, None

        def told(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal arrow
            arrow = b.schema.field("conv").type
            return b

        edits: list[tuple[str, str, str]] = []
        for key, found, ended in _conversations(map(told, batches), lambda: Conversation(lambda *e: edits.append(e))):
            if ended:
                found.search.finish()
            if found is not of:
                place, of = 0, found
            out += [(key, place + n, *e) for n, e in enumerate(edits, 1)]
            place += len(edits)
            edits.clear()
            if out and (not ended or len(out) > 10_000):
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], ["conv", "place", "edit", "role", "text"])
                out = []
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], ["conv", "place", "edit", "role", "text"])

    return _in_order(rows).mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")
