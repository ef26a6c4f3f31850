"""Repairs against all edits of short conversations, against a search that keeps whole strings, and the bound on memory."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from rillstone.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, live string, body int"


def everything(rows):
    """The least (cost, audit) over all edits, with two insertions at most in a place."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(gone and e != "D" for (_, gone, _), e in zip(rows, edits)):
            continue
        cost = sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (cut and e != "D") for (_, _, cut), e in zip(rows, edits))
        for ins in itertools.product(range(3), repeat=len(rows) + 1):
            total = cost + 5 * sum(ins)
            if best and total > best[0]:
                continue
            audit = "".join("I" * n + e for n, e in zip(ins, edits)) + "I" * ins[-1]
            choices = [[r[:1]] if e == "K" else ["u", "a"] if e == "R" else [""] for (r, _, _), e in zip(rows, edits)]
            parts = [x for n, c in zip(ins, choices) for x in [["u", "a"]] * n + [c]] + [["u", "a"]] * ins[-1]
            if (best is None or (total, audit) < best) and any(LEGAL.match("".join(p)) for p in itertools.product(*parts)):
                best = (total, audit)
    return best


def strings(rows):
    """The same by whole strings, state by state."""
    alive = {0: (0, "")}
    for role, gone, cut in rows:
        new = {}
        for state, (cost, audit) in alive.items():
            here = state
            for k in range(3):
                ways = [(here, 2, "D")]
                if not gone:
                    ways.append((3 if here == 2 else 2, 1 + 5 * cut, "R"))
                    to = {"u": 2 if here != 2 else None, "a": 3 if here == 2 else None, "s": 1 if here == 0 else None}.get(role[:1])
                    ways += [(to, 5 * cut, "K")] if to else []
                for to, more, e in ways:
                    way = (cost + 5 * k + more, audit + "I" * k + e)
                    new[to] = min(new.get(to, way), way)
                here = 3 if here == 2 else 2
        alive = new
    ends = {0: "", 1: "II", 2: "I", 3: ""}
    return min((c + 5 * len(ends[s]), a + ends[s]) for s, (c, a) in alive.items())


def search(rows):
    audit = []
    found = repair.Repair(lambda e, role, text: audit.append(e))
    for role, gone, cut in rows:
        found.add(role, "t", gone, cut)
    return found.finish(), "".join(audit), found.most_held


ROLES = ["system", "user", "assistant", "tool", " ", "usher"]


def test_short_conversations_against_all_edits():
    rng = random.Random(2)
    for _ in range(250):
        rows = [(rng.choice(ROLES), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 3))]
        assert search(rows)[:2] == everything(rows) == strings(rows)


def test_long_conversations_against_whole_strings():
    rng = random.Random(3)
    for n in range(300):
        odd, roles = rng.choice([0.02, 0.2, 0.6]), rng.choice([ROLES, ["user", "assistant"], ["assistant"], ["system", "user"]])
        rows = [(("user", "assistant")[i % 2] if rng.random() > odd else rng.choice(roles), rng.random() < odd / 2, rng.random() < odd / 2) for i in range(rng.randint(1, 120))]
        if n % 10 == 0:
            rows = [(roles[0], False, False)] * len(rows)
        assert search(rows)[:2] == strings(rows)


def test_survivors_coalesce_and_open_ones_stay_fast():
    rng = random.Random(4)
    rows = [(("user", "assistant")[i % 2], rng.random() < 0.05, rng.random() < 0.05) for i in range(30_000)]
    assert search(rows)[2] < 400
    cost, audit, held = search([("assistant", False, False)] * 20_000)
    assert (cost, audit) == (10_000, "RK" * 10_000) and held > 10_000


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain(rows, hurt=True):
    result = {}
    after = damaged(rows) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            kinds.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = strings(kinds)
        lines, state, row = [], 0, 0
        for e in audit:
            role, text = ("", "") if e == "I" else mine[row][1:]
            row += e != "I"
            if e != "D":
                state = {"s": 1, "u": 2, "a": 3}[role[:1]] if e == "K" else 3 if state == 2 else 2
                lines.append(f"{role if e == 'K' else ('user', 'assistant')[state - 2]}:{text}")
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        result[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("hurt", [True, False])
def test_reports_of_whole_tables(spark, hurt):
    rng = random.Random(5)
    text = ["Yes.", "no", "", None, " \t\n", "What?\n ", "é!", "a.b", "Long " * 3000 + "end.", "same.", "same."]
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), rng.choice(text)) for conv in range(120) for turn in range(rng.randint(1, 14)) if rng.random() > 0.1]
    rows += rows[:40] + [(None, 1, "user", "Hi."), (None, None, "assistant", "So."), (500, None, None, None), (501, -(2**62), "user", "x."), (501, 2**62, "assistant", "y.")]
    turns = repair.turns_of(table(spark, rows))
    got = {r.conv: tuple(r)[1:] for r in repair.structure_report(repair.damage(turns) if hurt else turns).collect()}
    expected = {c: (None if v[0] >= 2**63 else v[0], *v[1:]) for c, v in plain(rows, hurt).items()}
    assert got == expected


def test_repaired_rows_give_the_hash(spark):
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate([("assistant", "a."), ("user", "b."), ("user", "c"), ("assistant", "d."), ("user", "")][: c % 6])]
    turns = repair.turns_of(table(spark, rows))
    report = {r.conv: r for r in repair.structure_report(turns).collect()}
    made = {}
    for r in repair.repaired_rows(turns).orderBy("conv", "place").collect():
        made.setdefault(r.conv, []).append(r)
    for conv, r in report.items():
        mine = made.get(conv, [])
        assert [m.place for m in mine] == list(range(1, len(mine) + 1)) and "".join(m.edit for m in mine) == r.audit
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in mine if m.edit != "D").encode()).hexdigest() == r.repaired_sha256
        assert LEGAL.match("".join(m.role[:1] for m in mine if m.edit != "D"))


def test_empty_table_and_one_long_conversation(spark):
    assert repair.structure_report(repair.turns_of(table(spark, []))).count() == 0
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(25_000)]
    got = repair.structure_report(repair.damage(repair.turns_of(table(spark, rows)))).collect()
    assert len(got) == 1 and got[0].duplicate > 1000 and len(got[0].audit) > 20_000
