"""Fingerprints against a walk step by step, order and edits against plain code, classes against all pairs."""

import hashlib
import random

import numpy as np
import pytest

from rillstone.functions.arrow import edits
from rillstone.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, k string, part int"


def steps(text):
    """What a walk writes: the character of every step."""
    table, chars = fp._walk_table(), [ord(c) for c in text]
    out, s = [], 0
    for c in chars:
        leave = table[(c ^ (c >> 7)) & 127][s]
        out += [c] * ((leave - s) % fp.PERIOD)
        s = leave
    return out


def plain(text):
    seq = steps(text)
    digits = [0] * fp.SLOTS
    for at, slot in zip(*map(list, fp._records())):
        if at < len(seq):
            digits[slot] = int(fp._bits(np.array([slot]), np.array([at]), np.array([seq[at]]))[0] >> np.uint64(60))
    return f"{len(seq):x}-" + "".join(f"{d:x}" for d in digits) if text else "0-" + "0" * fp.SLOTS


def walked(text):
    w = fp.Walk().feed(fp.code_points(text))
    return f"{w.steps:x}-{fp.packed(w.digits).hex()}"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_walks_step_by_step():
    rng = random.Random(1)
    for text in ["", "a", "ab", "é日本🙂", "x" * 9000, prose(rng, 40), prose(rng, 3000)]:
        assert walked(text) == plain(text)


def test_parts_and_blocks_don_t_matter(monkeypatch):
    text = prose(random.Random(2), 500)
    whole = walked(text)
    monkeypatch.setattr(fp, "BLOCK", 7)
    assert walked(text) == whole
    w = fp.Walk()
    for i in range(0, len(text), 91):
        w = w.copy().feed(fp.code_points(text[i : i + 91]))
    assert f"{w.steps:x}-{fp.packed(w.digits).hex()}" == whole and (fp.unpacked(fp.packed(w.digits)) == w.digits).all()


def test_samples_are_spread_evenly_and_few_change_with_the_length():
    at, slot = fp._records()
    for n in (100, 5000, 10**6):
        last = {s: a for a, s in zip(at.tolist(), slot.tolist()) if a < n}
        assert len(last) == fp.SLOTS and abs(np.mean(list(last.values())) / n - 0.5) < 0.06
    last = {s: a for a, s in zip(at.tolist(), slot.tolist()) if a < 10_000}
    assert sum(a >= 9_500 for a in last.values()) < 30


def test_likeness_follows_the_steps_and_the_edits():
    rng = random.Random(3)
    get = lambda t: (lambda w: (w.steps, w.digits))(fp.Walk().feed(fp.code_points(t)))
    for _ in range(12):
        a, b = prose(rng, rng.randint(50, 600)), prose(rng, rng.randint(50, 600))
        two = a[: len(a) // 2] + b
        for x, y in ((a, b), (a, two), (b, two)):
            u, v = steps(x), steps(y)
            share = sum(p == q for p, q in zip(u, v)) / max(len(u), len(v))
            assert abs(fp.likeness(get(x), get(y)) - share) < 0.16
        near = list(a)
        near[rng.randrange(len(a))] = "#"
        assert fp.likeness(get(a), get("".join(near))) > fp.likeness(get(a), get(b)) + 0.2
        assert fp.likeness(get(a), get(a)) == 1.0
    assert fp.likeness(get(""), get("")) == 1.0 and fp.likeness(get(""), get("a")) == 0.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (k, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), walked(t), walked(edited)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 4])
def test_edited_pairs(spark, parts):
    rng = random.Random(4)
    rows = [(i * 7 % 101, prose(rng, rng.randint(0, 60))) for i in range(101)] + [(200, None), (201, ""), (202, "ab"), (203, "é日🙂x"), (None, "no id"), (300, prose(rng, 30_000)), (299, "short")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(parts)
    made = fp.edited_pairs(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in made), key=repr) == expected(rows)
    long = [r for r in made if r.n_chars > 150]
    assert all(0 <= r.near_next < 0.35 and 0.45 < r.near_edited <= 1 for r in long if r.doc_id != 300)
    assert all(r.near_edited == 1 for r in made if r.n_chars < 3)


def test_few_and_repeated_rows(spark):
    make = lambda rows: fp.edited_pairs(spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(3))
    assert make([]).count() == 0
    one = make([(1, "abcdef")]).collect()
    assert [(r.edited_sha256, r.near_next) for r in one] == [(hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    same = make([(1, "abcdef")] * 300 + [(0, "uvwxyz")]).collect()
    shas = [r.edited_sha256 for r in same]
    assert len(same) == 301 and shas.count(hashlib.sha256(b"abcdab").hexdigest()) == 299 and shas.count(hashlib.sha256(b"abcduv").hexdigest()) == 1 and shas.count(hashlib.sha256(b"uvwxab").hexdigest()) == 1


def test_classes_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(20, 80))) for i in range(40)]
    for i in range(60):
        t = list(rng.choice(rows[:20])[1])
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((100 + i, "".join(t)))
    rows += [(300 + i, rows[0][1]) for i in range(15)] + [(1, rows[0][1] + " tail"), (400, None), (401, ""), (None, rows[0][1])]
    got = fp.edit_classes(spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(3)).collect()
    texts = sorted({t or "" for _, t in rows})
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(texts):
        for b in texts[:n]:
            if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 100 * edits(a, b) <= 20 * max(len(a), len(b)):
                root[find(a)] = find(b)
    least = {}
    for k, t in rows:
        if k is not None:
            least[find(t or "")] = min(k, least.get(find(t or ""), k))
    # links are confirmed, so that classes never hold texts that all pairs keep apart; a sampled band may miss a pair
    truth = {k: least[find(t or "")] for k, t in rows if k is not None and k != 1}
    by_class = {}
    for r in got:
        if r.doc_id is None:
            assert r.class_id is None and not r.kept
        elif r.doc_id != 1:
            by_class.setdefault(r.class_id, set()).add(truth[r.doc_id])
    assert all(len(x) == 1 for x in by_class.values())
    found = {r.doc_id: r.class_id for r in got if r.doc_id != 1}
    assert all(found[300 + i] == 0 for i in range(15)) and found[400] == found[401] == 400 and found[0] == 0
    near = [found[k] == truth[k] for k in range(100, 160)]
    assert sum(near) / len(near) > 0.7
    assert sum(r.class_id == 0 for r in got if r.doc_id == 1) == 1
