"""Extraction, chat format, URL rules, packing and decontamination."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import chat, decontam, html, packing, queries, urls
from rillstone.llm.scratch import Scratch

PAGE = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Title &amp; more</h1><p>First <b>pa</b>ra&nbsp;graph of
 the text.</p><aside>Related junk</aside><div class="ad">buy now</div><p>Second, with a list:</p><ul><li>one</li><li>two</li></ul><p>End.</p></article>
<section id="comments"><article class="comment"><p>nice post, I liked it</p></article></section></main><form><label>Mail</label></form><footer>c</footer><script>var a = "<p>no</p>";</script></body></html>"""


#: weights that thirty such pages teach
LEARNT = html.weights_of({k: 30 * n for k, n in html.label_counts(PAGE.replace('<div class="ad">buy now</div>', "").replace("<form>", '<div class="ad">buy now</div><form>')).items()})
SCANS = pytest.mark.parametrize("seed", range(8))


def test_main_text():
    assert html.main_text(PAGE, LEARNT)[0] == "Title & more First para graph of the text. Second, with a list: one two End."
    for w in (html.PRIOR, LEARNT):
        assert html.main_text("", w)[0] == "" and html.main_text("<nav>a b</nav>", w)[0] == ""
        assert html.main_text("plain  words", w)[0] == "plain words"
        assert html.main_text('<p>a<p class="x', w)[0] == "a"
        assert html.main_text("<div hidden>not shown at all</div><p>shown</p>", w)[0] == "shown"
        assert html.main_text('<p>see <a class="related-link" href="x">this page</a> for more</p>', w)[0] == "see this page for more"
        assert html.main_text('<main><div class="entry-header"><h1>My title</h1></div><p>some words</p></main>', w)[0] == "My title some words"
        assert html.main_text("<article class='category-social'><p>The whole text stays.</p></article>", w)[0] == "The whole text stays."
    assert html.main_text("<form>" + "<div><p>a page in one form</p></div>" * 40 + "</form>", html.PRIOR)[0].count("one form") == 40
    assert html.main_text("<div role='navigation'><p>a b</p></div><p>text</p>", html.PRIOR)[0] == "text"


def plain_text(page, w):
    """The same by trying all runs of what a recursion over the elements leaves."""
    tokens, ends = html.read(page)
    scores = html.token_scores(tokens, ends, w)

    def walk(i, end):
        """(worth, kept tokens as (score, text)) of tokens i .. end"""
        worth, kept = 0.0, []
        while i < end:
            t = tokens[i]
            piece = html.unescape(t.text) if t.kind == "text" else "" if t.text in html.INLINE else " "
            if ends[i]:
                inner, inside = walk(i + 1, min(ends[i], end))
                total = scores[i] + inner
                cut = total < -html.GAP
                worth += 0.0 if cut else total
                kept += [(-html.GAP, " ")] if cut else [(scores[i], piece), *inside]
                i = min(ends[i], end)
            else:
                worth += scores[i]
                kept.append((scores[i], piece))
                i += 1
        return worth, kept

    kept = walk(0, len(tokens))[1]
    before = np.concatenate(([0.0], np.cumsum([s for s, _ in kept])))
    gain = before[None, :] - before[:, None]
    gain[np.tril_indices(len(before))] = 0
    if gain.max(initial=0) <= 1e-12:
        return ""
    lo, hi = min(((i, j) for i, j in zip(*np.nonzero(gain >= gain.max() - 1e-9), strict=True)), key=lambda x: (x[1], -x[0]))
    return " ".join("".join(x for _, x in kept[lo:hi]).split())


@SCANS
def test_scans_agree_with_trying_all_runs(seed):
    rng = random.Random(seed)
    names = ["p", "div", "div class='ad'", "div class='post x'", "nav", "aside", "li", "ul", "b", "a href='/'", "form", "footer", "h1", "br", "article", "section id='comments'", "span hidden"]
    for _ in range(60):
        page = ""
        for _ in range(rng.randint(0, 40)):
            kind = rng.random()
            name = rng.choice(names)
            page += " ".join(rng.choices(["word", "&amp;", "é", "x<y"], k=rng.randint(0, 12))) if kind < 0.4 else f"<{name}>" if kind < 0.7 else f"</{name.split()[0]}>"
        for w in (html.PRIOR, LEARNT):
            assert html.main_text(page, w)[0] == plain_text(page, w), page


def test_learnt_weights_find_held_out_articles(spark, sf):
    """Weights of one half of the pages, on the other half with the labels taken away."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()]
    counts = sum((html.label_counts(x) for x in pages[::2]), start=Counter())
    w = html.weights_of(counts)
    assert any(k.startswith(".") and v < -html.STRONG for k, v in w.items())
    f1, changed = [], 0
    for page in pages[1::2]:
        tokens, ends = html.read(page)
        lo, hi = html.labelled(tokens, ends)
        want = "".join(html.unescape(t.text) if t.kind == "text" else "" if t.text in html.INLINE else " " for t in tokens[lo:hi]).split()
        got = html.main_text(page.replace("article>", "div>"), w)[0].split()
        common = sum((Counter(want) & Counter(got)).values())
        f1.append(2 * common / max(1, len(want) + len(got)))
        # without the scans the page's words would all be there
        changed += got != "".join(html.unescape(t.text) if t.kind == "text" else " " for t in tokens).split()
    assert np.mean(f1) >= 0.98 and min(f1) >= 0.5 and changed >= 0.9 * len(f1)


def test_extract_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, PAGE, "y"), (None, "v", "<p>a b</p>", "z"), (2, None, PAGE, "y")], "page_id long, url string, html string, text string")
    got = html.extract_text(df, html.fit_weights(df)).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id == 1] == [""] and [r.text for r in got if r.page_id is None] == ["a b"]
    assert all(r.n_chars == len(r.text) for r in got)
    empty = df.limit(0)
    assert html.extract_text(empty, html.fit_weights(empty)).count() == 0


def test_escape_round_trip(spark):
    odd = ["", "\\", "\\\\l", "<turn a>\n</turn>\n", "#\\h#", "\\l<\\", "a > b & c", "\n\n", "é😀<"]
    df = spark.createDataFrame([(x,) for x in odd], "x string").select("x", chat.escape(F.col("x")).alias("e"))
    for r in df.select("x", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.x and "<" not in r.e and "#" not in r.e


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", "end", 0.5), (2, 1, None, "user", "alone", 0.0), (None, 7, 99, "user", None, None)]
    got = {(r.tree, r.rank): r for r in chat.conversations_of(spark, spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), branches=2).collect()}
    best, other = got[1, 1], got[1, 2]
    assert (best.leaf, best.n_turns, round(best.path_score, 6)) == (5, 4, 1.4) and (other.leaf, other.n_turns) == (2, 2)
    assert best.formatted == "<turn user>\nq</turn>\n<turn assistant>\ngood</turn>\n<turn user>\nmore</turn>\n<turn assistant>\nend</turn>\n"
    assert [best.formatted[s.start : s.start + s.length] for s in best.loss_spans] == ["good", "end"]
    assert got[2, 1].n_turns == 1 and got[None, 1].formatted == "<turn user>\n</turn>\n"


def test_chat_digests(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    by[-7] = [(t, role, text) for _, t, role, text in queries.CHAT_EXTRA]
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, sf).collect()}
    assert set(got) == set(by)
    for k, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_of_no_rows_and_of_clashing_columns(spark, tmp_path):
    rows = [(1, 1, "assistant", "b", 5, "x"), (1, 0, "user", None, 6, "y"), (2, 0, "assistant", "", 7, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node long, path string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest_rows(chat.conversations_of(spark, chat.linear_messages(df))).collect()}
    assert got == {1: (2, 1), 2: (1, 0)}
    df.limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [(r.conv_id, r.n_turns) for r in queries.op2_chat_format(spark, str(tmp_path)).collect()] == [(-7, 2)]


@pytest.mark.parametrize("most", [0, urls.BROADCAST_RULES])
def test_url_rules_beyond_the_broadcast_limit(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_RULES", most)
    rules = [urls.host_path_rule(f"h{i}.com", "a/" if i % 2 else "", "block") for i in range(300)] + [urls.host_path_rule("h7.com", "a/b/", "allow")]
    df = spark.createDataFrame([(i, f"http://www.h{i}.com/a/{'b/' if i % 3 == 1 else ''}") for i in range(400)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df, urls.rule_table(spark, rules)).collect()}
    want = {i: (f"h{i}.com/{'a/' if i % 2 else ''}", "block") if i < 300 else (None, "allow") for i in range(400)}
    assert got == want | {7: ("h7.com/a/b/", "allow")}


def test_url_rules(spark):
    cases = {
        "https://a.example.com/en/77?x": ("a.example.com", "/en/77", "example.com/en/7", "allow"), "http://EXAMPLE.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"), "x://b.example.net/de/81#f": ("b.example.net", "/de/81", "example.net/de/8", "block"), "x://net/de/": ("net", "/de/", "net/de/", "allow"),
        "http://www.cheap-pills.example.org/fr/1": ("www.cheap-pills.example.org", "/fr/1", None, "block"), "http://pillsbury.example.org/fr/1": ("pillsbury.example.org", "/fr/1", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://host.com": ("host.com", "", None, "allow"), "": ("", "", None, "allow"),
    }
    rules = [urls.host_path_rule(*r) for r in queries.URL_RULES] + [urls.word_rule(w) for w in urls.BLOCKED_WORDS] + [urls.host_path_rule("org", "", "allow")][:0]
    df = spark.createDataFrame([(i % 5 or None, u, "h") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string")
    got = urls.judge_urls(df, urls.rule_table(spark, rules)).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark, rules)).count() == 0
    with pytest.raises(ValueError):
        urls.rule_table(spark, [("r", ".*", [], 1, False, "block")])


def test_packing_is_a_partition_of_the_ids(spark, sf):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    model = Tokenizer.from_file(path)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-1, ""), (-2, None), (-3, "a <|endoftext|> b"), (-4, "  x\n\n y 's 12!! é"), (-5, "same"), (-5, "same")]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), path).collect()
    seqs, pieces = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024
    for doc, text in dict(docs).items():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[doc], key=lambda r: (r.start, r.sequence_id))
        copies = 2 if doc == -5 else 1
        assert sum(r.length for r in own) == copies * len(ids) and all(r.doc_tokens == len(ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_sum_of_squares_choice():
    rng = np.random.default_rng(2)
    for _ in range(60):
        window = 32
        count = rng.integers(0, 3, window + 1)
        count[0] = count[window] = 0
        size = int(rng.integers(1, window))
        cost = {}
        for h in range(0, window - size + 1):
            if h and not count[h]:
                continue
            after = count.copy()
            after[h] -= bool(h)
            after[h + size] += h + size < window
            cost[h] = int((after[1:window] ** 2).sum())
        assert cost[packing.best_level(count, size, window)] == min(cost.values())


def replayed(sizes, window):
    """(doc, start, length, sequence, offset) of a partition's documents by the rule itself; sizes: (doc, tokens) in order."""
    level, held, opened = {}, {}, 0
    count = [0] * (window + 1)
    for doc, n in sizes:
        for start in range(0, n, window):
            size = min(window, n - start)
            options = []
            for h in range(window - size + 1):
                if h and not count[h]:
                    continue
                change = (1 - 2 * count[h] if h else 0) + (1 + 2 * count[h + size] if h + size < window else 0)
                options.append((change, -h))
            h = -min(options)[1]
            if size == window:
                h = 0
            if h:
                w = level[h].pop()
                count[h] -= 1
            else:
                w, opened = opened, opened + 1
            held.setdefault(w, []).append((doc, start, size))
            if h + size < window:
                level.setdefault(h + size, []).append(w)
                count[h + size] += 1
    out, number = [], opened
    for w, pieces in sorted(held.items()):
        fill = sum(p[2] for p in pieces)
        edges = [0]
        while edges[-1] < fill and fill < window:
            edges.append(edges[-1] + (1 << ((fill - edges[-1]).bit_length() - 1)))
        if fill == window:
            edges, first = [0, window], w
        else:
            first, number = number, number + len(edges) - 1
        at = 0
        for doc, start, size in pieces:
            for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
                a, b = max(lo, at), min(hi, at + size)
                if a < b:
                    out.append((doc, start + a - at, b - a, first + i, a - lo))
            at += size
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 8, 32])
def test_every_piece_stays_where_the_rule_put_it(spark, sf, parts):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(parts).cache()
    order = df.select("doc_id", F.spark_partition_id().alias("p")).collect()
    got = packing.pack_documents(df, queries.tokenizer_path()).collect()
    tokens = {r.doc_id: r.doc_tokens for r in got}
    for p in range(parts):
        own = sorted((r.doc_id, r.start, r.length, r.sequence_id % packing.PER_PARTITION, r.offset) for r in got if r.sequence_id // packing.PER_PARTITION == p)
        assert own == replayed([(r.doc_id, tokens[r.doc_id]) for r in order if r.p == p], packing.WINDOW)
    df.unpersist()


def planted(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    items = [(f"i{n}", " ".join(word() for _ in range(rng.choice([3, 10, 14, 25])))) for n in range(12)] + [("same", None), ("none", ""), ("twin", "aa bb"), ("i0", "cc dd ee"), ("i0", "cc dd ee")]
    docs = []
    for n in range(60):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            it = rng.choice(items)[1] or ""
            at = rng.randint(0, len(w))
            cut = it.split()
            if rng.random() < 0.4 and cut:
                cut[rng.randrange(len(cut))] = "zz"
            w[at:at] = [c.upper() if rng.random() < 0.3 else c for c in cut]
        docs.append((n, ", ".join(w)))
    return docs + [(100, None), (101, ""), (None, docs[5][1]), (7, docs[7][1]), (200, "x cc, DD ee y"), (201, "aa bb cc dd ee")], items


def expected_hits(text, items, size=10):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    w, hit, found = cut(text), set(), set()
    for name, t in items:
        x = cut(t)
        k = min(size, len(x))
        for i in range(len(x) - k + 1 if x else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == x[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [2_000_000, 60])
def test_decontamination_against_a_scan(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", most)
    docs, items = planted(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as k", "'x' as item")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.find_benchmark(d, b).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        n, hit, found = expected_hits(texts[r.doc], items)
        assert (r.n_words, r.n_hit, sorted({s["item"] for s in r.spans})) == (n, hit, found)
    kept = decontam.find_benchmark(d, b, keep=True)
    assert kept.columns[:4] == ["doc_id", "text", "k", "item"] and kept.filter("__n_hit = 0").count() == sum(expected_hits(t, items)[1] == 0 for _, t in docs)
    assert decontam.report(decontam.find_benchmark(d.limit(0), b)).count() == 0
    assert decontam.report(decontam.find_benchmark(d, b.limit(0))).filter("contaminated").count() == 0


def near_plainly(doc, item, size, slop):
    """Every window all of whose words stand in the document with shifts within the slop, and the least shift, by trying all of them."""
    size, out = min(size, len(item)), []
    for pos in range(len(item) - size + 1):
        shifts = [[p - i for p, w in enumerate(doc) if w == item[i]] for i in range(pos, pos + size)]
        low = [s for s in sorted({s for x in shifts for s in x}) if all(any(s <= t <= s + slop for t in x) for x in shifts)]
        if low:
            out.append((pos, low[0]))
    return out


@pytest.mark.parametrize("most", [2_000_000, 20])
@pytest.mark.parametrize("slop", [0, 2])
def test_near_matches_against_a_scan(spark, monkeypatch, most, slop):
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", most)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    items = [[word() for _ in range(rng.randint(1, 9))] for _ in range(8)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            part = list(rng.choice(items))
            if rng.random() < 0.6 and len(part) > 2:
                j = rng.randrange(len(part) - 1)
                part[j], part[j + 1] = part[j + 1], part[j]
            if rng.random() < 0.4:
                part.insert(rng.randrange(len(part) + 1), word())
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((i, " ".join(text)))
    d = spark.createDataFrame([*docs, (90, None), (91, "")], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(70, None)], "item_id long, text string")
    found = decontam.find_benchmark(d, b, size=5, slop=slop)
    got = {r.doc: sorted((int(x.item), x.pos, x.shift) for x in r.near) for r in found.collect()}
    want = {i: sorted((k, *x) for k, item in enumerate(items) for x in near_plainly(t.split(), item, 5, slop)) for i, t in docs} | {90: [], 91: []}
    assert got == want and sum(map(len, want.values())) > 20
    report = {r.doc_id: r.n_near for r in decontam.report(found).collect()}
    assert report == {k: len({x[0] for x in v}) for k, v in want.items()}
    assert all(r.n_items <= r.n_near for r in decontam.report(found).collect())


@pytest.mark.parametrize("piece", ["<a", "<a b='", "<a b='\"", "<script", "<!", "</", "<", "<a 'b>", "<div>", "<article>x "])
def test_broken_markup_is_read_in_linear_time(piece):
    page = piece * (400_000 // len(piece))
    weights = html.weights_of({})
    for whole in (page, page + ">", page + "</article>x" * 1000):
        began = time.time()
        html.main_text(whole, weights)
        html.label_counts(whole)
        assert time.time() - began < 4


def test_broken_markup_and_huge_references():
    read = lambda page: [(t.kind, t.text) for t in html.read(page)[0]]
    assert read("<a b='x>y</a>z") == [("open", "a"), ("text", "y"), ("close", "a"), ("text", "z")]
    assert read("<a b='x>y' c=\">\">z") == [("open", "a"), ("text", "z")]
    assert read("1 < 2 <b>3<i") == [("text", "1 < 2 "), ("open", "b"), ("text", "3")]
    assert read("<SCRIPT>a<b></script >c<!-- d") == [("open", "script"), ("text", "c")]
    assert html.decoded("&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65;&amp;&#x42") == "�A&B"


def test_very_long_white_space_has_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, given = packing.encoder(path, 0), Tokenizer.from_file(path)
    rng = random.Random(6)
    pieces = ["ab", "\n" * 1001 + " ", "  " * 600 + "\t", "x!", "<|endoftext|>", "\x85" * 1005, "\xa0" * 1200 + "\n", "\x1c" * 1100, "'s", " z"]
    texts = ["".join(rng.choice([*pieces, " " * rng.randint(990, 1100)]) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    texts += [" " * 5_000_000, "a" + "\n" * 5_000_000 + "b"]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == [*given.encode(text, add_special_tokens=False).ids, 0]


def test_packing_of_a_document_of_white_space(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(1, " " * 1_500_000), (2, "x" + "\n" * 1_500_000 + "y"), (3, None)], "doc_id long, text string")
    made = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(made) == 3 and all(r[1] == r[2] for r in made)
