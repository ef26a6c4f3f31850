"""Main text of web pages: the maximum-scoring contiguous run of tokens.

A page is read as tokens: words, which score positive, and tags, which score negative.  Weights are log ratios of how often a
token occurs inside and outside the content, counted by Spark over a bounded sample of labelled pages: those with an ``article``
element, of which the one with most words is the content, or else a ``main`` element.  The labels themselves, ``article`` and
``main``, have no weight of their own.  An element is known by its class names and id, where the labelled pages have shown these
often enough, else by the first part of such a name, else by its tag; an element that holds the content counts as inside.  No
class or id is known beforehand; tags begin with a weight (menus, footers, asides and forms below others), from which the counts
move them.  Words inside elements of clearly negative weight are worth less, by the same weight.

Two linear passes find the answer.  The first sums up the elements from the inside out and cuts those worth less than -``GAP``;
what is cut doesn't count in the elements around it.  The second takes a cut element as one token of score -``GAP`` and finds the run
of greatest sum.

Character references are decoded after the markup is cut.  Inside a block white space becomes one space; blocks follow each
other in page order, joined by one space.  Inline tags leave no trace.  Scripts, styles, titles and comments are markup.

Null and empty pages, and pages without words of a positive run, give an empty text.  Unclosed and truncated markup is read as far
as it goes; an element that is never closed, though its end tag may not be left out, has no span: it can't be cut and its words
are worth what others are.  Of runs with equal sums the first and shortest counts.  Repeated rows give the same text; an empty table gives
an empty table.  Columns besides the key, the URL and the page don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: labelled pages that the weights are counted on at most, those of smallest hash of their key
MAX_LABELLED = 2000
#: weights of tags before any page is counted: fixed by what HTML says an element is for; all others have the last one
PRIOR = (
    {"word": 0.5, "a": -0.3, "div": -0.1, "section": -0.1, "article": -0.02, "main": -0.02, "body": -0.02, "html": -0.02}
    | dict.fromkeys("head nav footer".split(), -4.0)
    | dict.fromkeys(["aside"], -3.0)
    | dict.fromkeys("header form button select option dialog menu object canvas audio video map fieldset legend label datalist".split(), -2.5)
    | dict.fromkeys("script style noscript template textarea title iframe svg".split(), -1.0)
    | dict.fromkeys("p br h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th caption blockquote pre figure figcaption hr img".split(), -0.1)
    | dict.fromkeys("b i em strong span u s small sub sup code mark abbr cite q time font".split(), -0.02)
)
OTHER = -0.2
#: how many sightings of a token weigh as much as its prior weight, and how many make a class name known
PRIOR_COUNT, LEAST_SEEN = 5, 3
#: weights of tags lie between these below zero; from STRONG on they lessen the worth of the words inside
LEAST, MOST, STRONG = 0.02, 12.0, 1.5
#: what a cut costs
GAP = 1.0

_RAW = "script|style|noscript|template|textarea|title|iframe|svg"
#: tags without angle brackets in quotes, which are nearly all; a try never looks beyond the next bracket
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"<>]*\"|'[^'<>]*'|[^'\"<>])*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile("[\"'>]")
_RAW_NAME = re.compile(rf"(?:{_RAW})\Z", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _RAW.split("|")}
_ZEROS, _HUGE = re.compile("&#0+(?=[0-9])"), re.compile("&#0*[1-9][0-9]{7,};?")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
#: fixed values of HTML: elements within a line, those without an end tag, those whose end tag may be left out, and what a role equals
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDLESS = frozenset("p li dt dd td th tr thead tbody tfoot option optgroup colgroup".split())
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "menu": "menu"}
_NONE: tuple[str, ...] = ()


class Token(NamedTuple):
    kind: str  # text, open or close
    text: str  # the text, or the name of the tag
    names: tuple[str, ...] = _NONE  # class names and id
    hidden: bool = False


def _attributes(name: str, attrs: str) -> tuple[str, tuple[str, ...], bool]:
    """(tag, or the one that the role equals; names; whether it is never shown)"""
    names, hidden = [], False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            names += value.split()
        elif key == "role":
            name = ROLES.get(value, name)
        else:
            hidden |= key == "hidden" or value == "true" or "display:none" in value.replace(" ", "")
    return name, tuple(names), hidden


class Markup:
    """The tags of a page in order, by one forward scan: (start, end, kind, name, attributes), where kind is open, close or raw
    (an element whose content is no text), or empty for what leaves no token.

    A tag ends at the first > outside quotes, else at the first one.  No character is looked at more often than a fixed number of
    times, whatever the markup: where the last bracket and the last quotes stand is known, and where a scan from inside a tag gets
    to is remembered for every quote that it passes."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.beyond: dict[int, int] = {}
        self.special = (-1, -1)

    def tags(self) -> Iterator[tuple[int, int, str, str, str]]:
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            found = self.tag(at)
            if found is None:
                at += 1
            else:
                yield (at, *found)
                at = found[0]

    def tag(self, at: int) -> tuple[int, str, str, str] | None:
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (len(page) if end < 0 else end + 3), "", "", ""
        m = _PLAIN.match(page, at)
        if m and not (not m[1] and _RAW_NAME.match(m[2])):
            return m.end(), "close" if m[1] else "open", m[2], m[3]
        if at >= self.last:
            # cut off by the end of the page
            cut = page.find("<", at + 1) < 0 and _NAME.match(page, at)
            return (len(page), "", "", "") if cut else None
        if page[at + 1] in "!?":
            return page.index(">", at) + 1, "", "", ""
        m = _NAME.match(page, at)
        if not m:
            return None
        if not m[1] and _RAW_NAME.match(m[2]):
            end = _RAW_END[m[2].lower()].search(page, page.index(">", m.end()) + 1)
            return (end.end() if end else len(page)), "raw", m[2], ""
        end = self.outside(m.end())
        if end < 0:
            end = page.index(">", m.end())
        return end + 1, "close" if m[1] else "open", m[2], page[m.end() : end]

    def next_special(self, at: int) -> int:
        lo, hi = self.special
        if not lo <= at <= hi:
            m = _SPECIAL.search(self.page, at)
            self.special = (at, m.start() if m else len(self.page))
        return self.special[1]

    def outside(self, at: int) -> int:
        """The first > outside quotes from here on, or -1."""
        passed, here = [], self.next_special(at)
        while True:
            if here >= len(self.page):
                result = -1
            elif self.page[here] == ">":
                result = here
            elif here in self.beyond:
                result = self.beyond[here]
            elif here >= self.last_quote[self.page[here]]:
                result = -1
            else:
                passed.append(here)
                m = _SPECIAL.search(self.page, self.page.index(self.page[here], here + 1) + 1)
                here = m.start() if m else len(self.page)
                continue
            self.beyond.update(dict.fromkeys(passed, result))
            return result


def read(page: str) -> tuple[list[Token], list[int]]:
    """The tokens of a page, and for each opening tag the number of the first token after its element (0: no span)."""
    out: list[Token] = []
    ends: list[int] = []
    stack: list[tuple[str, int]] = []
    open_names: Counter = Counter()
    at = 0

    def add(token: Token) -> None:
        out.append(token)
        ends.append(0)

    for start, end, kind, name, attrs in Markup(page).tags():
        if start > at:
            add(Token("text", page[at:start]))
        at = end
        if not kind:
            continue
        name = name.lower()
        if kind == "raw":
            add(Token("open", name))
            continue
        if kind == "close":
            add(Token("close", name))
            while open_names[name]:
                open_name, i = stack.pop()
                open_names[open_name] -= 1
                if open_name == name:
                    ends[i] = len(out)
                    break
                if open_name in ENDLESS:
                    ends[i] = len(out) - 1
            continue
        role, names, hidden = _attributes(name, attrs) if attrs and not attrs.isspace() else (name, _NONE, False)
        if name in ENDLESS and stack and stack[-1][0] == name:
            ends[stack.pop()[1]] = len(out)
            open_names[name] -= 1
        add(Token("open", role, names, hidden))
        if name not in VOID and not attrs.endswith("/"):
            stack.append((name, len(out) - 1))
            open_names[name] += 1
    if at < len(page):
        add(Token("text", page[at:]))
    for name, i in stack:
        if name in ENDLESS or name in ("html", "body"):
            ends[i] = len(out)
    return out, ends


def labelled(tokens: list[Token], ends: list[int]) -> tuple[int, int] | None:
    """First and after-last token of the content of a labelled page."""
    before = [0, *accumulate(len(t.text.split()) if t.kind == "text" else 0 for t in tokens)]
    for label in ("article", "main"):
        spans = [(before[end] - before[i], -i, end) for i, (t, end) in enumerate(zip(tokens, ends, strict=True)) if end and t.text == label]
        if spans:
            _, i, end = max(spans)
            return -i, end
    return None


def _keys(t: Token) -> list[str]:
    """What an element is counted as."""
    return [*["." + n for n in dict.fromkeys(t.names)], *[n + "-*" for n in dict.fromkeys(re.split("[-_]", n)[0] for n in t.names)]] if t.names else [t.text]


def label_counts(page: str) -> Counter:
    """(token, inside the content) of a labelled page; what stands inside menus, footers and the like is theirs and isn't counted."""
    counts: Counter = Counter()
    tokens, ends = read(page)
    content = labelled(tokens, ends)
    if content is None:
        return counts
    skip = 0
    for i, t in enumerate(tokens):
        if i < skip:
            continue
        inside = content[0] <= i < content[1]
        if t.kind == "text":
            counts["word", inside] += len(t.text.split())
        elif t.kind == "open" and t.text not in ("article", "main") or t.names:
            holds = i < content[0] and ends[i] >= content[1]
            aside = not holds and PRIOR.get(t.text, OTHER) <= -STRONG
            skip = ends[i] if aside else skip
            # a label covers the whole article and says nothing of the asides and forms in it
            for key in _NONE if aside and inside else _keys(t):
                counts[key, inside or holds] += 1
    return counts


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log ratios, drawn to the prior weight where a token is rare; above zero for words and below it for tags."""
    total = {side: sum(n for (_, s), n in counts.items() if s is side) for side in (True, False)}
    out = dict(PRIOR)
    if not total[True]:
        return out
    for name in sorted({k for k, _ in counts}):
        inside, outside = counts.get((name, True), 0), counts.get((name, False), 0)
        seen = inside + outside
        if seen < LEAST_SEEN and name not in PRIOR:
            continue
        ratio = math.log((inside + 0.5) / (total[True] + 1)) - math.log((outside + 0.5) / (total[False] + 1))
        out[name] = (seen * ratio + PRIOR_COUNT * PRIOR.get(name, OTHER)) / (seen + PRIOR_COUNT)
    word = min(1.0, max(0.25, out.pop("word")))
    return {name: max(-MOST, min(-LEAST, w)) for name, w in out.items()} | {"word": word, "article": -LEAST, "main": -LEAST}


def weight_of(t: Token, weights: dict[str, float]) -> float:
    """Of a tag: the mean of its known names, of the known first parts of its names, or the tag's own."""
    if t.names:
        for keys in (["." + n for n in t.names], [re.split("[-_]", n)[0] + "-*" for n in t.names]):
            known = [weights[k] for k in keys if k in weights]
            if known:
                return sum(known) / len(known)
    return weights.get(t.text, OTHER)


def token_scores(tokens: list[Token], ends: list[int], weights: dict[str, float]) -> list[float]:
    """Words above zero, tags below; a closing tag scores as its opening one, and a hidden element as the least."""
    out, around, closing = [], [], {}
    for i, t in enumerate(tokens):
        while around and around[-1][0] <= i:
            around.pop()
        if t.kind == "text":
            out.append(len(t.text.split()) * weights["word"] * (math.exp(around[-1][1] / 2) if around else 1.0))
        elif t.kind == "close":
            out.append(closing.get(i, weights.get(t.text, OTHER)))
        else:
            w = -math.inf if t.hidden and ends[i] else weight_of(t, weights)
            out.append(w)
            if ends[i]:
                closing[ends[i] - 1] = w
                if w <= -STRONG:
                    around.append((ends[i], min(w, around[-1][1]) if around else w))
    return out


def cut_elements(scores: list[float], ends: list[int]) -> list[tuple[int, int]]:
    """Spans of the outermost elements that are worth less than -``GAP``, in one pass from the inside out."""
    cuts: list[tuple[int, int]] = []
    open_: list[list] = [[len(scores) + 1, 0, 0.0]]

    def finish(i: int) -> None:
        while open_[-1][0] <= i:
            end, start, total = open_.pop()
            if total < -GAP:
                while cuts and cuts[-1][0] > start:
                    cuts.pop()
                cuts.append((start, end))
                total = 0.0
            open_[-1][2] += total

    for i, s in enumerate(scores):
        finish(i)
        if ends[i]:
            # an element can't outlast the one around it
            open_.append([min(ends[i], open_[-1][0]), i, 0.0])
        open_[-1][2] += s
    finish(len(scores))
    return cuts


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and after-last index of the run of greatest sum, in one pass; (0, 0) if no sum is positive.

    Of equal sums the run that ends first counts, and of those the one that begins last."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def decoded(text: str) -> str:
    """Character references as characters; numbers beyond Unicode, however long, are the replacement character."""
    if "&" not in text:
        return text
    return unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#0", text)) if "&#" in text else text)


def main_text(page: str, weights: dict[str, float]) -> tuple[str, float]:
    """Text and score of the best run."""
    tokens, ends = read(page)
    scores = token_scores(tokens, ends, weights)
    parts, left, at = [], [], 0
    for start, end in [*cut_elements(scores, ends), (len(tokens), len(tokens))]:
        for t in tokens[at:start]:
            parts.append(decoded(t.text) if t.kind == "text" else "" if t.text in INLINE else " ")
        left += scores[at:start]
        if end > start:
            parts.append(" ")
            left.append(-GAP)
        at = end
    lo, hi = best_run(left)
    return " ".join("".join(parts[lo:hi]).split()), sum(left[lo:hi])


def fit_weights(pages: DataFrame, key: str = "page_id", html: str = "html", max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Weights from at most ``max_labelled`` of the labelled pages."""
    marked = pages.select(pages[key].alias("k"), pages[html].alias("h")).filter(F.col("h").rlike(r"(?i)<(article|main)[\s/>]") & F.col("k").isNotNull())
    chosen = marked.select("k", F.xxhash64("k").alias("x")).orderBy("x", "k").limit(max_labelled).select("k").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                total += label_counts(x.as_py())
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], ["name", "content", "n"])

    # the ids chosen are few by construction
    sample = marked.join(F.broadcast(chosen), "k", "left_semi").select("h")
    counted = sample.mapInArrow(run, "name string, content boolean, n long").groupBy("name", "content").agg(F.sum("n").alias("n"))
    return weights_of({(r.name, r.content): r.n for r in counted.collect()})


def extract_text(pages: DataFrame, weights: dict[str, float], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars, score of each page."""
    given = pages.select(pages[key].alias("k"), pages[url].alias("u"), pages[html].alias("h"))
    kind, address = given.schema["k"].dataType.simpleString(), given.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = [], []
            for x in batch.column(2):
                text, score = main_text(x.as_py() or "", weights)
                texts.append(text)
                scores.append(score)
            made = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made, pa.array([len(t) for t in texts], pa.int64()), pa.array(scores, pa.float64())], ["k", "u", "text", "n_chars", "score"])

    out = given.mapInArrow(run, f"k {kind}, u {address}, text string, n_chars long, score double")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars", "score")
