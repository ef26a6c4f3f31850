"""Text as Column expressions: tokens, units, numbers, sentences, prefixes, identifiers and clean-up.

All functions take and give Columns, run inside generated code, and treat null as empty text unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token, a number, a CJK character.
TOKEN = r"([A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|[一-鿿])"
ENGLISH = r"([A-Za-z0-9]+(?:'[A-Za-z0-9]+)?)"
NUMBER = r"(\b\d+(?:[.,:/-]\d+)*\b)"
CHUNK_NUMBER = r"(\d+(?:[.,]\d+)?)"
NOT_CJK = r"[^一-鿿]"
CJK_LANGS = ("zh", "ja", "ko")

# Source languages and their other names.
LANG_NAMES = {
    "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es", "por": "pt", "portuguese": "pt", "deu": "de", "ger": "de", "german": "de",
}
SOURCE_LANGS = ("fr", "es", "pt", "de")

# What is cut off a completion.
END_TOKENS = ("<|im_end|>", "<|endoftext|>")
ANSWER_PREFIXES = ("Compressed translation:", "Translation:", "Answer:", "译文：", "译文:", "压缩译文：", "压缩译文:")


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(_text(x), F.lit(pattern), F.lit(1))


def is_cjk(lang: Column, langs: tuple[str, ...] = CJK_LANGS) -> Column:
    """Language codes that begin with one of the given ones; null is none of them."""
    low = F.lower(_text(lang))
    found = F.lit(False)
    for x in langs:
        found = found | low.startswith(x)
    return found


# T1 - T3
def tokenize(x: Column) -> Column:
    """Lower-case words of ASCII letters and digits, and single CJK characters."""
    return F.transform(_all(x, TOKEN), F.lower)


def token_count(x: Column) -> Column:
    return F.size(_all(x, TOKEN))


def cjk_count(x: Column) -> Column:
    return F.length(F.regexp_replace(_text(x), NOT_CJK, ""))


def unit_count(x: Column, lang: Column) -> Column:
    """CJK characters for zh, ja and ko unless there are none; else tokens."""
    return F.when(is_cjk(lang) & (cjk_count(x) > 0), cjk_count(x)).otherwise(token_count(x))


def builder_units(x: Column, lang: Column) -> Column:
    """The training-set builder's own count: CJK characters for zh, without falling back; else words."""
    return F.when(is_cjk(lang, ("zh",)), cjk_count(x)).otherwise(F.size(_all(x, ENGLISH)))


def normalize(x: Column) -> Column:
    return F.array_join(tokenize(x), " ")


# T4 - T6
def coverage_units(x: Column, lang: Column) -> Column:
    """CJK characters for zh, ja and ko; else lower-case runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(_text(x)), r"[^\p{L}\p{N}]+", " "))
    other = F.filter(F.split(plain, " "), lambda t: t != "")
    cjk = F.filter(F.split(F.regexp_replace(_text(x), NOT_CJK, ""), ""), lambda t: t != "")
    return F.when(is_cjk(lang), cjk).otherwise(other)


def alignment_text(x: Column) -> Column:
    return F.regexp_replace(_text(x), r"[\p{P}\p{S}\s]", "")


def alignment_units(x: Column) -> Column:
    """Characters without white space, punctuation and symbols."""
    return F.filter(F.split(alignment_text(x), ""), lambda t: t != "")


def prefix_unit_count(x: Column, chars: Column) -> Column:
    """How many alignment units the first ``chars`` characters hold."""
    return F.length(alignment_text(F.substr(_text(x), F.lit(1), chars)))


def latency_units(x: Column, lang: Column) -> Column:
    """Characters but white space for zh and ja; else words between white space."""
    chars = F.filter(F.split(F.regexp_replace(_text(x), r"\s", ""), ""), lambda t: t != "")
    words = F.filter(F.split(_text(x), r"\s+"), lambda t: t != "")
    return F.when(is_cjk(lang, ("zh", "ja")), chars).otherwise(words)


# T7 - T9
def has_spoken(x: Column) -> Column:
    return _text(x).rlike(r"[\p{L}\p{N}]")


def spoken_chars(x: Column) -> Column:
    return F.length(F.regexp_replace(_text(x), r"[^\p{L}\p{N}]", ""))


def english_words(x: Column) -> Column:
    return F.transform(_all(x, ENGLISH), F.lower)


def numbers(x: Column) -> Column:
    return _all(x, NUMBER)


def chunk_numbers(x: Column) -> Column:
    return _all(x, CHUNK_NUMBER)


# T10
def split_sentences(x: Column, lang: Column, long_text: int = 800, units: int = 80) -> Column:
    """Sentences, trimmed; a single long one is cut into pieces of ``units`` words, or characters for zh and ja."""
    text = collapse(x)
    cjk = is_cjk(lang, ("zh", "ja"))
    pieces = F.when(cjk, F.split(text, r"(?<=[。！？!?])\s*")).otherwise(F.split(text, r"(?<=[.!?])\s+"))
    pieces = F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")
    words = F.split(text, " ")
    n = F.ceil(F.size(words) / units).cast("int")
    by_words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * units + 1, F.lit(units)), " "))
    by_chars = F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"((?:.{{{units - 1}}}\s*\S)|.+)"), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "")
    cut = F.when(~cjk & (F.size(words) > 1), by_words).otherwise(by_chars)
    return F.when(text == "", F.array().cast("array<string>")).when((F.size(pieces) <= 1) & (F.length(text) > long_text), cut).otherwise(pieces)


# T12
def span_by_ratio(units: Column, lo: Column, hi: Column, joiner: str = " ") -> Column:
    """The units between two shares of the whole, rounded half to even."""
    n = F.size(units)
    first = F.least(n, F.greatest(F.lit(0), F.bround(lo * n, 0).cast("int")))
    last = F.least(n, F.greatest(first, F.bround(hi * n, 0).cast("int")))
    return F.array_join(F.slice(units, first + 1, last - first), joiner)


def context_by_time(text: Column, units: Column, start_s: Column, end_s: Column, total_s: Column, context_s: float, joiner: str = " ") -> Column:
    """What is said from ``context_s`` before a span of audio to as long after it, with its times, by the shares of the whole's duration.

    Without a duration: the whole text, from 0 to 0."""
    lo, hi = F.greatest(F.lit(0.0), start_s - context_s), F.least(total_s, end_s + context_s)
    known = F.coalesce(total_s > 0, F.lit(False))
    part = F.when(known, span_by_ratio(units, lo / total_s, hi / total_s, joiner)).otherwise(text)
    return F.struct(part.alias("text"), F.when(known, lo).otherwise(F.lit(0.0)).alias("start_s"), F.when(known, hi).otherwise(F.lit(0.0)).alias("end_s"))


def detokenize(x: Column) -> Column:
    """No space before closing punctuation nor after opening brackets."""
    tight = F.regexp_replace(collapse(x), r"\s+([,.;:!?%)\]}])", "$1")
    return F.regexp_replace(tight, r"([(\[{])\s+", "$1")


# T13
def join_tokens(tokens: Column) -> Column:
    """A space before tokens that begin with an ASCII letter or digit, none before others."""
    return F.ltrim(F.array_join(F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit("^[A-Za-z0-9]")), F.concat(F.lit(" "), t)).otherwise(t)), ""))


def text_ticks(x: Column, duration_s: Column, chunk_s: float) -> Column:
    """array of (tick, start_s, end_s, chunk, prefix): the tokens (words and single other characters) dealt evenly over
    ceil(duration / chunk) ticks with rounded edges, one at least in each while there are any; empty without tokens."""
    tokens = F.regexp_extract_all(_text(x), F.lit(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|\S"), F.lit(0))

    def edge(s: Column, i: Column) -> Column:
        return F.bround(F.size(s["tokens"]) * i / s["count"], 0).cast("int")

    def said(tokens: Column) -> Column:
        # as join_tokens, by the whole text: no token holds a space, and only words keep the one before them
        return F.regexp_replace(F.concat(F.lit(" "), F.array_join(tokens, " ")), " (?![A-Za-z0-9])", "")

    def cut(s: Column) -> Column:
        # what lies between two edges; between equal ones the next token is said, if there is one.  Tokens go no further, as each step copies what it hands on
        def between(i: Column) -> Column:
            lo, hi = edge(s, i), edge(s, i + 1)
            return F.struct((hi <= lo).alias("again"), said(F.slice(s["tokens"], lo + 1, F.greatest(F.lit(1), hi - lo))).alias("said"))

        return F.struct(*[s[c].alias(c) for c in ("count", "duration")], F.transform(F.sequence(F.lit(0), s["count"] - 1), between).alias("between"))

    def upto(s: Column) -> Column:
        # how many characters lie before each edge, behind the space before the first word
        own = F.transform(s["between"], lambda t: F.when(t["again"], "").otherwise(t["said"]))
        whole = F.array_join(own, "")
        ends = F.aggregate(own, F.array(F.when(F.startswith(whole, F.lit(" ")), -1).otherwise(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t))))
        return F.struct(*[s[c].alias(c) for c in ("count", "duration", "between")], ends.alias("ends"), F.ltrim(whole).alias("whole"))

    def ticks(s: Column) -> Column:
        def one(i: Column) -> Column:
            own = F.get(s["between"], i)
            more = F.when(own["again"], F.length(own["said"])).otherwise(0)
            return F.struct(
                i.cast("int").alias("tick"), F.bround(i * chunk_s, 6).alias("start_s"), F.bround(F.least(s["duration"], (i + 1) * chunk_s), 6).alias("end_s"),
                F.ltrim(own["said"]).alias("chunk"), F.substring(s["whole"], F.lit(1), F.get(s["ends"], i + 1) + more).alias("prefix"),
            )

        return F.transform(F.sequence(F.lit(0), s["count"] - 1), one)

    # each step is bound once, so that the text is cut once
    given = F.array(F.struct(tokens.alias("tokens"), F.greatest(F.lit(1), F.ceil(duration_s / chunk_s).cast("int")).alias("count"), duration_s.alias("duration")))
    some = F.filter(given, lambda s: F.size(s["tokens"]) > 0)
    return F.get(F.transform(F.transform(F.transform(some, cut), upto), ticks), 0)


# T14
def cjk_prefix(x: Column, n: int) -> Column:
    """Up to and with what follows the n-th CJK character before the next one; the whole text if it has fewer."""
    found = F.regexp_extract(_text(x), rf"(?s)^((?:[^一-鿿]*[一-鿿]){{{n}}}[^一-鿿]*)", 1)
    return F.when(cjk_count(x) <= n, _text(x)).otherwise(found)


# T16
def canonical_model(x: Column) -> Column:
    """The first of kit, seed, gemini, chatgpt that the name holds; else the name itself."""
    low = F.lower(_text(x))
    out = F.when(low.contains("kit"), "kit").when(low.contains("seed"), "seed").when(low.contains("gemini"), "gemini")
    return out.when(low.contains("openai") | low.contains("chatgpt") | low.contains("gpt"), "chatgpt").otherwise(_text(x))


def chunk_ms(stated: Column, display: Column) -> Column:
    """A stated number, else the seconds in a label as milliseconds."""
    seconds = F.regexp_extract(_text(display), r"([0-9]+(?:\.[0-9]+)?)\s*s", 1).try_cast("double") * 1000
    return F.coalesce(stated.try_cast("int"), F.bround(seconds, 0).cast("int"))


def canonical_label(label: Column, model: Column, ms: Column) -> Column:
    """Spellings of a system's label at a chunk length as one."""
    low, size = F.lower(_text(label)), ms.cast("string")
    names = {"chatgpt": (("openai", "chatgpt"), "openai"), "gemini": (("gemini",), "gemini"), "seed": (("seed", "seed_ast"), "seed")}
    out = F.when(ms.isNull(), _text(label))
    for key, (heads, name) in names.items():
        spellings = [F.concat(F.lit(h + joint), size) for h in heads for joint in ("_", "_chunk")]
        out = out.when((model == key) & F.array_contains(F.array(*spellings), low), F.concat(F.lit(name + "_"), size))
    return out.when((model == "kit") & (low == F.concat(F.lit("kit_"), size)), F.concat(F.lit("kit_"), size)).otherwise(_text(label))


def row_key(run: Column, model: Column, ms: Column, label: Column) -> Column:
    return F.concat_ws("||", _text(run), model, F.coalesce(ms.cast("string"), F.lit("")), canonical_label(label, model, ms))


# P3 - P8
def source_lang(x: Column) -> Column:
    """Two-letter code without region, by code or name; null for languages not supported."""
    low = F.substring_index(F.replace(F.lower(F.trim(_text(x))), F.lit("_"), F.lit("-")), "-", 1)
    names = F.create_map(*[F.lit(v) for pair in LANG_NAMES.items() for v in pair])
    code = F.coalesce(F.try_element_at(names, low), low)
    return F.when(code.isin(*SOURCE_LANGS), code)


def lang_matches(x: Column, wanted: str, aliases: dict[str, tuple[str, ...]]) -> Column:
    return F.lower(_text(x)).isin(wanted, *aliases.get(wanted, ()))


def safe_id(x: Column, default: str = "sample", size: int = 180) -> Column:
    cut = F.substring(F.regexp_replace(_text(x), r"[^A-Za-z0-9_.-]+", "_"), 1, size)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def row_id(stated: Column, audio: Column) -> Column:
    """A stated id, else the third part from the end of the audio path, else its last."""
    parts = F.split(F.regexp_replace(_text(audio), r"/+$", ""), "/")
    return safe_id(F.coalesce(F.nullif(stated, F.lit("")), F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-1))))


def base_id(x: Column, chunks: bool = True) -> Column:
    """The id before ``__speed_``, else before ``__chunk_`` if wanted, else whole."""
    out = F.when(x.contains("__speed_"), F.substring_index(x, "__speed_", 1))
    if chunks:
        out = out.when(x.contains("__chunk_"), F.substring_index(x, "__chunk_", 1))
    return out.otherwise(x)


def collapse(x: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_text(x), r"(?U)\s+", " "))


def without_spaces(x: Column) -> Column:
    return F.regexp_replace(_text(x), r"(?U)\s+", "")


def without_lang_tag(x: Column) -> Column:
    return F.trim(F.regexp_replace(_text(x), r"^\[[a-zA-Z_-]+\]\s*", ""))


def clean_completion(x: Column, thinking: bool = False) -> Column:
    """A model's answer without end tokens, fences, announced prefixes (each once, in order) and paired quotes."""
    out = F.regexp_replace(_text(x), r"(?s)<think>.*?</think>", "") if thinking else _text(x)
    for token in END_TOKENS:
        out = F.replace(out, F.lit(token), F.lit(""))
    out = _strip(F.regexp_replace(_strip(out), r"^`+|`+$", ""))
    # a fold names each step's text once; nested conditions would double the expression with every prefix
    cut = lambda said, prefix: F.when(F.startswith(said, prefix), _strip(F.substr(said, F.length(prefix) + 1))).otherwise(said)
    return F.aggregate(F.array(*[F.lit(p) for p in ANSWER_PREFIXES]), out, cut, lambda said: collapse(_unquoted(said)))


def _unquoted(x: Column) -> Column:
    paired = (x.startswith('"') & x.endswith('"')) | (x.startswith("'") & x.endswith("'"))
    return F.when(paired, F.substr(x, F.lit(2), F.greatest(F.lit(0), F.length(x) - 2))).otherwise(x)


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


# P18
def json_object(x: Column) -> Column:
    """From the first opening brace to the last closing one; null without."""
    return F.nullif(F.regexp_extract(_text(x), r"(?s)(\{.*\})", 1), F.lit(""))


# IO14
def audio_span(uri: Column) -> Column:
    """path:offset:frames as a struct; the numbers are null where the ending isn't there."""
    pattern = r"^(.*):(\d+):(\d+)$"
    whole = F.regexp_extract(_text(uri), pattern, 1)
    path = F.when(whole == "", uri).otherwise(whole)
    return F.struct(path.alias("path"), F.regexp_extract(_text(uri), pattern, 2).try_cast("long").alias("offset"), F.regexp_extract(_text(uri), pattern, 3).try_cast("long").alias("frames"))
