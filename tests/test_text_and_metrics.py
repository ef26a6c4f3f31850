"""Text functions and scores: literal cases, and plain code for the sequential ones."""

import json
import random
import re
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillstone.functions import arrow, metrics as M, records as R, text as T
from rillstone.operators import scoring as C


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "lang", "tokens", "units", "builder"), [("hello world 123", "en", 3, 3, 3), ("hello 世界", "zh", 3, 2, 2), ("hello", "zh", 1, 1, 0), ("don't stop", "en", 2, 2, 2), ("世界 abc", "ja", 3, 2, 1), ("", "en", 0, 0, 0)])
def test_units(spark, text, lang, tokens, units, builder):
    got = spark.createDataFrame([(text, lang)], "t string, l string").select(T.token_count(F.col("t")), T.unit_count(F.col("t"), F.col("l")), T.builder_units(F.col("t"), F.col("l"))).first()
    assert tuple(got) == (tokens, units, builder)


def test_literal_scores(spark):
    c = lambda x: F.lit(x)
    assert one(spark, M.compression_ratio(c("a b"), c("a b c d"))) == 0.5
    assert one(spark, M.compression_ratio(c("a b"), c(""))) is None
    assert one(spark, M.number_recall(c("ship on 28 and 30"), c("28 only"))) == 0.5
    assert one(spark, M.term_recall(F.array(c("supplier audit"), c("June 28")), c("Supplier audit moved to June 28"))) == 1.0
    assert one(spark, M.real_time_factor(c("一二三四五"), c("zh"), c(4.0), c(1.0))) == 1.25
    assert one(spark, M.over(c(200.0), c(100.0))) == 1.0 and one(spark, M.over(c(50.0), c(100.0))) == 0.0
    assert one(spark, M.wer(c("a b c"), c("a x c"))) == pytest.approx(1 / 3) and one(spark, M.wer(c(""), c("a"))) == 1.0 and one(spark, M.wer(c(""), c(""))) is None
    assert one(spark, M.cer(c("a b"), c("ab"))) == 0.0
    assert one(spark, M.stress_mode(c(0.7))) == "concise"


def test_style(spark):
    say = lambda x: one(spark, M.style_violations(F.lit(x), F.lit("zh")))
    assert say("足证他是") == ["archaic_or_classical_style:足证"] and say("视他如兄弟") == ["archaic_or_classical_style:视X如Y"]
    assert say("乃是亦可") == ["bookish_written_style:乃,亦"] and say("张ABC") == ["mixed_cjk_latin_name"] and say("乃") == []
    assert one(spark, M.style_violations(F.lit("足证"), F.lit("en"))) == []


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def greedy(target, heard):
    at = 0
    for u in heard:
        if u not in target[at:]:
            break
        at = target.index(u, at) + 1
    return at


def test_sequences_against_plain_code(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 14))), " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 14)))) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    a, b = T.tokenize(F.col("a")), T.tokenize(F.col("b"))
    got = df.select("i", M.wer(F.col("a"), F.col("b")).alias("w"), arrow.lcs_length(a, b).alias("l"), arrow.ordered_match(a, b).alias("g"), M.bag_overlap(a, b).alias("o"), M.bag_f1(F.col("a"), F.col("b")).alias("f"), M.token_recall(F.col("a"), F.col("b")).alias("r")).collect()
    bag = {r.i: r for r in C.bag_scores(df, "i", "a", "b").collect()}
    for r in got:
        x, y = rows[r.i][1].split(), rows[r.i][2].split()
        o = sum((Counter(x) & Counter(y)).values())
        assert (r.l, r.g, r.o) == (lcs(x, y), greedy(x, y), o)
        assert r.w == (edit(x, y) / len(x) if x else (1.0 if y else None)) if not x or r.w is None else r.w == pytest.approx(edit(x, y) / len(x))
        assert r.r == pytest.approx(sum(t in y for t in x) / len(x) if x else 0.0)
        assert (bag[r.i].overlap, bag[r.i].f1) == (o, pytest.approx(2 * o / (len(x) + len(y)) if o else 0.0)) and bag[r.i].recall == pytest.approx(r.r)


def plain_bleu(pairs, order=4):
    import math

    m, t, h, r = [0] * order, [0] * order, 0, 0
    for ref, cand in pairs:
        h, r = h + len(cand), r + len(ref)
        for n in range(1, order + 1):
            x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (cand, ref))
            m[n - 1] += sum((x & y).values())
            t[n - 1] += sum(x.values())
    if not any(m):
        return 0.0
    logs, smooth = 0.0, 1.0
    for a, b in zip(m, t, strict=True):
        if b:
            smooth = smooth * 2 if not a else smooth
            logs += math.log(a / b if a else 1 / (smooth * b))
    return 100 * (1.0 if h >= r else math.exp(1 - r / h)) * math.exp(logs / order)


def test_corpus_scores(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))), " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "run int, i int, reference string, candidate string")
    for r in C.corpus_bleu(df, ["run"], "i", "13a").collect():
        assert r.bleu == pytest.approx(plain_bleu([(x[2].split(), x[3].split()) for x in rows if x[0] == r.run]))
    same = df.withColumn("candidate", F.col("reference"))
    assert {round(r.bleu, 6) for r in C.corpus_bleu(same, ["run"], "i").collect()} == {100.0} and {round(r.chrf, 6) for r in C.corpus_chrf(same, ["run"], "i").collect()} == {100.0}
    assert C.corpus_metrics(df, "run", "i").count() == 3
    toks = one(spark, C.bleu_tokens(F.lit("Hello, world (3.5%) 世界!"), "zh"))
    assert toks == ["Hello", ",", "world", "(", "3.5", "%", ")", "世", "界", "!"]
    doc = C.document_bleu(spark.createDataFrame([("d", 2, "cd"), ("d", 1, "ab")], "doc string, seg int, text string"), spark.createDataFrame([("d", "a b c d")], "doc string, text string"))
    assert doc.first().bleu == pytest.approx(100.0)


def test_clean_up(spark):
    t = lambda f, x: one(spark, f(F.lit(x)))
    assert t(T.clean_completion, '```Translation: "a  b"<|im_end|>```') == "a b" and t(T.clean_completion, "译文：你好") == "你好" and t(T.clean_completion, "it's") == "it's"
    assert one(spark, T.clean_completion(F.lit("<think>x</think> Answer: y"), thinking=True)) == "y"
    assert t(T.base_id, "a__chunk_1__speed_2") == "a__chunk_1" and t(T.base_id, "a__chunk_1") == "a" and t(T.base_id, "b") == "b"
    assert t(T.safe_id, "a b/c") == "a_b_c" and t(T.safe_id, "") == "sample" and t(T.source_lang, " FR_ca ") == "fr" and t(T.source_lang, "German") == "de" and t(T.source_lang, "en") is None
    assert t(T.json_object, 'x ```{"a": {"b": 1}}``` y') == '{"a": {"b": 1}}' and t(T.json_object, "none") is None
    assert tuple(t(T.audio_span, "/a:b/c.wav:12:340")) == ("/a:b/c.wav", 12, 340) and tuple(t(T.audio_span, "c.wav")) == ("c.wav", None, None)
    assert t(T.without_lang_tag, "[en-US] hi") == "hi" and t(T.canonical_model, "Seed-KIT") == "kit" and t(T.detokenize, "a , b ( c ) .") == "a, b (c)."
    key = spark.range(1).select(T.row_key(F.lit("run1"), F.lit("chatgpt"), F.lit(1920), F.lit("openai_chunk1920")).alias("k")).first().k
    assert key == "run1||chatgpt||1920||openai_1920"
    assert one(spark, T.cjk_prefix(F.lit("一，二。三"), 2)) == "一，二。" and t(T.alignment_text, "a, b! 世") == "ab世" and t(arrow.nfkc, "Ｈello 國！") == "hello国"


def test_sentences_and_parts(spark):
    s = lambda x, lang: one(spark, T.split_sentences(F.lit(x), F.lit(lang)))
    assert s("A b. C d!  E", "en") == ["A b.", "C d!", "E"] and s("你好。再见！好", "zh") == ["你好。", "再见！", "好"] and s("", "en") == []
    long = " ".join(["w"] * 500)
    assert [len(x.split()) for x in s(long, "en")] == [80] * 6 + [20]
    parts = one(spark, arrow.split_parts(F.lit("One two. Three four. Five six."), F.lit(3)))
    assert parts == ["One two.", "Three four.", "Five six."] and one(spark, arrow.list_literal(F.lit("['a ', '', 'b c']"))) == ["a", "b c"] and one(spark, arrow.list_literal(F.lit("oops"))) is None
    assert one(spark, T.span_by_ratio(F.array(*map(F.lit, "abcd")), F.lit(0.25), F.lit(0.75))) == "b c"
    ticks = one(spark, T.text_ticks(F.lit("a b, don't (d)"), F.lit(50.0), 20.0))
    # seven tokens over three ticks: edges 0, 2, 5, 7
    assert [(x.chunk, x.prefix, x.start_s, x.end_s) for x in ticks] == [("a b", "a b", 0.0, 20.0), (", don't(", "a b, don't(", 20.0, 40.0), ("d)", "a b, don't( d)", 40.0, 50.0)]
    few = one(spark, T.text_ticks(F.lit("a b"), F.lit(80.0), 20.0))
    # edges 0, .5, 1, 1.5, 2 rounded half to even
    assert [x.chunk for x in few] == ["a", "a", "b", ""]
    assert one(spark, T.text_ticks(F.lit(" "), F.lit(80.0), 20.0)) is None


def test_sentences_keep_their_digits(spark):
    """a sentence's place must not be what is trimmed from it."""
    s = lambda x, lang: one(spark, T.split_sentences(F.lit(x), F.lit(lang)))
    assert s("A b. 1 c 11. 28.68.191.238 is 2", "en") == ["A b.", "1 c 11.", "28.68.191.238 is 2"]
    assert s("0 好。 1 再见1！2", "zh") == ["0 好。", "1 再见1！", "2"]
    assert s("0123456789" * 81, "zh") == ["0123456789" * 8] * 10 + ["0123456789"]


def test_gates(spark):
    r = M.gate_reasons(F.lit(1.2), F.lit(1.4), F.array(F.lit("x")), F.lit(0.5), F.lit(0.95))
    assert one(spark, r) == ["speech_over_budget", "speech_too_fast_for_text", "text_style:x", "low_asr_target_coverage"]
    g = one(spark, M.rtf_gate(F.array(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.5))))
    assert (g.valid_chunks, g.violation_count, g.violation_rate, g.max_rtf, g["pass"]) == (2, 1, 0.5, 1.5, False)
    assert one(spark, M.rtf_gate(F.array().cast("array<double>")))["pass"] is False
    assert one(spark, M.runaway_turns(F.array(F.lit(9.0), F.lit(3.0)), F.array(F.lit(10), F.lit(10)), 5.0, 0.5)) == 1
    codes = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(9)))
    assert one(spark, M.code_reasons(codes, F.lit(0.1), 2, 0, 8, 0.01, F.lit(2), 0)) == ["code_out_of_range"]
    assert one(spark, M.final_reasons(F.lit(""), F.lit("en"), F.lit(3))) == ["empty_target"]
    assert one(spark, M.duration_budgets(F.array(F.lit(2.0), F.lit(None).cast("double")), 1.1, 0.1)) == [2.3, 0.1]


def test_records(spark):
    df = spark.createDataFrame([("", "s1", "en", "zh", "hello", "", "p", "2.5"), ("i", "s2", "en", "zh", None, "c", "p", "x")], "id string, sample_id string, src_lang string, tgt_lang string, source_text string, candidate_translation string, prediction string, src_end_s string")
    good, bad = R.canonical_samples(df)
    g = good.first()
    assert (g.id, g.candidate, g.src_duration_s, g.max_target_wpm) == ("s1", "p", 2.5, 185.0) and bad.first().reasons == ["missing_source_text"]
    labels = spark.createDataFrame([("a", '```{"chunks": [{"chunk_index": 1, "text": "two  2"}, {"chunk_index": 0, "text": "one"}], "full_text": "other"}```'), ("b", "no")], "id string, raw string")
    got = {r.id: r for r in R.chunk_labels(labels, "raw").collect()}
    assert got["a"].chunk_texts == ["one", "two 2"] and got["a"].full_text == "one two 2" and not got["b"].parsed
    chunks = spark.createDataFrame([("a", ["one two three four", "five"], ["x", "12 men"], [1.0, 9.0])], "id string, chunk_texts array<string>, sources array<string>, budgets array<double>")
    assert R.chunk_label_reasons(chunks).first().reasons == ["estimated_over_budget:0", "missing_numbers:1"]
    m = spark.createDataFrame([("s", 2, "text", True, "b"), ("s", 1, "text", True, "a"), ("s", 3, "control", True, "x"), ("s", 4, "text", False, "y")], "session string, message_id int, kind string, stable boolean, text string")
    assert R.stable_transcript(m, "session").first().transcript == "ab"
    assert R.timing_faults(spark.createDataFrame([("1", "x")], "a string, b string"), ["a", "b"]).first().bad_fields == ["b"]
    staged = R.staged_paths(spark.createDataFrame([("a b", "w", 20001, None), ("", "w", 1, None), ("b", "", 1, None), ("c", "w", None, "OSError"), ("d", "w", None, None)], "id string, audio string, samples long, fault string"), "root/", "dev")
    out = {r.id: r for r in staged.collect()}
    assert (out["a b"].packaged_duration_s, out["a b"].packaged_num_samples, out["a b"].packaged_sample_rate, out["a b"].staged) == (1.250062, 20001, 16000, "root/source_wav/dev/a_b.wav")
    assert [out[k].reason for k in ("", "b", "c", "d")] == ["missing_id", "missing_audio", "exception:OSError", "exception:Exception"] and out["c"].staged is None
    rows = spark.createDataFrame([("a", "x:0:32000", "s", "t", "en", "zh"), ("b", "x:0:8000", "s", "t", "en", "zh")], "id string, audio string, src_text string, tgt_text string, src_lang string, tgt_lang string")
    assert [r.id for r in R.codec_rows(rows, "en", "zh").collect()] == ["a"]
    assert R.chunked_samples(spark.createDataFrame([("a b", "FR", ["x", "", "y"])], "sample_id string, src_lang string, audios array<string>"), "audios").first().n_chunks == 2
    keep, drop = R.long_targets(spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None)], "i int, d double"), "d", 30.0)
    assert [r.i for r in keep.collect()] == [1] and sorted(r.reason for r in drop.collect()) == ["too_long", "unknown_duration"]


def test_long_pairs_take_linear_time_and_no_cap(spark):
    """Tokens are cut once a row; many distinct ones are no harder."""
    import time
    from collections import Counter

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    a, b = [f"w{i % 97}" for i in range(300)], [f"w{i % 89}" for i in range(0, 600, 2)]
    both = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").select(
        M.bag_overlap(T.tokenize(F.col("a")), T.tokenize(F.col("b"))).alias("o"), M.token_recall(F.col("a"), F.col("b")).alias("r"), M.wer(F.col("a"), F.col("b")).alias("w"),
    ).first()
    assert both.o == sum((Counter(a) & Counter(b)).values()) and both.r == sum(x in set(b) for x in a) / 300 and both.w == distance(a, b) / 300
    assert one(spark, M.wer(F.lit(" ".join(f"t{i}" for i in range(7000))), F.lit(" ".join(f"t{i}" for i in range(6400))))) == 600 / 7000
    took = {}
    for n in (1000, 8000):
        df = spark.createDataFrame([(" ".join(f"w{i * k % 5003}" for i in range(n)), " ".join(f"w{i * (k + 1) % 5003}" for i in range(n))) for k in range(1, 5)], "a string, b string").cache()
        df.count()
        began = time.time()
        df.select(M.bag_f1(F.col("a"), F.col("b")).alias("f"), M.token_recall(F.col("a"), F.col("b")).alias("r")).agg(F.sum("f"), F.sum("r")).collect()
        took[n] = time.time() - began
    assert took[8000] < 16 * max(0.3, took[1000])


def test_context_by_time(spark):
    at = lambda lo, hi, total: tuple(one(spark, T.context_by_time(F.lit("whole"), F.array(*map(F.lit, "abcdefghij")), F.lit(lo), F.lit(hi), F.lit(total), 2.0)))
    assert at(4.0, 6.0, 10.0) == ("c d e f g h", 2.0, 8.0)
    assert at(0.0, 1.0, 10.0) == ("a b c", 0.0, 3.0) and at(9.0, 10.0, 10.0) == ("h i j", 7.0, 10.0)
    assert at(1.0, 2.0, 0.0) == ("whole", 0.0, 0.0) == at(1.0, 2.0, None)


def test_compression_prompt(spark):
    import json

    df = spark.createDataFrame([("a", "en", "zh", "one\ntwo", 12, 4, ["x \"y\"", "中"], "ref"), ("b", "en", "de", "s", None, 4, None, ""), ("c", "en", "de", None, None, None, [], None)], "id string, src_lang string, tgt_lang string, source_text string, max_target_chars int, max_target_words int, must_keep_terms array<string>, reference_translation string")
    got = {r.id: r.p.split("\n") for r in df.select("id", R.compression_prompt(df, reference=True).alias("p")).collect()}
    assert got["a"][:8] == ["Source language: en", "Target language: zh", "Source transcript:", "one", "two", "Reference translation:", "ref", "Hard length budget:"]
    assert got["a"][8] == R.PROMPT_CHARS.format(12) and got["b"][5] == R.PROMPT_WORDS.format(4) and got["c"][4] == "Style requirements:" and got["c"][3] == ""
    limits = {"mode": None, "target_ratio": None, "max_target_chars": 12, "max_target_words": 4} | dict.fromkeys(R.LIMITS[4:13]) | {"must_keep_terms": ['x "y"', "中"], "core_meanings": []}
    assert got["a"][-2] == json.dumps(limits, ensure_ascii=False) and json.loads(got["b"][-2])["must_keep_terms"] == [] and got["c"][-1] == R.PROMPT_END
    out = R.completion_records(df, "S", F.lit("U"), F.col("source_text")).collect()
    assert [(r.id, r.prompt, r.completion) for r in out] == [("a", "System:\nS\n\nUser:\nU\n\nAssistant:\n", "one\ntwo"), ("b", "System:\nS\n\nUser:\nU\n\nAssistant:\n", "s")]


def test_clean_completion_cuts_prefixes_in_order(spark):
    first, second = T.ANSWER_PREFIXES[:2]
    assert one(spark, T.clean_completion(F.lit(f'{first} {second} "said  so"'))) == "said so"
    assert one(spark, T.clean_completion(F.lit("'"))) == "" and one(spark, T.clean_completion(F.lit(None).cast("string"))) == ""


def test_long_sequences_take_linear_steps():
    """16,000 units: distances by whole rows at a time."""
    rng = random.Random(5)
    a, b = ([rng.randrange(300) for _ in range(16_000)] for _ in range(2))
    began = time.time()
    found, apart = arrow.lcs(a, b), arrow.edits(a, b)
    assert time.time() - began < 3
    assert max(len(a), len(b)) - found <= apart <= len(a) + len(b) - 2 * found
    assert arrow.edits(a, a[:5000] + a[5001:]) == 1 and arrow.lcs(a, a[::2]) == 8000 and arrow.edits([], b) == 16_000
    began = time.time()
    series = arrow.ordered_match.func(pd.Series([range(16_000), None]), pd.Series([range(0, 16_000, 3), a]))
    assert series.tolist() == [16_000, 0] and time.time() - began < 1


def test_doubles_as_json_writes_them(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, 0.1, 0.00001, 0.0001, 0.00012345, 1e-7, 123456789.0, 12345678.9, 1e15, 1.5e15, 1e16, 1.25e22, 1e100, 5e-300, 1234567890123456.0, 0.5, -2.5e-6, -3e7, float("nan"), float("inf"), float("-inf")]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 20) for _ in range(200)]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").coalesce(1).select("i", R.json_double(F.col("v")).alias("x")).orderBy("i").collect()]
    want = [json.dumps(v) for v in values]
    # older Java virtual machines don't always find the shortest digits
    assert all(a == b or (float(a) == float(b) and ("e" in a) == ("e" in b)) for a, b in zip(got, want))
    assert sum(a == b for a, b in zip(got, want)) > 0.9 * len(want) and got[3:10] == want[3:10]



def plain_ticks(text, duration, chunk):
    tokens = re.findall(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|\S", text)
    n, count = len(tokens), max(1, -int(-duration // chunk))
    said = lambda some: "".join(" " + t if re.match("[A-Za-z0-9]", t) else t for t in some).lstrip(" ")
    out = []
    for i in range(count):
        lo, hi = round(n * i / count), round(n * (i + 1) / count)
        hi = hi if hi > lo else min(n, lo + 1)
        out.append((i, said(tokens[lo:hi]), said(tokens[:hi])))
    return out


def test_ticks_of_a_long_text_look_at_each_token_once(spark):
    """F12."""
    text = " ".join(f"w{i % 97}," if i % 5 else "é!" for i in range(12_000))
    one(spark, T.text_ticks(F.lit("a b"), F.lit(80.0), 20.0))
    begun = time.time()
    got = one(spark, F.transform(T.text_ticks(F.col("t"), F.lit(30_000.0), 20.0), lambda t: F.struct(t["tick"], t["chunk"], F.sha2(t["prefix"], 256))), t=text)
    assert time.time() - begun < 8
    import hashlib

    assert [tuple(r) for r in got] == [(i, c, hashlib.sha256(p.encode()).hexdigest()) for i, c, p in plain_ticks(text, 30_000.0, 20.0)]


@pytest.mark.parametrize(("text", "duration"), [("a b", 130.0), ("é , x's 7 -", 200.0), ("one", 1.0), ("(a) b c d e f g", 60.0)])
def test_ticks_against_plain_code(spark, text, duration):
    """also where ticks share tokens or have none."""
    got = one(spark, T.text_ticks(F.col("t"), F.lit(duration), 20.0), t=text)
    assert [(r.tick, r.chunk, r.prefix) for r in got] == plain_ticks(text, duration, 20.0)


def test_ticks_are_spaced_by_whole_texts(spark):
    """what a tick says is spaced in one pass, not token by token; texts that begin with a mark have no space to lose."""
    ticks = T.text_ticks(F.col("t"), F.lit(90.0), 20.0)
    assert "rlike" not in spark.createDataFrame([("a",)], "t string").select(ticks)._jdf.queryExecution().analyzed().toString().lower()
    for text in ("(a b) 'c d'e f", "\x01a b\x01 c", "\U0001f600 a\tb\nc - d\u00e9", "- - -", "a\n\nb"):
        assert [(r.tick, r.chunk, r.prefix) for r in one(spark, ticks, t=text)] == plain_ticks(text, 90.0, 20.0)


def test_tokens_go_to_python_as_texts(spark):
    """a batch holds no list for each row."""
    got = one(spark, arrow.ngram_overlap(F.lit("ab\nc\nab"), F.lit("ab\nab"), F.lit(2)))
    assert [(r.n, r.matched, r.hyp, r.ref) for r in got] == [(1, 2, 3, 2), (2, 0, 2, 1)]
    none = one(spark, arrow.ngram_overlap(F.lit(None).cast("string"), F.lit(""), F.lit(1)))
    assert [(r.n, r.matched, r.hyp, r.ref) for r in none] == [(1, 0, 0, 0)]


def test_parts_of_a_batch_are_cut_a_few_at_a_time(spark):
    """a batch's texts aren't all Python's at once; nulls, empty texts and batches longer than that keep their places."""
    assert arrow.split_parts.evalType == F.arrow_udf("int")(lambda x: x).evalType
    d = spark.range(1000).coalesce(1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("One  two. Three four. No "), F.col("id").cast("string"))).alias("t"))
    got = {r.id: r.p for r in d.select("id", arrow.split_parts(F.col("t"), F.lit(3)).alias("p")).collect()}
    assert got == {i: ["One two.", "Three four.", f"No {i}"] if i % 7 else [] for i in range(1000)}
