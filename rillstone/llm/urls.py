"""URL filters: pattern rules indexed by their rarest literal token; only fetched candidates run regular expressions.

DataFrame functions only.  Each rule names literal tokens that every URL it fits must hold.  Tokens are counted over
all URLs, a rule is filed under its rarest one, each URL's tokens fetch candidate rules by an equi-join, and only
these run their regular expression.  The rule of highest rank that fits gives the verdict.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and get the default verdict.  Repeated
rows and keys each get the same answer; an empty table gives an empty table; columns besides the key and the URL
don't matter, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rules up to this many rows are broadcast; larger tables are joined by a shuffle
BROADCAST_RULES = 100_000
RULE_SCHEMA = "rule string, pattern string, literals array<string>, rank int, named boolean, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: words that mark a host as unwanted when they stand between dots or hyphens in it
BLOCKED_WORDS = ("spam", "pills", "viagra", "casino", "jackpot", "bets", "betting", "porn", "xxx", "adult", "malware", "phishing", "warez", "ads", "adserver", "tracker")


def tokens(text: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits, as URLs are cut too."""
    return re.findall(r"[a-z0-9]+", text.lower())


def host_path_rule(host: str, path: str, verdict: str) -> tuple:
    """Fits the host and all its subdomains where the URL's path starts with the rule's; longer ones rank higher."""
    tail = re.escape("/" + path) if path else "(?:/|$)"
    whole = tokens(host) + tokens(path[: path.rfind("/") + 1])
    name = f"{host}/{path}"
    return name, rf"^(?:[^/]*\.)?{re.escape(host)}{tail}", sorted(set(whole)), 1_000_000 + len(name), True, verdict


def word_rule(word: str, verdict: str = "block") -> tuple:
    """Fits hosts that hold the word between dots, hyphens or their ends; ranks below all host and path rules."""
    return f"word:{word}", rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", tokens(word), len(word), False, verdict


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    for r in rules:
        if not r[2]:
            raise ValueError(f"rule {r[0]} has no literal token to be indexed by")
    return spark.createDataFrame(rules, RULE_SCHEMA)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_RULES else df


def judge_urls(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, url, host, path, rule (of named rules, else null), matched (any rule), verdict."""
    rows = df.select(F.col(key).alias("__key"), F.col(url).alias("__url"))
    rows = rows.withColumns({"host": url_host(F.col("__url")), "path": url_path(F.col("__url"))})
    seen = rows.filter(F.col("host") != "").withColumn("__at", F.concat("host", "path"))
    cut = F.array_distinct(F.regexp_extract_all(F.lower("__at"), F.lit("([a-z0-9]+)"), F.lit(1)))
    found = seen.select("__key", "__url", "__at", F.explode(cut).alias("literal"))

    n = rules.count()
    wanted = rules.select("rule", F.explode(F.array_distinct("literals")).alias("literal"))
    used = wanted.select("literal").distinct()
    counts = found.join(_small(used, n), "literal", "left_semi").groupBy("literal").agg(F.count(F.lit(1)).alias("n"))
    filed = wanted.join(counts, "literal", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "literal")).alias("rarest"))
    index = rules.join(filed, "rule").select("rule", "pattern", "rank", "named", "verdict", F.col("rarest.literal").alias("literal"))

    fits = found.join(_small(index, n), "literal").filter(F.expr("__at rlike pattern"))
    best = fits.groupBy("__key", "__url").agg(F.max(F.struct("rank", "rule", "named", "verdict")).alias("best"))
    best = best.select(F.col("__key").alias("k"), F.col("__url").alias("u"), "best")
    out = rows.join(best, rows["__key"].eqNullSafe(best["k"]) & rows["__url"].eqNullSafe(best["u"]), "left")
    return out.select(
        F.col("__key").alias(key), F.col("__url").alias(url), "host", "path",
        F.when(F.col("best.named"), F.col("best.rule")).alias("rule"),
        F.col("best.rule").alias("matched"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
