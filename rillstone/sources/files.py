"""Sources and sinks: records line by line, tables, score files, shards, runs of a directory, interval files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: labels of silence, and tiers by preference
SILENCES = ("", "sil", "sp", "spn", "<eps>", "<sil>", "silence")
WORD_TIERS = ("words", "word", "utterances")
#: stands behind each file of a shard
SEPARATOR = "\x1e"


def read_records(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, strict: bool = True, limit: int | None = None) -> DataFrame:
    """IO1, IO2: one JSON object a line; blank lines are skipped; a bad line fails, or is kept in _corrupt_record."""
    if strict:
        out = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        out = spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)
    return out.limit(limit) if limit is not None else out


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO3."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_new(todo: DataFrame, path: str, key: Sequence[str], rejected: str | None = None) -> None:
    """IO4: rows whose key neither output holds are appended; transient failures belong in neither and so come again."""
    from ..operators.joins import resume

    spark = todo.sparkSession
    done = [d for p in (path, rejected) if p and (d := _there(spark, p, todo.schema)) is not None]
    write_records(resume(todo, done, key), path, "append")


def _there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(schema).json(path)


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = "\t") -> DataFrame:
    """IO6: a table with a header line."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).csv(path)


def sniff_separator(spark: SparkSession, path: str, choices: str = "\t,;|") -> str:
    """IO6: of the given separators the one most frequent in the first line."""
    head = spark.read.text(path).limit(1).collect()
    return max(choices, key=(head[0].value if head else "").count)


def write_report(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str | Column]) -> None:
    """IO7: a sorted table in one file; for reports, which are small."""
    df.select(*columns).coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def best_candidates(df: DataFrame, langs: Sequence[str], least_s: float, n: int, score: str = "score", key: str = "id") -> DataFrame:
    """IO8: rows of the languages from a duration on, the first n by (score, id)."""
    return df.filter(F.lower("lang").isin(*langs) & (F.col("duration_s") >= least_s)).orderBy(score, key).limit(n)


def read_scores(spark: SparkSession, path: str | Sequence[str], wide: bool = False) -> DataFrame:
    """IO9: file, metric, value, from lines of ``metric<TAB>value`` or a header and one line of values."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"))
    if not wide:
        cut = F.split("value", "\t")
        return lines.filter(F.size(cut) >= 2).select("file", cut[0].alias("metric"), cut[1].try_cast("double").alias("value"))
    whole = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("l"), F.col("_metadata.file_path").alias("file"))
    pairs = whole.select("file", F.explode(F.arrays_zip(F.split(F.col("l")[0], ",").alias("metric"), F.split(F.col("l")[1], ",").alias("value"))).alias("p"))
    return pairs.select("file", F.trim("p.metric").alias("metric"), F.col("p.value").try_cast("double").alias("value"))


def wide_scores(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """IO9: a column for each named metric."""
    return scores.groupBy("file").pivot("metric", list(metrics)).agg(F.first("value"))


def read_runs(spark: SparkSession, root: str, result: str, manifest: str) -> DataFrame:
    """IO10: each run folder's result.json, overlaid with its manifest.json, and where it is."""
    own = lambda name, schema: spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{name}").withColumn("run_dir", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))
    a, b = own("result.json", result), own("manifest.json", manifest)
    shared = [c for c in b.columns if c in a.columns and c != "run_dir"]
    out = a.join(b.withColumnsRenamed({c: f"__{c}" for c in shared}), "run_dir", "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in shared}).drop(*[f"__{c}" for c in shared])


def require_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """IO11: fails at the first row that lacks one of the fields."""
    first = F.coalesce(*[F.when(F.col(n).isNull(), F.lit(f"missing required field {n}")) for n in names])
    check = F.when(first.isNotNull(), F.raise_error(first)).otherwise(F.lit(True))
    return df.filter(check.cast("boolean"))


def union_shards(shards: DataFrame, key: str, shard: str, order: str) -> DataFrame:
    """IO12: the first row of each key by (shard, order)."""
    rest = [c for c in shards.columns if c not in (key, shard, order)]
    return shards.groupBy(key).agg(F.min(F.struct(shard, order, *rest)).alias("__r")).select(key, "__r.*")


def shard_counts(shards: DataFrame, expected: DataFrame, shard: str) -> DataFrame:
    """IO12: rows of each expected shard; 0 for a missing one."""
    return expected.join(shards.groupBy(shard).agg(F.count(F.lit(1)).alias("n")), shard, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("missing", F.col("n") == 0)


_CLASS = re.compile(r'class\s*=\s*"IntervalTier"')
_NAME = re.compile(r'name\s*=\s*"((?:[^"]|"")*)"')
_SPAN = re.compile(r'xmin\s*=\s*([-\d.eE+]+)\s+xmax\s*=\s*([-\d.eE+]+)\s+text\s*=\s*"((?:[^"]|"")*)"')


def interval_rows(text: str) -> list[tuple[str, int, float, float, str]]:
    """tier, place, start, end and label of each interval of a long-form interval file."""
    out = []
    for part in _CLASS.split(text)[1:]:
        name = _NAME.search(part)
        for i, m in enumerate(_SPAN.finditer(part)):
            out.append((name[1] if name else "", i, float(m[1]), float(m[2]), m[3].replace('""', '"')))
    return out


def _intervals(files: DataFrame) -> DataFrame:
    """files: file, value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch["file"], batch["value"], strict=True) for r in interval_rows(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "tier", "pos", "start_s", "end_s", "text"])

    return files.mapInPandas(run, "doc_id string, tier string, pos int, start_s double, end_s double, text string")


def read_intervals(spark: SparkSession, path: str | Sequence[str], doc: str = r"([^/]+?)(?:\.[^./]+)?$") -> DataFrame:
    """IO13: doc_id, tier, pos, start_s, end_s, text of all interval files; ``doc`` finds the id in a file's path, by default its name."""
    return _intervals(spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", doc, 1).alias("file"), "value"))


def write_shards(files: DataFrame, path: str) -> None:
    """IO13: many small files (file, value) in few: their texts one after another, each below a line with its name, with a record separator behind."""
    whole = F.concat("file", F.lit("\n"), "value")
    files.select(F.replace(F.replace(whole, F.lit("\x1b"), F.lit("\x1b0")), F.lit(SEPARATOR), F.lit("\x1b1"))).write.option("lineSep", SEPARATOR).text(path)


def read_interval_shards(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """IO13: as read_intervals, of interval files in shards."""
    cut = F.split(F.replace(F.replace("value", F.lit("\x1b1"), F.lit(SEPARATOR)), F.lit("\x1b0"), F.lit("\x1b")), "\n", 2)
    return _intervals(spark.read.text(path, lineSep=SEPARATOR).select(cut[0].alias("file"), F.coalesce(F.get(cut, 1), F.lit("")).alias("value")))


def spoken_intervals(intervals: DataFrame, doc: str = "doc_id") -> DataFrame:
    """IO13: the intervals of each document's preferred tier that aren't silence and have a length."""
    low = F.lower("tier")
    rank = F.coalesce(*[F.when(low == t, F.lit(i)) for i, t in enumerate(WORD_TIERS)], F.when(low.contains("word"), F.lit(50)), F.lit(99))
    # the files are read once
    best = intervals.withColumn("__best", F.min(F.struct(rank.alias("r"), "tier")).over(Window.partitionBy(doc))["tier"])
    return best.filter(F.col("tier") == F.col("__best")).drop("__best").filter(~F.lower(F.trim("text")).isin(*SILENCES) & (F.col("end_s") > F.col("start_s")))
