"""From documents to packed sequences: five stages, each a table that the next one reads whole.

Each stage decides on all rows its predecessor kept.  Documents judged bad by the quality classifier go, then those without a
language, then all but the smallest id of each group of near copies (and rows whose id and text both repeat), then those holding a
benchmark passage; what is left is packed.  Rows with a null id can't be told apart: they pass the de-duplication unless repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import decontam, langid, minhash, packing, quality
from rillstone.llm.queries import table, tokenizer_path
from rillstone.llm.scratch import Scratch

#: a document has no language if the best one's share of its bytes is above an even share by less than this part of the rest
LEAST_MARGIN = 0.07


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, model = quality.fit_documents(docs, table(spark, sf_dir, "labels"))
    return quality.append_scores(docs, model).filter(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.fit_documents(docs)
    even = 1 / len(net.langs) if net else 1.0
    named = langid.append_languages(docs, net)
    return named.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__lang_score") >= even + LEAST_MARGIN * (1 - even))).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    left = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    return left.withColumn("__same", F.xxhash64("doc_id", "text")).dropDuplicates(["__same", "doc_id", "text"]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return found.filter("__n_hit = 0").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: learnt scores and hashed sketches can't be expressed in SQL; tests/llm/test_pipeline.py recomputes run() plainly, stage by stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = disk.save(stage(spark, docs, sf_dir), name)
        disk.drop_all_but(name)
    return STAGES[-1][1](spark, docs, sf_dir)
