"""From raw documents to token ids: five stages, each of which gets what the one before has kept.

A stage's table is run by its reader, after the stage has returned it. Those that hand texts to Python therefore leave the
session with fewer rows in a batch (`few_rows`): Spark's own 10,000 take memory in all stages after them, too, since
executors and their Python workers stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profspark.llm import bpe, language, pii
from profspark.llm.decontaminate import decontaminated
from profspark.llm.jaccard import representatives
from profspark.llm.scratch import Scratch, few_rows

#: Texts of which a smaller share of words is in the language found are rejected; passages in a second language are not.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or in no learned language, go; `lang` becomes the language found."""
    few_rows(spark)
    found = language.identified(docs, language.train(docs))
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of 80 per cent of common five-word shingles connect, the one with the smallest id stays."""
    return representatives(docs, size=5, percent=80)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go; so do texts that are benchmark for the most part."""
    few_rows(spark)
    cut = decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(docs, key="public test key").drop("n_entities")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text's bytes again."""
    few_rows(spark)
    how = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    coded = bpe.encoded(docs.withColumn("sum", F.sha2(F.coalesce("text", F.lit("")), 256)), keep=["doc_id", "lang", "source", "sum"], **how)
    back = bpe.decoded(coded, **how)
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("bytes", 256) == F.col("sum")).alias("exact"))


STAGES = [
    ("language", identify_language),
    ("copies", keep_one_of_copies),
    ("benchmarks", remove_benchmarks),
    ("personal data", replace_personal_data),
    ("tokens", encode),
]

#: Neither the language model nor the tokenizer can be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
