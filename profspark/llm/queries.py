"""The registered queries of the subpackage, over the whole tables, and their DuckDB counterparts where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profspark.llm import bpe, chat, language, licenses, mixing, pii, rules, toxicity, whitening
from profspark.llm.decontaminate import contamination
from profspark.llm.jaccard import jaccard_components
from profspark.llm.resample import resampled
from profspark.llm.runs import periodic_runs
from profspark.llm.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(language.fold("doc_id", 4) == 2, F.lit(False))
    model = toxicity.train(documents, labels.where(~held_out))
    found = toxicity.scored(documents, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.array_join(F.array_sort(F.array_distinct("matches.template")), ",").alias("templates"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("best"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    coded = bpe.encoded(table(spark, sf_dir, "documents"), keep=["doc_id"], **how)
    back = bpe.decoded(coded.withColumn("ids_sha256", F.sha2("ids", 256)), keep=["doc_id", "n_tokens", "ids_sha256"], **how)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(documents, key="public test key")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language.fold("doc_id", 3) == 1, F.lit(False))
    model = language.train(documents.where(~held_out))
    found = language.identified(documents, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    target = table(spark, sf_dir, "labels").where("quality = 1")
    return resampled(documents, target, keep=["doc_id"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assessed(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], conversations.schema)
    back = chat.read_back(chat.windows(conversations.unionByName(own)))
    # A digest of a conversation needs its texts in one place, as no window does.
    of_window = back.select(
        "conv_id",
        F.struct(
            "window",
            F.size("turns").alias("n"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("learned", "").alias("learned"),
            F.length("formatted").alias("chars"),
        ).alias("w"),
    )
    whole = of_window.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("w.n").alias("n_turns"), F.sum("w.chars").alias("formatted_chars"))
    learned = F.array_join("w.learned", "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long"),
        F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text): in one of ten documents, by a hash of the id, the words behind some place repeat those at it."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.floor(F.col("h") / 10) % F.col("n")))
    rows = rows.withColumn("left", F.col("n") - F.col("a")).withColumn("p", 1 + F.floor(F.col("left") / (3 + F.floor(F.col("h") / 10) % 8)))
    cycle = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    again = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(F.col("left") / F.col("p")).cast("int"))), F.lit(1), F.col("left").cast("int"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("l"), F.array_join(F.transform("runs", line), "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("l.s")).alias("start"),
        F.col("l.length").alias("length"),
        (-F.col("l.p")).alias("period"),
        F.expr("(1000 * l.length) div -l.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), whitening.fixed_point(F.col("embedding")), keep=["vec_id"])
    exact = F.col("deviation").try_cast("long").alias("deviation")
    return found.select("vec_id", "component", "n", exact, "whitened", "explained", "identity_error")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_bpe": op5_bpe,
    "op6_surrogates": op6_surrogates,
    "op7_language": op7_language,
    "op8_quality_rules": op8_quality_rules,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_chat_windows": op10_chat_windows,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_mixing": op12_mixing,
    "op13_whitening": op13_whitening,
}

# SQL has the digests of op10 (see tests/llm), but not the windows.
ORACLES = {name: SQL[name] for name in QUERIES if name in SQL}
