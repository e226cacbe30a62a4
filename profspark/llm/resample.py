"""Quality by importance resampling: two generative models of hashed n-grams, and Gumbel top-k.

A text's log weight is the log ratio of its probability under a model of target texts and one of all texts. Adding
independent Gumbel noise and keeping the k largest draws k texts without replacement, in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.llm.sampling import first_rows
from profspark.llm.scratch import Scratch, narrowed, packed, row_and, unpacked
from profspark.llm.words import ALNUM, U64, encoded, windows, words

BUCKETS = 10_000
#: The target model is fitted on at most so many target rows, the first in the order of a hash of their ids.
TARGET_ROWS = 20_000
BINS = 4096


def buckets(text: str | None, count: int = BUCKETS) -> np.ndarray:
    """How many of the text's words and word pairs fall into each bucket."""
    h = words(encoded((text or "").lower()), ALNUM)[0]
    both = np.concatenate((h, windows(h, 2)))
    return np.bincount((both % U64(count)).astype(np.int64), minlength=count)


def log_ratios(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Log ratio of target and raw probability by bucket, with add-one smoothing.

    Raw counts cover every text of `df`; target counts the texts of at most `target_rows` ids of `target`.
    """
    named = target.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    chosen = first_rows(named, "id", target_rows, named.count())
    flag = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.withColumn("target", F.lit(True))), "id", "left").select("target", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for target, text in zip(batch["target"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = buckets(text)
                total[0] += own
                if target:
                    total[1] += own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], names=["bucket", "raw", "target"])

    sums = flag.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = sums.toArrow()
    raw, wanted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table["bucket"].to_numpy()], wanted[table["bucket"].to_numpy()] = table["raw"].to_numpy(), table["target"].to_numpy()
    return np.log((wanted + 1) / (wanted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def gumbel(key: Column, seed: int) -> Column:
    """Noise that depends on the key and the seed only, so that a task that runs again draws the same."""
    uniform = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def resampled(df: DataFrame, target: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, keep: list[str] | None = None, target_rows: int = TARGET_ROWS) -> DataFrame:
    """`df` (or its columns `keep`) with log_weight, gumbel_key and selected, which replace columns of the same names.

    selected is true for ceil(share * rows) rows: those with the largest keys, and of equal keys (copies with one id)
    those that come first by id and text. Texts without words have log weight 0, null ones too. Rows with a null id
    share one draw of noise. Equal rows that the limit falls between are chosen as if numbered in any order.
    """
    scratch = Scratch(df.sparkSession)
    ratio = df.sparkSession.sparkContext.broadcast(log_ratios(df, target, id_col, text_col, target_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [float(buckets(t) @ ratio.value) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], batch["mark"], pa.array(weight, pa.float64())], names=["row", "id", "mark", "log_weight"])

    rows = narrowed(packed(df, text=F.col(text_col), id=F.col(id_col), mark=F.xxhash64(text_col)), keep)
    ids = rows.schema["id"].dataType.simpleString()
    weighted = rows.mapInArrow(run, row_and(rows, f"id {ids}, mark long, log_weight double"))
    weighted = scratch.keep(weighted.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("id"), seed)))
    wanted = -(-weighted.count() * share // 1)
    last = threshold(weighted, int(wanted), scratch)
    return unpacked(last, "log_weight", "gumbel_key", "selected")


def threshold(rows: DataFrame, wanted: int, scratch: Scratch) -> DataFrame:
    """`rows` with `selected`, true for the `wanted` ones with the largest gumbel_key.

    Counts by bin close in on the limiting key: at most BINS rows come to the driver at a time. Only the rows that equal
    it, which are copies of one text and id, are ordered.
    """
    key = F.col("gumbel_key")
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while low is not None and low < high:
        width = (high - low) / BINS
        bin_of = F.least(F.floor((key - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        counts = rows.where(key.between(low, high)).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for b in sorted(counts, key=lambda r: -r.bin):
            if above + b.n >= wanted:
                low, high = b.low, b.high
                break
            above += b.n
        else:
            break
        if len(counts) == 1 and width == 0:
            break
    if low is None or wanted <= 0:
        return rows.withColumn("selected", F.lit(False) if wanted <= 0 else F.lit(True))
    equal = rows.where(key == F.lit(low)).select(F.struct("id", "mark").alias("who")).groupBy("who").count().orderBy("who")
    spare, who, part = wanted - above, None, 0
    for r in equal.toLocalIterator():
        if r["count"] >= spare:
            who, part = r.who, spare
            break
        spare -= r["count"]
    if who is None:
        return rows.withColumn("selected", key >= F.lit(low))
    own = F.struct("id", "mark")
    edge = F.struct(F.lit(who["id"]).cast(rows.schema["id"].dataType).alias("id"), F.lit(who["mark"]).cast("long").alias("mark"))
    full = equal.where(F.col("who") == edge).select("count").first()["count"] == part
    clear = rows.withColumn("selected", (key > F.lit(low)) | ((key == F.lit(low)) & ((own < edge) | ((own == edge) & F.lit(full)))))
    if full:
        return clear
    # The limit falls between equal rows: the first `part` of them, wherever they stand.
    at_edge = (key == F.lit(low)) & (own == edge)
    copies = scratch.keep(rows.where(at_edge))
    some = copies.limit(part).withColumn("selected", F.lit(True))
    rest = copies.exceptAll(copies.limit(part)).withColumn("selected", F.lit(False)) if part else copies.withColumn("selected", F.lit(False))
    return clear.where(~at_edge).unionByName(some).unionByName(rest)
