"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in a shuffled order, once for each epoch. A document's virtual finish time is the number
of its source's words up to its own end, divided by the source's target, so that a source is served in proportion to its
target at any time. All entries are then sorted by finish time, whatever their source, and taken until the budget is
spent; the entry at the border gives its first words only.

No source is one group: a source's words are summed in blocks of the shuffled order and then inside the blocks, with
blocks as many as their sizes ask for. The sorted entries are summed by range partition; only the one partition in which
the budget ends is summed row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profspark.llm.scratch import Scratch

#: Rows of a block, unless the square root of a source's rows is more.
BLOCK = 2000
DIGITS = 8


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranged(df: DataFrame, scratch: Scratch, *order: Column) -> DataFrame:
    """The rows, written in ranges of `order`, with the number of their range as `part`."""
    return scratch.keep(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def before_parts(parts: DataFrame, value: Column) -> DataFrame:
    """(part, before, own): the sum of `value` in earlier parts and in the part; a row for each range partition."""
    sums = parts.groupBy("part").agg(F.sum(value).alias("own"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"), "own")


def _weighed(sources: DataFrame, weights: list[int], scratch: Scratch) -> DataFrame:
    """The sources with `weight`: the weights in turn, by code point, null last."""
    order = [F.col("unnamed"), F.col("source")]
    parts = ranged(sources, scratch, *order)
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    numbered = parts.join(before_parts(parts, F.lit(1)), "part").withColumn("nth", F.col("before") + number)
    nth = F.pmod(F.col("nth"), F.lit(len(weights))).cast("int")
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth + 1).cast("long"))
    return scratch.keep(weighed.drop("part", "before", "own", "nth"))


def _rate(sources: DataFrame, percent: int, total: int) -> float:
    """Words for each unit of weight, so that targets, cut at the sources' caps, add up to `percent` per cent of all."""
    rate = 0.0
    while True:
        capped = F.col("cap") <= F.col("weight") * F.lit(rate)
        caps, open_ = sources.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if not open_:
            return math.inf
        higher = (percent * total - 100 * caps) / (100 * open_)
        if higher <= rate:
            return rate
        rate = higher


def mixture(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: tuple[int, ...] = (3, 1, 2),
    percent: int = 150,
    epochs: int = 2,
) -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row of `df`, with the own types of id and source.

    size: words of `text` unless given; null counts as 0. The sources weigh `weights` in turn, by code point, null last,
    and share `percent` per cent of all sizes; a target stops at `epochs` times its source's size, and what is over goes
    to the others by weight. taken: words that the mix takes of the row, repeats counted; all together they are the
    budget, rounded down, and a source's are its target but for one document at its end, or where the entries of other
    sources at the border are large. Rows of one id, source and size are interchangeable; they stand together, and what
    is taken of them is dealt to them one by one. Rows without words, and all rows where none has words, get 0. An empty
    table gives an empty result. No other column is read, so clashing names do no harm.
    """
    scratch = Scratch(df.sparkSession)
    size = n_words(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    name = F.col("given").cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("given"), size.alias("size"))
    # Length before content: no two rows share a mark unless they are interchangeable.
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    units = rows.groupBy("id", "given", "size").agg(F.count(F.lit(1)).alias("copies"))
    mark = F.md5(F.concat(part(F.col("id").cast("string")), part(name), F.col("size").cast("string")).cast("binary"))
    units = units.select("*", F.coalesce(name, F.lit("")).alias("source"), F.col("given").isNull().alias("unnamed"), mark.alias("mark"))
    units = scratch.keep(units.withColumn("amount", F.col("size") * F.col("copies")))
    sources = units.groupBy("unnamed", "source").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("units"))
    sources = _weighed(sources.withColumn("cap", epochs * F.col("total")), list(weights), scratch)
    all_words, largest = sources.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.max("units"), F.lit(0))).first()
    target = F.least(F.col("weight") * F.lit(_rate(sources, percent, all_words)), F.col("cap").cast("double"))
    sources = sources.select("unnamed", "source", "total", F.when(F.col("cap") > 0, target).otherwise(0.0).alias("target"))

    blocks = max(1, math.ceil(largest / max(BLOCK, math.isqrt(largest))))
    block = F.floor(F.conv(F.substring("mark", 1, DIGITS), 16, 10).cast("long") * F.lit(blocks) / F.lit(16**DIGITS))
    units = units.withColumn("block", block)
    key, earlier = ["unnamed", "source"], (Window.unboundedPreceding, -1)
    of_block = units.groupBy(*key, "block").agg(F.sum("amount").alias("words"))
    of_block = of_block.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy(*key).orderBy("block").rowsBetween(*earlier)), F.lit(0)))
    of_block = scratch.keep(of_block.join(sources, key).drop("words"))
    in_block = Window.partitionBy(*key, "block").orderBy("mark", "size", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = units.join(of_block, [*key, "block"]).withColumn("end", F.col("before") + F.sum("amount").over(in_block))
    placed = scratch.keep(placed.select("id", "given", "size", "copies", "amount", "mark", "total", "target", "end"))

    finish = lambda epoch: (epoch * F.col("total") + F.col("end")).cast("double") / F.col("target")
    entries = placed.where("amount > 0").select("mark", "amount", F.explode(F.array(*[F.struct(finish(F.lit(e)).alias("finish"), F.lit(e).alias("epoch")) for e in range(epochs)])).alias("e"))
    last = _last_taken(entries.select("e.finish", "mark", "e.epoch", "amount"), percent * all_words // 100, scratch)

    def taken(epoch: int) -> Column:
        if last is None:
            return F.lit(0).cast("long")
        f, m, e, left = last
        at = finish(F.lit(epoch))
        same = (at == F.lit(f)) & (F.col("mark") == F.lit(m))
        whole = (at < F.lit(f)) | ((at == F.lit(f)) & (F.col("mark") < F.lit(m))) | (same & F.lit(epoch < e))
        return F.when(F.col("amount") == 0, 0).when(whole, F.col("amount")).when(same & F.lit(epoch == e), F.lit(left)).otherwise(0).cast("long")

    dealt = placed.select("*", F.array(*[taken(e) for e in range(epochs)]).alias("words"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    share = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), w - F.col("copy") * F.col("size"))))
    return dealt.select(F.col("id").alias(id_col), F.col("given").alias(source_col), "size", F.col("total").alias("source_size"), "target", share.alias("taken"))


def _last_taken(entries: DataFrame, budget: int, scratch: Scratch) -> tuple | None:
    """(finish, mark, epoch, words) of the entry with which the budget is spent; None: nothing is taken."""
    order = [F.col("finish"), F.col("mark"), F.col("epoch")]
    parts = ranged(entries, scratch, *order)
    at = before_parts(parts, F.col("amount")).where((F.col("before") < budget) & (F.col("before") + F.col("own") >= budget)).first()
    if at is None:
        return None
    running = F.sum("amount").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + at["before"]
    rows = parts.where(F.col("part") == at["part"]).withColumn("end", running)
    end = rows.where(F.col("end") >= budget).orderBy("end").first()
    scratch.drop(parts)
    return end["finish"], end["mark"], end["epoch"], end["amount"] - (end["end"] - budget)
