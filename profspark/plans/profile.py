"""Flame-graph profiles: an analysis result as the normalised tables of a profile message.

A result has three columns, by position: call path, count, value.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.functions.frames import offset_name
from profspark.operators.dense_ids import dense_ids
from profspark.operators.hot import dictionary_join, materialized
from profspark.operators.ranges import range_lookup

# The strings every profile starts with, at ids 0 to 5.
PRESET_STRINGS = ["", "samples", "count", "sampled_cpu", "ns", "process"]


class Profile:
    """Profile tables of a result, each made when it is asked for; what several share is checkpointed once.

    Without a line table there is one location per function name; its address is the smallest one seen under the name.
    With a line table (``LINE_SCHEMA``) there is one location per address, with file, line and column, and with
    ``inlined`` also the calls inlined there.
    """

    def __init__(
        self, result: DataFrame, with_offset: bool = False, lines: DataFrame | None = None, inlined: bool = False
    ):
        self.result, self.with_offset, self.lines, self.inlined = result, with_offset, lines, inlined

    @cached_property
    def _rows(self) -> DataFrame:
        return materialized(_rows(self.result))

    @cached_property
    def _frames(self) -> DataFrame:
        return _frames(self._rows, self.with_offset)

    @cached_property
    def _dictionaries(self) -> tuple[DataFrame, DataFrame]:
        """Locations by place, and functions."""
        if self.lines is not None:
            return _by_address(self._frames, self.lines, self.inlined)
        functions = _by_name(self._frames)
        named = self._frames.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("address").alias("address"))
        locations = named.join(functions, "name").select(
            F.col("name").alias("place"),
            F.col("function_id").alias("location_id"),
            "address",
            F.array(_line(F.col("function_id"), F.lit(0), F.lit(0))).alias("lines"),
        )
        return locations, functions

    @cached_property
    def samples(self) -> DataFrame:
        """location_ids, count, value"""
        located = self._frames.withColumn("place", F.col("name" if self.lines is None else "address"))
        return _samples(located, self._dictionaries[0].select("place", "location_id"))

    @cached_property
    def locations(self) -> DataFrame:
        """location_id, address, lines (function_id, line, col; innermost inlined call first)"""
        return self._dictionaries[0].select("location_id", "address", "lines")

    @cached_property
    def functions(self) -> DataFrame:
        """function_id, name_id, file_id"""
        return _with_strings(self._dictionaries[1], self.strings)

    @cached_property
    def strings(self) -> DataFrame:
        """string_id, value"""
        functions = self._dictionaries[1]
        names = functions.select(F.col("name").alias("value")).unionByName(functions.select(F.col("file").alias("value")))
        titles = self.result.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(c) for c in self.result.columns[1:3]])).alias("value")
        )
        return materialized(string_table(names.unionByName(titles)))

    @cached_property
    def header(self) -> DataFrame:
        """count_type, value_type, duration_nanos"""
        return _header(self._rows, self.result.columns, self.strings)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "samples": self.samples,
            "locations": self.locations,
            "functions": self.functions,
            "strings": self.strings,
            "header": self.header,
        }


def profile(
    result: DataFrame,
    with_offset: bool = False,
    lines: DataFrame | None = None,
    inlined: bool = False,
) -> Profile:
    """The profile tables of a result."""
    return Profile(result, with_offset, lines, inlined)


def _rows(result: DataFrame) -> DataFrame:
    stack, count, value = result.columns[:3]
    return (
        result.select(
            F.col(stack).alias("stack"),
            F.coalesce(F.col(count).cast("bigint"), F.lit(0)).alias("count"),
            F.coalesce(F.col(value).cast("bigint"), F.lit(0)).alias("value"),
        )
        .groupBy("stack", "count", "value")
        .agg(F.count(F.lit(1)).alias("repeats"))
        .withColumn("sample", F.sha2(F.to_json(F.struct("stack", "count", "value")), 256))
    )


def _frames(rows: DataFrame, with_offset: bool) -> DataFrame:
    """One row per frame of a sample; a sample without frames keeps one row with nulls."""
    exploded = rows.select("sample", "count", "value", "repeats", F.posexplode_outer("stack").alias("pos", "frame"))
    name = F.col("frame.name")
    if with_offset:
        name = F.when(name.isNotNull(), offset_name(name, F.col("frame.offset")))
    return exploded.select(
        "sample",
        "count",
        "value",
        "repeats",
        "pos",
        name.alias("name"),
        (F.col("frame.address") + F.col("frame.offset")).alias("address"),
    )


def _by_name(frames: DataFrame) -> DataFrame:
    names = frames.where(F.col("name").isNotNull()).select("name")
    functions = dense_ids(names, "function_id", 1).withColumn("file", F.lit(None).cast("string"))
    return materialized(functions)


def _line(function: Column, line: Column, col: Column) -> Column:
    return F.struct(
        function.cast("bigint").alias("function_id"), line.cast("bigint").alias("line"), col.cast("bigint").alias("col")
    )


def _by_address(frames: DataFrame, lines: DataFrame, inlined: bool) -> tuple[DataFrame, DataFrame]:
    """Locations by address, and the functions of their lines.

    One address has one name in a capture; should it have several, the smallest stands for it.
    """
    addresses = frames.where(F.col("name").isNotNull()).groupBy("address").agg(F.min("name").alias("name"))
    info = range_lookup(addresses, lines, [], "address", ["file", "line", "col", "inlined"])
    own = F.struct("name", "file", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("col", F.lit(0)).alias("col"))
    calls = F.array(own)
    if inlined:
        nested = F.transform(
            F.reverse(F.coalesce("inlined", F.array().cast(lines.schema["inlined"].dataType))),
            lambda c: F.struct(
                c["name"].alias("name"),
                c["file"].alias("file"),
                F.coalesce(c["line"], F.lit(0)).alias("line"),
                F.coalesce(c["col"], F.lit(0)).alias("col"),
            ),
        )
        calls = F.concat(nested, F.array(own))
    called = info.select("address", F.posexplode(calls).alias("pos", "call")).select("address", "pos", "call.*")
    called = materialized(called)
    # A function's file is the smallest one named with it, whatever order rows come in.
    functions = called.groupBy("name").agg(F.min("file").alias("file"))
    functions = materialized(dense_ids(functions.select("name"), "function_id", 1).join(functions, "name"))
    parts = (
        dictionary_join(called, functions.select("name", "function_id"), ["name"], "address", "inner")
        .groupBy("address")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "function_id", "line", "col"))).alias("parts"))
    )
    ids = dense_ids(parts.select("address"), "location_id", 1)
    located = materialized(parts.join(ids, "address"))
    locations = located.select(
        F.col("address").alias("place"),
        "location_id",
        "address",
        F.transform("parts", lambda p: _line(p["function_id"], p["line"], p["col"])).alias("lines"),
    )
    return locations, functions


def string_table(values: DataFrame) -> DataFrame:
    """(string_id, value): the presets, then all other distinct strings."""
    spark = values.sparkSession
    others = dense_ids(
        values.where(F.col("value").isNotNull() & ~F.col("value").isin(PRESET_STRINGS)), "string_id", len(PRESET_STRINGS)
    )
    presets = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in PRESET_STRINGS])).alias("string_id", "value"))
    return presets.select(F.col("string_id").cast("bigint").alias("string_id"), "value").unionByName(others)


def _with_strings(functions: DataFrame, strings: DataFrame) -> DataFrame:
    names = strings.select(F.col("value").alias("name"), F.col("string_id").alias("name_id"))
    files = strings.select(F.col("value").alias("file"), F.col("string_id").alias("file_id"))
    named = functions.join(names, "name")
    return dictionary_join(named, files, ["file"], "function_id").select(
        "function_id", "name_id", F.coalesce("file_id", F.lit(0)).cast("bigint").alias("file_id")
    )


def _samples(located: DataFrame, places: DataFrame) -> DataFrame:
    """Location ids per sample in stack order; a name such as the entry point is in most samples, hence the spread."""
    return (
        dictionary_join(located, places, ["place"], "sample")
        .groupBy("sample", "count", "value", "repeats")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("location_id").isNotNull(), F.struct("pos", "location_id")))).alias(
                "ids"
            )
        )
        .select(
            F.col("ids.location_id").alias("location_ids"),
            "count",
            "value",
            F.explode(F.expr("sequence(1, cast(repeats as int))")).alias("_copy"),
        )
        .drop("_copy")
    )


def _header(rows: DataFrame, columns: list[str], strings: DataFrame) -> DataFrame:
    """One row: string ids of the two value titles and the total value; running it on an empty result is an error."""
    _, count, value = columns[:3]
    sum_of_values = F.sum(F.col("value") * F.col("repeats"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(sum_of_values, F.lit(0)).alias("total"))

    def title(column: str) -> Column:
        return strings.where(F.col("value") == column).select("string_id").scalar()

    duration = F.when(F.col("n") == 0, F.raise_error(F.lit("empty result")).cast("bigint")).otherwise(F.col("total"))
    return total.select(
        title(count).alias("count_type"), title(value).alias("value_type"), duration.alias("duration_nanos")
    )
