"""A profile's tables as chunks of the encoded profile message, with built-in functions only.

Repeated fields of a message may be written in pieces, so each chunk encodes its own rows; the chunks in the order of
(section, part) are the whole message, and no task or driver holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field numbers of the public profile message format.
SAMPLE_TYPE, SAMPLE, LOCATION, FUNCTION, STRINGS, DURATION = 1, 2, 4, 5, 6, 10
VARINT, BYTES = 0, 2
# The last of a message's sections: header, samples, locations, functions, strings.
STRINGS_SECTION = 5


def varint(value: int) -> bytes:
    """A number of the format, for constants."""
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _varint(value: Column) -> Column:
    """A column's numbers as hexadecimal digits: seven bits a byte, lowest first, the top bit set on all but the last."""

    def byte(value: Column, i: Column) -> Column:
        rest = F.call_function("shiftrightunsigned", value, i * 7 + 7)
        more = F.when((i < 9) & (rest != 0), 128).otherwise(0)
        return F.lpad(F.hex(F.call_function("shiftrightunsigned", value, i * 7).bitwiseAND(127) + more), 2, "0")

    # A value has as many bytes as its bits fill, seven in each.
    def bytes_of(value: Column) -> Column:
        last = F.when(value < 0, 9).otherwise(F.greatest(F.length(F.bin(value)) - 1, F.lit(0)) / 7).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: byte(value, i)), "")

    return _let(value.cast("long"), bytes_of)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tag(field: int, kind: int) -> Column:
    return F.lit(varint(field << 3 | kind).hex().upper())


def _number(field: int, value: Column) -> Column:
    """Absent where it is 0."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, "").otherwise(F.concat(_tag(field, VARINT), _varint(value)))


def _block(field: int, digits: Column) -> Column:
    return _let(digits, lambda d: F.concat(_tag(field, BYTES), _varint(F.length(d) / 2), d))


def _packed(field: int, values: Column) -> Column:
    digits = F.array_join(F.transform(values, _varint), "")
    return F.when(F.size(values) > 0, _block(field, digits)).otherwise("")


def _sample() -> Column:
    return _block(SAMPLE, F.concat(_packed(1, F.col("location_ids")), _packed(2, F.array("count", "value"))))


def _location() -> Column:
    def line(part: Column) -> Column:
        return _block(4, F.concat(_number(1, part["function_id"]), _number(2, part["line"]), _number(3, part["col"])))

    lines = F.array_join(F.transform("lines", line), "")
    return _block(LOCATION, F.concat(_number(1, F.col("location_id")), _number(3, F.col("address")), lines))


def _function() -> Column:
    return _block(FUNCTION, F.concat(_number(1, F.col("function_id")), _number(2, F.col("name_id")), _number(4, F.col("file_id"))))


def _header() -> Column:
    types = [_block(SAMPLE_TYPE, _number(1, F.col(t))) for t in ("count_type", "value_type")]
    return F.concat(*types, _number(DURATION, F.col("duration_nanos")))


def profile_chunks(profile, rows_per_chunk: int = 5000) -> DataFrame:
    """(section, part, data) with at most ``rows_per_chunk`` rows in a chunk. Strings are cut by id range and ordered,
    because their position in the message is their id; all else may come in any order."""

    def encoded(section: int, table: DataFrame, digits: Column, number: Column) -> DataFrame:
        rows = table.select(number.alias("number"), digits.alias("digits"))
        chunks = rows.groupBy(F.floor(F.col("number") / rows_per_chunk).alias("part")).agg(
            F.sort_array(F.collect_list(F.struct("number", "digits"))).alias("rows")
        )
        data = F.unhex(F.array_join("rows.digits", ""))
        return chunks.select(F.lit(section).alias("section"), "part", data.alias("data"))

    any_order = F.monotonically_increasing_id()
    return (
        encoded(1, profile.header, _header(), any_order)
        .unionByName(encoded(2, profile.samples, _sample(), any_order))
        .unionByName(encoded(3, profile.locations, _location(), any_order))
        .unionByName(encoded(4, profile.functions, _function(), any_order))
        .unionByName(encoded(STRINGS_SECTION, profile.strings, _block(STRINGS, F.hex(F.encode("value", "utf-8"))), F.col("string_id")))
    )
