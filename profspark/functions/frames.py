"""Column expressions over call paths (arrays of frames) and names."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(stack: str | Column) -> Column:
    return F.size(stack) == 0


def combined_stack(dedup: bool = True) -> Column:
    """Kernel frames, then user frames. With ``dedup`` a frame that repeats is kept at its first place only."""
    return F.array_union("kstack", "ustack") if dedup else F.concat("kstack", "ustack")


def frame_names(stack: str | Column, with_offset: bool = False) -> Column:
    """The frames' names, in order; ``with_offset`` gives ``name-<offset in lower-case hex>``."""
    column = F.col(stack) if isinstance(stack, str) else stack
    if not with_offset:
        return column["name"]
    return F.transform(column, lambda f: offset_name(f["name"], f["offset"]))


def offset_name(name: Column, offset: Column) -> Column:
    return F.concat_ws("-", name, F.lower(F.hex(offset)))


def stack_text(stack: str | Column) -> Column:
    """One line per call path, for reports and comparisons: name:address:offset joined by ';'."""
    return F.array_join(
        F.transform(stack, lambda f: F.concat_ws(":", f["name"], f["address"].cast("string"), f["offset"].cast("string"))),
        ";",
    )


def c_string(raw: str | Column, size: int = 16) -> Column:
    """Text of a fixed-size, NUL-terminated buffer: at most ``size`` bytes, cut at the first NUL."""
    column = F.col(raw) if isinstance(raw, str) else raw
    return F.substring_index(F.decode(F.substring(column.cast("binary"), 1, size), "UTF-8"), "\0", 1)


def unsigned_to_long(column: str | Column) -> Column:
    """A 64-bit unsigned value read as decimal(20,0), as the signed long with the same bits."""
    value = F.col(column) if isinstance(column, str) else column
    wide = value.cast("decimal(20,0)")
    limit = F.lit("9223372036854775808").cast("decimal(20,0)")
    span = F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(wide >= limit, (wide - span).cast("bigint")).otherwise(wide.cast("bigint"))
