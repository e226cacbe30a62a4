"""Call paths kept once: a dictionary of paths beside an event table that holds their keys.

A key is a digest of 16 bytes, the same wherever and whenever a path is met, so that dictionaries of several captures can
be put together. Analyses then group and shuffle keys and numbers; paths are joined to the result, one for each row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STACKS = {"ustack": "ustack_key", "kstack": "kstack_key"}


def path_key(stack: Column) -> Column:
    """Null, empty and any other paths have different keys."""
    return F.unhex(F.md5(F.to_json(F.struct(stack.alias("s")))))


def no_path(key: str) -> Column:
    """True for the keys of a null and an empty path."""
    empty = [path_key(F.lit(None).cast("array<int>")), path_key(F.array().cast("array<int>"))]
    return (F.col(key) == empty[0]) | (F.col(key) == empty[1])


def intern_paths(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with keys in place of call paths, dictionary (key, stack)) of an event table."""
    keyed = events.withColumns({key: path_key(F.col(stack)) for stack, key in STACKS.items()})
    both = F.array(*[F.struct(F.col(key).alias("key"), F.col(stack).alias("stack")) for stack, key in STACKS.items()])
    paths = events.withColumns({key: path_key(F.col(stack)) for stack, key in STACKS.items()}).select(F.explode(both).alias("p")).select("p.*")
    return keyed.drop(*STACKS), paths.dropDuplicates(["key"])


def merge_paths(*dictionaries: DataFrame) -> DataFrame:
    """One dictionary of several captures' ones."""
    out = dictionaries[0]
    for other in dictionaries[1:]:
        out = out.unionByName(other)
    return out.dropDuplicates(["key"])


def with_path(result: DataFrame, paths: DataFrame, stack: str) -> DataFrame:
    """The result with the call path of its key column, which it takes the place of."""
    key = STACKS[stack]
    named = paths.select(F.col("key").alias(key), F.col("stack").alias(stack))
    return result.join(named, key, "left").select(stack, *[c for c in result.columns if c != key])
