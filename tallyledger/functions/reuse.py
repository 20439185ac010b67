"""Letting several readers of a frame share its exchanges, and dealing its rows out."""

from pyspark.sql import DataFrame, functions as F

_LEAST_HASH = -(2**31)


def shared(df: DataFrame) -> DataFrame:
    """The same rows, of which every reader asks for all columns.

    Readers that need different columns would each get a plan of their own, pruned to those, and scan the source anew. With
    one condition over all columns, always true, what lies below is the same plan for all, and its exchange runs once.
    """
    return df.where(F.hash(*[F.col(f"`{name}`") for name in df.columns]) >= _LEAST_HASH)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, those of a key together, in as many partitions as the session names (spark.sql.shuffle.partitions).

    Left to itself, adaptive execution merges them into about one a core, as long as they stay below 64 MB of packed rows; sorted
    or hashed by a task these take dozens of times as much. With a number named, what a task holds is rows / partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
