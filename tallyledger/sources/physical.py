"""Where physical tables come from and where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def physical_source(
    spark: SparkSession,
    *,
    path: str | None = None,
    table: str | None = None,
    format: str = "parquet",
    jdbc: dict[str, str] | None = None,
) -> DataFrame:
    """Read a physical table from files, from the catalog or over JDBC.

    For JDBC give `dbtable` and, so that the read is split over executors, `partitionColumn` (the
    movement date), `lowerBound`, `upperBound` and `numPartitions`; the connection is read-only by
    intent. Filters and column pruning of later operators reach all three kinds of source.
    """
    given = [kind for kind, value in (("path", path), ("table", table), ("jdbc", jdbc)) if value]
    if len(given) != 1:
        raise ValueError(f"give exactly one of path, table or jdbc, not {given}")
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc_options(jdbc)).load()
    if table:
        return spark.table(table)
    return spark.read.format(format).load(path)


def jdbc_options(options: dict[str, str]) -> dict[str, str]:
    """Complete JDBC options: read-only intent, wall-clock timestamps, large fetches."""
    split = [name for name in ("partitionColumn", "lowerBound", "upperBound", "numPartitions") if name in options]
    if split and len(split) < 4:
        raise ValueError(f"a split read needs all of partitionColumn, bounds and numPartitions, not {split}")
    url = options["url"]
    if url.startswith("jdbc:sqlserver:") and "applicationintent" not in url.lower():
        url = url.rstrip(";") + ";applicationIntent=ReadOnly"
    return {"fetchsize": "10000", "preferTimestampNTZ": "true"} | options | {"url": url}


def result_sink(df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite") -> None:
    """Write a result with a header as CSV, or in any other format, one file per task."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True).option("emptyValue", "").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    writer.format(format).save(path)
