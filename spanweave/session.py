"""Session and table helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "spanweave") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the session that the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows of a table that a task sorts or hashes by key at most on average.
ROWS_A_TASK = 500_000


def tasks_of(rows: DataFrame) -> int:
    """Partitions for shuffling a table by key: more of them as it grows, so that a task's memory stays the same. A table of Parquet is counted from its footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
