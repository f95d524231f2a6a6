"""Tables written to the folder that all executors share, and joins that check a side's size first."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, SparkSession] = {}

#: Most rows, and bytes as JSON, of a side that is broadcast; a larger side is joined by shuffling both.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 200_000, 32 << 20


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, wherever Catalyst moves the expression and however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session (tests) gets a local one; a cluster raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spanweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    _WRITTEN[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: all that was made of them is written itself."""
    for t in tables:
        path = getattr(t, "_staged_at", None)
        if path in _WRITTEN:
            drop(_WRITTEN.pop(path), path)


def clear() -> None:
    """Delete every staged table of this process."""
    while _WRITTEN:
        path, spark = _WRITTEN.popitem()
        try:
            drop(spark, path)
        except Exception:  # the session has already ended
            return


atexit.register(clear)


def sized(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark a side for broadcasting only when its counted rows and measured bytes are within the bounds."""
    rows, size = small.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).head()
    return F.broadcast(small) if rows <= max_rows and (size or 0) <= max_bytes else small


def without(columns: list[str], names: list[str]) -> list[str]:
    """The columns that have none of these names, compared as Spark does: case doesn't count."""
    low = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in low]
