"""Messages of a session kept for clients: each gets what came since it was last there, none twice."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spanweave.streaming.session import Sink

_NUMBER = StructType([StructField("number", LongType())])
_MESSAGES = StructType([StructField("seq", LongType()), StructField("message", StringType()), StructField("number", LongType()), StructField("kind", StringType())])


@dataclass
class MessageLog:
    """Messages of a stream's batches as JSON rows in a shared folder, and how far each client has read.

    A batch is seen once it is committed, whole: one that failed half-way shows nothing, and its next run replaces
    what it had written. A client's cursor is the last batch that it has confirmed, kept beside the messages, so that
    it outlives the session; a new client starts behind the last committed batch. Ids of clients are random, so
    two that come in one millisecond are two. Messages are read where they lie; only batch numbers come to the driver.
    """

    spark: SparkSession
    path: str

    def sink(self, number: int, onward: Sink | None = None) -> Sink:
        """A sink that adds each DataFrame of batch number to the log, then sends it onward.

        What a failed run of the batch had written goes first; a batch that is committed already is only sent onward.
        """
        done = number <= self._last("commits")
        if not done:
            files, p = self._files(f"messages/number={number}")
            files.delete(p, True)

        def add(kind: str, df: DataFrame) -> None:
            if not done:
                rows = df.select(F.monotonically_increasing_id().alias("seq"), F.to_json(F.struct(*df.columns)).alias("message"))
                rows.write.mode("overwrite").parquet(f"{self.path}/messages/number={number}/kind={kind}")
            if onward is not None:
                onward(kind, df)

        return add

    def _mark(self, folder: str, number: int) -> None:
        self.spark.range(1).select(F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("append").parquet(f"{self.path}/{folder}")

    def _last(self, folder: str) -> int:
        if not self._files(folder)[0].exists(self._files(folder)[1]):
            return -1
        return self.spark.read.schema(_NUMBER).parquet(f"{self.path}/{folder}").agg(F.coalesce(F.max("number"), F.lit(-1))).head()[0]

    def _files(self, folder: str) -> tuple:
        """The file system of a folder of the log, and the folder as its path."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commit(self, number: int) -> None:
        """Show batch number to clients; a batch that is committed again stays the same."""
        self._mark("commits", number)

    def connect(self, client: str | None = None) -> str:
        """The client's id: a new one, with its cursor at the last committed batch, or one that comes back with its own."""
        client = client or uuid.uuid4().hex
        files, p = self._files(f"cursors/{client}")
        if not files.exists(p):
            self._mark(f"cursors/{client}", self._last("commits"))
        return client

    def unread(self, client: str) -> tuple[DataFrame, int]:
        """(messages(number, kind, seq, message), last batch among them): what is committed behind the client's cursor.

        Rows of a batch and kind have their order by seq. Until the client confirms the last batch it gets the same again.
        """
        since, last = self._last(f"cursors/{client}"), self._last("commits")
        if last <= since:
            return self.spark.createDataFrame([], _MESSAGES).select("number", "kind", "seq", "message"), since
        d = self.spark.read.schema(_MESSAGES).option("basePath", f"{self.path}/messages").parquet(f"{self.path}/messages")
        return d.where(F.col("number").between(since + 1, last)).select("number", "kind", "seq", "message"), last

    def confirm(self, client: str, last: int) -> None:
        """The client has everything up to batch last; a cursor doesn't go back."""
        self._mark(f"cursors/{client}", last)
