"""Views that arrive as a stream, added to a back projection as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.project import Projector


def back_projection(projector: Projector, rays: DataFrame) -> DataFrame:
    """A streaming table of rays (a, d, p) as the running sums (r, c, v): back projection is linear, so that the state is one sum for each pixel."""
    return projector.bp(rays)


def accumulate_views(projector: Projector, rays: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a query whose table name, in the driver's memory, has the back projection of all that has arrived: for images that fit there."""
    writer = back_projection(projector, rays).writeStream.outputMode("complete").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


class Accumulator:
    """A back projection in a folder: each batch of rays adds a table of its own sums, by the batch's number, so that a batch that is run again counts once.

    The driver holds no values. Every FOLD batches the tables before them are summed into one.
    """

    FOLD = 64

    def __init__(self, projector: Projector, folder: str):
        self.projector, self.folder, self.spark = projector, folder, projector.spark

    def start(self, rays: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        """rays: a streaming table (a, d, p). checkpoint: where the stream's progress is kept, beside the sums if not named."""
        return rays.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint or f"{self.folder}/progress").start()

    def add(self, batch: DataFrame, number: int) -> None:
        self.projector.bp(batch).write.mode("overwrite").parquet(f"{self.folder}/sums/batch={number}")
        if number % self.FOLD == self.FOLD - 1:
            # The folded table comes first, and tables up to its number are left out from then on: a failure between leaves the old ones in use.
            self.table().write.mode("overwrite").parquet(f"{self.folder}/folded/upto={number}")

    def _read(self, kind: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.folder}/{kind}") if fs.exists(path) else None

    def table(self) -> DataFrame:
        """(r, c, v): the sums of all batches so far."""
        sums, folded = self._read("sums"), self._read("folded")
        if sums is None:
            return self.projector.pixels().withColumn("v", F.lit(0.0)).limit(0)
        parts = sums
        if folded is not None:
            last = folded.agg(F.max("upto")).first()[0]
            parts = sums.where(F.col("batch") > last).drop("batch").unionByName(folded.where(F.col("upto") == last).drop("upto"))
        return parts.groupBy("r", "c").agg(F.sum("v").alias("v"))
