"""What the corpus operators share: input columns, Arrow maps, shared-folder checkpoints."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a null text is empty."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def as_bytes(docs: DataFrame) -> DataFrame:
    """The text as UTF-8, for operators whose rules are about ASCII characters."""
    return docs.withColumn("text", F.col("text").cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, one of our own, which only a local session can share, so that others raise."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="radonlake-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Computes df once and cuts its lineage, with files that outlive an executor. parts: how many files at most, for tables known to be small."""
    shared_dir(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint()


#: A key with more than one in MOST_HOT of all rows, and HOT_LEAST at least, is hot; there are fewer than MOST_HOT of those.
MOST_HOT, HOT_LEAST = 1000, 50_000


def join_hot(rows: DataFrame, small: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with small, which has a row for each key and in column n about how many rows that key has.

    Hot keys' rows meet where they are, as fewer than MOST_HOT rows of small are sent to all executors for them; only the others' rows are
    shuffled. total: how many rows there are. how: inner or left. Column n is left out.
    """
    limit = max(HOT_LEAST, total // MOST_HOT)
    hot = cut(small.where(F.col(n) > limit), 1).drop(n)
    cool = small.where(F.col(n) <= limit).drop(n)
    if hot.isEmpty():
        return rows.join(cool, key, how)
    sent = F.broadcast(hot)
    return rows.join(sent, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key, how))


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


#: Rows that a Python operator works on at once; texts can be long, so that a batch is cut further by bytes.
SLICE_ROWS, SLICE_BYTES = 2048, 16 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(SLICE_ROWS, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() > SLICE_BYTES and batch.slice(at, n).nbytes > SLICE_BYTES:
                n //= 2
            yield batch.slice(at, n)
            at += n


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over slices of bounded size."""
    on_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(slices(batches))

    return df.mapInArrow(run, schema)


def load_tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer file; folder overrides where it is looked for."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
