"""Readers and the key/value relation derived from vectors.

A cache is the relation kv(layer, batch, head, pos, key, value): one row for each position of each head. Vectors are stored as
floats and computed with as doubles."""

from __future__ import annotations

import tempfile
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = ["layer", "batch", "head"]
KEYS = [*HEAD, "pos"]
WIDTH = 32


#: Rows of an Arrow batch: texts are wide, and a Python worker holds whole batches.
BATCH_ROWS = "1024"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of one folder. Where the session has Spark's own number of rows for Arrow batches, it gets BATCH_ROWS from here on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_from_vectors(vectors: DataFrame, layers: int = 2, heads: int = 2, width: int = WIDTH) -> DataFrame:
    """Vectors numbered 0, 1, ... become a dense cache: layer, head and position are digits of the number; the first half of a vector is the key, the second the value."""
    vec = F.col("embedding").cast("array<double>")
    return vectors.select(
        (F.col("vec_id") % layers).cast("int").alias("layer"),
        F.lit(0).alias("batch"),
        (F.expr(f"vec_id div {layers}") % heads).cast("int").alias("head"),
        F.expr(f"vec_id div {layers * heads}").cast("int").alias("pos"),
        F.slice(vec, 1, width).alias("key"),
        F.slice(vec, width + 1, width).alias("value"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where the setting is absent it is a temporary one on one machine, as in tests, and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="heddle-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Tables:
    """The tables of one folder, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def kv(self) -> DataFrame:
        return kv_from_vectors(self.embeddings)
