"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; every other column is left behind, so clashes can't occur."""
    return df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir.  Where that is unset, a local session (tests) gets a folder
    of its own; a cluster is refused, for its executors wouldn't see each other's files."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut in the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, such that df has no such column (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for models that are costly to load."""
    holder = sys.modules.setdefault("folio_worker_cache", types.ModuleType("folio_worker_cache"))
    return holder.__dict__.setdefault("entries", {})


def held_out(doc_id) -> "Column":  # noqa: F821
    """Rows whose labels may not be learnt from; a null doc_id, which no label can name, counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """(doc_id, text, label): at most `size` labelled documents that aren't held out, chosen by a hash of doc_id.

    The chosen ids are at most `size` rows, so they are broadcast to the one scan of the texts; the sample is written
    to the shared folder.  Several labels of one doc_id count as their maximum, and of several texts of one doc_id the
    least is taken; null labels and ids don't count.
    """
    labels = labels.select("doc_id", label)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(size)
    picked = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label")
    return durable(picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "sample")
