"""Source files of all supported formats below a folder, and their import by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docx, plain, tei

FORMATS = {".docx": "docx", ".xml": "xml", ".txt": "txt", ".md": "txt"}


class UnsupportedFormat(ValueError):
    """A file whose suffix no reader knows."""


def format_of(path: str) -> str:
    """The format of a path by its suffix, letter case aside."""
    for suffix, name in FORMATS.items():
        if path.lower().endswith(suffix):
            return name
    raise UnsupportedFormat(f"{path}: supported are {', '.join(sorted(FORMATS))}")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, format, size of the source files below folder, in order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    kind = F.coalesce(*(F.when(F.lower("path").endswith(s), F.lit(n)) for s, n in FORMATS.items()))
    return files.withColumn("format", kind).where("format is not null").select("path", "format", "size").orderBy("path")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of every source file below folder."""
    texts = plain.paragraphs(plain.read(spark, folder).select("doc_id", "text"))
    words = docx.blocks(docx.read(spark, folder))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").endswith(".xml"))
    markup = tei.read(files.select(F.col("path").alias("doc_id"), plain.decoded(F.col("content")).alias("xml"))).blocks
    return texts.unionByName(words, allowMissingColumns=True).unionByName(markup, allowMissingColumns=True)
