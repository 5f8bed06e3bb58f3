"""Plain text: line blocks, paragraphs by blank lines, and decoding of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import strip
from ..operators.blocks import lines

SUFFIXES = (".txt", ".md")


#: The control characters of Latin-1 to which Windows-1252 gives other meanings, and those.
CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
MEANINGS = "".join(bytes([ord(c)]).decode("cp1252") for c in CONTROLS)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Windows-1252 (bytes without a meaning there as Latin-1)."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.translate(F.decode(content, "iso-8859-1"), CONTROLS, MEANINGS))


def read(spark: SparkSession, path: str) -> DataFrame:
    """documents(doc_id, source_path, source_format, text) for the text files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = F.lower("path").rlike(r"\.(txt|md)$")
    return files.where(wanted).select(F.col("path").alias("doc_id"), F.col("path").alias("source_path"), F.lit("txt").alias("source_format"), decoded(F.col("content")).alias("text"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """Blocks of texts whose paragraphs are set off by blank lines: doc_id, pos (of the first line), block_type, heading_level, text.

    Lines that begin with # are headings of that many levels; short lines in capitals are headings of level 1; other
    neighbouring lines are joined by a space.
    """
    s = strip(F.col("text"))
    df = lines(documents).withColumn("text", F.regexp_replace("text", "\r$", "")).withColumns({"s": s, "__hash": F.col("text").startswith("#")})
    heading = (F.col("s") != "") & (F.col("__hash") | P.text_heading(F.col("text")))
    df = df.withColumn("__heading", heading)
    upto = Window.partitionBy("doc_id").orderBy("pos")
    df = df.withColumn("__run", F.sum((F.col("__heading") | (F.col("s") == "")).cast("int")).over(upto)).where("s <> ''")
    level = F.when(F.col("__hash"), F.least(F.length(F.regexp_extract("text", "^#+", 0)), F.lit(6))).otherwise(1)
    headings = df.where("__heading").select("doc_id", "pos", F.lit("heading").alias("block_type"), level.cast("int").alias("heading_level"), F.when(F.col("__hash"), strip(F.regexp_replace("text", "^#+|#+$", ""))).otherwise(F.col("s")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ")
    body = df.where("not __heading").groupBy("doc_id", "__run").agg(F.min("pos").alias("pos"), joined.alias("text"))
    return headings.unionByName(body.select("doc_id", "pos", F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("heading_level"), "text"))
