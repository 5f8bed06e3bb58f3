"""The block table: one row for each paragraph, heading or table of a document, in order.

Keys are doc_id and pos.  Operators need block_type and text; attributes that a source doesn't know may be missing
and count as null.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

ATTRIBUTES = {
    "block_id": "string", "block_type": "string", "heading_level": "int", "style_id": "string", "style_name": "string", "ind_left": "int", "ind_first_line": "int", "space_before": "int",
    "space_after": "int", "alignment": "string", "font_size": "double", "all_bold": "boolean", "all_italic": "boolean", "blank_before": "boolean", "blank_after": "boolean",
    "page_break": "boolean", "protected_zone": "string", "xml_tag": "string", "merged_from": "array<string>", "highlight": "string", "group_id": "string",
    "semantic": "struct<role:string,layout_kind:string,quote_kind:string,lineation:string,lines:array<string>,genre_hint:string,genre_confidence:double,genre_source:string>",
}


#: Bytes of text in a partition: a task's memory follows from these, not from the size of the table.
PART_BYTES = 8 << 20


def parts(documents: DataFrame) -> int:
    """How many partitions of PART_BYTES the texts of documents make, at least one a core; one pass over their lengths."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(documents.sparkSession.sparkContext.defaultParallelism, math.ceil(size / PART_BYTES))


def dealt(documents: DataFrame, n: int | None = None) -> DataFrame:
    """documents dealt by doc_id into n partitions (parts), before they become lines: work on texts has all cores, however few files
    and row groups hold them, and every window and group over a document's blocks uses this exchange.  A number that is given isn't
    coalesced, so partitions stay this small."""
    return documents.repartition(n or parts(documents), "doc_id")


def order(*, desc: bool = False):
    """Rows of a document by position; every operator over neighbours uses this window, so one exchange serves them all."""
    return Window.partitionBy("doc_id").orderBy(F.desc("pos") if desc else "pos")


def complete(df: DataFrame) -> DataFrame:
    """Adds the attributes that df lacks, as nulls; block_type defaults to paragraph and block_id to b<pos + 1>."""
    missing = {c: F.lit(None).cast(t) for c, t in ATTRIBUTES.items() if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    return df.withColumns({"block_type": F.coalesce("block_type", F.lit("paragraph")), "block_id": F.coalesce("block_id", F.concat(F.lit("b"), (F.col("pos") + 1).cast("string"))), "text": F.coalesce("text", F.lit(""))})


def lines(documents: DataFrame) -> DataFrame:
    """One block for each line of documents(doc_id, text)."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


def stripped(df: DataFrame) -> DataFrame:
    """Adds `s`, the text without white space at its ends."""
    return df.withColumn("s", strip(F.col("text")))
