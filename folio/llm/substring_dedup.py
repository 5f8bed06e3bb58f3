"""Substring dedup by content-defined chunks.

A gear hash rolls over each text's bytes; a chunk ends where the hash has zeros under a mask and the chunk is long
enough (or too long), so boundaries follow the content and an insertion shifts no later chunk.  A chunk never ends
inside a character, and a last chunk that would be too short belongs to the one before.  Chunks are compared by a
128-bit digest.  The first chunk with a digest, in the order of (doc_id, offset), is kept and the others are removed.

The first of each digest comes from a hash aggregate, which reduces a passage that a third of the corpus shares to one
row a task before its shuffle; chunks are then joined to it, and Spark can split that join's skewed partitions.  The
chunks of all texts are written once and read for both.

Defined results: null and empty texts have no chunks and are never named; repeated rows of one doc_id count as one
text after the other (the second's chunks repeat the first's, and name the same doc_id as source); rows with a null
doc_id come last in the order; an empty table gives an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

GEAR_SEED = 1
REACH = 16  # bytes that the gear hash below depends on
BLOCK_BYTES = 4_000_000


def gear_table() -> np.ndarray:
    return np.random.default_rng(GEAR_SEED).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash at every byte: h = (h << 1) + table[byte], which holds the last 16 bytes; by doubling."""
    h = table[data]
    reach = 1
    while reach < REACH:
        grown = h.copy()
        grown[reach:] += h[:-reach] << np.uint16(reach)
        h, reach = grown, 2 * reach
    return h


def cuts(data: np.ndarray, table: np.ndarray, least: int, bits: int, most: int) -> list[int]:
    """Ends of the chunks of one text (UTF-8), each where a character ends."""
    mask = np.uint16(((1 << bits) - 1) << (16 - bits))
    borders = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))

    def border(at):
        return borders[np.minimum(np.searchsorted(borders, at), len(borders) - 1)]

    ends, start = [], 0
    for at in [*np.unique(border(np.flatnonzero((gear_hash(data, table) & mask) == 0) + 1)).tolist(), len(data)]:
        while at - start > most + 3:
            start = int(border(start + most))
            ends.append(start)
        if at - start >= least:
            ends.append(at)
            start = at
    if start < len(data):  # the rest is too short for a chunk of its own
        ends[-1:] = [len(data)]
    return ends


def chunks(docs: DataFrame, least: int = 24, bits: int = 5, most: int = 512) -> DataFrame:
    """doc_id, start, length, hi, lo (the digest's halves) for every chunk; chunks have at least `least` bytes, but for texts shorter than that."""
    docs = common.documents(docs).select("doc_id", F.col("text").cast("binary"))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, k) for c, k in (("start", T.LongType()), ("length", T.IntegerType()), ("hi", T.LongType()), ("lo", T.LongType())))])
    table = gear_table()

    def run(batches):
        blake = hashlib.blake2b
        for batch in batches:
            rows, starts, lengths, digests = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                text, start = text.as_py(), 0
                for end in cuts(np.frombuffer(text, np.uint8), table, least, bits, most):
                    rows.append(row)
                    starts.append(start)
                    lengths.append(end - start)
                    digests.append(blake(text[start:end], digest_size=16).digest())
                    start = end
                if len(rows) > 200_000:
                    yield made(batch, rows, starts, lengths, digests)
                    rows, starts, lengths, digests = [], [], [], []
            yield made(batch, rows, starts, lengths, digests)

    def made(batch, rows, starts, lengths, digests):
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def repeated(docs: DataFrame, least: int = 24, bits: int = 5, most: int = 512) -> DataFrame:
    """doc_id, start, length, source_doc_id, source_start for each chunk that repeats an earlier one; offsets are bytes."""
    found = common.durable(chunks(docs, least, bits, most), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "start")
    sources = found.groupBy("hi", "lo").agg(F.min(place).alias("source"), F.max(place).alias("last")).where("source <> last").select("hi", "lo", "source")
    joined = found.join(sources, ["hi", "lo"])
    return joined.where(place != F.col("source")).select("doc_id", "start", "length", F.col("source.doc_id").alias("source_doc_id"), F.col("source.start").alias("source_start"))


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """text without byte spans (start, length), which may overlap; bytes of a character that only partly goes are left out with it."""
    data, kept, at = text.encode(), [], 0
    for start, length in sorted(spans):
        kept.append(data[at : max(at, start)])
        at = max(at, start + length)
    return b"".join([*kept, data[at:]]).decode(errors="ignore")


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the byte spans (doc_id, start, length) cut from their texts; other columns as they are, whatever their names.  Spans
    begin and end where characters do, as those of `repeated` do.  Each text is rebuilt once from the gaps between its spans."""
    name = common.unused(docs, "cut")
    gathered = spans.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
    cut = gathered.select(F.struct(F.col("doc_id").alias("id"), "spans").alias(name))

    @F.pandas_udf("string")
    def kept(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else cut_out(t, [(x["start"], x["length"]) for x in s]) for t, s in zip(text, found)], dtype=object)

    joined = docs.join(cut, F.col("doc_id") == F.col(name)["id"], "left")
    return joined.withColumn("text", F.when(F.col(name).isNotNull(), kept("text", F.col(name)["spans"])).otherwise(F.col("text"))).select(*docs.columns)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose chunks: how many, their bytes, the spans (start:end, joined by commas) and the documents that keep them."""
    found = repeated(common.read(spark, sf_dir, "documents"))
    spans = F.array_sort(F.collect_list(F.struct("start", "length")))
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("length").alias("n_removed"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), (s["start"] + s["length"]).cast("string"))), ",").alias("spans"),
        F.array_sort(F.collect_set("source_doc_id")).alias("source_doc_ids"),
    )


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
