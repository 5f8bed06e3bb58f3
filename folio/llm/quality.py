"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

A text's terms are its words, and the shapes of its words (runs of lower-case letters, capitals, digits and each
other sign folded to one character) with counts of repeated words and lines.  Either kind is weighted by inverse
document frequency and brought to a length of its own; together they are reduced by a truncated SVD that is fitted on
a bounded sample of labelled rows.  The labelled vectors of that sample (SAMPLE x DIMENSIONS floats, whatever the
corpus) go to every task; every document gets its exact cosine products with all of them in blocks, and its nearest
neighbours vote with their similarity as weight.

Defined results: null and empty texts have no terms, so all labelled vectors are equally near and the score is the
mean label; repeated rows, and rows with a null doc_id, each get a row; without labelled rows every score is 0.5; an
empty table gives an empty result.  Columns other than doc_id and text, and other columns of the labels, are ignored.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE = 6000  # labelled rows that the model may be fitted on
SIZES = (1024, 512)  # terms of either kind, what is in none of them included
WEIGHTS = (1.0, 0.6)  # lengths of the two kinds in a vector
DIMENSIONS = 32
NEIGHBOURS = 31
SHARPNESS = 16  # power of the cosine that a neighbour's vote weighs
BLOCK = 512
GOOD = 0.7


def _shape_table() -> bytes:
    table = bytearray(range(256))
    for b in range(256):
        c = chr(b)
        if b >= 128 or "a" <= c <= "z":
            table[b] = ord("a")
        elif "A" <= c <= "Z":
            table[b] = ord("A")
        elif "0" <= c <= "9":
            table[b] = ord("0")
        elif b < 33:
            table[b] = ord(" ")
    return bytes(table)


def terms(text: bytes, table: bytes) -> tuple[Counter, Counter]:
    """Counts of words, and of word shapes; `again` counts words that repeat the word before, `line` lines that were there before."""
    words = text.split()
    if not words:
        return Counter(), Counter()
    signs = np.frombuffer(text.translate(table), np.uint8)
    folded = signs[np.concatenate([[True], signs[1:] != signs[:-1]])].tobytes()
    shapes = Counter(folded.split())
    lines = [x for x in text.split(b"\n") if x]
    shapes[b"again"] = sum(map(eq, words, words[1:]))
    shapes[b"line"] = len(lines) - len(set(lines))
    return Counter(text.lower().translate(BARE).split()), shapes


BARE = bytes(32 if chr(b) in ".,;:!?\"'()[]{}<>|" else b for b in range(256))


def weigh(found: list[tuple[Counter, Counter]], vocabulary: list[dict[bytes, int]], idf: list[np.ndarray]) -> np.ndarray:
    """Rows of square roots of relative frequencies times idf, each kind at its own length (or zero); what is outside a vocabulary shares its last column."""
    parts = []
    for kind, (known, scale, weight) in enumerate(zip(vocabulary, idf, WEIGHTS)):
        out = np.zeros((len(found), len(scale)))
        for row, counters in zip(out, found):
            for term, n in counters[kind].items():
                row[known.get(term, len(scale) - 1)] += n
        out = np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)) * scale
        parts.append(weight * out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12))
    return np.concatenate(parts, axis=1)


def vocabularies(sample: DataFrame) -> tuple[list[dict[bytes, int]], list[np.ndarray]]:
    """The terms of either kind that most texts of the sample have, counted in Spark, and their inverse document frequencies."""
    table = _shape_table()
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                counts = Counter(), Counter()
                for text in batch.column(0).slice(at, BLOCK):
                    for c, found in zip(counts, terms(text.as_py(), table)):
                        c.update(t for t, n in found.items() if n)
                for kind, c in enumerate(counts):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c), pa.int32()), pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=schema.names)

    summed = sample.select(F.col("text").cast("binary")).mapInArrow(run, schema).groupBy("kind", "term").agg(F.sum("n").alias("n"))
    size = sample.count()
    vocabulary, idf = [], []
    for kind, most in enumerate(SIZES):
        top = summed.where(F.col("kind") == kind).orderBy(F.desc("n"), "term").limit(most - 1).collect()
        vocabulary.append({bytes(r["term"]): i for i, r in enumerate(top)})
        idf.append(np.array([np.log((1 + size) / (1 + r["n"])) + 1 for r in top] + [1.0]))
    return vocabulary, idf


def fit(sample: DataFrame) -> dict | None:
    """Vocabularies, idf, projection, and the unit vectors and labels of the sample's rows."""
    sample = sample.select("doc_id", "text", "label")
    if not sample.head(1):
        return None
    table = _shape_table()
    vocabulary, idf = vocabularies(sample)
    schema = T.StructType([sample.schema["doc_id"], T.StructField("columns", T.BinaryType()), T.StructField("values", T.BinaryType()), T.StructField("label", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                rows = weigh([terms(t.as_py(), table) for t in part.column(1)], vocabulary, idf).astype(np.float32)
                places = [np.flatnonzero(r).astype(np.int16) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.tobytes() for p in places], pa.binary()), pa.array([r[p].tobytes() for r, p in zip(rows, places)], pa.binary()), part.column(2)], names=schema.names)

    got = sample.select("doc_id", F.col("text").cast("binary"), "label").mapInArrow(run, schema).collect()  # at most SAMPLE rows, what isn't zero of them
    got.sort(key=lambda r: r["doc_id"])  # sums of floats depend on the order
    matrix = np.zeros((len(got), sum(map(len, idf))), np.float32)
    for row, r in zip(matrix, got):
        row[np.frombuffer(r["columns"], np.int16)] = np.frombuffer(r["values"], np.float32)
    _, vectors = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    projection = vectors[:, ::-1][:, :DIMENSIONS].copy()
    reduced = matrix @ projection
    reduced /= np.maximum(np.linalg.norm(reduced, axis=1, keepdims=True), 1e-12)
    return {"vocabulary": vocabulary, "idf": idf, "projection": projection, "vectors": reduced.astype(np.float32), "labels": np.array([r["label"] for r in got], np.float32)}


def vote(vectors: np.ndarray, model: dict) -> np.ndarray:
    """Similarity-weighted mean label of the nearest labelled vectors; exact products, a block of documents at a time."""
    cosines = vectors.astype(np.float32) @ model["vectors"].T
    k = min(NEIGHBOURS, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
    scores = (weights * model["labels"][near]).sum(axis=1) / weights.sum(axis=1)
    scores[~vectors.any(axis=1)] = model["labels"].mean()
    return np.clip(scores, 0.0, 1.0)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier)."""
    docs = common.documents(docs).select("doc_id", F.col("text").cast("binary"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    table = _shape_table()
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB at most: SAMPLE x DIMENSIONS floats and sum(SIZES) terms

    def run(batches):
        m = shared.value
        for batch in batches:
            scores = np.zeros(len(batch))
            for at in range(0, len(batch), BLOCK):
                block = batch.column(1).slice(at, BLOCK)
                x = weigh([terms(t.as_py(), table) for t in block], m["vocabulary"], m["idf"]) @ m["projection"]
                scores[at : at + len(block)] = vote(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(common.training_sample(common.documents(docs), common.read(spark, sf_dir, "labels"), "quality", SAMPLE))
    scored = score(docs, model)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}
