"""Near-duplicate documents by SimHash fingerprints and tables of distances to pivots.

Fingerprints that are equal are folded into one row first, so groups of exact copies cost nothing later.  Distinct
fingerprints are dealt into blocks by agreement on all but two of eight bands of eight bits: two fingerprints that
differ in at most two bits share a block, and a block can hold no more than 2**16 distinct fingerprints however the
corpus looks.  Within a block a table holds each fingerprint's Hamming distances to many reference fingerprints;
pairs whose distances to any reference differ by more than the threshold are discarded (triangle inequality), and
the Hamming distance itself is computed for the survivors.  A block returns a spanning forest of its links, never
all its pairs; connected components over those links give the groups.

`one_of_each`, the filtering form, decides by the shingles themselves (five words, Jaccard similarity of 0.8 or more):
see `similar_texts`.

Defined results: null and empty texts, and texts of white space, have fingerprint 0 and are linked like any others;
texts with fewer words than a shingle are hashed whole; repeated rows each get their row back; an empty table gives
an empty result; a group whose ids are all null has component null.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components, similar_texts

BANDS, BAND_BITS = 8, 8
PIVOTS = 32
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """SimHash of the text's word shingles: a bit is 1 if it is 1 in over half of the shingles' XXH64 values."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    take = min(shingle, len(words))
    starts, ends = starts[: len(words) - take + 1], ends[take - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    docs = common.documents(docs).select("doc_id", F.col("text").cast("binary"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def pivots() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(65).integers(0, 2, PIVOTS, dtype=np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def block_links(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (from, to) within blocks, which are runs of equal keys."""
    table = pivot_table(fps, refs)
    order = np.lexsort((table[:, 0], keys))  # within a block by the first coordinate: pairs too far apart there end the search
    keys, fps, table = keys[order], fps[order], table[order]
    parent = np.arange(len(fps))
    step, alive = 1, np.arange(len(fps))
    while len(alive := alive[alive + step < len(fps)]):
        near = keys[alive] == keys[alive + step]
        near &= np.abs(table[alive, 0] - table[np.minimum(alive + step, len(fps) - 1), 0]) <= bits
        alive = alive[near]
        a, b = alive, alive + step
        for k in range(1, table.shape[1], 4):  # the maximum over the coordinates, a few at a time
            if not len(a):
                break
            ok = np.abs(table[a, k : k + 4] - table[b, k : k + 4]).max(axis=1) <= bits
            a, b = a[ok], b[ok]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        a, b = a[linked], b[linked]
        while len(a):
            x, y = parent[a], parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent != (up := parent[parent])).any():
                parent = up
        step += 1
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[child], fps[parent[child]]


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """distinct(fp) -> (u, v): links that connect what differs in at most `bits` <= 2 bits."""
    if bits > 2:
        raise ValueError("blocks leave out two bands, so at most two bits may differ")
    masks = []
    for left_out in combinations(range(BANDS), 2):
        mask = (1 << 64) - 1
        for band in left_out:
            mask ^= ((1 << BAND_BITS) - 1) << (BAND_BITS * band)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)))
    dealt = distinct.select("fp", F.explode(keys).alias("key")).repartition(common.partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    refs = pivots()

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))  # the last block so far, which may go on
        for batch in batches:
            keys = np.concatenate([held[0], batch.column(1).to_numpy()])
            fps = np.concatenate([held[1], batch.column(0).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held = keys[cut:], fps[cut:]
            yield found(keys[:cut], fps[:cut])
        yield found(*held)

    def found(keys, fps):
        same = keys[1:] == keys[:-1]
        some = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else np.zeros(0, bool)
        u, v = block_links(keys[some], fps[some], refs, bits)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return dealt.mapInArrow(run, schema)


def groups(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that can be reached over links, the document's own included."""
    fps = common.durable(fingerprints(docs, shingle), "fingerprints")
    distinct = common.durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    star = components.stars(links(distinct.select("fp"), bits), "simhash")
    placed = distinct.join(star.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = common.durable(placed.join(named, "root").select("fp", "component_id"), "components")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


# --- near-duplicates by similarity


def shingles(text: bytes, size: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates (linked by a Jaccard similarity of word shingles of at least
    `similarity`): the one with the least doc_id; null ids come last.  All columns stay."""
    nodes, star = similar_texts.linked(docs, shingle, similarity)
    placed = nodes.join(star.withColumnRenamed("u", "node"), "node", "left").select("place", "h", F.coalesce("v", "node").alias("root"))
    winners = placed.groupBy("root").agg(F.min(F.struct("place", "h")).alias("w")).select(F.struct(F.col("w.place.doc_id").alias("id"), F.col("w.h").alias("h")).alias(common.unused(docs, "winner")))
    winners = common.durable(winners, "winners")
    named = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    repeats = bool(named.head(1)) or bool(docs.where("doc_id is null").head(1))
    hash_ = F.xxhash64(F.coalesce("text", F.lit("")))
    won = F.col(common.unused(docs, "winner"))
    kept = docs.join(winners, F.col("doc_id").eqNullSafe(won["id"]) & (hash_ == won["h"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept  # whole rows that the table repeats


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL: dict[str, str] = {}
