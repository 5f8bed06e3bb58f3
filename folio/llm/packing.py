"""Packing of tokenised documents into sequences of fixed length.

Method: shortest-pack-first over the length histogram.  Documents are tokenised once and cut into full pieces of
``max_tokens`` and a remainder.  The histogram of piece lengths (at most ``max_tokens`` rows, whatever the corpus)
is packed on the driver: lengths are placed longest first, each into the pattern with the most room left, and only
counts of patterns are kept.  Pieces then get a rank within their length, and the rank alone says which copy of
which pattern, and which slot of it, a piece takes.

Defined results: a null or empty text is one piece that holds the closing id alone; repeated rows are packed once
for each row; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

GPT2_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_CHARS = 4_000_000
GROUP_ROWS = 500  # rows of one length that one group numbers
SHELF = 10_000  # groups whose counts one task adds up


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 bytes are themselves, the rest follow from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_encoder(path: str):
    """A function from texts to lists of ids, for a byte-level BPE file of the tokenizers library.

    The vocabulary of such a file lists merges in order of rank, so the ids serve as ranks for a faster encoder; a
    file of any other kind is run by the tokenizers library itself.  Special strings in a text are their one id, as the
    library has it by default.
    """
    cache = common.worker_cache()
    if path not in cache:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        special = {t["content"]: t["id"] for t in added}
        plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))  # what is found in a text is that string alone
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain:
            import tiktoken

            of = byte_alphabet()
            ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            encoding = tiktoken.Encoding(path, pat_str=GPT2_SPLIT, mergeable_ranks=ranks, special_tokens=special)
            cache[path] = lambda texts: [encoding.encode(t, allowed_special="all") if any(x in t for x in special) else encoding.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            cache[path] = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return cache[path]


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens.  Documents are cut every max_tokens ids."""
    docs = common.documents(docs)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")])

    def run(batches):
        encode = load_encoder(tokenizer_path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            row, out = 0, [[] for _ in range(5)]
            while row < len(keys):
                some, room = [], BATCH_CHARS
                while row + len(some) < len(keys) and (room > 0 or not some):
                    some.append(texts[row + len(some)].as_py())
                    room -= len(some[-1])
                for ids in encode(some):
                    all_ids = np.array([*ids, end_id], dtype="<u4")
                    for start in range(0, len(all_ids), max_tokens):
                        part = all_ids[start : start + max_tokens]
                        for column, value in zip(out, (row, start, len(part), zlib.crc32(part.tobytes()), len(all_ids))):
                            column.append(value)
                    row += 1
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:])], names=schema.names)

    return docs.mapInArrow(run, schema)


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) and how often each is used; every length is used as often as counts says.

    For each length, longest first, open patterns with the most room are extended first; patterns without enough
    room stay; what finds no room opens new sequences.
    """
    by_room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        grown = []
        for room in sorted((r for r, open_ in by_room.items() if open_ and r >= length), reverse=True):
            open_ = by_room[room]
            while open_ and left:
                lengths, n = open_.pop()
                fits = room // length
                whole = min(n, left // fits)  # take as many of this length as the room holds
                if whole:
                    grown.append((room - fits * length, lengths + [length] * fits, whole))
                    left -= whole * fits
                    n -= whole
                if n and left:  # fewer are left than one pattern could hold
                    grown.append((room - left * length, lengths + [length] * left, 1))
                    n, left = n - 1, 0
                if n:
                    open_.append((lengths, n))
                    break
            if not left:
                break
        if left:
            fits = size // length
            if left // fits:
                grown.append((size - fits * length, [length] * fits, left // fits))
            if left % fits:
                grown.append((size - left % fits * length, [length] * (left % fits), 1))
        for room, lengths, n in grown:
            by_room[room].append((lengths, n))
    return [p for room in sorted(by_room) for p in by_room[room]]


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length: rank at which a pattern's share begins, its first sequence, its slots a sequence, and where in `offsets` they are."""
    table: dict[int, dict[str, list]] = defaultdict(lambda: {"first_rank": [], "sequence": [], "per": [], "at": [], "offsets": [], "next": 0})
    sequence = 0
    for lengths, n in patterns:
        places: dict[int, list[int]] = defaultdict(list)
        offset = 0
        for length in lengths:
            places[length].append(offset)
            offset += length
        for length, offsets in places.items():
            t = table[length]
            t["first_rank"].append(t["next"])
            t["sequence"].append(sequence)
            t["per"].append(len(offsets))
            t["at"].append(len(t["offsets"]))
            t["offsets"] += offsets
            t["next"] += n * len(offsets)
        sequence += n
    return {length: {k: np.array(v, dtype=np.int64) for k, v in t.items()} for length, t in table.items()}


def rank_within(df: DataFrame, key: str, order: list[str], sizes: dict[int, int], rows: int = GROUP_ROWS) -> DataFrame:
    """Adds `rank`, counted from 0 within each value of key.  A value is dealt over one group for each `rows` of its rows
    (sizes says how many it has), so that one which holds a third of all is numbered in parallel, by tasks of bounded
    size; the groups' counts give the offsets, added up in two levels, so no task sees the counts of all groups either."""
    groups = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, -(-n // rows)))) if sizes else F.create_map(F.lit(0), F.lit(1))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(*order), groups[F.col(key)]))
    counts = common.durable(dealt.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("shelf", F.floor(F.col("bucket") / SHELF)), "counts")

    def running(df: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
        before = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("n").over(before), F.lit(0)))

    # in two levels: groups within a shelf of SHELF groups, and shelves, of which a value has few
    shelves = running(counts.groupBy(key, "shelf").agg(F.sum("n").alias("n")), [key], "shelf", "first").drop("n")
    bases = running(counts, [key, "shelf"], "bucket", "base").join(shelves, [key, "shelf"]).select(key, "bucket", (F.col("first") + F.col("base")).alias("base"))
    numbered = dealt.withColumn("in_bucket", F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1)
    return numbered.join(bases, [key, "bucket"]).withColumn("rank", F.col("base") + F.col("in_bucket")).drop("base", "in_bucket", "bucket")


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each document."""
    cut = common.durable(pieces(docs, tokenizer_path, max_tokens, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_tokens rows
    table = slots(pack_histogram(histogram, max_tokens))
    ranked = rank_within(cut, "length", ["doc_id", "start", "length", "ids_crc32", "doc_tokens"], histogram)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows, t = np.flatnonzero(lengths == length), table[int(length)]
                share = np.searchsorted(t["first_rank"], ranks[rows], side="right") - 1
                within = ranks[rows] - t["first_rank"][share]
                sequence[rows] = t["sequence"][share] + within // t["per"][share]
                offset[rows] = t["offsets"][t["at"][share] + within % t["per"][share]]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.select(*names, "rank").mapInArrow(place, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}
