"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph (line) is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs' vectors,
lane by lane, modulo 2**32.  So the order of paragraphs doesn't matter, and paragraphs can be inserted or deleted by
adding or subtracting their vectors (`add`, `subtract`) without the rest of the text.

A vector has two parts.  The first, 32 lanes, comes from the paragraph's SHA-256 digest and decides equality.  The
second comes from the paragraph's word triples: 128 lanes count the triples whose hash has a 1 in that lane's bit,
and one lane counts the triples.  Taken as sums of +1 and -1 these lanes estimate inner products of multisets of
triples, which gives the likeness of two fingerprints.

Everything is built-in functions: triples are exploded and summed by a hash aggregate that keeps one row a document,
in the partition where the text already is.

Defined results: null and empty texts are one empty paragraph; texts whose paragraphs are the same multiset have the
same fingerprint; repeated rows each get a row; an empty table gives an empty result; a row whose doc_id is null has
no place in the order of documents, so its next document is itself.  Columns other than doc_id and text are ignored.
doc_ids are integers; other types are refused by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

EXACT, COUNTS = 32, 128  # lanes
LOW = 0xFFFFFFFF
WEIGHT = 4096
PAIR = (1 << 32) | 1  # the lowest bit of each half of a long


def _half(value: Column, high: bool) -> Column:
    return F.shiftrightunsigned(value, 32) if high else value.bitwiseAND(F.lit(LOW))


def vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts(*keys, txt) -> (*keys, lanes): the sum of the paragraphs' vectors for each distinct key."""
    paragraphs = texts.select(*keys, F.explode(F.split("txt", "\n")).alias("p"))
    hashed = paragraphs.select(*keys, F.unhex(F.sha2(F.col("p").cast("binary"), 256)).alias("digest"), F.split("p", r"\s+").alias("w"))
    triples = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"), F.slice("w", F.lit(3), F.size("w")).alias("c"))
    exploded = hashed.select(*keys, "digest", F.posexplode(triples).alias("i", "t"))
    first = F.xxhash64("t.a", "t.b", "t.c")
    rows = exploded.select(*keys, "digest", "i", first.alias("h0")).withColumn("h1", F.xxhash64("h0", F.lit(1)))
    # two lanes of counts share a long: a text of less than 2 GB has too few triples for the lower to reach the upper
    counts = [F.sum(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(PAIR))).alias(f"s{h}_{s}") for h in ("h0", "h1") for s in range(COUNTS // 4)]
    exact = []
    for k in range(EXACT // 2):
        lane = F.xxhash64("digest", F.lit(k))
        exact += [F.sum(F.when(F.col("i") == 0, _half(lane, high)).otherwise(F.lit(0).cast("long"))).alias(f"e{k}_{int(high)}") for high in (False, True)]
    summed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_triples"), *exact, *counts)
    packed = [F.col(f"s{h}_{s}") for h in ("h0", "h1") for s in range(COUNTS // 4)]
    lanes = [F.col(f"e{k}_{x}").bitwiseAND(F.lit(LOW)) for k in range(EXACT // 2) for x in (0, 1)]
    lanes += [_half(p, False) for p in packed] + [_half(p, True) for p in packed] + [F.col("n_triples").bitwiseAND(F.lit(LOW))]
    return summed.select(*keys, F.array(*lanes).alias("lanes"))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(LOW)))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(LOW)))


def text_form(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def signs(lanes: Column) -> Column:
    """The count lanes as sums of +1 and -1."""
    n = F.get(lanes, EXACT + COUNTS)
    return F.transform(F.slice(lanes, EXACT + 1, COUNTS), lambda c: (2 * c - n).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, a_signs: Column, b_signs: Column) -> Column:
    """0 to 1: twice the inner product over the sum of the squares, as the count lanes estimate them; 1 for equal fingerprints."""
    size = _dot(a_signs, a_signs) + _dot(b_signs, b_signs)
    return F.when(a == b, F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * _dot(a_signs, b_signs) / size)))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, placed, n, copy, doc_id, text, next_text): documents in the order of doc_id, each with the text that follows it.

    The order is cut into buckets at quantiles of doc_id, which are ids of the table, so the first document of each
    bucket is known beforehand and a copy of it goes to the bucket before (the very first: to the last).  Texts are
    shuffled once, and no task sees more than a bucket.  Only the quantiles, four for each shuffle partition, are
    gathered; a document counts once for every WEIGHT characters in them, so buckets are alike in size of text.  A row
    finds its bucket by halving the list of bounds.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer: the next document is the one with the next larger doc_id")
    spark = docs.sparkSession
    cuts = 4 * common.partitions(spark)
    quantiles = F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 100 * cuts)
    weighed = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.char_length("text") / WEIGHT).cast("int"))))
    least, rest = weighed.agg(F.min("doc_id"), quantiles).first()
    bounds = sorted({least, *(rest or [])} - {None})
    placed = F.col("doc_id").isNotNull()
    literal, wanted = F.array(*(F.lit(b).cast("long") for b in bounds)), F.col("doc_id").cast("long")

    def halve(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        right = F.get(literal, middle) <= wanted
        return F.struct(F.when(right, middle).otherwise(state["low"]).alias("low"), F.when(right, state["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))
    at = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(max(1, len(bounds))).alias("high")), halve, lambda s: s["low"])
    keyed = docs.select("doc_id", "text", placed.alias("placed"), F.xxhash64("text").alias("h"))
    own = F.when(F.col("placed"), at).otherwise(F.pmod(F.col("h"), F.lit(cuts)).cast("int"))
    keyed = keyed.withColumn("own", own)
    is_first = F.col("placed") & (F.get(literal, F.col("own")) == wanted) if bounds else F.lit(False)
    before = F.pmod(F.col("own") - 1, F.lit(max(1, len(bounds))))
    home = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("copy"))
    places = F.when(is_first, F.array(home, F.struct(before.alias("bucket"), F.lit(True).alias("copy")))).otherwise(F.array(home))
    dealt = keyed.select("doc_id", "text", "placed", "h", F.inline(places))
    order = Window.partitionBy("bucket", "placed").orderBy("copy", "doc_id", "h")
    return dealt.select(
        "bucket", "placed", F.row_number().over(order).alias("n"), "copy", "doc_id", "text",
        F.when(F.col("placed"), F.lead("text").over(order)).otherwise(F.col("text")).alias("next_text"),
    )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """For each document: fingerprints of its text and of its text with the last quarter replaced by the start of the next one's."""
    ordered = with_next(common.documents(docs))
    size = F.char_length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    both = ordered.select("bucket", "placed", "n", "copy", "doc_id", size.cast("long").alias("n_chars"), "text", F.when(~F.col("copy"), edited).alias("edited"))
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    kinds = F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("txt")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("txt"))), lambda x: x["txt"].isNotNull())
    keys = ["bucket", "placed", "n", "copy", "doc_id", "n_chars", "edited_sha256"]
    texts = both.withColumn("edited_sha256", digest).select(*keys, F.inline(kinds))
    found = vectors(texts, [*keys, "kind"]).withColumn("signs", signs(F.col("lanes")))
    order = Window.partitionBy("bucket", "placed").orderBy("n", "kind")
    rows = found.withColumns(
        {
            "edited_lanes": F.lead("lanes").over(order), "edited_signs": F.lead("signs").over(order),
            "next_lanes": F.when(F.col("placed"), F.lead("lanes", 2).over(order)).otherwise(F.col("lanes")),
            "next_signs": F.when(F.col("placed"), F.lead("signs", 2).over(order)).otherwise(F.col("signs")),
        }
    ).where(~F.col("copy") & (F.col("kind") == 0))
    near = {k: likeness(F.col("lanes"), F.col(f"{k}_lanes"), F.col("signs"), F.col(f"{k}_signs")).alias(f"near_{k}") for k in ("edited", "next")}
    return rows.select("doc_id", "n_chars", "edited_sha256", "lanes", "edited_lanes", *near.values())


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_with_edits(common.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("lanes")).alias("fingerprint"), text_form(F.col("edited_lanes")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLE_SQL: dict[str, str] = {}
