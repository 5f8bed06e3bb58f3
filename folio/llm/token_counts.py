"""Token counts of whole texts by a public tokenizer, without a shuffle of words.

Method: map-side two-tier lookup.  Tokenizers that drop white space give a text the sum of what they give its
pre-tokens, so a text is cut into those and only their lengths (numbers of tokens) are added up.  Tier one is a table of
the lengths of frequent pre-tokens, which is broadcast; tier two is a cache in each Python worker, which encodes what the
table lacks with the library itself and remembers it.  Both tiers hold what the library gave for that very string, so
counts don't depend on what is frequent.

Frequent pre-tokens are counted over all texts: each task keeps a Misra-Gries summary of at most ``SUMMARY`` pre-tokens,
and only these summaries are added up.  The table has at most ``FREQUENT`` pre-tokens of at most ``LONGEST`` bytes
(1 MB), whatever the corpus.

A pre-token here is a maximal run without ASCII white space, from which leading ASCII letters are parted where another ASCII
character follows (`word` and `,`).  The tokenizer's own splitter never joins across such a border, nor do Unicode
composition or case mapping reach across it.  Special strings hold no white space and stand inside one pre-token, where the
library treats them as it does by default.

Defined results: a null or empty text has 0 bytes and 0 tokens; very long texts, and very long pre-tokens, are counted whole
(a pre-token over ``LONGEST`` bytes is encoded but not remembered); repeated rows each get a row; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FREQUENT, LONGEST = 32_768, 32  # pre-tokens in the broadcast table, and the bytes of the longest
SUMMARY = 4_096  # pre-tokens that a task reports as frequent
CACHED = 500_000  # pre-tokens that a worker remembers; it starts anew when there are more
SLICE_CHARS = 4_000_000
PARTED = r"(^|[ \t\r\n])([A-Za-z]+)([!-@\[-`{-~])"
BLANKS = r"[ \t\r\n]+"


def drops_blanks(spec: dict) -> bool:
    """Whether a tokenizer file says that white space only separates: its splitter keeps matches alone, and they hold none."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    lone = not any(t.get("normalized") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or [])
    return lone and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and " " not in (first.get("pattern") or {}).get("Regex", " ")


def load(path: str):
    """(encode, additive): a function from a list of strings to their numbers of tokens, and whether pre-tokens may be counted one by one."""
    cache = common.worker_cache()
    key = ("token_counts", path)
    if key not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            cache[key] = (lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)], False)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                additive = drops_blanks(json.load(f))
            cache[key] = (lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)], additive)
    return cache[key]


def pretokens(texts: pa.Array) -> pa.ListArray:
    """The pre-tokens of each text; empty strings among them count nothing."""
    return pc.split_pattern_regex(pc.replace_substring_regex(texts, PARTED, r"\1\2 \3"), BLANKS)


def slices(texts: pa.Array, most: int = SLICE_CHARS):
    """The array in pieces of whole texts, each of about `most` bytes (or of one longer text)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def _reduced(counts: dict[str, int], most: int) -> dict[str, int]:
    """A Misra-Gries step: at most `most` entries stay, each less what the largest of the others had."""
    if len(counts) <= most:
        return counts
    ranked = sorted(counts.values(), reverse=True)
    return {w: n - ranked[most] for w, n in counts.items() if n > ranked[most]}


def summaries(texts: DataFrame, size: int = SUMMARY) -> DataFrame:
    """texts(text) -> word, n: each task's frequent pre-tokens of at most LONGEST bytes."""

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch.column(0)):
                found = pc.value_counts(pc.list_flatten(pretokens(part)))
                words, n = found.field(0), found.field(1)
                lengths = pc.binary_length(words)
                wanted = pc.and_(pc.greater(lengths, 0), pc.less_equal(lengths, LONGEST))
                for w, k in zip(words.filter(wanted).to_pylist(), n.filter(wanted).to_pylist()):
                    counts[w] = counts.get(w, 0) + k
                if len(counts) > 8 * size:
                    counts = _reduced(counts, size)
        counts = _reduced(counts, size)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long")


def frequent_lengths(docs: DataFrame, path: str, size: int = FREQUENT) -> dict[str, int]:
    """The most frequent pre-tokens of all texts with their numbers of tokens, at most `size` of them."""
    encode, additive = load(path)
    if not additive:
        return {}
    top = summaries(docs.select("text")).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    words = [r["word"] for r in top.select("word").collect()]  # bounded by size
    return dict(zip(words, encode(words) if words else []))


class Lookup:
    """Both tiers: the broadcast table, and this worker's cache over the library."""

    def __init__(self, table: dict[str, int], path: str):
        self.table, (self.encode, self.additive) = table, load(path)
        self.cache = common.worker_cache().setdefault(("token_lengths", path), {})

    def lengths(self, words: list[str]) -> list[int]:
        table, cache = self.table, self.cache
        found = [table.get(w, -1) for w in words]
        missing = [i for i, n in enumerate(found) if n < 0]
        unknown = [words[i] for i in missing if words[i] not in cache]
        fresh = dict(zip(unknown, self.encode(unknown))) if unknown else {}
        for i in missing:
            found[i] = fresh[words[i]] if words[i] in fresh else cache[words[i]]
        if len(cache) + len(fresh) > CACHED:
            cache.clear()
        cache.update((w, n) for w, n in list(fresh.items())[:CACHED] if len(w) <= LONGEST)
        return found

    def counts(self, texts: pa.Array) -> np.ndarray:
        if not self.additive:
            return np.array(self.encode(texts.to_pylist()), np.int64)
        lists = pretokens(texts)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        of_word = np.array(self.lengths(coded.dictionary.to_pylist()), np.int64)
        sums = np.concatenate([[0], np.cumsum(of_word[coded.indices.to_numpy(zero_copy_only=False)])]) if len(coded) else np.zeros(1, np.int64)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return np.diff(sums[np.concatenate([[0], ends]).astype(np.int64)])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of docs(doc_id, text)."""
    docs = common.documents(docs)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path))
    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens")]
    schema = T.StructType([docs.schema["doc_id"], *longs])

    def run(batches):
        lookup = Lookup(table.value, tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            n = np.concatenate([lookup.counts(part) for part in slices(texts)]) if len(texts) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLE_SQL: dict[str, str] = {}
