"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The benchmark is cut into blocks of bounded size.  For each block, one pass over all documents joins them to items on
seeds, which are all n-grams of an item whatever their frequency: an edited or partial copy may hold only frequent
ones.  A block's seeds are a sorted array of hashes, and a text's n-grams are looked up in it all at once.  The words
around the seeds are aligned to the item's words by Smith-Waterman, which tolerates replaced, inserted and missing
words.  The score is the best local alignment's over that of a perfect copy.

A seed may be in any number of items (a prompt that all of them begin with).  Places and items that share a seed are
expanded as arrays; an item is dropped when the words that it shares with the text, and then with the stretch around its
seeds, can't reach the score; and the items that are left are aligned together, one row of an array each.

The pass is a map; nothing is shuffled or gathered.  With more than one block, each pass's result is written before
the next block is read, so the driver holds one block, however long the benchmark is.

Words are runs of letters and digits in lower case; in scripts that don't part words, every character is one.

Defined results: null and empty texts never match; an item with fewer words than the n-gram says too little to be found inside
a text, so it matches the texts that have its words and no others (score 1, no seeds); items without words match nothing;
very long texts are searched whole, and of equally good passages the first counts; repeated documents or items each give their rows, and rows with a null doc_id are matched (and filtered) like any
others; empty tables give an empty result.  Columns other than doc_id, text and item_id, text are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

N = 3
BLOCK_GRAMS = 1_000_000  # n-grams of the benchmark that one pass looks for: some 200 MB in a worker
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.4

#: Scripts without blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
UNPARTED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD, PARTED = re.compile(r"\w+"), re.compile(rf"[{UNPARTED}]|[^\W{UNPARTED}]+")
HAS_UNPARTED = re.compile(f"[{UNPARTED}]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    low = text.lower()
    return (WORD if low.isascii() or not HAS_UNPARTED.search(low) else PARTED).findall(low)


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def gram_hashes(words: list[str], memo: WordHashes) -> np.ndarray:
    """A hash of each N-gram; what is told alike by chance fails in the alignment."""
    codes = np.array(list(map(memo.__getitem__, words)), np.uint64)
    h = np.zeros(max(0, len(words) - N + 1), np.uint64)
    for k in range(N if len(h) else 0):
        h = (h ^ (h >> np.uint64(31))) * MIX + codes[k : k + len(h)]
    return h


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two sequences of word numbers (-1 fits nothing), and where it ends in passage."""
    score, end = align_all(item[None, :], np.array([len(item)]), passage[None, :])
    return int(score[0]), int(end[0])


def align_all(items: np.ndarray, lengths: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """align() of each row of items (its first `lengths` numbers count) with the same row of passages, all at once."""
    rows, width = passages.shape
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    above, best, end = np.zeros((rows, width + 1), np.int32), np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for k in range(items.shape[1]):
        now = np.zeros_like(above)
        now[:, 1:] = np.maximum(above[:, :-1] + np.where(passages == items[:, k, None], MATCH, MISMATCH), above[:, 1:] + GAP)
        now = np.maximum(np.maximum.accumulate(np.maximum(now, 0) + ramp, axis=1) - ramp, 0)  # gaps in the item: a running maximum
        at = now.argmax(axis=1)
        top = np.where(k < lengths, now[np.arange(rows), at], 0)
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
        above = now
    return best, end


def item_blocks(benchmark: DataFrame):
    """Lists of (item_id, words) with at most BLOCK_GRAMS n-grams each (or one item), read one after another."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        if block and size + len(words) > BLOCK_GRAMS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    if block:
        yield block


PAIRS = 1_000_000  # pairs of a place and an item's seed that are looked at together
TOGETHER = 2_000_000  # cells of the table that one round of alignments fills for each word of an item


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of [first, last) of each row, one after another, and the row of each."""
    n = last - first
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row], row


class Matcher:
    """A block of items, ready to be looked for in texts."""

    def __init__(self, items: list, least: float):
        self.least, self.memo = least, WordHashes()
        self.whole: dict[tuple, list[int]] = defaultdict(list)  # short items by their words
        for i, (_, words) in enumerate(items):
            if len(words) < N:
                self.whole[tuple(words)].append(i)
        hashes = [gram_hashes(words, self.memo) for _, words in items]
        sizes = [len(h) for h in hashes]
        seeds = np.concatenate(hashes)
        by = np.argsort(seeds, kind="stable")
        self.seeds, self.of_item = seeds[by], np.repeat(np.arange(len(items)), sizes)[by]
        self.in_item = np.concatenate([np.arange(n) for n in sizes])[by]
        self.numbers: dict[str, int] = {}
        coded = [np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64) for _, words in items]
        self.lengths = np.array([len(c) for c in coded])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = np.concatenate(coded)
        totals = [np.unique(c, return_counts=True) for c in coded]
        self.kind_stop = np.cumsum([len(u) for u, _ in totals])
        self.kind_start = self.kind_stop - [len(u) for u, _ in totals]
        self.kinds, self.often = (np.concatenate([t[k] for t in totals]) for k in (0, 1))

    def shared(self, chosen: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How many words each chosen item shares with a text, repeats included; counts: of each word in the text."""
        at, row = ranges(self.kind_start[chosen], self.kind_stop[chosen])
        return np.bincount(row, np.minimum(self.often[at], counts[self.kinds[at]]), len(chosen))

    def matches(self, text: str) -> list[tuple[int, float, int, int, int]]:
        """Number of the item, score, first word, last word, number of seeds of every item that is found, by number."""
        words = words_of(text)
        short = [(i, 1.0, 0, len(words) - 1, 0) for i in self.whole.get(tuple(words), ())] if 0 < len(words) < N else []
        found = gram_hashes(words, self.memo)
        low = np.searchsorted(self.seeds, found)
        hit = np.flatnonzero(self.seeds[np.minimum(low, len(self.seeds) - 1)] == found) if len(self.seeds) else np.zeros(0, np.int64)
        if not len(hit):
            return short
        # seeds by value: in which items each is, and where in the text
        places = hit[np.argsort(found[hit], kind="stable")]
        values, begin, times = np.unique(found[places], return_index=True, return_counts=True)
        entry, seed = ranges(np.searchsorted(self.seeds, values), np.searchsorted(self.seeds, values, side="right"))
        number = np.array([self.numbers.get(w, -1) for w in words])
        counts = np.bincount(number[number >= 0], minlength=len(self.numbers))
        present = np.unique(self.of_item[entry])
        able = np.zeros(len(self.lengths), bool)
        able[present[self.shared(present, counts) >= self.least * self.lengths[present]]] = True
        kept = np.flatnonzero(able[self.of_item[entry]])
        kept = kept[np.argsort(self.of_item[entry[kept]], kind="stable")]
        out, items = short, self.of_item[entry[kept]]
        pairs = np.cumsum(times[seed[kept]])
        at = 0
        while at < len(kept):  # whole items, about PAIRS pairs of a place and an item's seed at a time
            stop = int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, side="right"))
            stop = int(np.searchsorted(items, items[max(stop - 1, at)], side="right"))
            some = kept[at:stop]
            place, row = ranges(begin[seed[some]], begin[seed[some]] + times[seed[some]])
            item, diagonal = self.of_item[entry[some]][row], places[place] - self.in_item[entry[some]][row]
            by = np.lexsort((diagonal, item))
            out += self.aligned(item[by], diagonal[by], number)
            at = stop
        return out

    def aligned(self, item: np.ndarray, diagonal: np.ndarray, number: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """Seeds by item and diagonal -> matches.  Seeds of an item whose diagonals are nearer than its length make one stretch."""
        fresh = np.concatenate([[True], (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > self.lengths[item[1:]])])
        first, last = np.flatnonzero(fresh), np.concatenate([np.flatnonzero(fresh)[1:], [len(item)]]) - 1
        of, size = item[first], self.lengths[item[first]]
        start = np.maximum(0, diagonal[first] - size // 2)
        stop = np.minimum(len(number), diagonal[last] + size + size // 2)
        # the words that an item shares with its stretch: stretches' words, as (stretch, word), counted
        at, row = ranges(start, stop)
        known = number[at] >= 0
        key, n = np.unique(row[known] * len(self.numbers) + number[at][known], return_counts=True)
        kind, of_row = ranges(self.kind_start[of], self.kind_stop[of])
        wanted = of_row * len(self.numbers) + self.kinds[kind]
        place = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        near = np.where(key[place] == wanted, n[place], 0) if len(key) else np.zeros(len(wanted), np.int64)
        able = np.flatnonzero(np.bincount(of_row, np.minimum(near, self.often[kind]), len(of)) >= self.least * size)
        best: dict[int, tuple[int, int, int]] = {}
        seeds = np.bincount(item, minlength=len(self.lengths))
        able = able[np.argsort(stop[able] - start[able], kind="stable")]  # rows of like width are aligned together
        while len(able):
            rows = int(np.searchsorted(np.arange(1, len(able) + 1) * (stop[able] - start[able] + 1), TOGETHER, side="right"))
            some, able = able[: max(rows, 1)], able[max(rows, 1) :]
            score, end = align_all(self._items(some, of, size), size[some], self._passages(some, start, stop, number))
            for k, got, e in sorted(zip(some.tolist(), score.tolist(), end.tolist())):
                i = int(of[k])
                now = best.get(i, (0, 0, 0))
                # the least stretch of those with the best score
                if got >= self.least * MATCH * size[k] and (got, -int(start[k])) > (now[0], -now[1]):
                    best[i] = got, int(start[k]), e
        out = []
        for i, (got, begin, end) in sorted(best.items()):
            words = self.words[self.starts[i] : self.starts[i] + self.lengths[i]]
            _, back = align(words[::-1], number[begin : begin + end][::-1])
            out.append((i, got / (MATCH * int(self.lengths[i])), begin + end - back, begin + end - 1, int(seeds[i])))
        return out

    def _items(self, some: np.ndarray, of: np.ndarray, size: np.ndarray) -> np.ndarray:
        table = np.full((len(some), int(size[some].max())), -2, np.int64)
        at, row = ranges(self.starts[of[some]], self.starts[of[some]] + size[some])
        table[row, at - self.starts[of[some]][row]] = self.words[at]
        return table

    def _passages(self, some: np.ndarray, start: np.ndarray, stop: np.ndarray, number: np.ndarray) -> np.ndarray:
        table = np.full((len(some), int((stop - start)[some].max())), -1, np.int64)
        at, row = ranges(start[some], stop[some])
        table[row, at - start[some][row]] = number[at]
        return table


def _block_matches(docs: DataFrame, items: list, item_type: T.DataType, least: float) -> DataFrame:
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", item_type), T.StructField("score", T.DoubleType())]
        + [T.StructField(c, T.IntegerType()) for c in ("first_word", "last_word", "n_seeds")]
    )

    def run(batches):
        matches, ids = Matcher(items, least).matches, pa.array([item_id for item_id, _ in items])
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1)):
                for m in matches(text.as_py()):
                    rows.append(row)
                    found.append(m)
            columns = list(zip(*found)) or [[] for _ in range(5)]
            own = [batch.column(0).take(pa.array(rows, pa.int64())), ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.float64()), *(pa.array(c, pa.int32()) for c in columns[2:])]
            yield pa.RecordBatch.from_arrays(own, names=schema.names)

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word (of the best passage), n_seeds for pairs with at least that score."""
    docs = common.documents(docs)
    item_type = benchmark.schema["item_id"].dataType
    out, before = None, None
    for items in item_blocks(benchmark):
        if before is not None:  # there is more than one block: what the last one found is written before the next is held
            before = common.durable(before, "matches")
            out = before if out is None else out.union(before)
        before = _block_matches(docs, items, item_type, least)
    if before is None:
        out = docs.sparkSession.createDataFrame([], T.StructType([docs.schema["doc_id"], T.StructField("item_id", item_type)]))
        return out.select("*", F.lit(0.0).alias("score"), *(F.lit(0).alias(c) for c in ("first_word", "last_word", "n_seeds")))
    return before if out is None else out.union(before)


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows in which an item of the benchmark is found; all columns as they are.  Each row is judged by its
    own text where it is: no shuffle, and rows with a null or repeated doc_id are decided like any others."""
    at = docs.columns.index("text")
    filtered = False
    for items in item_blocks(benchmark):
        docs = _block_filter(common.durable(docs, "kept") if filtered else docs, items, at, least)
        filtered = True
    return docs


def _block_filter(docs: DataFrame, items: list, at: int, least: float) -> DataFrame:
    def run(batches):
        matches = Matcher(items, least).matches
        for batch in batches:
            yield batch.filter(pa.array([not matches(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLE_SQL: dict[str, str] = {}
