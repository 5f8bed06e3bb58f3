"""Suffix-array dedup: removes every byte that a long string of an earlier document covers.

A byte goes when it lies in a string of LENGTH bytes that also starts in a document with a smaller doc_id.  Sorting
every suffix of the corpus in one array isn't possible, so the suffixes are dealt to many small arrays in which
equal strings must meet: each window of LENGTH bytes goes where its least K-gram (by hash) sends it.  Neighbouring
windows mostly share that K-gram and travel as one unit.

K-grams that many units have would make some arrays large.  A first pass over all texts counts them: each block reports
what holds a share of its own units, or occurs as often where such K-grams are, and the sums give every K-gram with twice
that share of the corpus.  Those heavy K-grams come last in the order by hash, so that windows meet under another K-gram
wherever they hold a lighter one.  Windows that hold nothing but heavy K-grams are dealt one by one, by a hash of all their bytes:
equal ones still meet, and no K-gram, however frequent, sends all its windows to one task.

Each array is sorted deep-shallow: multikey quicksort on 8-byte characters to a shallow depth, then blind tries for
the groups that share so long a prefix.  The tries of all groups grow together, one branch position a round; a trie
looks at no byte between branches but those that tell its leaves are equal.

Blocks of input are resolved by themselves first: of equal units only those of the block's smallest doc_id go on, so
a passage that a third of the corpus shares reaches a task at most once a block.  Units are shuffled compressed; the
texts are shuffled once, to be joined with what is to be removed.

Defined results: null and empty texts lose nothing; rows with a null doc_id take no part and lose nothing; rows that
repeat a doc_id and text each get the same result, for a document is not smaller than itself (rows that share a
doc_id but not the text get the union of their spans); an empty table gives an empty result.  Columns other than
doc_id and text are ignored.  doc_ids are integers, for the smaller one keeps a string; other types are refused by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 50
K = 12  # bytes of the K-gram that places a window
SHALLOW = 24
BLOCK_BYTES, CHUNK_BYTES = 8_000_000, 1_000_000
ROUND_WINDOWS = 500_000
BUCKET_BYTES = 64_000_000  # of text for each bucket, where the session's partitions would make it more
HEAVY, LIGHTEST = 1 / 1000, 1 / 50_000  # a K-gram is heavy if it has BUCKET_BYTES of the texts, within these shares of all units
LEVEL = 6  # of zstd, for what is shuffled

_MIX = np.random.default_rng(11).integers(1, 1 << 62, 260, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sorted_within(runs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The order that sorts keys within each run (runs ascend already)."""
    if not runs[-1]:
        return np.argsort(keys)
    by = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[by] = np.cumsum(np.concatenate([[False], keys[by][1:] != keys[by][:-1]]))
    return np.argsort(runs * len(keys) + rank)


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts equally long byte strings (rows, a multiple of 8 wide): their order, and whether each differs from the one before."""
    n, width = rows.shape
    order, first = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, first
    first[0] = True
    words = rows.view(">u8")
    live = np.arange(n if n > 1 else 0)  # positions in runs, of two or more, of equal prefixes

    def runs_of(live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(first[live])
        return starts, np.diff(np.append(starts, len(live)))

    def split(live: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Sorts every run by its keys and splits it where they change; gives the positions whose runs stay shared."""
        starts, sizes = runs_of(live)
        run = np.repeat(np.arange(len(starts)), sizes)
        by = _sorted_within(run, keys)
        order[live] = order[live][by]
        keys = keys[by]
        first[live[1:][(keys[1:] != keys[:-1]) & (run[1:] == run[:-1])]] = True
        starts, sizes = runs_of(live)
        return live[np.repeat(sizes > 1, sizes)]

    # multikey quicksort: every run of equal prefixes is sorted by its next character and split where that changes
    for depth in range(0, min(shallow, width), 8):
        if not len(live):
            return order, first
        live = split(live, words[order[live], depth // 8].astype(np.uint64))
    # blind tries: a run's next branch is at the first byte in which any of its strings differs from its first one
    while len(live):
        starts, sizes = runs_of(live)
        heads = np.repeat(order[live[starts]], sizes)
        same = np.empty(len(live), np.int64)
        for at in range(0, len(live), 1 << 17):
            part = slice(at, at + (1 << 17))
            differs = rows[order[live[part]], shallow:] != rows[heads[part], shallow:]
            same[part] = np.where(differs.any(axis=1), differs.argmax(axis=1), width - shallow)
        branch = np.minimum.reduceat(same, starts)
        grows = np.repeat(branch < width - shallow, sizes)  # other runs are leaves: their strings are equal
        live, at = live[grows], np.repeat(branch, sizes)[grows]
        if len(live):
            live = split(live, rows[order[live], shallow + at].astype(np.uint64))
    return order, first


def least_in_group(order: np.ndarray, first: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row the smallest doc of the rows that equal it."""
    out = np.empty(len(order), np.int64)
    if len(order):
        starts = np.flatnonzero(first)
        out[order] = np.repeat(np.minimum.reduceat(docs[order], starts), np.diff(np.append(starts, len(order))))
    return out


def gram_hash(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes at every place where K bytes are, by doubling (K = 8 + 4)."""
    h1 = _MIX[data]
    h2 = h1[:-1] * _MIX[256] + h1[1:]
    h4 = h2[:-2] * _MIX[257] + h2[2:]
    h8 = h4[:-4] * _MIX[258] + h4[4:]
    h = h8[: len(data) - K + 1] * _MIX[259] + h4[8 : len(data) - K + 9]
    return _finished(h)


def _finished(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * _MIX[0]


def gram_hash_of(grams: np.ndarray) -> np.ndarray:
    """gram_hash for rows of K bytes each."""
    h1 = _MIX[grams]
    h2 = h1[:, 0::2] * _MIX[256] + h1[:, 1::2]
    h4 = h2[:, 0::2] * _MIX[257] + h2[:, 1::2]
    return _finished((h4[:, 0] * _MIX[258] + h4[:, 1]) * _MIX[259] + h4[:, 2])


NONE = np.zeros(0, np.uint64)


def units_of(data: np.ndarray, ends: np.ndarray, heavy: np.ndarray = NONE) -> tuple[np.ndarray, ...]:
    """Units of documents that lie one after another in data and end at `ends`: start, windows, place of the K-gram in the unit, its hash.

    heavy: ascending hashes of K-grams that place a window only if it holds no other.
    """
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h = gram_hash(data)
    index = np.uint64((1 << 24) - 1)
    rank = h
    if len(heavy):
        rank = h >> np.uint64(1)
        rank[within(h, heavy)] |= np.uint64(1 << 63)
    least = (rank & ~index) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    reach, span = 1, LENGTH - K + 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    valid = np.zeros(len(data) + 1, np.int64)  # windows must end with their document
    begins = np.concatenate([[0], ends[:-1]])
    whole = ends - begins >= LENGTH
    np.add.at(valid, begins[whole], 1)
    np.add.at(valid, ends[whole] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(valid)[: len(least)] > 0)
    gram = (least[windows] & index).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(windows) else windows
    start = windows[new]
    return start, np.diff(np.append(new, len(windows))), gram[new] - start, h[gram[new]]


UNIT_WIDTH = -(-(2 * LENGTH - K + 1) // 8) * 8  # bytes of the longest unit and one for its length, in whole words


def unit_rows(data: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(UNIT_WIDTH, np.uint8)])
    rows = sliding_window_view(padded, UNIT_WIDTH)[start]
    rows[np.arange(UNIT_WIDTH)[None, :] >= (windows + LENGTH - 1)[:, None]] = 0
    rows[:, -1] = windows
    return rows


def met(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Units whose K-gram units of another document have too, ordered by K-gram."""
    by = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[by][1:] != keys[by][:-1]])) if len(by) else by
    if not len(by):
        return by
    sizes = np.diff(np.append(starts, len(by)))
    several = np.minimum.reduceat(docs[by], starts) < np.maximum.reduceat(docs[by], starts)
    return by[np.repeat(several, sizes)]


def resolve_units(data, start, windows, keys, docs) -> np.ndarray:
    """Units that equal one of a smaller document."""
    gone = np.zeros(len(start), bool)
    some = met(keys, docs)
    rows = unit_rows(data, start[some], windows[some])
    gone[some] = docs[some] > least_in_group(*deep_shallow(rows), docs[some])
    return gone


def resolve_windows(data, start, windows, keys, docs):
    """Runs (unit, first window, windows) that equal windows of a smaller document, among units that differ."""
    some = met(keys, docs)
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    at = 0
    while at < len(some):
        stop = at + 1
        total = np.cumsum(windows[some[at:]])
        stop = at + max(1, int(np.searchsorted(total, ROUND_WINDOWS)))
        while stop < len(some) and keys[some[stop]] == keys[some[stop - 1]]:  # whole K-grams
            stop += 1
        part = some[at:stop]
        at = stop
        unit = np.repeat(part, windows[part])
        window = np.arange(len(unit)) - np.repeat(np.cumsum(windows[part]) - windows[part], windows[part])
        if len(unit) <= 2 * ROUND_WINDOWS:
            rounds = [slice(None)]
        else:  # one K-gram has so many windows: equal ones are in the same round
            number = window_hash(padded, start[unit] + window) % np.uint64(-(-len(unit) // ROUND_WINDOWS))
            rounds = [np.flatnonzero(number == k) for k in range(-(-len(unit) // ROUND_WINDOWS))]
        for chosen in rounds:
            yield from _resolve_round(padded, start, docs, unit[chosen], window[chosen])


def _strings(padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The LENGTH bytes at each place, as rows of whole words."""
    rows = sliding_window_view(padded, -(-LENGTH // 8) * 8)[places]
    rows[:, LENGTH:] = 0
    return rows


def window_hash(padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH bytes at each place, a bounded number of them at a time."""
    out = np.zeros(len(places), np.uint64)
    for at in range(0, len(places), ROUND_WINDOWS):
        words = _strings(padded, places[at : at + ROUND_WINDOWS]).view(np.uint64)
        for k in range(words.shape[1]):
            out[at : at + ROUND_WINDOWS] = _finished(out[at : at + ROUND_WINDOWS] * _MIX[256] + words[:, k] * _MIX[257])
    return out >> np.uint64(20)


def _resolve_round(padded, start, docs, unit, window):
    gone = np.flatnonzero(docs[unit] > least_in_group(*deep_shallow(_strings(padded, start[unit] + window)), docs[unit]))
    if len(gone):
        u, w = unit[gone], window[gone]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 1) | (u[1:] != u[:-1])]))
        yield u[new], w[new], np.diff(np.append(new, len(gone)))


def _planes(values: np.ndarray) -> bytes:
    """Longs as eight planes of bytes, of which the upper ones compress to nothing."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").reshape(-1)


def packed(data: bytes, start, windows, place, docs, offsets) -> bytes:
    """Units of one bucket, ordered by document and offset, compressed."""
    strings = b"".join([data[a:b] for a, b in zip(start.tolist(), (start + windows + LENGTH - 1).tolist())])
    step = np.diff(docs, prepend=0)
    ahead = np.where(step == 0, np.diff(offsets, prepend=0), offsets)  # within a document the distance, else the place
    head = np.array([len(start)], "<i8").tobytes() + windows.astype(np.uint8).tobytes() + place.astype(np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + _planes(step) + _planes(ahead) + strings)


def unpacked(blobs: list[bytes]):
    """data, start, windows, place, docs, offsets of all the blobs' units."""
    parts: list[list[np.ndarray]] = [[] for _ in range(5)]
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        windows, place = (np.frombuffer(raw, np.uint8, n, 8 + n * k).astype(np.int64) for k in (0, 1))
        step, ahead = _from_planes(raw, n, 8 + 2 * n), _from_planes(raw, n, 8 + 10 * n)
        summed = np.cumsum(ahead)
        fresh = np.flatnonzero(np.concatenate([[True], step[1:] != 0]))
        offsets = summed - np.repeat(summed[fresh] - ahead[fresh], np.diff(np.append(fresh, n)))
        for p, c in zip(parts, [windows, place, np.cumsum(step), offsets, np.frombuffer(raw, np.uint8, offset=8 + 18 * n)]):
            p.append(c)
    windows, place, docs, offsets, data = (np.concatenate(p) for p in parts)
    return data, np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1), windows, place, docs, offsets


DEALT = "bucket int, doc_id long, start long, stop long, blob binary"


def _units_of_texts(texts: list[bytes], heavy: np.ndarray = NONE):
    """units_of for the texts, joined; a few of them at a time, to bound the memory that hashes take."""
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    got, low = [], 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, begins[low] + CHUNK_BYTES, side="right")))
        for piece in _pieces(begins[low], ends[low:high]):
            part = units_of(data[piece[0] : piece[1]], piece[2], heavy)
            got.append((part[0] + piece[0], *part[1:]))
        low = high
    return data, begins, ends, *(np.concatenate(c) for c in zip(*got))


def _blocks(batches):
    """Blocks of (doc_id, text) of at most BLOCK_BYTES (or one text), without the texts that no string fits in."""
    found, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if len(text) < LENGTH:
                continue
            if found and size + len(text) > BLOCK_BYTES:
                yield found
                found, size = [], 0
            found.append((doc.as_py(), text))
            size += len(text)
    if found:
        yield found


def _hot_regions(data: np.ndarray, start, windows, keys, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all K-grams in the windows of units that K-grams of `often` place: where these come last, some of them place."""
    hot = within(keys, often)
    marks = np.zeros(len(data) + 1, np.int64)
    np.add.at(marks, start[hot], 1)
    np.add.at(marks, (start + windows + LENGTH - K)[hot], -1)
    places = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
    grams = sliding_window_view(data, K)
    hashes = [gram_hash_of(grams[places[at : at + ROUND_WINDOWS]]) for at in range(0, len(places), ROUND_WINDOWS)]
    return np.unique(np.concatenate(hashes), return_counts=True)


def heavy_grams(docs: DataFrame, share: float) -> np.ndarray:
    """Ascending hashes of the K-grams that place over `share` of all units, some that place over half of it, and those that
    occur as often in the windows of such units: when the first come last, these would place the windows instead.

    Blocks report what has over half the share of their own units, so the sums miss at most half the share.  A unit has
    one K-gram every few bytes, so at most 80 / share K-grams come to the driver, and 2 / share where no passage repeats.
    """

    def run(batches):
        for found in _blocks(batches):
            data, _, _, start, windows, _, units = _units_of_texts([t for _, t in found])
            keys, counts = np.unique(units, return_counts=True)
            total = counts.sum()
            often = keys[counts > total * share / 2]
            if len(often):
                often, counts = _hot_regions(data, start, windows, units, often)
                chosen = counts > total * share / 2
                often, counts = often[chosen], counts[chosen]
            else:
                counts = counts[:0]
            columns = np.append(often, np.uint64(0)).view(np.int64), np.append(counts, 0), np.append(np.zeros(len(often), np.int64), total)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gram", "n", "units"])

    counted = docs.mapInArrow(run, "gram long, n long, units long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("units").alias("units"))
    found = common.durable(counted, "grams")
    total = found.agg(F.sum("units")).first()[0] or 0
    return np.sort(np.array([r["gram"] for r in found.where(F.col("n") > total * share / 2).collect()], np.int64).view(np.uint64))


def within(keys: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    return ascending[np.minimum(np.searchsorted(ascending, keys), len(ascending) - 1)] == keys if len(ascending) else np.zeros(len(keys), bool)


def apart(data, start, windows, place, keys, docs, offsets):
    """The units' windows one by one (start, windows, place, doc, offset), without those that equal one of a smaller document; runs of the latter (start, doc, stop)."""
    ends = np.cumsum(windows)
    gone, runs = np.zeros(ends[-1] + 1, np.int64), []
    for unit, window, n in resolve_windows(data, start, windows, keys, docs):
        at = offsets[unit] + window
        runs.append((at, docs[unit], at + n + LENGTH - 1))
        np.add.at(gone, (ends - windows)[unit] + window, 1)
        np.add.at(gone, (ends - windows)[unit] + window + n, -1)
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    unit = np.searchsorted(ends, kept, side="right")
    window = kept - (ends - windows)[unit]
    return (start[unit] + window, np.ones(len(kept), np.int64), place[unit] - window, docs[unit], offsets[unit] + window), runs


def deal(docs: DataFrame, buckets: int, heavy: np.ndarray = NONE) -> DataFrame:
    """Rows for the buckets: compressed units, and (as doc_id, start, stop) what a block could remove by itself."""

    def block(found: list[tuple[int, bytes]]):
        texts, ids = [t for _, t in found], np.array([i for i, _ in found], np.int64)
        data, begins, ends, start, windows, place, keys = _units_of_texts(texts, heavy)
        joined = data.tobytes()
        owner = np.searchsorted(ends, start, side="right")
        docs_ = ids[owner]
        gone = resolve_units(data, start, windows, keys, docs_)
        offsets = start - begins[owner]
        removed = [(offsets[gone], docs_[gone], (offsets + windows + LENGTH - 1)[gone])]
        is_heavy = within(keys, heavy)
        stay, hot = np.flatnonzero(~gone & ~is_heavy), np.flatnonzero(~gone & is_heavy)
        bucket = ((keys[stay] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
        if len(hot):
            alone, runs = apart(data, start[hot], windows[hot], place[hot], keys[hot], docs_[hot], offsets[hot])
            removed += runs
            named = (window_hash(np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)]), alone[0]) % np.uint64(buckets)).astype(np.int32)
            start, windows, place, docs_, offsets = (np.concatenate([x[stay], y]) for x, y in zip((start, windows, place, docs_, offsets), alone))
            stay = np.argsort(start, kind="stable")  # by document and offset
            bucket = np.append(bucket, named)[stay]
        # maximal runs of what is gone, for the rows go through a shuffle
        a, d, b = (np.concatenate(c) for c in zip(*removed))
        if len(a):
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > b[:-1]) | (a[1:] < a[:-1])]))
            last = np.append(new[1:], len(a)) - 1
            yield pa.RecordBatch.from_arrays([pa.array((d[new] % buckets).astype(np.int32)), pa.array(d[new]), pa.array(a[new]), pa.array(b[last]), pa.nulls(len(new), pa.binary())], names=["bucket", "doc_id", "start", "stop", "blob"])
        by = np.argsort(bucket, kind="stable")
        numbers, firsts = np.unique(bucket[by], return_index=True)
        blobs = []
        for f, s in zip(firsts, np.append(firsts[1:], len(by))):
            u = stay[by[f:s]]
            blobs.append(packed(joined, start[u], windows[u], place[u], docs_[u], offsets[u]))
        empty = pa.nulls(len(blobs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), empty, empty, empty, pa.array(blobs, pa.binary())], names=["bucket", "doc_id", "start", "stop", "blob"])

    def run(batches):
        for found in _blocks(batches):
            yield from block(found)

    return docs.mapInArrow(run, DEALT)


def _pieces(begin: int, ends: np.ndarray):
    """Stretches of at most 2**23 bytes: (from, to, ends of the documents in it); a longer text is cut into stretches that share LENGTH - 1 bytes."""
    most = 1 << 23
    if ends[-1] - begin <= most:
        yield begin, ends[-1], ends - begin
        return
    for at in range(begin, int(ends[-1]) - LENGTH + 1, most - LENGTH + 1):
        stop = min(at + most, int(ends[-1]))
        yield at, stop, np.array([stop - at])


def resolve(table: pa.Table) -> pa.Table:
    """One bucket: (doc_id, start, stop) to remove."""
    out = [table.filter(pa.compute.is_valid(table["doc_id"])).select(["doc_id", "start", "stop"])]
    blobs = [b.as_py() for b in table["blob"] if b.is_valid]
    if blobs:
        data, start, windows, place, docs, offsets = unpacked(blobs)
        keys = gram_hash_of(sliding_window_view(data, K)[start + place])
        gone = resolve_units(data, start, windows, keys, docs)
        found = [(docs[gone], offsets[gone], (offsets + windows + LENGTH - 1)[gone])]
        stay = np.flatnonzero(~gone)
        for unit, window, n in resolve_windows(data, start[stay], windows[stay], keys[stay], docs[stay]):
            u = stay[unit]
            found.append((docs[u], offsets[u] + window, offsets[u] + window + n + LENGTH - 1))
        out.append(pa.table([np.concatenate(c) for c in zip(*found)], names=["doc_id", "start", "stop"]))
    return pa.concat_tables(out)


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, spans: unordered and overlapping start << 32 | stop of the bytes to remove, for documents that lose some."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer: of equal strings that of the smallest doc_id stays")
    rows = common.documents(docs).where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    heavy = heavy_grams(rows, min(HEAVY, max(LIGHTEST, BUCKET_BYTES / max(1, size))))
    dealt = deal(rows, max(4 * common.partitions(docs.sparkSession), size // BUCKET_BYTES), heavy)
    found = dealt.groupBy("bucket").applyInArrow(resolve, "doc_id long, start long, stop long")
    return found.groupBy("doc_id").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("stop"))).alias("spans"))  # a text has less than 2**31 bytes


def squeezed(docs: DataFrame) -> DataFrame:
    """doc_id, z: the texts compressed, for the one shuffle that they go through."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("z", T.BinaryType())])

    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(t.as_py()) for t in batch.column(1)], pa.binary())], names=schema.names)

    return common.documents(docs).select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)


def merged(spans, size: int) -> list[tuple[int, int]]:
    """Maximal runs of packed spans, within a text of `size` bytes."""
    runs: list[list[int]] = []
    for packed_span in sorted(spans):
        start, stop = packed_span >> 32, min(packed_span & 0xFFFFFFFF, size)
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        elif start < stop:
            runs.append([start, stop])
    return [(a, b) for a, b in runs]


def apply(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), spans (array of maximal start, stop) for every row of docs."""
    spans = removals(docs).withColumnRenamed("doc_id", "__id")
    joined = squeezed(docs).join(spans, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "z", "spans")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()), T.StructField("spans", span)])

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [[] for _ in range(5)]
            for z, found in zip(batch.column(1), batch.column(2)):
                text = unpress.decompress(z.as_py())
                runs = merged(found.as_py() or (), len(text))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                values = len(text), sum(b - a for a, b in runs), len(runs), b"".join([*kept, text[at:]]), [{"start": a, "stop": b} for a, b in runs]
                for column, value in zip(out, values):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], names=schema.names)

    return joined.mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(common.read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
