"""Texts whose word shingles have a Jaccard similarity of at least `similarity`: links that connect all of them.

1. Texts with the same set of shingles are folded into one node.
2. Prefix filter.  Two similar sets of sizes n and m share at least `similarity` of either, so in any order that all
   texts use, the first n - ceil(similarity * n) + 1 shingles of one must hold one of the other's.  The order is rarest
   first, from exact counts over all nodes; shingles of one node alone come first and need no partner, so a text with
   enough of them is done.  In the list of the first shingle that two sets share, nothing before it is shared, so what
   follows must suffice: its place in either order bounds what they can share (positional filter).  Shingles that a fixed share of all nodes holds are counted in the map and stand last, so no
   task sees the list of a shingle that a third of the nodes has.
3. In each list of a prefix shingle one node is the hub: that with the least text of its own, which for a family of
   edited copies is their source.  Every other node of the list is compared with it.
4. What the hubs' links leave in different components is compared within the lists: nodes outside the hub's component
   with all, in tiles of bounded size.  Nodes of one component need no comparison, for only connections are asked for.

Pairs are told apart by SimHash first: distances to reference fingerprints discard a pair when any two coordinates
differ too much, then the Hamming distance itself; survivors are decided by their shingles.  No pair is left out by
size, number or place.  The one chance in it is SimHash's: at the very threshold a pair's fingerprints differ in
more than FAR bits with a probability of about 1e-7.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components

WORDS = 4  # longs of a fingerprint
BITS = 64 * WORDS
FAR = 76  # bits; texts at a similarity of 0.8 differ in about 39 of 256, six standard deviations below this
FEW = 16  # sets smaller than this have too few shingles for that estimate: their pairs aren't told apart by SimHash
PIVOTS = 8
TILE = 1024  # rows of a side of a comparison
MEMO = 200_000
BLOCK_SHINGLES = 4_000_000
SHARE = 1 / 2000  # of all nodes: what more of them hold is found in the map
COMMON = 1000  # shingles of fewer nodes than this never count as common
LAST = 1 << 30  # rank of the first common shingle

_ODD = np.random.default_rng(6).integers(1, 1 << 62, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[k]
    return (h ^ (h >> np.uint64(29))) * _ODD[k + 1]


def shingle_hashes(text: bytes, size: int, memo: WordHashes) -> np.ndarray:
    """The set of a text's shingles as sorted 48-bit hashes; fewer words than a shingle are one shingle."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    codes = np.array(list(map(memo.__getitem__, words)), np.uint64)
    take = min(size, len(words))
    h = np.full(max(1, len(words) - size + 1), take, np.uint64)
    for k in range(take):
        h = h * _ODD[0] + codes[k : k + len(h)]
    return np.unique(_mixed(h, 1) >> np.uint64(16)).astype(np.int64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles: a bit is 1 if it is 1 in over half of the shingles' wide hashes."""
    h = hashes.astype(np.uint64)
    rows = np.stack([_mixed(h * _ODD[3] + _ODD[4 + k], 8) for k in range(WORDS)], axis=1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), 255):  # what a byte can count
        ones += np.add.reduce(np.unpackbits(rows[at : at + 255].view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(rows)).view("<i8")


def nodes_of(docs: DataFrame, shingle: int) -> DataFrame:
    """node, digest (of the set of shingles), place and h (its first row and that text's hash), n, f0..f3 (fingerprint), z (that row's text, compressed)."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id").alias("place"), F.xxhash64("text").alias("h"), F.col("text").cast("binary"))

    def run(batches):
        memo, press = WordHashes(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = [[] for _ in range(3 + WORDS)]
            for text in batch.column(2):
                text = text.as_py()
                hashes = shingle_hashes(text, shingle, memo)
                for column, value in zip(out, (xxhash.xxh3_128_digest(hashes), len(hashes), press.compress(text), *fingerprint(hashes).tolist())):
                    column.append(value)
            types = [pa.binary(), pa.int32(), pa.binary(), *[pa.int64()] * WORDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types))], names=schema.names)

    kinds = [("digest", T.BinaryType()), ("n", T.IntegerType()), ("z", T.BinaryType()), *((f"f{k}", T.LongType()) for k in range(WORDS))]
    schema = T.StructType([rows.schema["place"], rows.schema["h"], *(T.StructField(c, k) for c, k in kinds)])
    first = rows.mapInArrow(run, schema).groupBy("digest").agg(F.min(F.struct("place", "h", "n", *(f"f{k}" for k in range(WORDS)), "z")).alias("w"))
    return common.durable(first.select(F.monotonically_increasing_id().alias("node"), "digest", "w.*"), "nodes")


def common_shingles(nodes: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that many nodes hold, rarest first.  At most average size / SHARE * 2 of them exist, whatever the corpus."""

    def run(batches):
        memo, unpress = WordHashes(), zstandard.ZstdDecompressor()
        held, size = [], 0
        for batch in batches:
            for z in batch.column(0):
                held.append(shingle_hashes(unpress.decompress(z.as_py()), shingle, memo))
                size += len(held[-1])
                if size > BLOCK_SHINGLES:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= max(2, SHARE / 2 * len(held))
        return pa.RecordBatch.from_arrays([pa.array(values[keep]), pa.array(counts[keep])], names=["s", "c"])

    found = nodes.select("z").mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    rows = found.where(F.col("c") >= max(SHARE / 2 * nodes.count(), COMMON)).collect()
    return np.array([r["s"] for r in sorted(rows, key=lambda r: (r["c"], r["s"]))], np.int64)


def prefixes(nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """s, node, n, own (the share of shingles that no other node has), pos (of s in the node's order): a row for each prefix
    shingle that others have, too."""
    last = common_shingles(nodes, shingle)
    by = np.argsort(last)

    def spread(batches):
        memo, unpress = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            out, size = [], 0
            for node, z in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingle_hashes(unpress.decompress(z.as_py()), shingle, memo)
                f = np.ones(len(hashes), np.int32)
                if len(last):
                    at = np.minimum(np.searchsorted(last[by], hashes), len(last) - 1)
                    f = np.where(last[by][at] == hashes, LAST + by[at], f).astype(np.int32)
                out.append((np.append(hashes, -1), np.full(len(hashes) + 1, node), np.append(f, np.int32(len(hashes)))))
                size += len(hashes)
                if size > BLOCK_SHINGLES:
                    yield made(out)
                    out, size = [], 0
            if out:
                yield made(out)

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["s", "node", "f"])

    def shared(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]  # the last shingle so far, which may go on
        for batch in batches:
            s, node, f = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
            cut = int(np.searchsorted(s, s[-1])) if len(s) else 0
            held = [s[cut:], node[cut:], f[cut:]]
            yield told(s[:cut], node[:cut], f[:cut])
        yield told(*held)

    def told(s, node, f):
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(s)))
        f = np.where((s >= 0) & (f < LAST), np.repeat(sizes, sizes), f).astype(np.int32)
        keep = (f > 1) | (s < 0)
        return pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(node[keep]), pa.array(f[keep])], names=["s", "node", "f"])

    # sizes and common shingles have no list to meet in; they go where their node sends them
    dealt = nodes.select("node", "z").mapInArrow(spread, "s long, node long, f int")
    dealt = dealt.repartition(common.partitions(nodes.sparkSession), F.when((F.col("s") >= 0) & (F.col("f") < LAST), F.col("s")).otherwise(F.col("node"))).sortWithinPartitions("s")
    per = dealt.mapInArrow(shared, "s long, node long, f int").groupBy("node").agg(
        F.max(F.when(F.col("s") < 0, F.col("f"))).alias("n"), F.collect_list(F.when(F.col("s") >= 0, F.struct("f", "s"))).alias("others")
    )
    alone = F.col("n") - F.size("others")
    need = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1 - alone
    some = per.select("node", "n", (alone / F.col("n")).alias("own"), need.alias("need"), alone.alias("alone"), "others").where("need > 0 and size(others) > 0")
    return some.select("node", "n", "own", "alone", F.posexplode(F.slice(F.array_sort("others"), F.lit(1), F.col("need"))).alias("k", "o")).select(F.col("o.s").alias("s"), "node", "n", "own", (F.col("alone") + F.col("k")).alias("pos"))


def near(a: str, b: str, similarity: float) -> Column:
    """Pairs of nodes in columns a and b (structs of n and f0..f3) that sizes and fingerprints don't tell apart."""
    x, y = F.col(a), F.col(b)
    apart = sum((F.bit_count(x[f"f{k}"].bitwiseXOR(y[f"f{k}"])) for k in range(1, WORDS)), F.bit_count(x["f0"].bitwiseXOR(y["f0"])))
    alike = F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"])
    return alike & ((F.least(x["n"], y["n"]) < FEW) | (apart <= FAR))


def _marks() -> list[str]:
    return ["n", *(f"f{k}" for k in range(WORDS))]


def may_share(n: Column, pos: Column, m: Column, at: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles can be similar if the first one they share is at pos and at in their orders."""
    return F.least(n - pos, m - at) >= F.ceil((n + m) * similarity / (1 + similarity) - 1e-9)


def hub_pairs(posts: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): every node of a list with the list's hub v."""
    hubs = posts.groupBy("s").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("own", "node", "n", "pos")).alias("hub")).where("members > 1")
    met = posts.join(hubs.select("s", "hub"), "s").where(may_share(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), similarity))
    pairs = met.select(F.col("node").alias("u"), F.col("hub.node").alias("v")).where("u <> v").distinct()
    marks = nodes.select("node", F.struct(*_marks()).alias("m"))
    both = pairs.join(marks.select(F.col("node").alias("u"), F.col("m").alias("a")), "u").join(marks.select(F.col("node").alias("v"), F.col("m").alias("b")), "v")
    return both.where(near("a", "b", similarity)).select("u", "v")


def rest_pairs(posts: DataFrame, nodes: DataFrame, star: DataFrame, similarity: float) -> DataFrame:
    """(u, v), u > v: pairs of a list's nodes in different components that sizes and fingerprints don't tell apart.

    A list's nodes outside its hub's component are dealt over tiles, and so are all its nodes; each task compares one
    tile of the former with one of the latter.
    """
    spark = posts.sparkSession
    placed = posts.join(star.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("s", "node", "own", "pos", F.coalesce("root", "node").alias("component"))
    placed = common.durable(placed, "placed")
    lists = placed.groupBy("s").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("own", "node", "component")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = placed.join(lists.where("low <> high").select("s", "members", F.col("hub.component").alias("main")), "s")
    others = open_.where("component <> main").groupBy("s").agg(F.count(F.lit(1)).alias("n_others"))
    rows = open_.join(others, "s").join(nodes.select("node", *_marks()), "node")
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    rows = rows.select("s", "node", "component", *_marks(), "pos", (F.col("component") == F.col("main")).alias("inside"), tiles("members").alias("all_"), tiles("n_others").alias("out"))
    own = F.pmod(F.xxhash64("node"), F.col("all_")).cast("int")
    left = rows.where("not inside").select("*", F.pmod(F.xxhash64("node", F.lit(1)), F.col("out")).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("all_") - 1)).alias("b"), F.lit(0).alias("side"))
    right = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("a"), own.alias("b"), F.lit(1).alias("side"))
    names = ["s", "a", "b", "side", "node", "component", "pos", *_marks()]
    dealt = left.select(*names).union(right.select(*names)).repartition(common.partitions(spark), "s", "a", "b").sortWithinPartitions("s", "a", "b", "side", "node")

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            cut = int(change[-1]) if len(change) else 0
            for part in np.split(rows[:cut], change[:-1]):
                yield made(part)
            held = rows[cut:]
        if held is not None:
            yield made(held)

    def made(rows):
        u, v = compared(rows[rows[:, 3] == 0], rows[rows[:, 3] == 1], similarity) if len(rows) else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def compared(left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left and right rows (s, a, b, side, node, component, pos, n, f0..) that belong to different components and may be similar."""
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prints = [np.ascontiguousarray(x[:, 8:]).view(np.uint64) for x in (left, right)]
    refs = prints[1][:: max(1, len(right) // PIVOTS)][:PIVOTS]
    tables = [np.bitwise_count(p[:, None, :] ^ refs[None, :, :]).sum(axis=2, dtype=np.int16) for p in prints]
    found = [], []
    m, rest = right[:, 7], right[:, 7] - right[:, 6]
    for at in range(len(left)):
        n = left[at, 7]
        needed = np.ceil((n + m) * similarity / (1 + similarity) - 1e-9)
        ok = (right[:, 5] != left[at, 5]) & (np.minimum(n, m) >= similarity * np.maximum(n, m)) & (np.minimum(n - left[at, 6], rest) >= needed)
        small = np.minimum(n, m) < FEW
        some = np.flatnonzero(ok & (small | (np.abs(tables[1] - tables[0][at]).max(axis=1) <= FAR)))
        apart = np.bitwise_count(prints[1][some] ^ prints[0][at]).sum(axis=1, dtype=np.int64)
        some = some[small[some] | (apart <= FAR)]
        found[0].append(np.full(len(some), left[at, 4]))
        found[1].append(right[some, 4])
    return np.concatenate(found[0]), np.concatenate(found[1])


def decided(pairs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are similar.  Only texts of nodes in pairs travel, compressed; the list of
    those nodes is written first, so Spark knows its size when it chooses how to pick them out."""
    pairs = common.durable(pairs, "pairs")
    wanted = common.durable(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), "wanted")
    texts = nodes.select("node", "z").join(wanted, "node", "left_semi")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("z").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("z").alias("b")), "v")

    def run(batches):
        memo, unpress = WordHashes(), zstandard.ZstdDecompressor()
        last = None, np.zeros(0, np.int64)  # a hub's pairs come one after another
        for batch in batches:
            keep = []
            for v, a, b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if last[0] != v:
                    last = v, shingle_hashes(unpress.decompress(b.as_py()), shingle, memo)
                x = shingle_hashes(unpress.decompress(a.as_py()), shingle, memo)
                common_ = len(np.intersect1d(x, last[1], assume_unique=True))
                keep.append(common_ >= similarity * (len(x) + len(last[1]) - common_) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def linked(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, star): nodes(node, digest, place, ...), and for each node that is similar to another the least node of its component."""
    if not math.isclose(similarity, 0.8) and similarity < 0.8:
        raise ValueError("FAR holds for similarities of 0.8 and more")
    nodes = nodes_of(docs, shingle)
    posts = common.durable(prefixes(nodes, shingle, similarity), "prefixes")
    first = common.durable(decided(hub_pairs(posts, nodes, similarity), nodes, shingle, similarity), "similar")
    star = components.stars(first, "groups")
    more = common.durable(decided(rest_pairs(posts, nodes, star, similarity), nodes, shingle, similarity), "similar")
    return nodes, components.stars(star.union(more), "groups") if more.head(1) else star
