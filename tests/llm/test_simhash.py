import re

import numpy as np
import xxhash

from folio.llm import components, simhash, similar_texts

from .data import AWKWARD, empty, frame, text


def reference(t: str | None, shingle: int = 3) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps: dict) -> dict:
    ids = sorted(fps)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_against_brute_force(spark):
    rows = AWKWARD + [(100 + k, text(1, 80).replace("pine", "fir", k % 3)) for k in range(30)] + [(200 + k, text(300 + k, 30)) for k in range(40)]
    fps = {i: reference(t) for i, t in rows}
    expected = classes(fps)
    got = simhash.groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fp"] & (1 << 64) - 1 == fps[r["doc_id"]]
        assert r["component_id"] == expected[r["doc_id"]]


def test_chains_of_fingerprints(spark):
    rng = np.random.default_rng(3)
    start = int(rng.integers(0, 1 << 62))
    chain = [start]
    for k in range(40):  # each two bits from the one before, so the ends are far apart
        chain.append(chain[-1] ^ 1 << (k * 7 % 64) ^ 1 << (k * 11 % 64))
    other = [int(x) for x in rng.integers(0, 1 << 62, 300)]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in {*chain, *other}], "fp long")
    star = {r["u"]: r["v"] for r in components.stars(simhash.links(df)).collect()}
    roots = {star.get(x - (1 << 64) if x >> 63 else x, x - (1 << 64) if x >> 63 else x) for x in chain}
    assert len(roots) == 1


def test_pivot_filter_loses_nothing():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base ^ np.uint64(0b10101)]))
    u, v = simhash.block_links(np.zeros(len(fps), np.int64), fps, simhash.pivots(), 2)
    assert (np.bitwise_count(u ^ v) <= 64).all()
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u, v):
        parent[find(int(a))] = find(int(b))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if int(a ^ b).bit_count() <= 2:
                assert find(int(a)) == find(int(b))


def test_one_of_each(spark):
    kept = simhash.one_of_each(frame(spark))
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert 1 in ids and 3 not in ids and ids.count(12) == 1
    assert kept.columns == frame(spark).columns
    assert simhash.one_of_each(empty(spark)).collect() == [] and simhash.groups(empty(spark)).collect() == []


def jaccard(a, b):
    x, y = simhash.shingles((a or "").encode(), 5), simhash.shingles((b or "").encode(), 5)
    return len(x & y) / len(x | y)


def least_reachable(texts: dict) -> dict:
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if jaccard(texts[a], texts[b]) >= 0.8 - 1e-9]
    least, changed = {i: i for i in ids}, True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def edited(t: str, words: int, mark: str, step: int = 17) -> str:
    w = t.split(" ")
    for j in range(words):
        w[(step * (j + 1)) % len(w)] = mark
    return " ".join(w)


def families() -> list[tuple[int, str]]:
    """Edited, extended, truncated and reordered copies at similarities around 0.8, chains of them, two families of one template, and short texts."""
    rows = []
    for k in range(8):
        base = text(900 + k, 150)
        rows.append((k, base))
        rows += [(100 + 10 * k + c, edited(base, 1 + c % 4, f"changed{c}", 17 + 6 * c)) for c in range(6)]
        words = base.split(" ")
        rows += [(300 + 10 * k + c, " ".join(words + text(70 + c, 10 + 7 * c).split())) for c in range(5)]  # extended
        rows += [(500 + 10 * k + c, " ".join(words[: len(words) - 5 - 7 * c])) for c in range(5)]  # truncated
    chain = text(990, 120)
    for c in range(12):  # each close to the one before; the ends are strangers
        rows.append((700 + c, chain))
        chain = edited(chain, 2, f"link{c}", 11 + 7 * c)
    template = text(991, 90)
    rows += [(800 + c, template + " " + text(992 + c % 2, 30) + " " + f"own{c // 2}") for c in range(12)]
    parts = [text(994 + c, 20, 1000) for c in range(6)]
    rows += [(850 + c, " ".join(parts[c:] + parts[:c])) for c in range(6)]  # one set of words in different orders
    rows += [(900 + c, " ".join(f"w{j}" for j in range(n))) for c, n in enumerate([0, 1, 3, 4, 5, 6, 8, 9, 13, 14])]
    return rows


def test_one_of_each_against_brute_force(spark):
    rows = families()
    least = least_reachable(dict(rows))
    assert len(set(least.values())) < len(rows) / 2
    assert {r["doc_id"] for r in simhash.one_of_each(frame(spark, rows)).collect()} == set(least.values())


def test_tiles_lists_and_common_shingles_change_nothing(spark, monkeypatch):
    rows = families()
    monkeypatch.setattr(similar_texts, "TILE", 3)
    monkeypatch.setattr(similar_texts, "COMMON", 4)  # so that many shingles stand last
    monkeypatch.setattr(similar_texts, "BLOCK_SHINGLES", 500)
    assert {r["doc_id"] for r in simhash.one_of_each(frame(spark, rows)).collect()} == set(least_reachable(dict(rows)).values())


def test_what_the_hubs_leave_is_compared(spark):
    """A hub that is no near copy of the others in its list: they are still found."""
    rows = [(k, edited(text(1, 100), 3, f"x{k}", 9 + k) + " tail one two three four") for k in range(10)]
    nodes = similar_texts.nodes_of(frame(spark, rows), 5)
    posts = similar_texts.prefixes(nodes, 5, 0.8)
    nothing = spark.createDataFrame([], "u long, v long")
    got = {tuple(r) for r in similar_texts.decided(similar_texts.rest_pairs(posts, nodes, nothing, 0.8), nodes, 5, 0.8).collect()}
    of = {r["node"]: r["place"]["doc_id"] for r in nodes.collect()}
    texts = dict(rows)
    # without any links each list's hub is a component of its own, so all pairs of a list are compared
    assert {frozenset((of[u], of[v])) for u, v in got} == {frozenset((a, b)) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8 - 1e-9}


def test_sample_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: simhash.shingles((r["text"] or "").encode(), 5) for r in docs.collect()}
    holders, links = {}, []
    for i, s in sorted(texts.items()):
        met = {}
        for x in s:
            for j in holders.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            holders[x].append(i)
        links += [(i, j) for j, n in met.items() if n >= 0.8 * (len(s) + len(texts[j]) - n) - 1e-9]
    least, changed = {i: i for i in texts}, True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    assert links and {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == set(least.values())


def test_null_ids(spark):
    got = simhash.groups(frame(spark, [(None, "a b c d"), (None, "a b c d"), (4, "x y z")])).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["4", "None", "None"]
