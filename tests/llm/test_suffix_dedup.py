import random

import numpy as np
import pytest
from numpy.lib.stride_tricks import sliding_window_view

from folio.llm import suffix_dedup as sd

from .data import AWKWARD, empty, frame, text


def reference(rows):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            if first.setdefault(w, i) < i:
                gone[k : k + 50] = b"\1" * 50
        out[i] = gone
    return out


def compare(spark, rows):
    expected, texts = reference(rows), dict(rows)
    got = sd.apply(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        gone, b = expected[r["doc_id"]], (texts[r["doc_id"]] or "").encode()
        assert bytes(r["kept"]) == bytes(x for x, g in zip(b, gone) if not g), r["doc_id"]
        assert r["n_bytes"] == len(b) and r["n_removed"] == sum(gone)
        assert r["n_spans"] == sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))


def test_awkward_rows(spark):
    compare(spark, AWKWARD)


def test_shared_passages_of_every_length(spark):
    r = random.Random(7)
    shared = [text(500 + k, 40) for k in range(6)]
    rows = []
    for i in range(60):
        t = text(1000 + i, r.randrange(5, 120))
        for _ in range(r.randrange(3)):
            p = r.choice(shared)
            a = r.randrange(len(p) - 60)
            at = r.randrange(len(t))
            t = t[:at] + p[a : a + r.choice([49, 50, 51, 60, 120, 200])] + t[at:]
        rows.append((i, t))
    rows += [(100, "abc" * 60), (101, "bca" * 70), (102, "x" * 49), (103, "x" * 50), (104, "x" * 120), (105, "\0" * 80), (106, "\0" * 60 + "é" * 60)]
    compare(spark, rows)


def test_sort_is_a_sort():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 3, (400, 56)).astype(np.uint8)
    rows[200:] = rows[:200]
    rows[100:150, :40] = rows[0, :40]
    order, first = sd.deep_shallow(rows)
    ordered = [bytes(x) for x in rows[order]]
    assert ordered == sorted(ordered)
    assert [bool(x) for x in first] == [k == 0 or ordered[k] != ordered[k - 1] for k in range(len(ordered))]
    assert len(sd.deep_shallow(rows[:0])[0]) == 0


def test_units_cover_every_window():
    data = np.frombuffer(("\n".join(text(k, 50) for k in range(3)) + "a" * 200).encode(), np.uint8)
    ends = np.array([100, 130, 400, len(data)])
    start, windows, place, keys = sd.units_of(data, ends)
    covered = sorted(s + w for s, n in zip(start, windows) for w in range(n))
    begins = [0, *ends[:-1]]
    assert covered == [k for a, b in zip(begins, ends) for k in range(a, b - 49)]
    assert (sd.gram_hash(data)[start + place] == keys).all()


def test_blob_round_trip():
    data = text(3, 300).encode()
    start, windows, place, _ = sd.units_of(np.frombuffer(data, np.uint8), np.array([len(data)]))
    docs = np.where(np.arange(len(start)) < 5, -7, 1 << 40)
    got = sd.unpacked([sd.packed(data, start, windows, place, docs, start), sd.packed(data, start[:1], windows[:1], place[:1], docs[:1], start[:1])])
    assert (got[5][:-1] == start).all() and (got[4][:-1] == docs).all() and (got[2][:-1] == windows).all()
    assert bytes(got[0][got[1][3] : got[1][3] + 50]) == data[start[3] : start[3] + 50]


def test_null_ids_and_empty_tables(spark):
    assert sd.apply(empty(spark)).collect() == []
    t = text(1, 60)
    got = sd.apply(frame(spark, [(None, t), (None, t), (2, t), (3, t)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("2", 0), ("3", len(t)), ("None", 0), ("None", 0)]


def test_ids_that_are_no_integers_are_refused(spark):
    df = spark.createDataFrame([("a", "x" * 60)], "doc_id string, text string")
    with pytest.raises(TypeError, match="integer"):
        sd.removals(df)


def test_heavy_grams_come_last_and_are_split(spark, monkeypatch):
    """Half of the rows hold one passage of 12 bytes between ever other words; all of its windows are compared in rounds."""
    monkeypatch.setattr(sd, "ROUND_WINDOWS", 40)
    hot = "hot passage "
    rows = [(i, "".join(text(3000 + 7 * (i % 90) + k, 2)[:13] + hot for k in range(12))) for i in range(120)] + [(200 + i, hot * 8) for i in range(3)] + [(300 + i, text(i, 40)) for i in range(40)]
    df = sd.common.documents(frame(spark, rows)).select("doc_id", sd.F.col("text").cast("binary"))
    heavy = sd.heavy_grams(df, 1 / 50)
    assert 0 < len(heavy) <= 100 and (np.diff(heavy.astype(float)) > 0).all()

    def in_heavy(heavy):
        data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
        keys = sd.units_of(data, np.cumsum([len(t) for _, t in rows]), heavy)[3]
        return np.isin(keys, sd.heavy_grams(df, 1 / 50)).mean()

    assert in_heavy(heavy) < in_heavy(sd.NONE) / 2
    monkeypatch.setattr(sd, "HEAVY", 1 / 50)
    compare(spark, rows)


def test_one_gram_fills_no_bucket(spark, monkeypatch):
    """Texts of two passages in every order: their windows hold nothing but heavy grams, and still meet only their equals."""
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(["abcdefghijkl", "mnopqrstuvwx"], 14))) for i in range(150)] + [(900, "-" * 700), (901, "-" * 90), (902, text(1, 60))]
    monkeypatch.setattr(sd, "HEAVY", 1 / 200)
    monkeypatch.setattr(sd, "BLOCK_BYTES", 2_000)
    df = sd.common.documents(frame(spark, rows)).select("doc_id", sd.F.col("text").cast("binary"))
    heavy = sd.heavy_grams(df, 1 / 200)

    def dealt(heavy):
        found = [(r["bucket"], sd.unpacked([r["blob"]])) for r in sd.deal(df.coalesce(1), 64, heavy).where("blob is not null").collect()]
        buckets: dict[int, int] = {}
        meets: dict[bytes, set[int]] = {}
        for bucket, (data, start, windows, *_) in found:
            buckets[bucket] = buckets.get(bucket, 0) + int(windows.sum())
            for a, n in zip(start, windows):
                for k in range(n):
                    meets.setdefault(bytes(data[a + k : a + k + 50]), set()).add(bucket)
        assert all(len(b) == 1 for b in meets.values())
        return buckets, meets

    (together, seen), (split, seen_too) = dealt(sd.NONE), dealt(heavy)
    assert set(seen) == set(seen_too) and max(split.values()) < max(together.values()) / 3
    compare(spark, rows)


def test_windows_of_one_gram_are_compared_in_rounds(monkeypatch):
    monkeypatch.setattr(sd, "ROUND_WINDOWS", 25)
    texts = [(b"%02d" % (k % 7)) * 15 + b"one gram....." + (b"%02d" % (k % 5)) * 15 for k in range(60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    start, windows, place, _ = sd.units_of(data, ends)
    docs = np.searchsorted(ends, start, side="right")
    got = {(int(start[u] + w + k)) for units, at, n in sd.resolve_windows(data, start, windows, np.zeros(len(start), np.uint64), docs) for u, w, c in zip(units, at, n) for k in range(c)}
    first: dict[bytes, int] = {}
    expected = set()
    for k, t in enumerate(texts):
        for i in range(len(t) - 49):
            if first.setdefault(t[i : i + 50], k) < k:
                expected.add(int(ends[k]) - len(t) + i)
    assert got == expected and expected
