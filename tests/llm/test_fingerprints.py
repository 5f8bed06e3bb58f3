import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm import fingerprints as fp

from .data import AWKWARD, empty, frame


def chained(first: int, *rest) -> int:
    """Spark's xxhash64 of several columns: each value is hashed with the hash so far as seed."""
    h = 42
    for v in (first, *rest):
        if v is not None:
            h = xxhash.xxh64_intdigest(v, h)
    return h


def lanes(text: str) -> list[int]:
    out, n = [0] * 160, 0
    for p in text.split("\n"):
        digest = hashlib.sha256(p.encode()).digest()
        for k in range(16):
            h = chained(digest, k.to_bytes(4, "little"))
            out[2 * k] += h & 0xFFFFFFFF
            out[2 * k + 1] += h >> 32
        w = re.split(r"[ \t\n\x0b\f\r]+", p)
        for i in range(len(w)):
            h0 = chained(*(x.encode() for x in w[i : i + 3]))
            h1 = chained(h0.to_bytes(8, "little"), (1).to_bytes(4, "little"))
            n += 1
            for j, h in enumerate((h0, h1)):
                for s in range(32):
                    out[32 + 32 * j + s] += h >> s & 1
                    out[96 + 32 * j + s] += h >> (s + 32) & 1
    return [x & 0xFFFFFFFF for x in out] + [n]


def test_against_brute_force(spark):
    rows = [(i, t or "") for i, t in AWKWARD]
    got = fp.compare_with_edits(frame(spark)).collect()
    assert len(got) == len(rows)
    ordered = sorted({i: t for i, t in rows}.items())
    after = {i: ordered[(k + 1) % len(ordered)][1] for k, (i, _) in enumerate(ordered)}
    after[12] = dict(rows)[12]  # the row is there twice, so one of the two is followed by the other
    texts = dict(rows)
    for r in got:
        t, i = texts[r["doc_id"]], r["doc_id"]
        cut = len(t) // 4
        possible = [after[i]] + ([texts[20]] if i == 12 else [])
        edits = [t[: len(t) - cut] + x[:cut] for x in possible]
        digests = [hashlib.sha256(e.encode()).hexdigest() for e in edits]
        assert r["edited_sha256"] in digests and r["n_chars"] == len(t)
        assert r["lanes"] == lanes(t)
        assert r["edited_lanes"] == lanes(edits[digests.index(r["edited_sha256"])])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_order_and_increments(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f\ng"), (2, "g\na b c\nd e f"), (3, "a b c\ng"), (4, "d e f"), (5, "a b c\nd e f\ng\ng")], "k int, txt string")
    found = {r["k"]: r["lanes"] for r in fp.vectors(df, ["k"]).collect()}
    assert found[1] == found[2] and found[1] != found[5]
    pair = spark.createDataFrame([(found[3], found[4], found[1])], "a array<long>, b array<long>, whole array<long>")
    assert pair.select(fp.add(F.col("a"), F.col("b")) == F.col("whole")).first()[0]
    assert pair.select(fp.subtract(F.col("whole"), F.col("b")) == F.col("a")).first()[0]


def test_likeness_follows_overlap(spark):
    from .data import text

    base = text(5, 400)
    df = frame(spark, [(1, base), (2, text(6, 400))])
    r = {x["doc_id"]: x for x in fp.compare_with_edits(df).collect()}[1]
    assert r["near_edited"] > 0.55 > 0.3 > r["near_next"]


def test_null_ids_and_empty_tables(spark):
    assert fp.compare_with_edits(empty(spark)).collect() == []
    rows = fp.compare_with_edits(frame(spark, [(None, "abcd efgh"), (None, ""), (3, "x y z w")])).collect()
    assert len(rows) == 3
    own = next(r for r in rows if r["doc_id"] is None and r["n_chars"] == 9)
    assert own["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and own["near_next"] == 1.0


def test_every_row_finds_its_bucket(spark):
    """Bounds are halved, not scanned: ids at, between and beyond them, negative ones, and repeated ones."""
    rows = [(k * 7 - 300, f"text {k} " * (1 + 900 * (k % 11 == 0))) for k in range(120)] + [(14, "again")]
    got = [r for r in fp.with_next(common.documents(frame(spark, rows))).collect() if not r["copy"]]
    ordered = sorted(rows)
    follows = {r: ordered[(k + 1) % len(ordered)][1] for k, r in enumerate(ordered)}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] != 14:
            assert r["next_text"] == follows[r["doc_id"], r["text"]] or r["doc_id"] == 7


def test_ids_that_are_no_integers_are_refused(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(TypeError, match="integer"):
        fp.with_next(df)
