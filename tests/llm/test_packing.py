import zlib

import numpy as np
import pytest

from folio.llm import packing

from .data import AWKWARD, empty, frame

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


def ids_of(texts):
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [[*e.ids, 0] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, docs, size):
    by_doc = {}
    for (i, _), ids in zip(docs, ids_of([t or "" for _, t in docs])):
        by_doc.setdefault(i, []).append(ids)
    seen = {}
    for r in rows:
        ids = by_doc[r["doc_id"]][0]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, parts in seen.items():
        assert sum(n for _, n in parts) == sum(map(len, by_doc[i]))
    packs = {}
    for r in rows:
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(packs)


@pytest.mark.parametrize("size", [1024, 64])
def test_round_trip(spark, size):
    rows = packing.pack(frame(spark), P.path("byte_bpe_50k.json"), max_tokens=size).collect()
    n = check(rows, AWKWARD, size)
    total = sum(r["length"] for r in rows)
    assert n <= 1.25 * total / size + 2


def test_special_strings_and_other_files(spark):
    docs = [(1, "<|endoftext|> a <|startoftext|>"), (2, "it's  fine\n\n  x")]
    check(packing.pack(frame(spark, docs), P.path("byte_bpe_50k.json")).collect(), docs, 1024)
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(frame(spark, docs), P.path("word_bpe_49k.json")).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in docs}


def test_empty_table(spark):
    assert packing.pack(empty(spark), P.path("byte_bpe_50k.json")).collect() == []


def test_histogram_is_used_up():
    rng = np.random.default_rng(0)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 1025, 5000), return_counts=True))}
    used = {}
    for lengths, n in packing.pack_histogram(counts, 1024):
        assert sum(lengths) <= 1024 and n > 0
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == counts
    sequences = sum(n for _, n in packing.pack_histogram(counts, 1024))
    assert sequences * 1024 < 1.02 * sum(k * n for k, n in counts.items())


def test_a_hot_length_is_numbered_in_groups_of_bounded_size(spark):
    rows = [(k, 7 if k % 3 else k % 5) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    sizes = {r["length"]: r["count"] for r in df.groupBy("length").count().collect()}
    got = packing.rank_within(df, "length", ["doc_id"], sizes, rows=100)
    ranks = {}
    for r in got.collect():
        ranks.setdefault(r["length"], []).append(r["rank"])
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in sizes.items()}
    largest = df.withColumn("g", packing.F.pmod(packing.F.xxhash64("doc_id"), packing.F.lit(20))).where("length = 7").groupBy("g").count().agg(packing.F.max("count")).first()[0]
    assert largest < 200  # 2000 rows of one length in 20 groups


def test_special_strings_are_one_id(spark):
    docs = [(1, "<|endoftext|> hello"), (2, "a<|endoftext|><|endoftext|>b <|endoftext"), (3, "<|endoftext|>")]
    rows = packing.pack(frame(spark, docs), P.path("byte_bpe_50k.json"), 64).collect()
    check(rows, docs, 64)
    assert {r["doc_id"]: r["doc_tokens"] for r in rows}[1] == 3


def test_ranks_over_several_shelves(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHELF", 2)
    df = spark.createDataFrame([(k, 5) for k in range(200)], "doc_id long, length long")
    assert sorted(r["rank"] for r in packing.rank_within(df, "length", ["doc_id"], {5: 200}, rows=10).collect()) == list(range(200))
