"""Token counts against the tokenizers libraries themselves."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folio.llm import token_counts as K

from . import data

WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "<|endoftext|>", "<|startoftext|>", "<|endof", "a", "A", "'s", "'LL", "'", "''", "́", "é", "É", "ß", "Σ", "ς", "ΑΣ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "1", "23",
    "漢字", "ไทย", "😀", "‍", "-", "_", "I've", "can't", "ﬁ", "İ", "ı", "K", "̸", "=", "<", "|", "x" * 70, "가", "\x00", "﻿", "word,", "(word)",
]


def library(texts, path=WORDS):
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def counted(df, path=WORDS):
    return sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in K.count_tokens(df, path).collect())


def test_awkward_texts(spark):
    r = random.Random(6)
    rows = data.AWKWARD + [(1_000 + k, "".join(r.choice(PARTS) for _ in range(r.randrange(14)))) for k in range(3_000)] + [(5_000, "ab" * 100_000), (5_001, "the and " * 50_000)]
    want = sorted((k, len((t or "").encode()), n, n > 2048) for (k, t), n in zip(rows, library([t for _, t in rows])))
    assert counted(data.frame(spark, rows)) == want


def test_query_on_the_given_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in K.op13_token_counts(spark, sf).collect())
    assert got == sorted((k, len((t or "").encode()), n, n > 2048) for (k, t), n in zip(rows, library([t for _, t in rows])))


def test_counts_dont_depend_on_the_table_or_the_caches_size(spark, monkeypatch):
    texts = [t or "" for _, t in data.AWKWARD]
    import pyarrow as pa

    for most, table in ((3, {}), (10**6, {"word": 1})):
        monkeypatch.setattr(K, "CACHED", most)
        assert K.Lookup(table, WORDS).counts(pa.array(texts)).tolist() == library(texts)


def test_frequent_pretokens_are_those_of_all_texts(spark):
    df = data.frame(spark, [(k, "often " * 50 + f"{k}rare{k} seldom seldom") for k in range(40)])
    table = K.frequent_lengths(df, WORDS, 2)
    assert table == dict(zip(["often", "seldom"], library(["often", "seldom"])))
    found = {r["word"]: r["n"] for r in K.summaries(df.select("text"), 3).groupBy("word").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert 0 < 2_000 - found["often"] <= 40 * 54 // 4 + 12  # a summary of k entries misses at most a (k + 1)-th of all


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokenizers_that_keep_white_space_get_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    texts = [t or "" for _, t in data.AWKWARD]
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        want = [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        want = library(texts, path)
    assert counted(data.frame(spark), path) == sorted((k, len(t.encode()), n, n > 2048) for (k, _), t, n in zip(data.AWKWARD, texts, want))


def test_empty(spark):
    assert K.count_tokens(data.empty(spark), WORDS).count() == 0
