import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from folio.llm import substring_dedup as sd

from .data import AWKWARD, empty, frame, text


def test_gear_hash_is_the_rolling_one():
    table, data = sd.gear_table(), np.frombuffer(text(1, 100).encode(), np.uint8)
    h, expected = 0, []
    for b in data:
        h = ((h << 1) + int(table[b])) & 0xFFFF
        expected.append(h)
    assert sd.gear_hash(data, table)[15:].tolist() == expected[15:]


def test_boundaries_resist_shifts():
    table, base = sd.gear_table(), text(2, 3000).encode()

    def cut(b):
        ends = sd.cuts(np.frombuffer(b, np.uint8), table, 24, 5, 512)
        return {b[i:j] for i, j in zip([0, *ends], ends)}

    one, two = cut(base), cut(b"some words before it " + base[:5000] + b"in the middle" + base[5000:])
    assert len(one & two) > 0.97 * len(one)


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in AWKWARD if i != 12] + [(30 + k, text(30 + k, 60) + " " + text(99, 70)) for k in range(5)]
    table, first, expected = sd.gear_table(), {}, {}
    for i, t in sorted(rows):
        b, start = (t or "").encode(), 0
        for end in sd.cuts(np.frombuffer(b, np.uint8), table, 24, 5, 512):
            if end - start >= 24 or end - start == len(b):
                key = hashlib.blake2b(b[start:end], digest_size=16).digest()
                if key in first:
                    expected[i, start] = (end - start, *first[key])
                first.setdefault(key, (i, start))
            start = end
    got = {(r["doc_id"], r["start"]): (r["length"], r["source_doc_id"], r["source_start"]) for r in sd.repeated(frame(spark, rows)).collect()}
    assert got == expected and {i for i, _ in got} >= {3, 31, 32, 33, 34}


def test_removal_keeps_the_rest(spark):
    rows = [(1, text(1, 60)), (2, "é start " + text(1, 60) + " end"), (3, None), (4, "")]
    df = frame(spark, rows)
    left = {r["doc_id"]: r["text"] for r in sd.without(df, sd.repeated(df)).collect()}
    assert left[1] == rows[0][1] and left[3] is None and left[4] == "" and left[2].startswith("é st") and len(left[2]) < len(rows[1][1]) / 2


def test_repeated_rows_null_ids_and_empty_tables(spark):
    assert sd.repeated(empty(spark)).collect() == []
    t = text(1, 60)
    got = sd.repeated(frame(spark, [(5, t), (None, t)])).select("doc_id", "source_doc_id").distinct().collect()
    assert [(r[0], r[1]) for r in got] == [(None, 5)]
    assert sd.repeated(frame(spark, [(5, t), (5, t)])).where(F.col("source_doc_id") != 5).count() == 0


def test_chunks_cover_texts_and_end_where_characters_do(spark):
    r = random.Random(5)
    table = sd.gear_table()
    for n in (0, 1, 23, 24, 25, 47, 600, 5000):
        t = "".join(r.choice("aé漢𝔘 \u00a0ß") for _ in range(n))
        b = t.encode()
        ends = sd.cuts(np.frombuffer(b, np.uint8), table, 24, 5, 512)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(b)
        begins = [0, *ends[:-1]]
        assert all(e - a >= 24 for a, e in zip(begins, ends)) or len(ends) <= 1
        assert all(e - a <= 512 + 3 + 24 for a, e in zip(begins, ends))
        for a, e in zip(begins, ends):
            b[a:e].decode()


def test_without_on_text_that_is_not_ascii(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("éèàüß漢字仮名𝔘 ab") for _ in range(900)) for _ in range(3)]
    rows = [(1, texts[0]), (2, texts[1] + texts[0]), (3, texts[0][100:700]), (4, texts[0]), (5, None), (6, "")]
    df = frame(spark, rows)
    spans = sd.repeated(df)
    got = {x["doc_id"]: x["text"] for x in sd.without(df, spans).collect()}
    assert got[1] == texts[0] and got[5] is None and got[6] == "" and got[4] == ""  # a copy goes whole, its last bytes too
    assert got[2].startswith(texts[1][:800]) and len(got[2]) < len(texts[1]) + 200
    assert set(got[3]) <= set(texts[0])


def test_cut_out():
    assert sd.cut_out("abcdef", [(1, 2), (4, 1)]) == "adf" and sd.cut_out("abcdef", [(0, 4), (2, 3)]) == "f" and sd.cut_out("é", []) == "é"
