import random

import numpy as np

import pytest

from folio.llm import decontamination as dc

from .data import AWKWARD, empty, frame, text


def slow(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item, passage = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(-1, 6, rng.integers(1, 40))
        assert dc.align(item, passage)[0] == slow(item, passage)


def edited(t, r, share):
    return " ".join(w if r.random() > share else r.choice(["changed", w + " added", ""]) for w in t.split(" "))


def test_copies_are_caught_and_clean_documents_left_alone(spark):
    r = random.Random(3)
    items = [(k, text(700 + k, 40)) for k in range(8)] + [(90, None), (91, "two words"), (92, text(700, 40))]
    leaks = {200 + k: (k, share) for k, share in ((0, 0.0), (1, 0.05), (2, 0.1), (3, 0.15), (4, 0.2))}
    rows = AWKWARD + [(d, text(d, 60) + " " + edited(items[k][1], r, share) + " " + text(d + 50, 60)) for d, (k, share) in leaks.items()]
    rows += [(300 + k, text(40 + k, 50) + " " + items[5][1]) for k in range(60)]  # one item in most documents still has seeds
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(frame(spark, rows), benchmark).collect()
    pairs = {(x["doc_id"], x["item_id"]) for x in got}
    assert pairs == {(d, k) for d, (k, _) in leaks.items()} | {(300 + k, 5) for k in range(60)} | {(200, 92)}
    exact = next(x for x in got if (x["doc_id"], x["item_id"]) == (200, 0))
    assert exact["score"] == 1.0 and exact["last_word"] - exact["first_word"] + 1 == 40
    left = {x["doc_id"] for x in dc.without_leaks(frame(spark, rows), benchmark).collect()}
    assert left == {i for i, _ in rows} - {d for d, _ in pairs}


def test_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, text(700 + k, 40)) for k in range(6)], "item_id long, text string")
    df = frame(spark, [(k, text(5, 20) + " " + text(700 + k, 40)) for k in range(6)])
    whole = {tuple(r) for r in dc.contaminated(df, items).collect()}
    monkeypatch.setattr(dc, "BLOCK_GRAMS", 50)
    assert {tuple(r) for r in dc.contaminated(df, items).collect()} == whole and len(whole) == 6


def test_edited_and_partial_copies_with_frequent_seeds_only(spark):
    """Every n-gram that a copy keeps may be frequent, and those it lost rare or in no document."""
    items = {k: text(800 + k, 40).replace("\n", " ") for k in range(4)}
    words = [items[k].split(" ") for k in range(4)]
    forms = [
        " ".join("changed" if j % 5 == 4 else w for j, w in enumerate(words[0])),
        " ".join("changed" if j % 4 == 3 else w for j, w in enumerate(words[1])),
        " ".join(words[2][11:29]),
        " ".join("changed" if j % 5 == 4 else w for j, w in enumerate(words[3])),
    ]
    rows = [(k, text(20 + k, 50) + " " + forms[k] + " " + text(60 + k, 50)) for k in range(3)]
    rows += [(100 + k, text(200 + k, 50) + " " + forms[3]) for k in range(60)] + [(200, items[3]), (201, text(5, 300))]
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in dc.contaminated(frame(spark, rows), benchmark).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (200, 3)} | {(100 + k, 3) for k in range(60)}
    numbers = {w: n for n, w in enumerate(sorted({w for _, t in rows for w in dc.words_of(t)} | {w for t in items.values() for w in dc.words_of(t)}))}
    coded = {k: [numbers[w] for w in dc.words_of(t)] for k, t in items.items()}
    for d in (0, 1, 2, 100, 200):
        for k in items:
            best = slow(coded[k], [numbers[w] for w in dc.words_of(dict(rows)[d])]) / 80
            assert (best >= dc.LEAST_SCORE) == ((d, k) in got) and got.get((d, k), best) == best


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, text(1, 30))], "item_id long, text string")
    assert dc.contaminated(empty(spark), items).collect() == []
    assert dc.contaminated(frame(spark), items.limit(0)).collect() == []
    assert dc.without_leaks(frame(spark), items.limit(0)).count() == len(AWKWARD)


def test_rows_without_an_id_are_judged_too(spark):
    items = [(1, text(700, 30))]
    rows = [(None, "before " + text(700, 30) + " after"), (None, text(701, 60)), (5, text(700, 30)), (5, text(702, 40)), (6, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = dc.without_leaks(frame(spark, rows), bench)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("None", text(701, 60)), ("5", text(702, 40)), ("6", None)], key=lambda r: (r[0], r[1] or ""))
    assert kept.columns == frame(spark, rows).columns
    assert sum(r["doc_id"] is None for r in dc.contaminated(frame(spark, rows), bench).collect()) == 1


def smith_waterman(item: list[str], passage: list[str]) -> int:
    rows = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (dc.MATCH if a == b else dc.MISMATCH), rows[i - 1][j] + dc.GAP, rows[i][j - 1] + dc.GAP)
    return max(map(max, rows))


@pytest.mark.parametrize("block", [dc.BLOCK_GRAMS, 60])
def test_query_against_brute_force(spark, monkeypatch, block):
    """Every document against every item by plain Smith-Waterman; with small blocks, too."""
    monkeypatch.setattr(dc, "BLOCK_GRAMS", block)
    items = [(k, text(800 + k, 24)) for k in range(6)] + [(9, "two words"), (10, None)]
    rows = [(k, text(900 + k, 60)) for k in range(6)]
    for k in range(6):
        w = items[k][1].split()
        for c, step in enumerate((3, 4, 5, 9)):  # one word in so many replaced
            rows.append((100 + 10 * k + c, text(950 + k, 20) + " " + " ".join("other" if j % step == 1 else x for j, x in enumerate(w)) + " " + text(960 + k, 20)))
        rows.append((100 + 10 * k + 8, text(970 + k, 30) + " " + " ".join(w[: 8 + k])))  # a part
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in dc.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {}
    for d, t in rows:
        words = dc.words_of(t)
        seen = set(zip(words, words[1:], words[2:]))
        for i, it in items:
            w = dc.words_of(it or "")
            if len(w) >= dc.N and seen & set(zip(w, w[1:], w[2:])):
                score = smith_waterman(w, words) / (dc.MATCH * len(w))
                if score >= dc.LEAST_SCORE:
                    expected[d, i] = score
    assert len(expected) > 15 and set(got) == set(expected)
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_short_items_match_whole_texts_only(spark):
    items = spark.createDataFrame([(1, "Two words!"), (2, "alone"), (3, "..."), (4, "two  WORDS")], "item_id long, text string")
    df = frame(spark, [(1, "two words"), (2, "here are two words more"), (3, "Alone."), (4, "..."), (5, ""), (6, None)])
    got = {(x["doc_id"], x["item_id"], x["score"], x["n_seeds"]) for x in dc.contaminated(df, items).collect()}
    assert got == {(1, 1, 1.0, 0), (1, 4, 1.0, 0), (3, 2, 1.0, 0)}
    assert {r["doc_id"] for r in dc.without_leaks(df, items).collect()} == {2, 4, 5, 6}


def test_scripts_without_blanks(spark):
    assert dc.words_of("Ab中文c ไท") == ["ab", "中", "文", "c", "ไ", "ท"] and dc.words_of("Été no_1") == ["été", "no_1"]
    item = "".join(chr(0x4E00 + 7 * k) for k in range(30))
    df = frame(spark, [(1, "".join(chr(0x5F00 + 11 * k) for k in range(40)) + item[:12] + "一" + item[13:] + "end"), (2, "".join(chr(0x5F00 + 11 * k) for k in range(60)))])
    got = dc.contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(x["doc_id"], x["last_word"] - x["first_word"] + 1) for x in got] == [(1, 30)]


def test_many_items_with_one_opening():
    r = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    items = [(k, ["answer", "the", "question", *(r.choice(words) for _ in range(r.randrange(0, 30)))]) for k in range(300)]
    text_ = ["answer", "the", "question"] * 3 + [r.choice(words) for _ in range(150)] + items[7][1] + ["x"] + items[8][1][5:]
    got = {m[0]: m[1] for m in dc.Matcher(items, 0.4).matches(" ".join(text_))}
    number: dict = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in ws]) for _, ws in items]
    passage = np.array([number.setdefault(w, len(number)) for w in text_])
    for i, c in enumerate(coded):  # a perfect copy, or no more than the full table allows
        full = dc.align(c, passage)[0] / (2 * len(c))
        assert got.get(i, 0) <= full and (full < 1 or got[i] == 1)
    assert got[7] == 1.0


def test_chunks_of_pairs_change_nothing(monkeypatch):
    items = [(k, text(900 + k, 30).split()) for k in range(20)]
    whole = dc.Matcher(items, 0.4)
    texts = [text(5, 60) + " " + " ".join(items[k][1][3:]) + " " + " ".join(items[k + 1][1]) for k in range(0, 18, 3)]
    want = [whole.matches(t) for t in texts]
    monkeypatch.setattr(dc, "PAIRS", 5)
    monkeypatch.setattr(dc, "TOGETHER", 50)
    assert [whole.matches(t) for t in texts] == want and all(len(m) >= 2 for m in want)
