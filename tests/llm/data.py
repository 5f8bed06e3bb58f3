"""Fixtures shared by the tests of this folder: small tables with the awkward cases in them."""

import random

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak umbra violet willow yew zelkova".split()


def text(seed: int, words: int, per_line: int = 12) -> str:
    r = random.Random(seed)
    chosen = [r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing"]) + str(r.randrange(100)) * (r.random() < 0.2) for _ in range(words)]
    return "\n".join(" ".join(chosen[i : i + per_line]) for i in range(0, words, per_line))


#: doc_id, text: ordinary ones, exact copies, a near copy, null, empty, white space, one word, a very long one, non-ASCII letters, a tie on doc_id that repeats a whole row
AWKWARD = [
    (1, text(1, 80)), (2, text(2, 80)), (3, text(1, 80)), (4, text(1, 80).replace("oak", "elm", 1)), (5, None), (6, ""), (7, " \n\t "), (8, "word"), (9, text(9, 6000)),
    (10, "Éa çà\u00a0là " * 30), (11, text(11, 40) + "\n" + text(2, 60)), (12, text(12, 50)), (12, text(12, 50)), (20, "a" * 300), (21, "ab" * 200),
]


def frame(spark, rows=AWKWARD):
    """documents with columns whose names could clash with those that operators use inside."""
    names = ("base", "entropy", "__id", "__h", "__cut", "winner", "cut", "doc", "spans", "reach", "word", "shelf")
    schema = "doc_id long, text string, bucket string, n long, h string, label int, " + ", ".join(f"`{x}` string" for x in names)
    df = spark.createDataFrame([(*r, "x", r[0], "h", 7, *names) for r in rows], schema)
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
