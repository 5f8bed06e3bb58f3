"""Conversation repair against plain enumeration and against a table of whole strings."""

import hashlib
import random
import re
import zlib

import pytest

from folio.llm import conversations as C

INITIALS = re.compile(r"(s?(ua)+)?")


def enumerated(codes: str) -> tuple[int, str]:
    """All edit sequences of at most two inserted turns in one place, by their output."""
    best = (10**9, "")

    def go(i, cost, audit, out, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(codes) and INITIALS.fullmatch(out):
            best = min(best, (cost, audit))
        if inserts < 2:
            for x in "ua":
                go(i, cost + 5, audit + "I", out + x, inserts + 1)
        if i < len(codes):
            c = codes[i]
            go(i + 1, cost + 2, audit + "D", out, 0)
            if c not in "BD":
                more = 5 * c.isupper()
                if c.lower() != "x":
                    go(i + 1, cost + more, audit + "K", out + c.lower(), 0)
                for x in "ua":
                    go(i + 1, cost + more + 1, audit + "R", out + x, 0)

    go(0, 0, "", "", 0)
    return best


def tabled(codes: str) -> tuple[int, str]:
    """Whole audits for each state, row by row; turns are inserted before rows and at the end."""

    def inserted(t):
        for _ in range(2):
            for q, (cost, audit) in list(t.items()):
                for x in "ua":
                    r = C.NEXT[x].get(q)
                    if r is not None:
                        t[r] = min(t.get(r, (10**9, "")), (cost + 5, audit + "I"))
        return t

    t = {0: (0, "")}
    for c in codes:
        new: dict = {}
        for q, (cost, audit) in inserted(t).items():
            for more, letter, r in C._edits(c, q):
                new[r] = min(new.get(r, (10**9, "")), (cost + more, audit + letter))
        t = new
    return min(v for q, v in inserted(t).items() if q in C.ACCEPTING)


def test_search_equals_enumeration():
    r = random.Random(3)
    for k in range(3_000):
        codes = "".join(r.choice("suaxSUABDuaua") for _ in range(r.randrange(0, 9)))
        assert C.solve(codes) == tabled(codes), codes
        assert k >= 60 or enumerated(codes[:3]) == C.solve(codes[:3]), codes


def test_long_conversations_are_chained_exactly():
    r = random.Random(4)
    for n in (63, 64, 65, 128, 400):
        for letters in ("uaua", "suaxSUABD", "UADx", "s"):
            codes = "".join(r.choice(letters) for _ in range(n))
            assert C.solve(codes) == tabled(codes)


def expected(rows):
    """The contract, conversation by conversation, of (conv_id, turn, role, text)."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        blank = lambda v: " " if v is None else v
        k = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
        codes, seen = "", set()
        for _, role, text in turns:
            bare = text.strip(C.BLANKS)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "B" if not bare else "D" if (role, text) in seen else letter if bare[-1] in ".!?" else letter.upper()
            seen.add((role, text))
        cost, audit = tabled(codes)
        known = [t for t, *_ in turns if t is not None]
        initials = [role[:1] for _, role, _ in turns]
        odd, at, lines = (len(audit) - audit.count("D")) % 2, 0, []
        for letter in audit:
            role = "ua"[(len(lines) - odd) % 2] if letter in "IR" else ""
            role = {"u": "user", "a": "assistant"}.get(role)
            if letter == "I":
                lines.append(f"{role}:")
                continue
            _, own, text = turns[at]
            at += 1
            if letter != "D":
                lines.append(f"{role or own}:{text}")
        assert INITIALS.fullmatch("".join(x[:1] for x in lines))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, codes.count("B"), codes.count("D"), sum(c in "SUAX" for c in codes), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = (*C.COUNTS, "cost", "audit", "repaired_sha256")


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, extra=True):
        df = spark.createDataFrame([(*r, "x", 1, 2, "d") for r in rows], "conv_id long, turn long, role string, text string, part string, at int, code int, digest string")
        df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
        return str(tmp_path)

    return write


def compare(spark, path, rows):
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in C.op11_conversations(spark, path).collect()}
    assert got == expected(rows)


def test_query_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(spark, sf, rows)


def test_awkward_rows_and_a_conversation_over_many_tasks(spark, folder):
    r = random.Random(5)
    texts = ["Yes.", "No!", "And then", "", " \t", None, "Why?", "x" * 200_000 + ".", "é.\n"]
    rows = [(9, t, r.choice(["user", "assistant", "user", "system", "tool", "", None, "User"]), r.choice(texts[:7] + [f"Text {t}.", f"Part {t}"])) for t in range(2_000)]
    rows += [(9, None, "user", "Nowhere.")] * 300 + [(9, 5, "assistant", "Same.")] * 40
    for conv in [*range(20, 60), None]:
        rows += [(conv, r.choice([None, *range(8)]), r.choice(["system", "user", "assistant", None]), r.choice(texts)) for _ in range(r.randrange(1, 9))]
    rows += [(70, k, "user", "Only one.") for k in range(3)] + [(71, None, None, None)]
    compare(spark, folder(rows), rows)


def test_turns_are_dialogues(spark, folder):
    path = folder([(1, 0, "user", "Hello."), (1, 1, "user", "Again!"), (2, 0, "assistant", "Late."), (3, 0, "system", "Rules."), (3, 2, "user", "So?")])
    turns = C.repair(spark.read.parquet(f"{path}/conversations.parquet")).turns.orderBy("conv_id", "position").collect()
    roles: dict = {}
    for t in turns:
        roles.setdefault(t["conv_id"], "")
        roles[t["conv_id"]] += t["role"][0]
    assert all(INITIALS.fullmatch(x) for x in roles.values()) and roles[1] == "ua"


def test_empty(spark, folder):
    assert C.op11_conversations(spark, folder([])).count() == 0
