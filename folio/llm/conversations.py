"""Repair of conversations: the cheapest edits that make the turns of each a regular dialogue.

A dialogue is an optional system turn and then pairs of a user and an assistant turn, or nothing at all; roles count by their
first letter.  A row may be kept (cost 0), given the role user or assistant (1) or deleted (2), and an empty user or
assistant turn may be inserted anywhere (5).  Blank rows and repeats of an earlier row must be deleted; a row that ends
without `.`, `!` or `?` costs 5 more unless it is deleted.

Method: Dijkstra on the implicit lattice of (turn index, grammar state), with the priority key (cost, audit), where audit is
the string of the edits' initials; the search stops at the first accepting end node that is popped, so ties go to the
least audit.  Of two paths of equal cost to one node neither audit is a beginning of the other, which makes the key safe.

Scale.  Rows are dealt by ranges of (conv_id, turn), so a conversation is cut only where a task's range ends, and one that
holds a third of all rows is spread over many tasks.  Whole conversations are solved where they lie.  Of a
conversation at the border of a range, each task's stretch gives the best path from every state to every state (16 costs,
and the ranks of their audits), the stretches are chained by these numbers alone, and the chosen paths are joined back to the
rows.  Searches run over at most SEGMENT rows and are chained in the same way, which keeps them linear.

Defined results: null roles and texts are one space (so blank); null turns come first; rows of one turn are ordered by role
and then by a digest of their content; repeated rows are duplicates; very long texts travel whole and are only looked at for
their last character and their digest; a null conv_id is a conversation of its own; an empty table gives empty results;
other columns are ignored.  Whoever asks for the audit or a digest of a whole conversation gets it in one row, which a
conversation of any length has to fit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SEGMENT = 64  # rows that one search covers where a conversation is longer
#: Grammar states: nothing yet, after system, after user, after assistant; and where each role's first letter leads.
STATES, ACCEPTING = range(4), (0, 3)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
REMEMBERED = 50_000

Path = tuple[int, str]


def _edits(code: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, letter, next state) of the edits of a row: s, u, a, x by its role's letter, capital if truncated, B or D if it must go."""
    yield DELETE, "D", state
    if code not in "BD":
        more = TRUNCATED if code.isupper() else 0
        if state in NEXT[code.lower()]:
            yield KEEP + more, "K", NEXT[code.lower()][state]
        for letter in "ua":
            if state in NEXT[letter]:
                yield REROLE + more, "R", NEXT[letter][state]


def search(codes: str, start: int, *, ends: bool) -> dict[int, Path]:
    """Dijkstra from state `start` before the first row.

    ends: the rows end the conversation; turns may be inserted after the last, and the first accepting end node is the
    result.  Otherwise the best path to every state after the last row; turns are inserted before rows only.
    """
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    done: set[tuple[int, int]] = set()
    out: dict[int, Path] = {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(codes):
            if not ends:
                out[state] = cost, audit
                continue
            if state in ACCEPTING:
                return {state: (cost, audit)}
        for letter in "ua":
            if state in NEXT[letter]:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, NEXT[letter][state]))
        if i < len(codes):
            for more, letter, after in _edits(codes[i], state):
                heapq.heappush(heap, (cost + more, audit + letter, i + 1, after))
    return out


def ranked(audits) -> dict[str, int]:
    return {a: k for k, a in enumerate(sorted(set(audits)))}


def chain(pieces: list[dict[tuple[int, int], tuple[int, int]]], start: int) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """pieces: for each stretch of rows, (cost, rank of its audit) by (state before, state after).  Gives, for every state
    after the last, the cost and the (before, after) of each piece on the best path from start.

    Audits of one stretch are never a beginning of one another, so paths compare by the rank of what came before and then by
    the rank of the piece.
    """
    best = {start: (0, 0)}
    back: list[dict[int, int]] = []
    for piece in pieces:
        found: dict[int, tuple[int, int, int, int]] = {}
        for (before, after), (cost, rank) in piece.items():
            if before in best:
                key = (best[before][0] + cost, best[before][1], rank, before)
                if after not in found or key < found[after]:
                    found[after] = key
        order = {k: n for n, k in enumerate(sorted({x[1:3] for x in found.values()}))}
        best = {after: (x[0], order[x[1:3]]) for after, x in found.items()}
        back.append({after: x[3] for after, x in found.items()})
    out = {}
    for last in best:
        way, after = [], last
        for step in reversed(back):
            way.append((step[after], after))
            after = step[after]
        out[last] = best[last][0], way[::-1]
    return out


def stretch(codes: str, starts=STATES) -> dict[tuple[int, int], Path]:
    """The best path from each state to each state over rows of any number."""
    parts = [codes[i : i + SEGMENT] for i in range(0, len(codes), SEGMENT)]
    tables = [{(q, r): path for q in STATES for r, path in search(part, q, ends=False).items()} for part in parts]
    orders = [ranked(a for _, a in t.values()) for t in tables]
    numbers = [{k: (cost, order[audit]) for k, (cost, audit) in t.items()} for t, order in zip(tables, orders)]
    return {(q, r): (cost, "".join(t[step][1] for t, step in zip(tables, way))) for q in starts for r, (cost, way) in chain(numbers, q).items()}


def endings() -> dict[tuple[int, int], Path]:
    """Turns that are inserted after the last row."""
    return {(q, r): path for q in STATES for r, path in search("", q, ends=True).items()}


def solve(codes: str) -> Path:
    """(cost, audit) of a whole conversation."""
    if len(codes) <= SEGMENT:
        return next(iter(search(codes, 0, ends=True).values()))
    whole, last = stretch(codes, [0]), endings()
    return min((cost + more, audit + tail) for (_, q), (cost, audit) in whole.items() for (p, _), (more, tail) in last.items() if p == q)


class Solver:
    """solve() that remembers the rows' codes it has seen last."""

    def __init__(self):
        self.known: OrderedDict[str, Path] = OrderedDict()

    def __call__(self, codes: str) -> Path:
        if codes not in self.known:
            self.known[codes] = solve(codes)
            if len(self.known) > REMEMBERED:
                self.known.popitem(last=False)
        return self.known[codes]


def role_at(position: int, odd: bool) -> str:
    """The role of an inserted or renamed turn: dialogues of odd length begin with the system's."""
    return "assistant" if (position - odd) % 2 else "user"


def applied(audit: str, rows: list[dict]) -> list[tuple]:
    """(position, turn, role, text, edit) of the turns that edits leave of rows."""
    odd, out, at = bool((len(audit) - audit.count("D")) % 2), [], 0
    for letter in audit:
        if letter == "I":
            out.append((len(out), None, role_at(len(out), odd), "", "I"))
            continue
        row = rows[at]
        at += 1
        if letter != "D":
            out.append((len(out), row["turn"], role_at(len(out), odd) if letter == "R" else row["role"], row["text"], letter))
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")


def _prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, initial, code (without duplicates), digest."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    df = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(bare == "", "B").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return df.select("*", initial.alias("initial"), code.alias("code"), digest.alias("digest"))


@dataclass
class Repaired:
    turns: DataFrame  # conv_id, position, turn, role, text, edit (K, R or I; an inserted turn's number is null)
    conversations: DataFrame  # conv_id, COUNTS, cost, audit


def _counts(codes: str, initials: list[str], turns: list) -> dict:
    known = [t for t in turns if t is not None]  # in order
    gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
    truncated = sum(c.isupper() and c not in "BD" for c in codes)
    return {"gaps": gaps, "blank": codes.count("B"), "duplicate": codes.count("D"), "truncated": truncated, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))}


def _solved_in_place(rows: DataFrame) -> DataFrame:
    """The repaired turns (kind turn) and facts (kind conversation) of conversations that lie within one task, and the rows (kind row)
    of a task's first and last conversation, which may go on in other tasks; part and at say where a row is."""
    longs = {c: T.LongType() for c in ("part", "at", "turn", *COUNTS, "cost")}
    fields = ["kind", "conv_id", "part", "at", "turn", "role", "text", "edit", "initial", "code", "digest", *COUNTS, "cost", "audit"]
    own = {"conv_id": rows.schema["conv_id"].dataType, "turn": rows.schema["turn"].dataType, "digest": T.BinaryType()}
    schema = T.StructType([T.StructField(f, own.get(f, longs.get(f, T.StringType()))) for f in fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        part, solver, out = TaskContext.get().partitionId(), Solver(), []

        def pending(run_rows, first_at):
            out.extend({"kind": "row", "part": part, "at": first_at + k, **r} for k, r in enumerate(run_rows))

        def finished(run_rows):
            seen: set[bytes] = set()
            codes = []
            for r in run_rows:
                codes.append("D" if r["code"] != "B" and r["digest"] in seen else r["code"])
                seen.add(r["digest"])
            code, conv_id = "".join(codes), run_rows[0]["conv_id"]
            cost, audit = solver(code)
            out.append({"kind": "conversation", "conv_id": conv_id, "cost": cost, "audit": audit, **_counts(code, [r["initial"] for r in run_rows], [r["turn"] for r in run_rows])})
            out.extend({"kind": "turn", "conv_id": conv_id, "at": p, "turn": turn, "role": role, "text": text, "edit": edit} for p, turn, role, text, edit in applied(audit, run_rows))

        held: list[dict] = []
        first, sent, last = True, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if last is not None and row["conv_id"] != last[0]:
                    if not first:
                        finished(held)
                    held, first = [], False
                last = (row["conv_id"],)
                if first:  # goes on as it is, so nothing of it is held
                    pending([row], sent)
                    sent += 1
                else:
                    held.append(row)
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out.clear()
        pending(held, 0)
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    keys = ["conv_id", "turn", "role", "digest"]
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(common.partitions(rows.sparkSession), *(F.col(k).asc_nulls_first() for k in [*keys, "tie"]))
    return common.durable(spread.sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in [*keys, "tie"])).drop("tie").mapInArrow(run, schema), "conversations")


def _stretches(flags: DataFrame) -> DataFrame:
    """For each task's stretch of a conversation and each pair of states: cost, rank among the stretch's audits, audit, turns left; and its counts."""
    fields = [("part", T.LongType()), ("before", T.IntegerType()), ("after", T.IntegerType()), ("cost", T.LongType()), ("rank", T.IntegerType()), ("audit", T.StringType()), ("left", T.LongType()), ("first", T.StringType()), ("last", T.StringType())]
    fields += [(c, T.LongType()) for c in COUNTS[1:]]
    schema = T.StructType([flags.schema["conv_id"], *(T.StructField(*f) for f in fields)])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        codes, initials = "".join(rows["code"].to_pylist()), rows["initial"].to_pylist()
        paths = stretch(codes)
        order = ranked(a for _, a in paths.values())
        counts = _counts(codes, initials, [])
        del counts["gaps"]
        shared = {"conv_id": rows["conv_id"][0].as_py(), "part": rows["part"][0].as_py(), "first": initials[0], "last": initials[-1], **counts}
        return pa.Table.from_pylist([{**shared, "before": q, "after": r, "cost": cost, "rank": order[audit], "audit": audit, "left": len(audit) - audit.count("D")} for (q, r), (cost, audit) in paths.items()], schema=arrow)

    return flags.groupBy("conv_id", "part").applyInArrow(run, schema)


def _chained(stretches: DataFrame) -> DataFrame:
    """For each stretch the states before and after it on the conversation's best path, the position of its first turn, whether the dialogue's length
    is odd; with the last one (tail is not null) the turns inserted at the end, the cost and the counts of the whole."""
    fields = [("part", T.LongType()), ("before", T.IntegerType()), ("after", T.IntegerType()), ("offset", T.LongType()), ("odd", T.BooleanType()), ("tail", T.StringType()), ("end", T.LongType()), ("cost", T.LongType())]
    fields += [(c, T.LongType()) for c in COUNTS[1:]]
    schema = T.StructType([stretches.schema["conv_id"], *(T.StructField(*f) for f in fields)])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        parts: dict[int, list[dict]] = {}
        for row in table.sort_by("part").to_pylist():
            parts.setdefault(row["part"], []).append(row)
        last, ends = endings(), ranked(a for _, a in endings().values())
        pieces = [{(r["before"], r["after"]): (r["cost"], r["rank"]) for r in rows} for rows in parts.values()]
        # the accepting states count as one, so that their paths compare by cost and audit
        cost, way = chain([*pieces, {(q, 0): (more, ends[a]) for (q, _), (more, a) in last.items()}], 0)[0]
        chosen = [next(r for r in rows if (r["before"], r["after"]) == step) for rows, step in zip(parts.values(), way)]
        tail = next(a for (q, _), (_, a) in last.items() if q == way[-1][0])
        total = sum(r["left"] for r in chosen) + len(tail)
        counts = {c: sum(r[c] for r in chosen) for c in COUNTS[1:]}
        counts["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(chosen, chosen[1:]))
        out, offset = [], 0
        for k, r in enumerate(chosen):
            row = {"conv_id": r["conv_id"], "part": r["part"], "before": r["before"], "after": r["after"], "offset": offset, "odd": bool(total % 2)}
            offset += r["left"]
            out.append(row | ({"tail": tail, "end": offset, "cost": cost, **counts} if k == len(chosen) - 1 else {}))
        return pa.Table.from_pylist(out, schema=arrow)

    return stretches.drop("audit").groupBy("conv_id").applyInArrow(run, schema)


def _role(position: Column, odd: Column) -> Column:
    return F.when((position - odd.cast("long")) % 2 != 0, "assistant").otherwise("user")


def _across(rows: DataFrame) -> Repaired:
    """Conversations that may lie in several tasks: rows(conv_id, part, at, turn, role, text, initial, code, digest)."""
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "at")).alias("first")).select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    bare = rows.select("conv_id", "part", "at", "initial", "code", "digest").join(common.durable(first, "first"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    repeated = (F.struct("part", "at") > F.col("first")) & (F.col("code") != "B")
    flags = bare.select("conv_id", "part", "at", "initial", F.when(repeated, "D").otherwise(F.col("code")).alias("code"))
    stretches = common.durable(_stretches(flags), "stretches")
    ways = common.durable(_chained(stretches), "ways")
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    chosen = ways.join(stretches.select("conv_id", "part", "before", "after", "audit"), same(ways, stretches, ["conv_id", "part", "before", "after"])).select(ways["conv_id"], ways["part"], "offset", "odd", "audit")
    chosen = common.durable(chosen, "chosen")
    pieces = chosen.select("conv_id", "part", "offset", "odd", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]"), F.lit(0))).alias("at", "piece"))
    op, inserts = F.right("piece", F.lit(1)), F.length("piece") - 1
    n = inserts + (op != "D").cast("int")
    before = F.coalesce(F.sum(n).over(Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.select("conv_id", "part", F.col("at").cast("long").alias("at"), "odd", op.alias("op"), inserts.alias("inserts"), n.alias("n"), (F.col("offset") + before).alias("start")).where("n > 0")
    met = placed.join(rows.select("conv_id", "part", "at", "turn", "role", "text"), same(placed, rows, ["conv_id", "part", "at"])).select(placed["conv_id"], "odd", "op", "inserts", "start", "turn", "role", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    position, inserted = F.col("start") + F.col("j"), F.col("j") < F.col("inserts")
    turns = met.select(
        "conv_id", position.alias("position"), F.when(~inserted, F.col("turn")).alias("turn"), F.when(inserted | (F.col("op") == "R"), _role(position, F.col("odd"))).otherwise(F.col("role")).alias("role"),
        F.when(inserted, "").otherwise(F.col("text")).alias("text"), F.when(inserted, "I").otherwise(F.col("op")).alias("edit"),
    )
    tails = ways.where("length(tail) > 0").select("conv_id", "odd", F.explode(F.sequence(F.col("end"), F.col("end") + F.length("tail") - 1)).alias("position"))
    tails = tails.select("conv_id", "position", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), _role(F.col("position"), F.col("odd")).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    spans = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    whole = ways.where("tail is not null")
    facts = whole.join(spans, same(whole, spans, ["conv_id"])).join(audits, same(whole, audits, ["conv_id"])).select(whole["conv_id"], *COUNTS, "cost", F.concat("audit", "tail").alias("audit"))
    return Repaired(turns.unionByName(tails), facts)


def repair(rows: DataFrame) -> Repaired:
    """rows(conv_id, turn, role, text): repaired turns, and what was found and done in each conversation."""
    done = _solved_in_place(_prepared(rows))
    across = _across(done.where("kind = 'row'").select("conv_id", "part", "at", "turn", "role", "text", "initial", "code", "digest"))
    turns = done.where("kind = 'turn'").select("conv_id", F.col("at").alias("position"), "turn", "role", "text", "edit")
    facts = done.where("kind = 'conversation'").select("conv_id", *COUNTS, "cost", "audit")
    return Repaired(turns.unionByName(across.turns), facts.unionByName(across.conversations))


def transcript_digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of `role:text` of a conversation's turns in order, joined by newlines.  A digest is computed in order, so one task reads a
    conversation, turn by turn and without holding more than one."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        last, digest = None, None
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                if last != (conv_id,):
                    if last is not None:
                        out.append({"conv_id": last[0], "sha256": digest.hexdigest()})
                    last, digest = (conv_id,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": last[0], "sha256": digest.hexdigest()}], schema=arrow)

    sorted_turns = turns.repartition(common.partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "position")
    return sorted_turns.select("conv_id", "role", "text").mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of (conv_id, turn): rows lost, emptied, without sentence marks, repeated, or with the role user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    df = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = common.read(spark, sf_dir, "conversations")
    fixed = repair(damaged(given))
    every = given.select(F.col("conv_id").alias("id")).distinct()
    digests = transcript_digests(fixed.turns).select(F.col("conv_id").alias("of"), "sha256")
    df = every.join(fixed.conversations, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("id").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "cost")]
    return df.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


QUERIES = {"op11_conversations": op11_conversations}
ORACLE_SQL: dict[str, str] = {}
