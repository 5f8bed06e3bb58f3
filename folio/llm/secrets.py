"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is built-in column functions in one pass over the text; the plan has no exchange and no Python.

Base kinds are found by patterns (assignments to secret-like names, access keys, long lower-case hex).  Candidates
for the entropy scan are maximal runs of base64-like characters that mix letters and digits.  Each candidate belongs
to a character class (hex digits, one case with digits, both cases with digits, base64), and a window slides over it:
the counts of the characters in the window, five bits each in six longs, and from them the sum of c*log2(c), are
updated by the character that enters and the one that leaves, which costs the same whatever the window or the
class.  The candidate is reported under its class when its best window reaches the class's threshold, unless the
allow-list names it.  A base span over the same characters doesn't hide it, as base kinds don't hide each other.

Defined results: a null text is an empty one; a text without finds has zero counts, empty spans and the digest of the
empty string; repeated rows each get a row; an empty table gives an empty result.  Offsets are code points.  Very long
texts are scanned whole, and the cost of a text with many finds grows with their number to the power of 1.5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
MIN_VALUE = 8

WINDOW = 20
#: Character classes, asked in this order: what all characters of a candidate are, and the bits its best window must
#: reach.  A window of 20 holds at most log2(20) = 4.32 (hex: 4.0); of random strings of 20 characters 99 in 100 reach these.
CLASSES = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9), "lower": (r"^[0-9a-z]+$", 3.38), "upper": (r"^[0-9A-Z]+$", 3.38), "mixed": (r"^[0-9A-Za-z]+$", 3.6), "base64": (r"", 3.6),
}
KINDS = ("assign", "access", "hex", *(f"entropy_{c}" for c in CLASSES))  # in the order in which spans with one start are listed
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CELL, CELLS = 5, 12  # bits of a count, counts in a long
#: Candidates that are known to be harmless: identifiers in UUID form, placeholders, runs of the alphabet ...
ALLOW = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|example|placeholder|your[_-]|x{6}|abcdefgh|12345678"
#: ... and names and paths made of words and numbers, which are what has none of these.
UNLIKE_NAMES = r"[0-9][A-Za-z]|[0-9]{5}|[+]"


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), kind.cast("int").alias("kind"), end.cast("long").alias("end"))


NO_SPANS = "cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"


def _named(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


NO_LONGS = "cast(array() as array<bigint>)"


def scan_before(values: Column, combine) -> Column:
    """For each of an array of longs, combine() over all before it (0 before the first).

    Appending to an array copies it, so the values are taken in chunks of the square root of their number: n values cost
    n^1.5 copies instead of n^2, some 30 million for 100,000.
    """

    def running(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("last"), F.expr(NO_LONGS).alias("out"))
        return F.aggregate(xs, start, lambda s, x: F.struct(combine(s["last"], x).cast("long").alias("last"), F.array_append(s["out"], s["last"]).alias("out")))

    def whole(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        chunks = _named(size, lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int")), lambda c: running(F.slice(v, c * b + 1, b))))
        shifted = lambda ps, firsts: F.flatten(F.transform(ps, lambda p, i: _named(F.get(firsts, i), lambda first: F.transform(p["out"], lambda o: combine(first, o).cast("long")))))
        return _named(chunks, lambda ps: _named(running(F.transform(ps, lambda p: p["last"]))["out"], lambda firsts: shifted(ps, firsts)))

    return _named(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.expr(NO_LONGS)))


def _located(text: Column, pattern: str, found: Column, kind) -> Column:
    """Spans of the matches in `found` (all matches of pattern, in order), where kind(match) is the number of a kind.  What lies between
    the matches is what split() leaves, so running sums of lengths give the offsets."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))

    def spans(g: Column) -> Column:
        steps = F.transform(found, lambda hit, i: F.get(g, i) + F.length(hit))
        placed = lambda starts: F.transform(found, lambda hit, i: _named(F.get(starts, i) + F.get(g, i), lambda at: _span(at, kind(hit), at + F.length(hit))))
        return _named(scan_before(steps, lambda a, b: a + b), placed)

    return F.when(F.size(found) > 0, F.filter(_named(gaps, spans), lambda x: x["kind"].isNotNull())).otherwise(F.expr(NO_SPANS))


def best_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any `window` consecutive characters of candidate (of all, if fewer)."""
    if window >> CELL:
        raise ValueError(f"a count has {CELL} bits")
    plogp = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    codes = F.transform(F.split(candidate, "(?!^)(?!$)"), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    longs = -(-len(ALPHABET) // CELLS)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def count(counts, code):
        return F.call_function("shiftright", F.get(counts, F.floor(code / CELLS).cast("int")), (code % CELLS * CELL).cast("int")).bitwiseAND(F.lit((1 << CELL) - 1)).cast("int")

    def one(code, k):
        return F.when(F.floor(code / CELLS) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (code % CELLS * CELL).cast("int"))).otherwise(F.lit(0).cast("long"))

    def slide(state, codes, i):
        enters, leaves = F.get(codes, i), F.when(i >= window, F.get(codes, i - window))
        counts = state["counts"]
        up, down = count(counts, enters), count(counts, leaves)
        added = F.get(plogp, up + 1) - F.get(plogp, up)
        total = F.when(enters == leaves, state["sum"]).otherwise(state["sum"] + added + F.coalesce(F.get(plogp, down - 1) - F.get(plogp, down), F.lit(0.0)))
        n = F.least(i + 1, F.lit(window)).cast("double")
        new = F.when(enters == leaves, counts).otherwise(F.transform(counts, lambda c, k: c + one(enters, k) - F.coalesce(one(leaves, k), F.lit(0).cast("long"))))
        full = (i + 1 >= window) | (i + 1 == F.size(codes))
        return F.struct(new.alias("counts"), total.alias("sum"), F.when(full, F.greatest(state["best"], F.log2(n) - total / n)).otherwise(state["best"]).alias("best"))

    # one-element array: names the codes once, so that the lambda below doesn't compute them for each character
    named = F.transform(F.array(codes), lambda cs: F.aggregate(F.sequence(F.lit(0), F.size(cs) - 1), start, lambda s, i: slide(s, cs, i), lambda s: s["best"]))
    return F.get(named, F.lit(0))


def entropy_kind(hit: Column) -> Column:
    """The number of the kind under which a candidate is reported, or null."""
    mixed = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & hit.rlike(UNLIKE_NAMES) & ~hit.rlike(ALLOW)
    kind, needed = F.lit(None).cast("int"), F.lit(None).cast("double")
    for name, (characters, bits) in reversed(CLASSES.items()):
        kind = F.when(hit.rlike(characters), F.lit(KINDS.index(f"entropy_{name}"))).otherwise(kind)
        needed = F.when(hit.rlike(characters), F.lit(bits)).otherwise(needed)
    return F.when(mixed, F.when(best_entropy(hit) >= needed, kind))


def _found(docs: DataFrame) -> DataFrame:
    """doc (docs' columns, as a struct), base, entropy."""
    text = F.coalesce(F.col("doc")["text"], F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    kinds = {
        "assign": lambda hit: F.when(F.length(F.regexp_extract(hit, ASSIGN, 2)) >= MIN_VALUE, F.lit(KINDS.index("assign"))),
        "access": lambda hit: F.lit(KINDS.index("access")),
        "hex": lambda hit: F.lit(KINDS.index("hex")),
        "entropy": entropy_kind,
    }
    held = docs.select(F.struct(*docs.columns).alias("doc"))
    hits = held.select("doc", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()))
    spans = hits.select("doc", *(_located(text, p, F.col(k), kinds[k]).alias(k) for k, p in patterns.items()))
    return spans.select("doc", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "entropy")


def scan(docs: DataFrame) -> DataFrame:
    """docs' columns and `base`, `entropy`: arrays of struct(start, kind, end), kind an index into KINDS.  Columns of docs with
    one of these two names give way."""
    return _found(docs).select(*(F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in ("base", "entropy")), "base", "entropy")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


CHUNK = 4096  # code points; a text is cut into chunks once, and what is kept is cut from these
CHUNKS = f"(?s).{{1,{CHUNK}}}"


def _between(chunks: Column, start: Column, stop: Column) -> Column:
    """Code points start to stop of the chunked text.  `substring` counts from the start of its string, here of a chunk."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((stop - 1) / CHUNK).cast("int")
    chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    head = F.substr(chunk(first), (start % CHUNK + 1).cast("int"), F.lit(CHUNK))
    middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.substr(chunk(last), F.lit(1), ((stop - 1) % CHUNK + 1).cast("int"))
    within = F.substr(chunk(first), (start % CHUNK + 1).cast("int"), (stop - start).cast("int"))
    return F.when(stop <= start, "").when(first == last, within).otherwise(F.concat(head, middle, tail))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of `text` replaced by mark (overlapping spans by one); other columns as they are.

    A span is new if it starts where none before it reaches; the text is put together from what lies between new spans.
    """
    found = _found(docs).withColumn("spans", F.array_sort(F.concat("base", "entropy")))
    found = found.withColumn("reach", scan_before(F.transform("spans", lambda s: s["end"]), F.greatest))
    text = F.col("doc")["text"]

    def rebuilt(chunks: Column) -> Column:
        # of overlapping spans only the first starts at or after all that came before
        pieces = F.filter(F.arrays_zip(F.col("spans").alias("s"), F.col("reach").alias("r")), lambda x: x["s"]["start"] >= x["r"])
        kept = F.transform(pieces, lambda x: F.concat(_between(chunks, x["r"], x["s"]["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), _between(chunks, F.array_max(F.transform("spans", lambda s: s["end"])), F.char_length(text).cast("long")))

    new = F.when(F.size("spans") > 0, _named(F.regexp_extract_all(text, F.lit(CHUNKS), F.lit(0)), rebuilt)).otherwise(text)
    return found.select(*((new if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(common.read(spark, sf_dir, "documents")))

    def count(kind: str) -> Column:
        number = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "entropy"))).alias("spans"))


QUERIES = {"op9_secrets": op9_secrets}
ORACLE_SQL: dict[str, str] = {}
