"""Inline spans through a rewrite: which parts of a text changed, and which span each character of the new text is in.

A rewrite by rules says itself what it replaced (`typography.rewrite_steps`), so its pieces are composed step by step and no
texts are compared.  Texts that changed in another way are aligned.  Both are Arrow UDFs; texts that didn't change pass at no cost.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import Match, SequenceMatcher
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V
from . import typography

STYLES = ("bold", "italic", "small_caps", "sub", "sup")
SPAN = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(f, T.BooleanType()) for f in STYLES), T.StructField("kind", T.StringType()), T.StructField("note_ref", T.StringType())])
MARKED = T.StructType([*SPAN.fields, T.StructField("changed", T.BooleanType())])
REGION = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
NEAR = 3  # regions closer than this become one
CENTURY = re.compile(r"\b([IVXLCDM]{1,8})(e)\b", re.IGNORECASE)
CONTEXT = re.compile(V.CENTURY_CONTEXT + r"\b", re.IGNORECASE)
CONTEXT_LENGTH = 32
TABLE = 60_000  # up to this product of lengths the longest match is looked up in the matcher's own table
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _window_hashes(prefix: np.ndarray, powers: np.ndarray, size: int) -> np.ndarray:
    return prefix[size:] - prefix[:-size] * powers[size]


class Matcher(SequenceMatcher):
    """SequenceMatcher without junk, with the same longest match (first in a, then in b) for long texts by hashed windows
    and bisection: its own search takes the product of the lengths."""

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        x, y = self.a[alo:ahi], self.b[blo:bhi]
        if x and y and (at := y.find(x)) >= 0:  # one whole side is the longest match, wherever it is in the other
            return Match(alo, blo + at, len(x))
        if x and y and (at := x.find(y)) >= 0:
            return Match(alo + at, blo, len(y))
        if len(x) * len(y) <= TABLE:
            i, j, size = SequenceMatcher(None, x, y, autojunk=False).find_longest_match(0, len(x), 0, len(y))
            return Match(alo + i, blo + j, size)
        n = max(len(x), len(y)) + 1
        powers = np.full(n, BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        a, b = (self._prefixes(t) for t in (x, y))
        low, high, found = 0, min(len(x), len(y)), (0, 0)
        while low < high:
            size = (low + high + 1) // 2
            at = self._common(x, y, _window_hashes(a, powers, size), _window_hashes(b, powers, size), size)
            if at is None:
                high = size - 1
            else:
                low, found = size, at
        return Match(alo + found[0], blo + found[1], low)

    @staticmethod
    def _prefixes(text: str) -> np.ndarray:
        out, value = [0], 0
        for c in map(ord, text):
            value = (value * BASE + c + 1) & MASK
            out.append(value)
        return np.array(out, np.uint64)

    @staticmethod
    def _common(x: str, y: str, a: np.ndarray, b: np.ndarray, size: int) -> tuple[int, int] | None:
        """The first window of x that occurs in y, and where it first does; equal hashes are checked by the texts."""
        for i in np.flatnonzero(np.isin(a, b)).tolist():
            j = y.find(x[i : i + size])
            if j >= 0:
                return i, j
        return None


def _steps(before: str, after: str):
    return Matcher(None, before, after, autojunk=False).get_opcodes()


def regions(before: str | None, after: str | None) -> list[tuple[int, int]]:
    """Stretches of the new text that were replaced or inserted."""
    out: list[list[int]] = []
    if before != after:
        for kind, _, _, start, stop in _steps(before or "", after or ""):
            if kind not in ("replace", "insert"):
                continue
            if out and start - out[-1][1] <= NEAR:
                out[-1][1] = stop
            else:
                out.append([start, stop])
    return [(a, b) for a, b in out]


def carry(spans: list[dict], after: str) -> list[dict]:
    """The new text in spans: kept characters stay in theirs, new ones join the span at the place where they were put."""
    before = "".join(s["text"] or "" for s in spans)
    if before == after or not spans:
        return [dict(s, changed=False) for s in spans]
    owner = [k for k, s in enumerate(spans) for _ in s["text"] or ""] or [0]
    marks = regions(before, after)
    source = []
    for kind, i1, _, j1, j2 in _steps(before, after):
        source += [owner[min(i1 + (j - j1 if kind == "equal" else 0), len(owner) - 1)] for j in range(j1, j2)]
    out: list[dict] = []
    last = None
    for j, (c, k) in enumerate(zip(after, source)):
        key = k, any(a <= j < b for a, b in marks)
        if key == last:
            out[-1]["text"] += c
        else:
            out.append(dict(spans[k], text=c, changed=key[1]))
            last = key
    return out


Piece = tuple[int, int]  # where it begins in the first text (kept), or -1 - the place where it was put (made), and its length


def _edits(step: str) -> list[tuple[int, int, int]]:
    """A marked text -> for each edit: characters kept since the last, replaced and made; what both sides of an edit begin or end with is kept."""
    first, *rest = step.split(typography.OLD)
    kept, out = len(first), []
    for part in rest:
        old, _, more = part.partition(typography.NEW)
        new, _, gap = more.partition(typography.END)
        least = min(len(old), len(new))
        head = next((k for k in range(least) if old[k] != new[k]), least)
        tail = next((k for k in range(least - head) if old[-1 - k] != new[-1 - k]), least - head)
        if head + tail < max(len(old), len(new)):
            out.append((kept + head, len(old) - head - tail, len(new) - head - tail))
            kept = tail + len(gap)
        else:
            kept += len(old) + len(gap)
    return out


def piece_table(length: int, steps: list[str]) -> list[Piece]:
    """The pieces of a text after all steps, in order: kept ones of the first text, which has `length` characters, and made ones."""
    table: list[Piece] = [(0, length)]
    for step in steps:
        edits = _edits(step)
        if not edits:
            continue
        out: list[Piece] = []
        stack = table[::-1]
        for kept, gone, made in edits:
            _take(stack, kept, out)
            dropped: list[Piece] = []
            _take(stack, gone, dropped)
            near = dropped[:1] or stack[-1:]
            place = (near[0][0] if near[0][0] >= 0 else -1 - near[0][0]) if near else length
            if made:
                out.append((-1 - place, made))
        table = out + stack[::-1]
    return table


def _take(stack: list[Piece], n: int, out: list[Piece]) -> None:
    """Moves the next n characters from the stack (its top is last) to out."""
    while n > 0 and stack:
        at, size = stack.pop()
        if size > n:
            stack.append((at + n if at >= 0 else at, size - n))
            size = n
        out.append((at, size))
        n -= size


def piece_regions(table: list[Piece]) -> list[tuple[int, int]]:
    """Stretches of the new text that were made; near ones are one."""
    out: list[list[int]] = []
    at = 0
    for origin, size in table:
        if origin < 0:
            if out and at - out[-1][1] <= NEAR:
                out[-1][1] = at + size
            else:
                out.append([at, at + size])
        at += size
    return [(a, b) for a, b in out]


def move(spans: list[dict], steps: list[str], after: str) -> list[dict]:
    """carry(), from the rewrite's steps instead of an alignment: linear in the text and in its edits."""
    before = "".join(s["text"] or "" for s in spans)
    table = piece_table(len(before), steps)
    if not spans or sum(n for _, n in table) != len(after):  # the steps are of another text than the spans'
        return carry(spans, after)
    starts = list(accumulate((len(s["text"] or "") for s in spans), initial=0))
    owner = lambda at: min(bisect_right(starts, at) - 1, len(spans) - 1)
    marks, out, last, at = piece_regions(table), [], None, 0

    def put(k: int, text: str, changed: bool) -> None:
        nonlocal last
        if (k, changed) == last:
            out[-1]["text"] += text
        elif text:
            out.append(dict(spans[k], text=text, changed=changed))
            last = k, changed

    inside = 0
    for origin, size in table:
        stop = at + size
        while at < stop:
            while inside < len(marks) and marks[inside][1] <= at:
                inside += 1
            changed = inside < len(marks) and marks[inside][0] <= at
            edge = marks[inside][1] if changed else marks[inside][0] if inside < len(marks) else stop
            k = owner(origin) if origin >= 0 else owner(-1 - origin)
            end = min(stop, edge, at + (starts[k + 1] - origin if origin >= 0 and k + 1 < len(starts) else stop - at))
            put(k, after[at:end], changed)
            origin, at = (origin + end - at if origin >= 0 else origin), end
    return out


def style_centuries(spans: list[dict]) -> list[dict]:
    """Century numerals before a century word: the numeral in lower-case small capitals, its e raised; equal neighbours are joined."""
    text = "".join(s["text"] or "" for s in spans)
    marks: list[tuple[int, int, str]] = []
    for m in CENTURY.finditer(text):
        if m[1].lower() in V.CENTURIES and CONTEXT.match(text[m.end() : m.end() + CONTEXT_LENGTH]):
            marks += [(m.start(1), m.end(1), "small_caps"), (m.start(2), m.end(2), "sup")]
    if not marks:
        return [dict(s) for s in spans]
    out: list[dict] = []
    at = k = 0
    for s in spans:
        end = at + len(s["text"] or "")
        if at == end:
            out.append(dict(s))
        first = at
        while at < end:
            while k < len(marks) and marks[k][1] <= at:
                k += 1
            begins = k < len(marks) and marks[k][0] <= at
            stop = min(end, marks[k][1] if begins else marks[k][0] if k < len(marks) else end)
            look = marks[k][2] if begins and s["kind"] == "text" else None
            c = s["text"][at - first : stop - first]
            new = dict(s, text=c.lower() if look == "small_caps" else c) | ({look: True} if look else {})
            if out and {**out[-1], "text": ""} == {**new, "text": ""}:
                out[-1]["text"] += new["text"]
            else:
                out.append(new)
            at = stop
    return out


def _rows(spans) -> list[dict]:
    return [] if spans is None else [s if isinstance(s, dict) else s.asDict() for s in spans]


@F.pandas_udf(T.ArrayType(REGION))
def _regions(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "stop": b} for a, b in regions(x, y)] for x, y in zip(before, after)])


@F.pandas_udf(T.ArrayType(MARKED))
def _carry(spans: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([carry(_rows(s), a or "") for s, a in zip(spans, after)])


@F.pandas_udf(T.ArrayType(SPAN))
def _centuries(spans: pd.Series) -> pd.Series:
    return pd.Series([style_centuries(_rows(s)) for s in spans])


@F.pandas_udf(T.ArrayType(REGION))
def _piece_regions(length: pd.Series, steps: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "stop": b} for a, b in piece_regions(piece_table(n, list(s)))] for n, s in zip(length, steps)])


@F.pandas_udf(T.ArrayType(MARKED))
def _moved(spans: pd.Series, steps: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([move(_rows(x), list(s), a or "") for x, s, a in zip(spans, steps, after)])


def step_regions(before: Column, steps: Column) -> Column:
    """array<struct<start, stop>> of what the steps of rewrite_steps made, in the text after them.  No texts are compared."""
    return _piece_regions(F.length(before), steps)


def moved_spans(spans: Column, steps: Column, after: Column) -> Column:
    """carried_spans, from the steps of rewrite_steps."""
    return _moved(spans, steps, after)


def changed_regions(before: Column, after: Column) -> Column:
    """array<struct<start, stop>> of what is new in after."""
    return _regions(before, after)


def carried_spans(spans: Column, after: Column) -> Column:
    """spans with their text replaced by after, and `changed` on the new parts."""
    return _carry(spans, after)


def plain(spans: Column) -> Column:
    """spans without `changed`."""
    return F.transform(spans, lambda x: F.struct(*(x[f.name].alias(f.name) for f in SPAN.fields)))


def as_given(new: Column, given: Column, kind: T.DataType) -> Column:
    """new, spans of the fields here, with the fields of arrays of type kind: fields unknown here are those of the first given span."""
    own = set(SPAN.fieldNames())
    field = lambda x, f: (x[f.name] if f.name in own else F.get(given, F.lit(0))[f.name]).cast(f.dataType).alias(f.name)
    return F.transform(new, lambda x: F.struct(*(field(x, f) for f in kind.elementType.fields)))


def century_spans(spans: Column) -> Column:
    return _centuries(spans)


def _element(kind: T.DataType, given: dict[str, Column]) -> Column:
    """A span of the fields of an array's elements: what is given, else false or null."""
    value = lambda f: given.get(f.name, F.lit(False) if f.name in STYLES else F.lit(None))
    return F.struct(*(value(f).cast(f.dataType).alias(f.name) for f in kind.elementType.fields))


def line_break(kind: T.DataType) -> Column:
    """A line break as an element of arrays of this type."""
    return _element(kind, {"text": F.lit("\n"), "kind": F.lit("line_break")})


def or_plain(spans: Column, text: Column, kind: T.DataType) -> Column:
    """spans, or the text as one span without style where there are none."""
    return F.when(F.size(spans) > 0, spans).otherwise(F.array(_element(kind, {"text": text, "kind": F.lit("text")})))


def joined_lines(lines: Column, kind: T.DataType) -> Column:
    """Arrays of spans as one, with a line break between neighbours."""
    return F.flatten(F.transform(lines, lambda x, i: F.when(i > 0, F.concat(F.array(line_break(kind)), x)).otherwise(x)))


def cut_lines(spans: Column) -> Column:
    """The arrays of spans between line breaks, empty ones left out: places of the breaks first, then a slice for each line."""
    at = lambda n: F.sequence(F.lit(1), n)
    breaks = F.concat(F.array(F.lit(0)), F.filter(at(F.size(spans)), lambda i: F.element_at(spans, i)["kind"] == "line_break"), F.array(F.size(spans) + 1))
    line = lambda b, i: F.slice(spans, F.get(b, i - 1) + 1, F.get(b, i) - F.get(b, i - 1) - 1)
    lines = F.get(F.transform(F.array(breaks), lambda b: F.transform(at(F.size(b) - 1), lambda i: line(b, i))), F.lit(0))
    return F.when(F.size(spans) > 0, F.filter(lines, lambda x: F.size(x) > 0))
