"""Typographic rewriting: every rule is a column expression, and a rule set is their composition in a fixed order.

Every rule is made of built-in expressions.  Rules that need the text around a match cut it there and fold over the
pieces, and only for texts that hold such a mark.  A rule that uses its text more than once binds it first, so the
composition grows with the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import WHITE, capital, contains_any, rstrip, strip

N, B, SP = V.NNBSP, V.NBSP, V.SPACES


#: Noncharacters that stand before what an edit replaces, between that and what replaces it, and after it.
OLD, NEW, END = "\ufdd1", "\ufdd2", "\ufdd3"


def _edit(old: str, new: str) -> str:
    return OLD + old + NEW + new + END


class Rule:
    """A rewrite as steps.  A step replaces a pattern, or is a function of a text and of how an edit is written; so it gives
    either the new text, or the text with its edits marked, in which what was replaced is still there.  A pattern may come
    with strings of which every match holds one: texts without them aren't searched."""

    def __init__(self, *steps):
        self.steps = steps

    def __call__(self, t: Column) -> Column:
        for step in self.steps:
            t = _replaced(t, *step) if isinstance(step, tuple) else step(t, False)
        return t

    def marked(self) -> list:
        """A function for each step, from a text to the text with the step's edits marked."""
        one = lambda step: (lambda t: _replaced(t, step[0], _edit("$0", step[1]), *step[2:])) if isinstance(step, tuple) else (lambda t: step(t, True))
        return [one(step) for step in self.steps]


def _replaced(t: Column, pattern: str, by: str, *parts: str) -> Column:
    if not parts:
        return F.regexp_replace(t, pattern, by)
    return _bound(t, lambda x: F.when(contains_any(x, parts), F.regexp_replace(x, pattern, by)).otherwise(x))


def _replace(pattern: str, by: str, *parts: str) -> Rule:
    return Rule((pattern, by, *parts))


#: Closed forms only; the case of the word, or of its first letter, is kept.
_LIGATURE_WORD = rf"(?U)\b(?=(?i:{'|'.join(V.LIGATURES)})\b)(\p{{L}}?)"


def _centuries(t: Column, marked: bool) -> Column:
    """Numerals of the closed list in capitals, with a plain e.  They are marked by control characters, then raised."""
    numerals = "|".join(sorted(V.CENTURIES, key=len, reverse=True))
    new = "\x01$1\x02e"
    found = F.regexp_replace(t, rf"(?U)(?=[ivxIVX\x{{130}}\x{{131}}])\b((?i:{numerals}))[eè][rm]?[eé]?\b", _edit("$0", new) if marked else new)
    raised = lambda p: F.when(p.contains("\x02"), F.concat(F.upper(F.substring_index(p, "\x02", 1)), F.substring_index(p, "\x02", -1))).otherwise(p)
    return _bound(found, lambda x: F.when(contains_any(x, ["\x01", "\x02"]), F.array_join(F.transform(F.split(x, "\x01"), raised), "")).otherwise(x))


def _bound(t: Column, make) -> Column:
    """make(t) with t computed once, however often make uses it."""
    return F.get(F.transform(F.array(t), make), F.lit(0))


def _opened(before: Column, piece: Column) -> Column:
    """Whether a French quotation is open after piece: the last of its marks decides, without one what was before."""
    back = F.reverse(piece)
    opening, closing = F.instr(back, V.OPEN_QUOTE), F.instr(back, V.CLOSE_QUOTE)
    return F.when((opening > 0) & ((closing == 0) | (opening < closing)), F.lit(True)).when(closing > 0, F.lit(False)).otherwise(before)


def _count(t: Column, mark: str) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))


#: A pair of marks: the marks with the blanks inside them, and what they hold.
_PAIR = r"(?sU)^(.\s*)(.*?)(\s*.)$"


def _french_marks(t: Column, marked: bool) -> Column:
    """Pairs of straight or English marks become French ones, or English ones inside a French quotation; technical uses stay.

    The text is cut at the pairs; a fold over the pieces keeps the end of what it has passed, whether a quotation is open
    there, and how many closing marks are still to come.
    """
    gaps = F.split(t, V.QUOTE_PAIR, -1)
    pieces = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(t, F.lit(V.QUOTE_PAIR), F.lit(0)).alias("mark"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    start = F.struct(F.lit("").alias("end"), F.lit(False).alias("open"), _count(t, V.CLOSE_QUOTE).alias("left"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        mark = F.coalesce(x["mark"], F.lit(""))
        before = rstrip(F.right(F.concat(state["end"], x["gap"]), F.lit(V.QUOTE_REACH)))
        after = F.substring(F.ltrim(F.left(F.coalesce(x["next"], F.lit("")), F.lit(V.QUOTE_REACH)), F.lit(WHITE)), 1, 1)
        inside = F.substr(mark, F.lit(2), F.length(mark) - 2)
        technical = before.rlike(V.QUOTE_TECHNICAL_BEFORE) | inside.contains("\\") | after.isin(list(V.QUOTE_TECHNICAL_AFTER))
        is_open, left = _opened(state["open"], x["gap"]), state["left"] - _count(x["gap"], V.CLOSE_QUOTE) - _count(mark, V.CLOSE_QUOTE)
        quoted = lambda a, b: F.regexp_replace(mark, _PAIR, _edit("$1", a) + "$2" + _edit("$3", b)) if marked else F.concat(F.lit(a), strip(inside), F.lit(b))
        new = F.when((mark == "") | technical, mark).when(is_open & (left > 0), quoted("“", "”")).otherwise(quoted(V.OPEN_QUOTE + N, N + V.CLOSE_QUOTE))
        end = F.right(F.concat(state["end"], x["gap"], mark), F.lit(V.QUOTE_REACH))
        return F.struct(end.alias("end"), _opened(is_open, mark).alias("open"), left.alias("left"), F.concat(state["out"], x["gap"], new).alias("out"))

    return F.aggregate(pieces, start, step, lambda state: state["out"])


def _quotes(t: Column, marked: bool) -> Column:
    return _bound(t, lambda x: F.when(x.contains('"') | x.contains("“"), _french_marks(x, marked)).otherwise(x))


_STRONG = r"([;?!]|:(?:(?!\d)|(?<!\d:)))"
_SLASHED = r"(?U)(?<!\S)[^\s/\\]*+[/\\]\S*+"  # a whole token


def _space_strong(t: Column, marked: bool) -> Column:
    """A fixed space before : ; ? !, but not within numbers (10:30) and not in tokens with a slash (addresses, paths), however long."""
    by = (_edit("$1", N) if marked else N) + "$2"
    spaced = lambda x: F.regexp_replace(x, f"(?=[ \\t\\x{{A0}}\\x{{202F}}:;?!])({SP}*){_STRONG}", by)

    def tokenwise(x: Column) -> Column:
        pieces = F.arrays_zip(F.split(x, _SLASHED, -1).alias("gap"), F.regexp_extract_all(x, F.lit(_SLASHED), F.lit(0)).alias("token"))
        return F.array_join(F.transform(pieces, lambda p: F.concat(spaced(p["gap"]), F.coalesce(p["token"], F.lit("")))), "")

    return _bound(t, lambda x: F.when(~contains_any(x, ":;?!"), x).when(contains_any(x, "/\\"), tokenwise(x)).otherwise(spaced(x)))


#: Rules by name, in the order in which they apply.
RULES = {
    "apostrophe": _replace(r"([A-Za-z\x{C0}-\x{24F}])'", f"$1{V.APOSTROPHE}", "'"),
    "ellipsis": _replace(r"\.{3}", V.ELLIPSIS, "..."),
    "quotes": Rule(_quotes),
    "ligatures": Rule((_LIGATURE_WORD + "oe", "$1œ", "oe"), (_LIGATURE_WORD + "OE", "$1Œ", "OE"), (_LIGATURE_WORD + "Oe", "$1Œ", "Oe")),
    "quote_open": _replace(rf"{V.OPEN_QUOTE}{SP}*", V.OPEN_QUOTE + N, V.OPEN_QUOTE),
    "quote_close": _replace(rf"{SP}*{V.CLOSE_QUOTE}", N + V.CLOSE_QUOTE, V.CLOSE_QUOTE),
    "space_strong": Rule(_space_strong),
    "space_weak": _replace(rf"{SP}+([,.])(?!\d)", "$1"),
    "double_space": _replace(r"[ \t]{2,}", " ", "  ", " \t", "\t ", "\t\t"),
    "civility": _replace(r"(?U)(?=[MDP])\b(M\.|Mme[s]?|Dr?|Pr?|Prof\.) (?=[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}])", f"$1{B}"),
    "centuries": Rule(_centuries),
    "ordinals": Rule((r"(?U)\b1(ère|ere)\b", "1re", "1ère", "1ere"), (r"(?U)\b(\d+)(ème|eme)\b", "$1e", "ème", "eme")),
    "double_dash": _replace("--", V.EN_DASH, "--"),
    "etc": _replace(rf"etc(?:{V.ELLIPSIS}\.*|\.{{2,}})", "etc.", "etc"),
    "pages": _replace(r"(?U)(?=[pvtfcmMnN])\b(pp?|vol|t|f|fol|fig|chap|cat|pl|ms|Ms|n°|N°|col)\.\s+(?=[\dIVXLCivxlc])", f"$1.{N}"),
    "number": _replace(r"(?U)\b([Nn]°)\s+(?=\d)", f"$1{N}", "°"),
    # the first group of a number, or a group right after one that was matched; parts of addresses (192.168.1.204 170.106.47.218) are no groups
    "thousands": _replace(r"(?U)(?=\d)((?<!\w|\d\.\d{1,3}\.)\d{1,3}|\G(?!^)\d{3}) (?=\d{3}(?!\w|\.\d{1,3}\.\d))", "$1" + N),
    "dash": _replace(rf"(?U)(?<=\w) {V.EN_DASH} (?=\w)|(?<=\w) - (?=[A-Za-z\x{{C0}}-\x{{FF}}])", f" {V.EM_DASH} ", f" {V.EN_DASH} ", " - "),
}


def rewrite(t: Column, rules=tuple(RULES)) -> Column:
    """t after the named rules, in their fixed order."""
    for name, rule in RULES.items():
        if name in rules:
            t = rule(t)
    return t


def rewrite_steps(t: Column, rules=tuple(RULES)) -> Column:
    """struct(text, steps): t after the named rules, and for each step that edited it the text with the edits marked, in order.

    An edit is OLD, what was there, NEW, what came in its place, END; so steps hold all that a piece table needs.
    """
    state = F.struct(t.alias("text"), F.expr("cast(array() as array<string>)").alias("steps"))
    plain = lambda m: F.regexp_replace(m, f"{OLD}[^{NEW}]*{NEW}([^{END}]*){END}", "$1")

    def after(s: Column, step) -> Column:
        """The state after a step, with the marked text computed once."""
        return _bound(step(s["text"]), lambda m: F.when(m.contains(OLD), F.struct(plain(m).alias("text"), F.array_append(s["steps"], m).alias("steps"))).otherwise(s))

    def then(step):
        return lambda s: after(s, step)

    for name, rule in RULES.items():
        for step in rule.marked() if name in rules else ():
            state = _bound(state, then(step))
    return state


def changes(before: Column, rules=tuple(RULES)) -> Column:
    """An array of struct(before, after): one entry if the rules change the text, else none.

    Inside a lambda the rewritten text is computed once; as a column with a filter on it, it would be computed twice.
    """
    return F.filter(F.array(F.struct(before.alias("before"), rewrite(before, rules).alias("after"))), lambda x: x["before"] != x["after"])


def edits(before: Column, rules=tuple(RULES)) -> Column:
    """changes(), with the steps of rewrite_steps: an array of struct(before, after, steps)."""
    pair = lambda t: F.struct(before.alias("before"), t["text"].alias("after"), t["steps"].alias("steps"))
    return F.filter(F.transform(F.array(rewrite_steps(before, rules)), pair), lambda x: x["before"] != x["after"])


def note_text(t: Column) -> Column:
    """A note: no leading blanks, a capital first, abbreviations in lower case within, fixed spaces, a final point."""
    t = F.regexp_replace(t, r"^[ \t]+", "")
    t = F.concat(capital(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))
    for short in ("ibid", "idem", "id"):
        t = F.regexp_replace(t, rf"(?iU)(?<!^)\b{short}\b", short)
    for short in ("op", "art", "loc"):
        t = F.regexp_replace(t, rf"(?iU)(?<!^)\b{short}\.(\s*)cit\b", f"{short}.$1cit")
    t = F.regexp_replace(t, rf"(?iU)\b(op|art|loc)\.{SP}+(cit)\.", f"$1.{N}$2.")
    t = F.regexp_replace(t, rf"(?iU)\bs\.{SP}+([ld])\.", f"s.{N}$1.")
    bare = F.regexp_replace(t, r"(?U)\s+$", "")
    complete = bare.rlike(rf"[.!?{V.ELLIPSIS}{V.CLOSE_QUOTE}]$") | bare.rlike(r"https?://\S+$") | bare.rlike(r"[»›’]$")
    return F.when((bare != "") & ~complete, F.concat(bare, F.lit("."))).otherwise(t)


def bibliography_text(t: Column) -> Column:
    """A bibliography entry: trimmed, fixed spaces after abbreviations, a final point."""
    t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?U)\b(pp?|vol|t|f|fig|col|n°|N°)\.\s+(?=[\dIVXLCivxlc])", f"$1.{N}")
    t = F.regexp_replace(t, r"(?U)\b([Nn]°)\s+(?=\d)", f"$1{N}")
    return F.when((t != "") & ~t.rlike(rf"[.!?{V.ELLIPSIS}{V.CLOSE_QUOTE}]$"), F.concat(t, F.lit("."))).otherwise(t)


def century_styling(t: Column) -> Column:
    """The century numerals that a century word follows: their small-capitals part and their superscript."""
    return F.regexp_extract_all(t, F.lit(rf"(?iU)\b([IVXLCDM]{{1,8}})e\b(?={V.CENTURY_CONTEXT})"), F.lit(1))


def quote_point_suspects(t: Column) -> Column:
    """Quotations closed before a full stop whose own end, or what introduces them, makes the stop doubtful."""
    found = F.regexp_extract_all(t, F.lit(r"(?U)(?::\s*)?«[^»]+»\."), F.lit(0))

    def doubtful(m: Column) -> Column:
        inside = F.regexp_replace(F.regexp_extract(m, r"«([^»]+)»\.$", 1), r"(?U)^\s+|\s+$", "")
        return (inside != "") & ~inside.rlike('[“”"«»]') & (inside.rlike("[.;:?!…]$") | m.startswith(":"))

    return F.transform(F.filter(found, doubtful), lambda m: F.regexp_extract(m, r"(«[^»]+»\.)$", 1))
