"""What a block's text looks like: boolean columns over stripped text and block attributes.

Every function takes columns and gives a column, so a whole set of them is one projection for the optimiser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import contains_any, ends_with_any, fold, is_upper, last_char, last_word, starts_upper, strip, word_count, words


def _unless(sign: Column, test: Column) -> Column:
    """test, which is false wherever sign holds; only the rest is looked at (an expression that `&` joins may be computed for all rows)."""
    return F.when(sign, F.lit(False)).otherwise(test)


def caption_or_reference(s: Column) -> Column:
    low = F.lower(s)
    return low.startswith("p.") | low.startswith("page") | contains_any(fold(s), V.CAPTION_FRAGMENTS)


def passage_reference(s: Column) -> Column:
    """A list of short tokens such as `VI, I, 52`, at least two, of which one is a number."""
    bare = F.regexp_replace(s, r"^[,;:.]+|[,;:.]+$", "")
    tokens = F.filter(F.split(bare, ","), lambda t: strip(t) != "")
    tokens = F.transform(tokens, lambda t: F.regexp_replace(strip(t), r"^\.+|\.+$", ""))
    found = bare.contains(",") & (F.size(tokens) >= 2) & F.forall(tokens, lambda t: t.rlike(V.PASSAGE_TOKEN)) & F.exists(tokens, lambda t: t.rlike(r"(?i)\d|[IVXLCDM]"))
    return _unless(~s.rlike(V.PASSAGE_START), found)


def list_item(s: Column) -> Column:
    return s.rlike(V.LIST_MARKER)


def bibliography_like(s: Column) -> Column:
    low = F.lower(s)
    return contains_any(low, [*V.BIBLIOGRAPHY_MARKERS, "doi.org", "http://", "https://"]) | s.rlike(r"(?U),\s*\d{4}\b")


def technical_markup(s: Column) -> Column:
    attribute, code = _unless(~(s.contains("=") & s.contains('"')), s.rlike(V.MARKUP_ATTRIBUTE)), _unless(~s.contains("("), s.rlike(V.MARKUP_CODE))
    return s.rlike(V.MARKUP_TAG) | attribute | code


def italic_verse_line(s: Column, all_italic: Column) -> Column:
    return F.coalesce(all_italic, F.lit(False)) & F.length(s).between(20, 160) & starts_upper(s) & ends_with_any(s, [";", ",", ".", "?", "!", ":"])


def name_list(s: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.regexp_replace(s, r"(?U),?\s+et\s+", ","), ","), strip), lambda p: p != "")

    def is_name(p: Column) -> Column:
        return (word_count(p) >= 2) & ~p.rlike(r"(?U)\d|[()\[\]{}<>]") & starts_upper(p)

    return _unless(s.rlike(V.NO_NAMES) | ~s.rlike(r",|(?U:\set\s)"), (F.size(parts) >= 3) & F.forall(parts, is_name))


def chronology_line(s: Column) -> Column:
    return s.rlike(V.CHRONOLOGY)


def note_zone(*styles: Column) -> Column:
    return contains_any(fold(F.concat_ws(" ", *styles)), V.NOTE_STYLES)


def source_heading_level(level: Column, style_id: Column, style_name: Column) -> Column:
    """An explicit level from 1 to 6, else the digit in a heading style's id, else in its name; null without one."""
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), V.STYLE_LEVEL, 1), F.lit("")).try_cast("int")
    return F.coalesce(F.when(level.between(1, 6), level), found(style_id), found(style_name))


SHARED = ("caption", "passage", "list", "bibliography", "verse_line", "names", "title_barred")


def shared(s: Column, all_italic: Column) -> dict[str, Column]:
    """Tests that several of the functions below need; put them in a projection of their own and pass the columns on."""
    return dict(zip(SHARED, (caption_or_reference(s), passage_reference(s), list_item(s), bibliography_like(s), italic_verse_line(s, all_italic), name_list(s), _not_a_title(s))))


def blocks_heading(s: Column, all_italic: Column, f: dict[str, Column] | None = None) -> Column:
    f = f or shared(s, all_italic)
    return f["caption"] | f["passage"] | f["list"] | f["bibliography"] | f["verse_line"]


def allcaps_title(s: Column) -> Column:
    return is_upper(s) & (F.length(s) > 4) & (F.length(s) < 140)


def _not_a_title(s: Column) -> Column:
    """Signs that both heading tests reject (neither takes texts of over 180 characters)."""
    return (
        (F.length(s) > 180) | (s == "") | last_char(s).isin(".", "?", "!", ",") | s.rlike(r"(?U),\s*\d{4}") | s.rlike(r",\s+[a-z]{4,}") | s.rlike(V.CREDIT_START)
        | last_word(s).isin(V.TRAILING_PREPOSITIONS) | s.rlike(V.VERB_LEAD) | s.rlike(V.NAME_PAIR) | s.rlike(V.ABBREVIATION_ENTRY) | s.rlike(V.INSTITUTION)
    )


def heading_candidate(s: Column, all_italic: Column, f: dict[str, Column] | None = None) -> Column:
    """Could be a heading set in bold: short and not a sentence, reference, credit or institution."""
    f = f or shared(s, all_italic)
    return (F.length(s) <= 180) & ~blocks_heading(s, all_italic, f) & ~f["title_barred"]


def heading_heuristic(s: Column, all_italic: Column, f: dict[str, Column] | None = None) -> Column:
    """Reads like a heading without any formatting: two to eight words and none of the signs against it."""
    f = f or shared(s, all_italic)
    return (
        (F.length(s) <= 70) & word_count(s).between(2, 8) & starts_upper(s) & ~blocks_heading(s, all_italic, f) & ~f["title_barred"]
        & ~s.rlike(V.ROMAN_ONLY) & ~s.rlike(V.CONNECTOR) & ~s.rlike(r"^[-]\s") & ~s.rlike(V.SUBORDINATE) & ~f["names"]
    )


def italic_kind(s: Column, all_italic: Column, f: dict[str, Column] | None = None) -> Column:
    """author, heading or '' for a block all in italics."""
    f = f or shared(s, all_italic)
    n = word_count(s)
    capitals = F.forall(words(s), lambda w: ~F.substring(w, 1, 1).rlike(r"\p{L}") | starts_upper(w))
    out = blocks_heading(s, all_italic, f) | (n < 2) | s.rlike(r"(?U),\s*\d{4}") | s.contains("http") | s.contains("doi.org") | (F.length(s) > 250)
    author = n.between(2, 4) & ~s.rlike(r"(?U)\d") & ~contains_any(s, [",", V.OPEN_QUOTE, "("]) & capitals
    titled = s.rlike(V.NUMBERED) | (n.between(4, 25) & (F.length(s) <= 200) & ~s.rlike(r",\s+[a-z]{4,}"))
    return F.when(out, "").when(author, "author").when(f["names"], "").when(titled, "heading").otherwise("")


def block_quote(s: Column) -> Column:
    return s.startswith(V.OPEN_QUOTE) & ((F.length(s) > 180) | ((F.length(s) > 120) & s.endswith(V.CLOSE_QUOTE)))


def strong_heading_signal(s: Column, source_level: Column, bold: Column, italic: Column, font_size: Column) -> Column:
    return source_level.isNotNull() | (bold & ~italic) | s.rlike(V.NUMBERED_STRONG) | allcaps_title(s) | (F.coalesce(font_size, F.lit(0.0)) >= 14.0)


def sentence_like(s: Column) -> Column:
    return ends_with_any(s, [".", "!", "?", ":", ";"]) | s.rlike(V.VERB_LEAD)


def heading_vetoes(s: Column, all_italic: Column, source_level: Column, f: dict[str, Column] | None = None) -> Column:
    """Sorted names of what speaks against a heading."""
    f = f or shared(s, all_italic)
    reasons = {
        "bibliography_like": f["bibliography"],
        "caption_or_reference": f["caption"],
        "list_like": f["list"],
        "name_list": f["names"],
        "passage_reference": f["passage"],
        "poetry_line_candidate": f["verse_line"],
        "sentence_connector": s.rlike(V.CONNECTOR),
        "sentence_like": sentence_like(s),
        "technical_markup": technical_markup(s),
        "too_short_fragment": source_level.isNull() & (word_count(s) <= 1),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in reasons.items())))


def bold_level(s: Column) -> Column:
    number = F.regexp_extract(s, V.NUMBERED, 1)
    return F.when(is_upper(s), 1).when(number != "", F.when(number.try_cast("int") <= 9, 2).otherwise(3)).when(F.length(s) <= 45, 2).otherwise(3)


def italic_level(s: Column) -> Column:
    return F.when(s.rlike(V.NUMBERED), 2).when(F.length(s) <= 60, 2).otherwise(1)


def heuristic_level(s: Column) -> Column:
    return F.when(is_upper(s), 1).when(s.rlike(V.NUMBERED), 2).when(F.length(s) <= 50, 2).otherwise(3)


def verse_line(s: Column, block_type: Column, in_notes: Column, zone: Column) -> Column:
    """A line that may belong to a stanza set off by blank paragraphs."""
    return (block_type == "paragraph") & (s != "") & (word_count(s) <= V.LINE_WORDS) & ~list_item(s) & ~in_notes & ~(F.lower(F.coalesce(zone, F.lit(""))) == "table")


def text_heading(line: Column) -> Column:
    """A line of plain text that is a heading: short, no sentence punctuation, all capitals."""
    s = strip(line)
    return (F.length(s) <= 100) & ~s.rlike("[.!?;:]") & (F.upper(s) == s) & s.rlike(r"\p{L}")
