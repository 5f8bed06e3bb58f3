"""Text primitives as column expressions: Unicode-aware trimming, word counts, case tests."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What Unicode calls white space, which is what (?U)\s matches.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(t: Column) -> Column:
    """Without white space of any kind (no-break spaces too) at either end."""
    return F.btrim(t, F.lit(WHITE))


def rstrip(t: Column) -> Column:
    return F.rtrim(t, F.lit(WHITE))


def words(t: Column) -> Column:
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def is_upper(t: Column) -> Column:
    """At least one cased character, and none in lower case."""
    return (F.upper(t) == t) & (F.lower(t) != t)


def _single_capitals() -> tuple[str, str]:
    """Letters whose capital takes several characters, and the one that stands for it: title case, the capital sharp s, else the letter itself."""
    several = [chr(c) for c in range(0x80, 0x10000) if len(chr(c).upper()) > 1]
    return "".join(several), "".join("\u1e9e" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in several)


SEVERAL, SINGLE = _single_capitals()


def capital(c: Column) -> Column:
    """A character in capitals, as one character."""
    return F.when(F.length(F.upper(c)) > 1, F.translate(c, SEVERAL, SINGLE)).otherwise(F.upper(c))


def starts_upper(t: Column) -> Column:
    return is_upper(F.substring(t, 1, 1))


def last_char(t: Column) -> Column:
    return F.substring(t, -1, 1)


def last_word(t: Column) -> Column:
    return F.lower(F.regexp_extract(t, r"(?U)(\S+)\s*$", 1))


def ends_with_any(t: Column, endings) -> Column:
    return last_char(t).isin(list(endings))


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters that canonical decomposition makes a single other character with marks, and those characters."""
    found = {}
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if c == c.lower() and len(base) == 1 and base != c:
            found[c] = base
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _plain_letters()


def fold(t: Column) -> Column:
    """Lower case without accents, in Latin, Greek and Cyrillic: composed letters by their decomposition, and loose marks left out."""
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.regexp_replace(F.translate(F.lower(t), ACCENTED, PLAIN), r"\p{Mn}", ""))


def contains_any(t: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | t.contains(p)
    return out
