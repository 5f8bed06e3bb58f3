"""Pieces of SQL for the oracle side: lines of documents and text tests, in DuckDB's dialect."""

from __future__ import annotations

SP = r"[ \t\x{A0}\x{202F}]"
EDGE = r"^[\s\x{A0}\x{202F}]+|[\s\x{A0}\x{202F}]+$"

LINES = """l AS (
  SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos, unnest(string_split(text, chr(10))) AS text FROM documents
)"""

def strip(t: str) -> str:
    return f"regexp_replace({t}, '{EDGE}', '', 'g')"


def words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array({t}, '[\s\x{{A0}}\x{{202F}}]+'), lambda w: w <> '')"


def n_words(t: str) -> str:
    return f"len({words(t)})"


def is_upper(t: str) -> str:
    return f"(upper({t}) = {t} AND lower({t}) <> {t})"


def fold(t: str) -> str:
    return f"strip_accents(lower({t}))"


def has(t: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({t}, '{p}')" for p in parts) + ")"


def ends(t: str, chars: str) -> str:
    return "right(" + t + ", 1) IN (" + ", ".join(f"'{c}'" for c in chars) + ")"


S = "s"
CAPTION = f"(starts_with(lower(s), 'p.') OR starts_with(lower(s), 'page') OR {has(fold(S), 'accolade', 'souligne', 'face a', 'voir ', 'cf.')})"
BARE = "regexp_replace(s, '^[,;:.]+|[,;:.]+$', '', 'g')"
TOKENS = f"list_transform(list_filter(string_split({BARE}, ','), lambda t: {strip('t')} <> ''), lambda t: regexp_replace({strip('t')}, '^\\.+|\\.+$', '', 'g'))"
PASSAGE = (
    f"(contains({BARE}, ',') AND len({TOKENS}) >= 2 AND len(list_filter({TOKENS}, lambda t: NOT regexp_matches(t, '(?i)^([IVXLCDM]+|[0-9]+|[A-Za-z]{{1,4}})$'))) = 0"
    f" AND len(list_filter({TOKENS}, lambda t: regexp_matches(t, '(?i)[0-9IVXLCDM]'))) > 0)"
)
LIST_ITEM = r"regexp_matches(regexp_replace(s, '[\s\x{A0}\x{202F}]+', ' ', 'g'), '^\s*([0-9]+[.)]|[A-Za-zÀ-ÿ][.)]|[-–—•*])\s+')"
BIBLIO = (
    "(" + has("lower(s)", " éd.", " ed.", " p.", " pp.", " vol.", " t.", " n°", " no.", "doi.org", "http://", "https://") + r" OR regexp_matches(s, ',[\s\x{A0}\x{202F}]*[0-9]{4}($|[^\pL\pN_])'))"
)
MARKUP = r"""(regexp_matches(s, '<[^>]+>') OR regexp_matches(s, '[\pL\pN_][\pL\pN_:-]*\s*=\s*"[^"]*"') OR regexp_matches(s, '(?i)\b(print|class|def|return)\s*\('))"""
CHRONOLOGY = r"regexp_matches(s, '^[0-9]{3,4}\s*[-–—:]\s+\S+')"
ITALIC_VERSE = f"(italic AND length(s) BETWEEN 20 AND 160 AND {is_upper('left(s, 1)')} AND {ends(S, ';,.?!:')})"
PARTS = rf"list_filter(list_transform(string_split(regexp_replace(s, ',?[\s\x{{A0}}\x{{202F}}]+et[\s\x{{A0}}\x{{202F}}]+', ',', 'g'), ','), lambda p: {strip('p')}), lambda p: p <> '')"
NAMES = f"(len({PARTS}) >= 3 AND len(list_filter({PARTS}, lambda p: NOT ({n_words('p')} >= 2 AND NOT regexp_matches(p, '[0-9]|[()\\[\\]{{}}<>]') AND {is_upper('left(p, 1)')}))) = 0)"
BLOCKING = f"({CAPTION} OR {PASSAGE} OR {LIST_ITEM} OR {BIBLIO} OR {ITALIC_VERSE})"
VERB_LEAD = r"regexp_matches(s, '^[A-Z][A-Za-z]*(ait|aient|ront|raient|rait|ions|iez)($|[^\pL\pN_])')"
CONNECTOR = r"regexp_matches(s, '(?i)^(Et|Mais|Or|Car|Puis|Alors|Ainsi|Enfin|Cependant|Tandis)($|[^\pL\pN_])')"
CAPS = f"({is_upper(S)} AND length(s) > 4 AND length(s) < 140)"
LAST_WORD = rf"lower(regexp_extract(s, '([^\s\x{{A0}}\x{{202F}}]+)$', 1))"
NO_TITLE = (
    rf"(s = '' OR {ends(S, '.?!,')} OR regexp_matches(s, ',\s*[0-9]{{4}}') OR regexp_matches(s, ',\s+[a-z]{{4,}}')"
    r" OR regexp_matches(s, '(?i)^(Sous|Dans|Pour|Avec|Sur|Par|Textes?|Études?|Articles?|Ouvrage|Actes?)\s+')"
    f" OR {LAST_WORD} IN ('par', 'de', 'du', 'des', 'au', 'aux', 'en', 'à') OR {VERB_LEAD}"
    r" OR regexp_matches(s, '^[A-Z][A-Za-z-]+(\s+[A-Za-z-]+)+\s+et\s+[A-Z]') OR regexp_matches(s, '^[A-Z]{2,6}[ ]?\s*:')"
    r" OR regexp_matches(s, '(?i)^(Universit[ée]|École|Institut|CNRS|UMR|Laboratoire|Centre|Facult[ée]|UFR|Acad[ée]mie|Fondation|Museum|Musée|Biblioth[èe]que)'))"
)
HEADING_LIKE = (
    f"({n_words(S)} BETWEEN 2 AND 8 AND length(s) <= 70 AND {is_upper('left(s, 1)')} AND NOT {BLOCKING} AND NOT {NO_TITLE} AND NOT regexp_matches(s, '^[IVXLCDMivxlcdm]{{1,5}}$')"
    rf" AND NOT {CONNECTOR} AND NOT regexp_matches(s, '^-\s') AND NOT regexp_matches(s, '\s(qui|que|dont|où|car|mais|avec|dans|pour|sur)\s') AND NOT {NAMES})"
)
BOLD_HEADING = f"(length(s) <= 180 AND NOT {BLOCKING} AND NOT {NO_TITLE})"
NUMBERED = r"regexp_extract(s, '^([0-9]+)\s*[-.]\s*', 1)"
NUMBERED_STRONG = r"regexp_matches(s, '(?i)^([0-9]+|[IVXLCDM]+)\s*[.-]\s+\S+')"
ITALIC_KIND = (
    rf"CASE WHEN {BLOCKING} OR {n_words(S)} < 2 OR regexp_matches(s, ',\s*[0-9]{{4}}') OR {has(S, 'http', 'doi.org')} OR length(s) > 250 THEN ''"
    f" WHEN {n_words(S)} BETWEEN 2 AND 4 AND NOT regexp_matches(s, '[0-9]') AND NOT {has(S, ',', '«', '(')} AND len(list_filter({words(S)}, lambda w: regexp_matches(left(w, 1), '\\pL') AND NOT {is_upper('left(w, 1)')})) = 0 THEN 'author'"
    rf" WHEN {NAMES} THEN '' WHEN {NUMBERED} <> '' OR ({n_words(S)} BETWEEN 4 AND 25 AND length(s) <= 200 AND NOT regexp_matches(s, ',\s+[a-z]{{4,}}')) THEN 'heading' ELSE '' END"
)
SENTENCE = f"({ends(S, '.!?:;')} OR {VERB_LEAD})"
VETOES = (
    "list_filter(["
    + ", ".join(
        f"CASE WHEN {c} THEN '{k}' END"
        for k, c in {
            "bibliography_like": BIBLIO, "caption_or_reference": CAPTION, "list_like": LIST_ITEM, "name_list": NAMES, "passage_reference": PASSAGE, "poetry_line_candidate": ITALIC_VERSE,
            "sentence_connector": CONNECTOR, "sentence_like": SENTENCE, "technical_markup": MARKUP, "too_short_fragment": f"{n_words(S)} <= 1",
        }.items()
    )
    + "], lambda v: v IS NOT NULL)"
)

#: Lines with attributes derived from their place, as integers, the same way in both engines.
BLOCKS = f"""{LINES}, b AS (
  SELECT doc_id, pos, text, {strip('text')} AS s, (doc_id + pos) % 5 = 0 AS bold, (doc_id + pos) % 11 = 0 AS italic, pos % 6 = 0 AND pos > 0 AS blank_before,
    CASE (doc_id + pos) % 7 WHEN 0 THEN 720 WHEN 1 THEN 360 ELSE 0 END AS ind_left, CASE WHEN (doc_id + pos) % 13 = 0 THEN 300 ELSE 0 END AS space_before
  FROM l
)"""
