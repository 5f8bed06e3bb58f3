"""Values that results depend on: characters, word lists, patterns, thresholds and names.

Everything in this file is a fixed value of the editorial conventions.  Patterns are in Java's dialect; (?U) makes
classes and word boundaries Unicode-aware.
"""

# Characters
NNBSP, NBSP, APOSTROPHE, ELLIPSIS, EN_DASH, EM_DASH = "\u202f", "\u00a0", "\u2019", "\u2026", "\u2013", "\u2014"
OPEN_QUOTE, CLOSE_QUOTE = "«", "»"
SPACES = r"[ \t\x{A0}\x{202F}]"

# Centuries
CENTURIES = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx", "xxi", "xxii", "xxiii"]
CENTURY_CONTEXT = r"\s*(?:si[eè]cles?|s\.)\b"

# Straight and English quotation marks: a pair, how far around it is looked, what before and after it says that it is technical
QUOTE_PAIR, QUOTE_REACH = r"[\"“][^\"\n”]+[\"”]", 48
QUOTE_TECHNICAL_BEFORE, QUOTE_TECHNICAL_AFTER = r"(?sU)(?:\b[\w:-]+\s*=|\(|\(.*,)$|^[^>]*<[^>]*$", ")],;:"

# Words that take the ligature, without it
LIGATURES = ["boeuf", "boeufs", "oeuf", "oeufs", "soeur", "soeurs", "coeur", "coeurs", "oeuvre", "oeuvres", "oeil", "voeu", "voeux", "noeud", "noeuds", "moeurs"]

# Sections and captions
BIBLIOGRAPHY_TITLE = r"(?iU)^(sources?|bibliographie|r(?:é|e)f(?:é|e)rences\s*bibliographiques?|bibliography|travaux\s*cit(?:é|e)s?|works?\s*cited)"
BIBLIOGRAPHY_TITLE_NORMALISER = r"(?iU)^(sources?|bibliographie|références\s*bibliographiques?|bibliography|travaux\s*cités?|works?\s*cited|références)"
CLOSING_STYLES = ["Titre1", "Titre2", "heading 1", "heading 2"]
CAPTION_FRAGMENTS = ["accolade", "souligne", "soulignee", "face a", "voir ", "cf."]
BIBLIOGRAPHY_MARKERS = [" éd.", " ed.", " p.", " pp.", " vol.", " t.", " n°", " no."]
BIBLIOGRAPHY_ENTRY = r"^[A-Z\(][A-Za-z'\-\s]{1,40},.{5,},\s*\d{4}"

# Headings
STYLE_LEVEL = r"(?i)(?:heading|tei_head|tei_titre|titre|head)[_\-\s]*([1-6])"
NUMBERED = r"^(\d+)\s*[-\.]\s*"
NUMBERED_STRONG = r"(?i)^(?:\d+|[IVXLCDM]+)\s*[\.\-]\s+\S+"
CREDIT_START = r"(?iU)^(Sous|Dans|Pour|Avec|Sur|Par|Textes?|Études?|Articles?|Ouvrage|Actes?)\s+"
VERB_LEAD = r"(?U)^[A-Z][A-Za-z]*(ait|aient|ront|raient|rait|ions|iez)\b"
CONNECTOR = r"(?iU)^(Et|Mais|Or|Car|Puis|Alors|Ainsi|Enfin|Cependant|Tandis)\b"
NAME_PAIR = r"(?U)^[A-Z][A-Za-z\-]+\s+[A-Za-z\-][A-Za-z\-\s]*\s+et\s+[A-Z]"  # one class for all inner words: a repeated group would recurse
ROMAN_ONLY = r"^[IVXLCDMivxlcdm]{1,5}$"
PASSAGE_TOKEN = r"(?i)^(?:[IVXLCDM]+|\d+|[A-Za-z]{1,4})$"
ABBREVIATION_ENTRY = r"^[A-Z]{2,6}[ ]?\s*:"
INSTITUTION = r"(?iU)^(Universit[ée]|École|Institut|CNRS|UMR|Laboratoire|Centre|Facult[ée]|UFR|Acad[ée]mie|Fondation|Museum|Musée|Biblioth[èe]que)"
SUBORDINATE = r"(?U)\s(qui|que|dont|où|car|mais|avec|dans|pour|sur)\s"
TRAILING_PREPOSITIONS = ["par", "de", "du", "des", "au", "aux", "en", "à"]
LIST_MARKER = r"(?U)^\s*(?:[0-9]+[\.\)]|[A-Za-zÀ-ÿ][\.\)]|[-–—•*])\s+\S"
# How a list of passages begins at least, and how no list of names does: its first or second part in lower case
PASSAGE_START = r"(?U)^[,;:.]*[\s,]*\.*[A-Za-z0-9]+\.*\s*,"
NO_NAMES = r"(?U)^(?:[^,]*,)?\s*(?!et\s)\p{Ll}"
CHRONOLOGY = r"^\d{3,4}\s*[-–—:]\s+\S+"
MARKUP_TAG, MARKUP_ATTRIBUTE, MARKUP_CODE = r"<[^>]+>", r"(?U)\b[\w:-]+\s*=\s*\"[^\"]*\"", r"(?i)\b(print|class|def|return)\s*\("
NOTE_STYLES = ["footnote", "endnote", "note de bas", "notedebasdepage"]

# Verse
VERSE_ENDINGS = [",", ";", ":", ".", "!", "?"]
SPEECH_BEFORE = r"(?U)\b(?:annonce|dit|repond|chante|recite|declame|ecrit|cite)\b"
SPEECH_WITHIN = r"(?U)\b(?:dit|ecrit|écrit|chant|poeme|poème|vers)\b"
SEQUENCE_MIN, SEQUENCE_MAX, LINE_WORDS, STANZA_SPACE = 3, 20, 16, 240

CHRONOLOGY_LINE = r"(?iU)^\s*(?:\d{1,4}|[IVXLCDM]+)\s*(?:[-–—.:)]|\b)"

# Quotations and epigraphs
QUOTE_INDENT, QUOTE_LENGTH, EPIGRAPH_LENGTH, EPIGRAPH_WORDS = 400, 60, 350, 5
EPIGRAPH_BAD_ENDINGS = [".", "!", "?", ",", ":", ";", ELLIPSIS]

# Profiles: heading transform, heading diagnostic, verse transform, verse diagnostic
PROFILES = {"conservative": (0.90, 0.70, 0.82, 0.60), "balanced": (0.85, 0.60, 0.78, 0.55), "exploratory": (0.75, 0.50, 0.72, 0.48)}
PROFILE_ALIASES = {"prudent": "conservative", "conservateur": "conservative", "equilibre": "balanced", "exploratoire": "exploratory"}

# Output styles
STYLES = {
    "paragraph": "Normal", "paragraph_lead": "TEI_paragraph_consecutive", "heading_1": "Heading 1", "heading_2": "Heading 2", "heading_3": "Heading 3", "heading_4": "Heading 4",
    "heading_5": "Heading 5", "quote_block": "TEI_quote", "quote_nested": "TEI_quote_nested", "bibliography_item": "TEI_bibl_reference", "bibliography_start": "TEI_bibl_start",
    "epigraph": "TEI_epigraph", "acknowledgment": "TEI_acknowledgment", "abstract": "TEI_abstract", "keywords": "TEI_keywords", "author": "TEI_aut:", "appendix_start": "TEI_appendix_start",
    "footnote": "footnote text", "dedication": "TEI_dedication", "verse": "TEI_verse", "figure_title": "TEI_figure_title", "figure_caption": "TEI_figure_caption", "code": "TEI_code",
}
STYLE_LEVELS = {"Titre1": 1, "Titre2": 2, "Titre3": 3, "Titre4": 4, "Titre5": 5, "Titre6": 6, "heading1": 1, "heading2": 2, "heading3": 3, "Heading1": 1, "Heading2": 2, "Heading3": 3, "heading 1": 1, "heading 2": 2, "heading 3": 3}
ABSTRACT, KEYWORDS, ACKNOWLEDGMENT = r"(?i)^(résumé|abstract|summary)", r"(?i)^(mots[- ]clés?|keywords?)", r"(?i)^(remerciements?|acknowledgments?)"
HIGHLIGHTS = {
    "orthotypo": "yellow", "footnote": "bright green", "biblio": "turquoise", "ai": "pink", "ai_structure": "violet", "exploratory_structure": "dark yellow", "structure_applied": "teal", "suspect_unhandled": "red",
}
NOTE_HIGHLIGHTS = {k: v for k, v in HIGHLIGHTS.items() if k != "ai_structure"}  # notes have no structure to mark
#: Names of settings in older files, and what they are called here; a mode goes before the flags, of which the oldest switches the editor only
FORMER_SETTINGS = {"decision_mode": "mode", "enable_structure_ai": "structure_ai", "enable_editorial_ai": "editorial_ai", "max_ai_calls": "calls", "enable_ai": "editorial_ai"}
FORMER_FLAGS = ["enable_structure_ai", "enable_ai"]
#: What word-processor files call those colours
HIGHLIGHT_VALUES = {
    "yellow": "yellow", "bright green": "green", "turquoise": "cyan", "pink": "magenta", "violet": "darkMagenta", "dark yellow": "darkYellow", "teal": "darkCyan", "red": "red",
}

# Diagnostics of tables, note calls and quotations: codes, reasons and rules
TABLE_SHOWN, TABLE_MISSING, TABLE_EMPTY = "table_exported_to_tei", "table_not_exported_to_tei", "table_export_fallback"
TABLE_REASONS = ["missing_table_ooxml", "invalid_table_ooxml", "no_rows"]
CALL_RULES = {"call_spacing": "R-AN-003", "call_placement": "R-AN-002"}
CALL_CATEGORIES = {"call_spacing": "footnote_call_spacing", "call_placement": "footnote_call_placement"}
QUOTE_RULE, QUOTE_CATEGORY, NOTE_RULE, CORRECTION_RULE = "R-GQ-004", "quote_punctuation", "purh.note.batch", "purh.ai.editorial"
LINE_RULE = "structure.lineated.group.annotate"

# Arbitration
CALL_FACTORS = {"conservative": (0.5, 0.90), "balanced": (1.0, 0.85), "aggressive": (1.0, 0.75)}
EDITORIAL_CALLS, EDITORIAL_LENGTH = 8, 200
