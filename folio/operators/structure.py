"""The structure stage: stanzas are merged, then every block goes through one ladder of rules.

The ladder is a single projection.  Its one piece of state, whether a bibliography section is open, depends only on
rules that don't read it, so it is a window over their outcome.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions import spans
from ..functions.text import last_char, word_count
from . import scoring, sequences
from .blocks import complete, order, stripped


@dataclass
class Structured:
    blocks: DataFrame  # with old_type, rule, heading_level, merged_from, semantic
    verse: DataFrame | None  # one row for each scored sequence
    scored: DataFrame | None = None  # blocks with the sequence (verse) that each is in, before sequences are merged
    thresholds: scoring.Thresholds | None = None
    judged: DataFrame | None = None  # blocks with verse_found, the scored sequence that begins at each, so that both need one pass


def dominant_indent(df: DataFrame) -> DataFrame:
    """doc_id, ind_left: each document's most frequent left indent (not 0); of equally frequent ones the first to occur."""
    counted = df.where("ind_left is not null and ind_left <> 0").groupBy("doc_id", "ind_left").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"))
    return counted.groupBy("doc_id").agg(F.max_by("ind_left", F.struct("n", -F.col("at"))).alias("dominant"))


def _lineated(lines: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit("lineated_block").alias("role"), F.lit("lineated_block").alias("layout_kind"), null.alias("quote_kind"), F.lit("lineated").alias("lineation"), lines.alias("lines"),
        null.alias("genre_hint"), F.lit(None).cast("double").alias("genre_confidence"), null.alias("genre_source"),
    )


def merge_runs(df: DataFrame, name: str, rule: str, wanted: Column) -> DataFrame:
    """Each run in column `name` where wanted holds becomes its first row, a lineated block of the run's lines.

    merged_from lists the blocks that were given: what a row was merged from before goes on in it.
    """
    w = sequences.whole_run(name)
    hit = F.col(name).isNotNull() & wanted
    df = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    df = df.withColumns({"__lines": F.when(F.col("__hit"), F.collect_list("s").over(w)), "__ids": F.when(F.col("__hit"), F.flatten(F.collect_list(F.coalesce("merged_from", F.array("block_id"))).over(w))), "__at": F.row_number().over(sequences.in_run(name))})
    spanned = "spans" in df.columns and isinstance(df.schema["spans"].dataType, T.ArrayType)
    if spanned:  # a stanza has its lines' styles and calls, with breaks between the lines
        kind = df.schema["spans"].dataType
        own = df.withColumn("__spans", F.when(F.col("__hit"), spans.or_plain(F.col("spans"), F.col("s"), kind)))
        df = own.withColumn("__spans", F.when(F.col("__hit"), spans.joined_lines(F.collect_list("__spans").over(w), kind)))
    kept = df.where(~F.col("__hit") | (F.col("__at") == 1))
    put = lambda c, new: F.when(F.col("__hit"), new).otherwise(F.col(c))
    joined = F.array_join("__lines", "\n")
    return kept.withColumns(
        {
            "block_type": put("block_type", F.lit("lineated_block")), "text": put("text", joined), "s": put("s", joined), "rule": put("rule", F.lit(rule)), "merged_from": put("merged_from", F.col("__ids")),
            **({"spans": put("spans", F.col("__spans"))} if spanned else {}),
            "alignment": put("alignment", F.lit("left")), "semantic": put("semantic", _lineated(F.filter("__lines", lambda x: x != ""))), "protected_zone": put("protected_zone", F.lit(None).cast("string")),
        }
    ).drop("__hit", "__lines", "__ids", "__at", "__spans")


def vetoes_of_run(df: DataFrame, name: str) -> DataFrame:
    """Adds verse_free: whether nothing speaks against the row's run being verse (null outside runs).  A window over the exchange by doc_id that is there."""
    w, inside = sequences.whole_run(name), F.col(name).isNotNull()
    vetoes = scoring.verse_vetoes(F.count(F.lit(1)).over(w), w, inside)
    return df.withColumn("verse_free", F.when(inside, F.size(vetoes) == 0))


def with_document_facts(df: DataFrame) -> DataFrame:
    """Adds dominant (dominant_indent) and had_heading (whether any block was given as a heading), as windows over the document."""
    whole, same = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "ind_left")
    indented = F.col("ind_left").isNotNull() & (F.col("ind_left") != 0)
    df = df.withColumns({"__n": F.when(indented, F.count(F.lit(1)).over(same)), "__at": F.when(indented, F.min("pos").over(same))})
    best = F.max_by(F.when(indented, F.col("ind_left")), F.when(indented, F.struct("__n", -F.col("__at")))).over(whole)
    return df.withColumns({"dominant": best, "had_heading": F.coalesce(F.bool_or(F.col("block_type") == "heading").over(whole), F.lit(False))}).drop("__n", "__at")


def prepare(blocks: DataFrame, t: scoring.Thresholds | None = None, heuristics: bool = True) -> Structured:
    """Runs the stage over blocks of any number of documents."""
    t = t or scoring.thresholds()[0]
    df = stripped(complete(blocks)).withColumn("rule", F.lit(None).cast("string")).withColumn("old_type", F.col("block_type"))
    df = with_document_facts(df)
    verse = scored = judged = None
    candidate = F.lit(False)
    if heuristics:
        df = vetoes_of_run(sequences.blank_bounded(df), "stanza")
        df = merge_runs(df, "stanza", "stanza.between_blanks", F.coalesce("verse_free", F.lit(False))).drop("stanza", "verse_free", "edge_before", "edge_after")
        df = sequences.scored_sequences(df)
        scored, df = df, scoring.with_verse_scores(df, t)
        df = df.withColumns({"verse_decision": F.col("verse_found.decision"), "verse_found": F.when(F.col("pos") == F.col("verse_found.first_pos"), F.col("verse_found"))})
        verse = df.where("verse_found is not null").select("doc_id", "verse", "verse_found.*")
        applied = ["transform", "diagnostic"] if t.auto_apply else ["transform"]
        df = df.withColumn("__candidate", F.coalesce(F.col("verse_decision").isin("transform", "diagnostic"), F.lit(False)))
        df = merge_runs(df, "verse", "stanza.scored", F.col("verse_decision").isin(applied))
        candidate = F.col("__candidate")
    df = df.where(~sequences.is_blank())
    df = scoring.score_headings(df, t, candidate)
    df = scoring.without_tests(_ladder(df, t, heuristics)).drop("heading_like", "__candidate", "verse", "verse_decision", "had_heading")
    if heuristics:
        judged, df = df, df.drop("verse_found")
    return Structured(df, verse, scored, t, judged)


def epigraph(s: Column, first: Column) -> Column:
    """Whether a document's first block, s, reads like an epigraph."""
    return first & (F.length(s) <= V.EPIGRAPH_LENGTH) & ~last_char(s).isin(V.EPIGRAPH_BAD_ENDINGS) & (word_count(s) >= V.EPIGRAPH_WORDS)


def _ladder(df: DataFrame, t: scoring.Thresholds, heuristics: bool) -> DataFrame:
    s, kind = F.col("s"), F.col("block_type")
    paragraph, on = kind == "paragraph", F.lit(heuristics)
    bold, italic = F.coalesce("all_bold", F.lit(False)), F.coalesce("all_italic", F.lit(False))
    wanted = on & F.col("heading_decision").isin(["transform", "diagnostic"] if t.auto_apply else ["transform"])
    step = lambda rule, to, level=None: F.struct(F.lit(rule).alias("rule"), F.lit(to).alias("to"), (F.lit(None).cast("int") if level is None else level.cast("int")).alias("level"))
    f = {k: F.col(f"__p_{k}") for k in P.SHARED}
    italics = P.italic_kind(s, italic, f)
    first = F.row_number().over(order()) == 1
    early = (
        F.when(s == "", F.lit(None))
        .when(kind == "heading", step("heading.given", "heading", F.coalesce("heading_level", "source_level", F.lit(2))))
        .when(paragraph & F.col("source_level").isNotNull(), step("heading.source_style", "heading", F.col("source_level")))
        .when(paragraph & wanted & P.allcaps_title(s), step("heading.capitals", "heading", F.lit(1)))
        .when(paragraph & wanted & bold & ~italic & P.heading_candidate(s, italic, f), step("heading.bold", "heading", P.bold_level(s)))
        .when(paragraph & on & italic & ~bold & (italics == "author"), step("author.italic", "author"))
        .when(paragraph & wanted & italic & ~bold & (italics == "heading"), step("heading.italic", "heading", P.italic_level(s)))
        .when(paragraph & on & ~F.col("had_heading") & epigraph(s, first), step("epigraph.first", "epigraph"))
    )
    df = df.withColumn("__early", early)
    event = F.when(F.col("__early.rule") == "heading.given", s.rlike(V.BIBLIOGRAPHY_TITLE)).when(F.col("__early.to") == "heading", F.lit(False))
    df = sequences.carried(df, event, "in_bibliography", F.lit(False))
    indent, own = F.coalesce("ind_left", F.lit(0)), F.coalesce("ind_first_line", F.lit(0)) == 0
    entry = kind.isin("paragraph", "quote_block") & ~F.col("in_bibliography") & s.rlike(V.BIBLIOGRAPHY_ENTRY)
    late = (
        F.when((s == "") | F.col("__early").isNotNull(), F.lit(None))
        .when(paragraph & F.col("in_bibliography"), step("bibliography.section", "bibliography_item"))
        .when(paragraph & on & (indent > V.QUOTE_INDENT) & own & (indent != F.coalesce("dominant", F.lit(0))) & (F.length(s) >= V.QUOTE_LENGTH), step("quote.indent", "quote_block"))
        .when(on & entry, step("bibliography.pattern", "bibliography_item"))
        .when(paragraph & on & P.block_quote(s), step("quote.marks", "quote_block"))
        .when(paragraph & wanted & F.col("heading_like"), step("heading.heuristic", "heading", P.heuristic_level(s)))
    )
    df = df.withColumn("__step", F.coalesce(F.col("__early"), late))
    new_type = F.coalesce(F.col("__step.to"), kind)
    left_over = on & (new_type == "paragraph") & paragraph & F.col("heading_decision").isin("transform", "diagnostic") & (s != "")
    highlight = F.when(left_over, "suspect_unhandled").when((F.col("__step.to") == "heading") & ~F.col("__step.rule").isin("heading.given", "heading.source_style"), "exploratory_structure" if t.auto_apply else "structure_applied")
    return df.withColumns(
        {
            "block_type": new_type, "rule": F.coalesce("rule", "__step.rule"), "heading_level": F.when(new_type == "heading", F.coalesce("__step.level", "heading_level")).otherwise(F.col("heading_level")),
            "highlight": F.coalesce(highlight, F.col("highlight")), "heading_note": F.when(left_over, F.when(F.col("heading_decision") == "transform", "warning").otherwise("info")),
        }
    ).drop("__early", "__step")


def transformations(done: Structured) -> DataFrame:
    """One row for each block whose type a rule changed, with the blocks it was merged from; and one for each line of a scored sequence."""
    changed = done.blocks.where("old_type <> block_type").select("doc_id", "pos", F.col("block_id").alias("target"), F.lit("structure").alias("module"), F.col("old_type").alias("before"), F.col("block_type").alias("after"), "rule", "merged_from")
    if done.scored is None:
        return changed
    lines = lines_of_sequences(done.scored, done.verse, done.thresholds)
    annotated = lines.select("doc_id", "pos", "target", F.lit("structure").alias("module"), "before", "after", F.lit(V.LINE_RULE).alias("rule"), "group_id", "line_index", "score", "decision")
    return changed.unionByName(annotated, allowMissingColumns=True)


def lineage(given: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, pos, block_id of every given block, and what became of it: into (the block that holds it now) and how (kept, merged, removed).

    Merges of merges need no walk, for merged_from lists given blocks however often they were merged.
    """
    whole = blocks.select(F.col("doc_id").alias("__doc"), F.col("block_id").alias("into"), F.explode(F.coalesce("merged_from", F.array("block_id"))).alias("__id"))
    df = complete(given).select("doc_id", "pos", "block_id").join(whole, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("block_id") == F.col("__id")), "left")
    how = F.when(F.col("into").isNull(), "removed").when(F.col("into") == F.col("block_id"), "kept").otherwise("merged")
    return df.select("doc_id", "pos", "block_id", "into", how.alias("how"))


def verse_lines(df: DataFrame, t: scoring.Thresholds | None = None) -> DataFrame:
    """One row for each line of a scored sequence that isn't ignored: doc_id, pos, target, group_id, line_index (from 1), score,
    decision, before, after, highlight.  Groups are numbered within their document, in order.

    df: blocks before runs are merged (`prepare` merges them, so it keeps only first lines).
    """
    t = t or scoring.thresholds()[0]
    df = sequences.scored_sequences(stripped(complete(df)))
    return lines_of_sequences(df, scoring.score_verse(df, t), t)


def lines_of_sequences(df: DataFrame, verse: DataFrame, t: scoring.Thresholds) -> DataFrame:
    """verse_lines, from blocks with their sequence and the scored sequences."""
    verse = verse.where("decision <> 'ignore'")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos"))
    found = verse.select(F.col("doc_id").alias("__doc"), F.col("verse").alias("__verse"), "score", "decision", F.format_string("poetry_group_%03d", number).alias("__group"))
    hit = df.where("verse is not null").join(found, (F.col("doc_id") == F.col("__doc")) & (F.col("verse") == F.col("__verse")))
    applied = F.lit(t.auto_apply) | (F.col("decision") == "transform")
    colour = F.when(applied, "exploratory_structure" if t.auto_apply else "structure_applied").otherwise("suspect_unhandled")
    after = F.when(applied, "lineated_block").otherwise(F.col("block_type"))
    index = F.row_number().over(sequences.in_run("verse"))
    return hit.select("doc_id", "pos", F.col("block_id").alias("target"), F.col("__group").alias("group_id"), index.alias("line_index"), "score", "decision", F.col("block_type").alias("before"), after.alias("after"), colour.alias("highlight"))


def diagnostics(done: Structured) -> DataFrame:
    """What a person should look at: undecided headings, bibliography entries found by pattern, and verse."""
    columns = lambda category, severity, score, decision, text: [F.lit("structure").alias("module"), F.lit(category).alias("category"), severity.alias("severity"), score.cast("double").alias("score"), decision.alias("decision"), F.substring(text, 1, 180).alias("excerpt")]
    found = {
        "heading_note is not null": columns("heading", F.col("heading_note"), F.col("heading_score"), F.col("heading_decision"), F.col("s")),
        "rule = 'bibliography.pattern'": columns("bibliography", F.lit("info"), F.lit(0.5), F.lit("transform"), F.col("s")),
    }
    if done.judged is not None:  # a sequence's first line stays whether it is merged or not
        v = F.col("verse_found")
        found["verse_found.decision <> 'ignore'"] = columns("verse", F.lit("info"), v["score"], v["decision"], v["excerpt"])
    rows = F.array_compact(F.array(*(F.when(F.expr(condition), F.struct(*row)) for condition, row in found.items())))
    out = (done.blocks if done.judged is None else done.judged).select("doc_id", "pos", F.inline(rows))
    if done.verse is not None and done.judged is None:
        v = done.verse.where("decision <> 'ignore'")
        out = out.unionByName(v.select("doc_id", F.col("first_pos").alias("pos"), *columns("verse", F.lit("info"), F.col("score"), F.col("decision"), F.col("excerpt"))))
    return out
