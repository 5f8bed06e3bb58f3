"""Notes and their calls: numbering, resolution and placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions import spans, typography
from ..functions.text import strip
from . import sequences
from .blocks import complete, order

SPACE_KINDS = {" ": "space", "\u00a0": "nbsp", "\u202f": "nnbsp"}
FINAL = [".", ",", ";", ":", "?", "!", "»", '"', "”", "›"]


def calls(spans: DataFrame) -> DataFrame:
    """spans(doc_id, pos, i, text, kind, note_ref) -> the note calls, each with the character before it (null at a start)."""
    before = Window.partitionBy("doc_id", "pos").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ending = F.last(F.when(F.length("text") > 0, F.substring("text", -1, 1)), ignorenulls=True).over(before)
    return spans.withColumn("char_before", ending).where("kind = 'note_call'")


def call_problems(spans: DataFrame) -> DataFrame:
    """Note calls after a space, final punctuation or a closing quotation mark: doc_id, pos, i, note_ref, rule, space_kind."""
    kinds = F.create_map(*(F.lit(x) for pair in SPACE_KINDS.items() for x in pair))
    c = F.col("char_before")
    found = F.array_compact(F.array(F.when(c.isin(list(SPACE_KINDS)), "call_spacing"), F.when(c.isin(FINAL), "call_placement")))
    return calls(spans).select("doc_id", "pos", "i", "note_ref", F.explode(found).alias("rule"), F.try_element_at(kinds, c).alias("space_kind"))


def call_findings(spans: Column) -> Column:
    """What call_problems finds, from a block's array of spans: array<struct<i, note_ref, rule, space_kind, excerpt>>.

    The call's own text counts as what stands before a later call; an excerpt is the call with the spans next to it.
    """
    kinds = F.create_map(*(F.lit(x) for pair in SPACE_KINDS.items() for x in pair))
    start = F.struct(F.lit("").alias("last"), F.expr("cast(array() as array<struct<i:int,c:string>>)").alias("calls"))

    def step(state: Column, x: Column) -> Column:
        text = F.coalesce(x["text"], F.lit(""))
        calls = F.when(x["kind"] == "note_call", F.array_append(state["calls"], F.struct(x["i"].alias("i"), state["last"].alias("c")))).otherwise(state["calls"])
        return F.struct(F.when(text != "", F.right(text, F.lit(1))).otherwise(state["last"]).alias("last"), calls.alias("calls"))

    numbered_spans = F.transform(spans, lambda x, i: F.struct(x["text"].alias("text"), x["kind"].alias("kind"), i.alias("i")))
    calls = F.aggregate(numbered_spans, start, step, lambda state: state["calls"])

    def found(c: Column) -> Column:
        near = F.slice(spans, F.greatest(c["i"], F.lit(1)), F.when(c["i"] > 0, 3).otherwise(2))
        excerpt = F.array_join(F.transform(near, lambda x: F.coalesce(x["text"], F.lit(""))), "")
        row = lambda rule: F.struct(c["i"].cast("long").alias("i"), F.get(spans, c["i"])["note_ref"].alias("note_ref"), F.lit(rule).alias("rule"), F.try_element_at(kinds, c["c"]).alias("space_kind"), excerpt.alias("excerpt"))
        return F.array_compact(F.array(F.when(c["c"].isin(list(SPACE_KINDS)), row("call_spacing")), F.when(c["c"].isin(FINAL), row("call_placement"))))

    return F.when(F.exists(spans, lambda x: x["kind"] == "note_call"), F.flatten(F.transform(calls, found)))


def call_diagnostics(blocks: DataFrame) -> DataFrame:
    """Diagnostics of the note calls in the spans of blocks; nothing is exploded but what is found."""
    found = complete(blocks).select("doc_id", "pos", F.col("block_id").alias("target"), F.inline(call_findings(F.col("spans"))))
    named = lambda values: F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("rule"))
    return found.select("doc_id", "pos", F.lit("footnotes").alias("module"), named(V.CALL_CATEGORIES).alias("category"), F.lit("warning").alias("severity"), named(V.CALL_RULES).alias("rule"), "target", "excerpt", "note_ref", "space_kind")


def quote_diagnostics(blocks: DataFrame) -> DataFrame:
    """Diagnostics of quotations closed before a full stop, outside quotations set apart and technical text."""
    df = complete(blocks)
    wanted = (F.col("block_type") != "quote_block") & ~F.col("text").rlike(V.MARKUP_TAG) & ~F.col("text").rlike(V.MARKUP_ATTRIBUTE)
    found = df.select("doc_id", "pos", F.col("block_id").alias("target"), F.explode(F.when(wanted, typography.quote_point_suspects(F.col("text")))).alias("excerpt"))
    return found.select("doc_id", "pos", F.lit("typography").alias("module"), F.lit(V.QUOTE_CATEGORY).alias("category"), F.lit("warning").alias("severity"), F.lit(V.QUOTE_RULE).alias("rule"), "target", "excerpt")


def resolve_calls(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """Notes with target_pos (the first block that calls them), call_count and all calling blocks in order."""
    calling = spans.where("kind = 'note_call'").groupBy("doc_id", F.col("note_ref").alias("note_id")).agg(F.min("pos").alias("target_pos"), F.count(F.lit(1)).alias("call_count"), F.array_sort(F.collect_set("pos")).alias("call_positions"))
    return notes.join(calling, ["doc_id", "note_id"], "left").withColumn("call_count", F.coalesce("call_count", F.lit(0).cast("long")))


def numbered(notes: DataFrame, by: str = "target_pos") -> DataFrame:
    """Adds number: 1..n within each document, in the order of by (unplaced notes last)."""
    return notes.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col(by).asc_nulls_last(), "note_id")))


def normalise(notes: DataFrame) -> DataFrame:
    """Notes with rewritten text and changed."""
    new = typography.note_text(F.col("text"))
    return notes.withColumn("before", F.col("text")).withColumn("text", new).withColumn("changed", ~F.col("text").eqNullSafe(F.col("before")))


def has_spans(df: DataFrame) -> bool:
    return "spans" in df.columns and isinstance(df.schema["spans"].dataType, T.ArrayType)


def with_text(df: DataFrame, new: Column) -> DataFrame:
    """df with another text; its spans, where it has some, go with it."""
    if not has_spans(df):
        return df.withColumn("text", new)
    moved = df.withColumn("__new", new)
    carried = spans.as_given(spans.carried_spans(F.col("spans"), F.col("__new")), F.col("spans"), df.schema["spans"].dataType)
    return moved.withColumn("spans", F.when((F.size("spans") > 0) & ~F.col("__new").eqNullSafe(F.col("text")), carried).otherwise(F.col("spans"))).withColumn("text", F.col("__new")).drop("__new")


def edited(notes: DataFrame) -> DataFrame:
    """notes(doc_id, note_id, text, and label and spans where there are some) as they are exported: typography, then the rules of notes;
    adds given and typed, the text before either, so that both changes can be told."""
    df = notes.withColumn("text", F.coalesce("text", F.lit("")))
    if has_spans(df):  # the text of a note with spans is that of its spans
        df = df.withColumn("text", F.when(F.size("spans") > 0, F.array_join(F.transform("spans", lambda x: F.coalesce(x["text"], F.lit(""))), "")).otherwise(F.col("text")))
    df = df.withColumn("given", F.col("text")).withColumn("typed", typography.rewrite(F.col("text")))
    df = with_text(df, typography.note_text(F.col("typed")))
    if has_spans(df):
        kind = df.schema["spans"].dataType
        df = df.withColumn("spans", F.when(F.size("spans") > 0, spans.as_given(spans.century_spans(spans.plain(F.col("spans"))), F.col("spans"), kind)).otherwise(F.col("spans")))
    return df


def note_changes(notes: DataFrame) -> DataFrame:
    """Transformations of edited notes: one row for typography and one for the rules of notes, where they changed the text."""
    change = lambda module, before, after, rule: F.struct(F.lit(module).alias("module"), F.col(before).alias("before"), F.col(after).alias("after"), F.lit(rule).alias("rule"))
    both = F.filter(F.array(change("typography", "given", "typed", "typography.batch"), change("footnotes", "typed", "text", V.NOTE_RULE)), lambda x: x["before"] != x["after"])
    return notes.select("doc_id", F.lit(None).cast("long").alias("pos"), F.col("note_id").alias("target"), F.inline(both))


def bibliography_sections(blocks: DataFrame) -> DataFrame:
    """Paragraphs under the heading of a bibliography become bibliography_item, up to the next heading in a style that closes a section."""
    s, heading = strip(F.col("text")), F.col("block_type") == "heading"
    event = F.when(heading & s.rlike(V.BIBLIOGRAPHY_TITLE_NORMALISER), F.lit(True)).when(heading & F.col("style_id").isin(V.CLOSING_STYLES), F.lit(False))
    df = sequences.carried(complete(blocks), event, "__in_section", F.lit(False))
    entry = F.col("__in_section") & (F.col("block_type") == "paragraph") & (s != "")
    return df.withColumn("block_type", F.when(entry, "bibliography_item").otherwise(F.col("block_type"))).drop("__in_section")


def bibliography(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, item_id (bib1, bib2, ... in order), raw_text for every entry among blocks."""
    entries = blocks.where((F.col("block_type") == "bibliography_item") & (strip(F.col("text")) != ""))
    return entries.select("doc_id", "pos", F.concat(F.lit("bib"), F.row_number().over(order()).cast("string")).alias("item_id"), strip(F.col("text")).alias("raw_text"))


def normalise_bibliography(blocks: DataFrame) -> DataFrame:
    """Blocks of type bibliography_item with their entry rewritten; other blocks as they are."""
    entry = F.col("block_type") == "bibliography_item"
    return with_text(blocks, F.when(entry & (strip(F.col("text")) != ""), typography.bibliography_text(F.col("text"))).otherwise(F.col("text")))
