"""Canonical semantics, invariants, the export gate and output styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import strip
from .blocks import complete, order, stripped

FIELDS = ("role", "layout_kind", "quote_kind", "lineation", "lines", "genre_hint", "genre_confidence", "genre_source")


def _text(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def read_semantics(semantic: Column) -> Column:
    """The struct with blank strings as nulls and lines trimmed, blank ones left out."""
    lines = F.filter(F.transform(F.coalesce(semantic["lines"], F.expr("cast(array() as array<string>)")), strip), lambda x: x != "")
    special = {"lines": lines, "genre_confidence": semantic["genre_confidence"]}
    return F.struct(*((special[f] if f in special else _text(semantic[f])).alias(f) for f in FIELDS))


def verse_lines(semantic: Column, text: Column) -> Column:
    """The recorded lines, else the text's non-blank lines, else the text."""
    split = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.when(F.size(semantic["lines"]) > 0, semantic["lines"]).when(F.size(split) > 0, split).otherwise(F.filter(F.array(strip(text)), lambda x: x != ""))


def is_lineated(kind: Column, sem: Column) -> Column:
    payload = (sem["layout_kind"] == "lineated_block") & (sem["lineation"] == "lineated") & (F.size(sem["lines"]) > 0)
    pair = ((kind == "lineated_block") & (sem["role"] == "lineated_block")) | ((kind == "quote_block") & (sem["role"] == "quote"))
    return F.coalesce(payload & pair, F.lit(False))


def canonicalise(blocks: DataFrame) -> DataFrame:
    """Adds canonical (what semantic should be, by block type) and changed."""
    df = complete(blocks).withColumn("__sem", read_semantics(F.col("semantic")))
    sem, kind = F.col("__sem"), F.col("block_type")
    plain, lineated, quote = kind.isin("heading", "paragraph", "table"), kind == "lineated_block", kind == "quote_block"
    none = F.lit(None).cast("string")
    role = F.when(plain | lineated, kind).when(quote, "quote").otherwise(sem["role"])
    canonical = F.struct(
        role.alias("role"), F.when(lineated, "lineated_block").alias("layout_kind"), F.when(quote, "prose").otherwise(none).alias("quote_kind"), F.when(lineated, "lineated").when(quote, "prose").alias("lineation"),
        F.when(lineated, verse_lines(sem, F.col("text"))).otherwise(F.expr("cast(array() as array<string>)")).alias("lines"),
        *(F.when(lineated, sem[f]).alias(f) for f in ("genre_hint", "genre_confidence", "genre_source")),
    )
    return df.withColumn("canonical", canonical).withColumn("changed", ~F.col("canonical").eqNullSafe(sem)).drop("__sem")


def validate(blocks: DataFrame, column: str = "semantic") -> DataFrame:
    """One row for each broken invariant: doc_id, pos, target, rule, severity, excerpt."""
    df = complete(blocks).withColumn("__sem", read_semantics(F.col(column)))
    sem, kind, raw = F.col("__sem"), F.col("block_type"), F.col(column)
    role, lineation, lines = sem["role"], sem["lineation"], F.size(sem["lines"]) > 0
    verse = F.coalesce(role == "lineated_block", F.lit(False))
    lineated = F.coalesce(lineation == "lineated", F.lit(False))
    poetry = is_lineated(kind, sem) & (F.coalesce(sem["genre_hint"] == "poetry", F.lit(False)) | F.coalesce((role == "quote") & (sem["quote_kind"] == "poetry"), F.lit(False)))
    dated = F.size(F.filter(sem["lines"], lambda x: x.rlike(V.CHRONOLOGY_LINE)))
    checks = [
        ("heading_level", "error", (kind == "heading") & ~F.coalesce(F.col("heading_level").between(1, 6), F.lit(False))),
        ("quote_fields_outside_quote", "error", sem["quote_kind"].isNotNull() & ~F.coalesce(role == "quote", F.lit(False))),
        ("lineated_role_type", "error", verse & (kind != "lineated_block")),
        ("lineation_without_lines", "error", lineated & ~lines),
        ("lineated_without_lineation", "error", verse & ~lineated),
        ("lineated_without_lines", "error", verse & ~lines),
        ("lines_without_lineation", "error", lines & ~lineated),
        ("lineation_on_other_type", "error", lineated & ~kind.isin("lineated_block", "quote_block")),
        ("dated_lines", "warning", poetry & (F.size(sem["lines"]) >= 2) & (dated >= F.greatest(F.lit(2), F.size(sem["lines"]) - 1))),
        ("legacy_verse", "warning", F.coalesce((strip(raw["quote_kind"]) == "poetry") & (strip(raw["lineation"]) == "verse"), F.lit(False))),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, c in checks)))
    return df.select("doc_id", "pos", F.col("block_id").alias("target"), F.substring("text", 1, 220).alias("excerpt"), F.inline(found))


def gate(blocks: DataFrame, problems: DataFrame) -> DataFrame:
    """doc_id, blocked, n_errors, n_warnings for every document that has blocks: errors keep a document from export."""
    counts = problems.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    docs = blocks.select("doc_id").distinct().join(counts, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return docs.select("doc_id", (F.coalesce("n_errors", F.lit(0)) > 0).alias("blocked"), zero("n_errors"), zero("n_warnings"))


def output_styles(blocks: DataFrame) -> DataFrame:
    """Adds style: the output paragraph style of every block."""
    df = stripped(complete(blocks)).withColumn("__sem", read_semantics(F.col("semantic")))
    levels = F.create_map(*(F.lit(x) for pair in V.STYLE_LEVELS.items() for x in pair))
    styles = F.create_map(*(F.lit(x) for pair in V.STYLES.items() for x in pair))
    style_id, style_name = F.coalesce("style_id", F.lit("")), F.coalesce("style_name", F.lit(""))
    digit = F.regexp_extract(F.when(style_id != "", style_id).otherwise(style_name), r"(\d)", 1).try_cast("int")
    level = F.coalesce(F.when(F.col("heading_level").between(1, 6), F.col("heading_level")), F.try_element_at(levels, style_id), F.try_element_at(levels, style_name), F.when(digit.between(1, 6), digit), F.lit(1))
    before, s, kind = F.lag("block_type").over(order()), F.col("s"), F.col("block_type")
    name = (
        F.when(kind == "heading", F.concat(F.lit("heading_"), level.cast("string")))
        .when((kind == "lineated_block") | ((kind == "quote_block") & is_lineated(kind, F.col("__sem"))), "verse")
        .when((kind == "paragraph") & s.rlike(V.ABSTRACT), "abstract").when((kind == "paragraph") & s.rlike(V.KEYWORDS), "keywords").when((kind == "paragraph") & s.rlike(V.ACKNOWLEDGMENT), "acknowledgment")
        .when((kind == "paragraph") & before.isin("quote_block", "lineated_block"), "paragraph_lead").otherwise(kind)
    )
    missing = F.when(kind == "heading", "Heading 1").otherwise("Normal")
    return df.withColumn("style", F.coalesce(F.try_element_at(styles, name), missing)).drop("__sem", "s")
