"""Runs of neighbouring blocks: islands, chunks, carried state and context windows.

All of them are windows over (doc_id, pos).  Islands number the runs of rows that satisfy a predicate; a run also
ends where a break is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.text import word_count
from .blocks import order


def islands(df: DataFrame, member: Column, starts: Column | None = None, name: str = "run") -> DataFrame:
    """Adds `name`: the number of the member's run within its document, null for other rows."""
    w = order()
    df = df.withColumn("__in", F.coalesce(member, F.lit(False)))
    fresh = ~F.coalesce(F.lag("__in").over(w), F.lit(False))
    if starts is not None:
        df = df.withColumn("__cut", F.coalesce(starts, F.lit(False)))
        fresh = fresh | F.col("__cut")
    df = df.withColumn("__new", (F.col("__in") & fresh).cast("int"))
    return df.withColumn(name, F.when(F.col("__in"), F.sum("__new").over(w))).drop("__in", "__new", "__cut")


def in_run(name: str = "run"):
    return Window.partitionBy("doc_id", name).orderBy("pos")


def whole_run(name: str = "run"):
    return in_run(name).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def chunked(df: DataFrame, size: int, name: str = "run") -> DataFrame:
    """Splits runs into chunks of at most `size`: `name` becomes a struct of run and chunk (null outside runs)."""
    n = F.row_number().over(in_run(name)) - 1
    return df.withColumn(name, F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("run"), F.floor(n / size).alias("chunk"))))


def carried(df: DataFrame, event: Column, name: str, default: Column) -> DataFrame:
    """Adds `name`: the latest non-null event before the row, or default."""
    before = order().rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__event", event).withColumn(name, F.coalesce(F.last("__event", ignorenulls=True).over(before), default)).drop("__event")


def context(df: DataFrame, reach: int, part: int = 300, whole: int = 700) -> DataFrame:
    """Adds before and after: the texts of the `reach` neighbours on either side, cut and joined by ` / `."""
    piece = F.substring("s", 1, part)

    def joined(low: int, high: int) -> Column:
        found = F.collect_list(piece).over(order().rowsBetween(low, high))
        return F.substring(F.array_join(F.filter(found, lambda t: t != ""), " / "), 1, whole)

    return df.withColumns({"before": joined(-reach, -1), "after": joined(1, reach)})


def first_k(df: DataFrame, candidate: Column, k: int, name: str = "chosen") -> DataFrame:
    """Adds `name`: whether the row is among the first k candidates of its document."""
    df = df.withColumn("__candidate", F.coalesce(candidate, F.lit(False)))
    rank = F.sum(F.col("__candidate").cast("int")).over(order())
    return df.withColumn(name, F.col("__candidate") & (rank <= k)).drop("__candidate")


def is_blank() -> Column:
    return (F.col("block_type") == "paragraph") & (F.col("s") == "")


def boundaries(df: DataFrame) -> DataFrame:
    """Adds edge_before and edge_after: whether a blank paragraph, there or recorded on a neighbour, is next to the row."""
    w = order()
    df = df.withColumns({"__blank": is_blank(), "__flag": F.coalesce("blank_before", F.lit(False))})
    near = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns(
        {
            "edge_before": F.col("__flag") | near(F.lag("__blank").over(w)),
            "edge_after": near(F.col("blank_after")) | near(F.lead("__flag").over(w)) | near(F.lead("__blank").over(w)),
        }
    ).drop("__blank", "__flag")


def blank_neighbours(df: DataFrame) -> DataFrame:
    """How many blank rows lie between each row and its nearest row with text, before and after it."""
    w = order()
    with_text = F.when(~is_blank(), F.col("pos"))
    ahead, behind = order(desc=True).rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(w)
    df = df.withColumn("__n", n)
    text_n = F.when(~is_blank(), F.col("__n"))
    found = df.withColumns({"__prev": F.last(text_n, True).over(behind), "__next": F.last(text_n, True).over(ahead), "nearest_before": F.last(with_text, True).over(behind), "nearest_after": F.last(with_text, True).over(ahead), "__all": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))})
    return found.withColumns(
        {"blanks_before": F.col("__n") - F.coalesce("__prev", F.lit(0)) - 1, "blanks_after": F.coalesce("__next", F.col("__all") + 1) - F.col("__n") - 1}
    ).drop("__n", "__prev", "__next", "__all")


def blank_bounded(df: DataFrame) -> DataFrame:
    """Adds stanza: the run of three to twenty short lines between blank paragraphs that the row is in, or null."""
    in_notes = P.note_zone(F.col("style_name"), F.col("style_id"), F.col("xml_tag"))
    df = boundaries(df)
    df = islands(df, P.verse_line(F.col("s"), F.col("block_type"), in_notes, F.col("protected_zone")), F.col("edge_before"), "stanza")
    w = whole_run("stanza")
    ok = F.first("edge_before").over(w) & F.last("edge_after").over(w) & F.count(F.lit(1)).over(w).between(V.SEQUENCE_MIN, V.SEQUENCE_MAX)
    return df.withColumn("stanza", F.when(F.col("stanza").isNotNull() & ok, F.col("stanza")))


def scored_sequences(df: DataFrame) -> DataFrame:
    """Adds verse: the sequence of short lines that the row is in (a struct of run and chunk), or null.

    Runs break at headings, long or listed paragraphs, recorded blank paragraphs and wide gaps; they are cut after
    twenty lines; a short lead that ends with a colon is left out of four or more; fewer than three lines don't count.
    """
    w = order()
    gap = F.greatest(F.coalesce(F.lag("space_after").over(w), F.lit(0)), F.coalesce("space_before", F.lit(0)))
    member = (F.col("block_type") == "paragraph") & (F.col("s") != "") & (word_count(F.col("s")) <= V.LINE_WORDS) & ~P.list_item(F.col("s"))
    df = chunked(islands(df, member, F.coalesce("blank_before", F.lit(False)) | (gap > V.STANZA_SPACE), "verse"), V.SEQUENCE_MAX, "verse")
    run = whole_run("verse")
    n, at = F.count(F.lit(1)).over(run), F.row_number().over(in_run("verse"))
    df = df.withColumns({"__n": n, "__lead": (at == 1) & (n >= 4) & F.col("s").endswith(":") & (word_count(F.col("s")) <= 4)})
    left = F.col("__n") - F.max(F.col("__lead").cast("int")).over(run)
    kept = F.col("verse").isNotNull() & ~F.col("__lead") & (left >= V.SEQUENCE_MIN)
    return df.withColumn("verse", F.when(kept, F.col("verse"))).drop("__n", "__lead")


def clusters(df: DataFrame) -> DataFrame:
    """Adds cluster: the run of at least three short paragraphs (more than 5, at most 80 characters) that the row is in; rows after a run's twentieth are out."""
    short = (F.col("block_type") == "paragraph") & (F.length("s") > 5) & (F.length("s") <= 80)
    df = islands(df, short, None, "cluster")
    n, at = F.count(F.lit(1)).over(whole_run("cluster")), F.row_number().over(in_run("cluster"))
    return df.withColumn("cluster", F.when(F.col("cluster").isNotNull() & (n >= V.SEQUENCE_MIN) & (at <= V.SEQUENCE_MAX), F.col("cluster")))


def merged_neighbours(df: DataFrame, same: list[str], texts: str = "text", separator: str = "") -> DataFrame:
    """Joins the texts of neighbouring rows that agree in the columns `same`: doc_id, pos (of the first), *same, text."""
    w = order()
    key = F.struct(*same)
    changed = F.coalesce(~F.lag(key).over(w).eqNullSafe(key), F.lit(True)).cast("int")
    runs = df.withColumn("__new", F.when(F.lag("pos").over(w).isNull(), 1).otherwise(changed)).withColumn("__run", F.sum("__new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", texts))), lambda x: x[texts]), separator)
    return runs.groupBy("doc_id", "__run", *same).agg(F.min("pos").alias("pos"), joined.alias("text")).drop("__run")


def section_depth(df: DataFrame, deepest: int = 3) -> DataFrame:
    """Adds level (headings, clamped to 1..deepest) and depth: how many sections are open at the row, its own heading's included.

    A heading closes the open sections of its level and deeper; so a level's section is open if its last heading comes
    after the last heading of any higher level.
    """
    level = F.when(F.col("block_type") == "heading", F.least(F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)), F.lit(deepest)))
    df = df.withColumn("level", level)
    upto = order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = [F.coalesce(F.last(F.when(F.col("level") == k, F.col("pos")), True).over(upto), F.lit(-1)) for k in range(1, deepest + 1)]
    df = df.withColumns({f"__l{k}": c for k, c in enumerate(opened, 1)})
    depth, above = F.lit(0), F.lit(-1)
    for k in range(1, deepest + 1):
        depth = depth + (F.col(f"__l{k}") > above).cast("int")
        above = F.greatest(above, F.col(f"__l{k}"))
    return df.withColumn("depth", depth).drop(*(f"__l{k}" for k in range(1, deepest + 1)))
