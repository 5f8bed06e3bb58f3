"""Scores for headings and verse, thresholds by profile, and the decisions that follow from them."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.text import ends_with_any, fold, rstrip, starts_upper, word_count
from .blocks import order


@dataclass(frozen=True)
class Thresholds:
    heading_transform: float = 0.85
    heading_diagnostic: float = 0.60
    verse_transform: float = 0.82
    verse_diagnostic: float = 0.60
    auto_apply: bool = False
    enabled: bool = True


def thresholds(profile: str | None = None, *, enabled: bool = True, **wanted) -> tuple[Thresholds, list[str]]:
    """A profile's thresholds with overrides (heading_transform=... and so on), and warnings about what was corrected."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", str(profile or "conservative").strip().lower()) if not unicodedata.combining(c))
    name, warnings = V.PROFILE_ALIASES.get(plain, plain), []
    if name not in V.PROFILES:
        warnings.append(f"profile {profile!r} is unknown; conservative is used")
        name = "conservative"
    fields = ("heading_transform", "heading_diagnostic", "verse_transform", "verse_diagnostic")
    values = dict(zip(fields, V.PROFILES[name]))
    for field in fields:
        if (value := wanted.get(field)) is None:
            continue
        try:
            number = float(value)
        except (TypeError, ValueError):
            warnings.append(f"{field}: {value!r} is no number; the profile's value is used")
            continue
        if not 0 <= number <= 1:
            warnings.append(f"{field}: {value!r} is outside 0..1 and was clamped")
        values[field] = min(1.0, max(0.0, number))
    for kind, at in (("heading", 0), ("verse", 2)):
        if values[f"{kind}_diagnostic"] > values[f"{kind}_transform"]:
            warnings.append(f"{kind}: the diagnostic threshold is above the transform threshold; the profile's pair is used")
            values[f"{kind}_transform"], values[f"{kind}_diagnostic"] = V.PROFILES[name][at : at + 2]
    return Thresholds(**values, auto_apply=name == "exploratory", enabled=enabled), warnings


def _on(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _decided(vetoed: Column, score: Column, transform, diagnostic) -> Column:
    return F.when(vetoed, "ignore").when(score >= transform, "transform").when(score >= diagnostic, "diagnostic").otherwise("ignore")


def score_headings(df: DataFrame, t: Thresholds, extra_veto: Column | None = None) -> DataFrame:
    """Adds source_level, heading_like, heading_vetoes, heading_score, heading_decision and heading_ai to blocks with `s`,
    and the shared tests (__p_...), which `without_tests` drops."""
    s, bold, italic = F.col("s"), F.coalesce("all_bold", F.lit(False)), F.coalesce("all_italic", F.lit(False))
    df = df.withColumn("source_level", P.source_heading_level(F.col("heading_level"), F.col("style_id"), F.col("style_name")))
    level = F.col("source_level")
    df = df.withColumns({f"__p_{k}": c for k, c in P.shared(s, italic).items()})  # computed once, used by both tests below and by the ladder
    f = {k: F.col(f"__p_{k}") for k in P.SHARED}
    vetoes = P.heading_vetoes(s, italic, level, f)
    if extra_veto is not None:
        vetoes = F.array_sort(F.when(extra_veto, F.array_append(vetoes, F.lit("poetry_sequence_candidate"))).otherwise(vetoes))
    n = F.length(s)
    df = df.withColumns({"heading_vetoes": vetoes, "heading_like": P.heading_heuristic(s, italic, f), "__strong": P.strong_heading_signal(s, level, bold, italic, F.col("font_size"))})
    summed = (
        0.15 * F.when(n.between(8, 90), 1.0).when(n.between(4, 120), 0.35).otherwise(0.0)
        + 0.15 * _on(~ends_with_any(s, [".", "!", "?", ";", ":"]))
        + 0.10 * _on(~s.rlike(V.VERB_LEAD))
        + 0.10 * _on(P.allcaps_title(s))
        + 0.15 * _on(bold & ~italic)
        + 0.10 * _on(s.rlike(V.NUMBERED_STRONG))
        + 0.05 * _on(starts_upper(s))
        + 0.20 * _on(F.col("heading_like"))
    )
    free = F.size("heading_vetoes") == 0
    fast = bold & ~italic & n.between(8, 120) & (word_count(s) <= 14) & free
    raised = F.greatest(summed, F.when(F.col("heading_like"), 0.90).otherwise(0.0), F.when(fast, t.heading_transform).otherwise(0.0))
    score = F.when(level.isNotNull(), 1.0).otherwise(F.round(F.least(F.lit(1.0), raised), 3) if t.enabled else F.lit(0.0))
    df = df.withColumn("heading_score", score)
    decision = (
        F.when(~free, "ignore").when(level.isNotNull(), "transform").when(F.col("__strong") & (F.col("heading_score") >= t.heading_transform), "transform")
        .when(F.col("heading_score") >= t.heading_diagnostic, "diagnostic").otherwise("ignore")
    )
    ai = F.lit(t.enabled) & (F.col("heading_score") >= t.heading_diagnostic) & (F.col("heading_score") < t.heading_transform)
    return df.withColumns({"heading_decision": decision, "heading_ai": ai}).drop("__strong")


def without_tests(df: DataFrame) -> DataFrame:
    return df.drop(*(f"__p_{k}" for k in P.SHARED))


def verse_vetoes(n: Column, over: WindowSpec | None = None, of: Column | None = None) -> Column:
    """Sorted names of what speaks against a group of rows being verse: an aggregate, or a window function (over; then only rows where `of` holds are looked at)."""
    s = F.col("s")

    def agg(f, test: Column) -> Column:
        c = f(test if of is None else F.when(of, test))
        return c if over is None else c.over(over)

    in_notes = agg(F.bool_or, P.note_zone(F.col("style_name"), F.col("style_id"), F.col("xml_tag")))
    like_bibliography = agg(F.count_if, P.bibliography_like(s))
    explicit = (F.col("block_type") == "heading") | P.source_heading_level(F.col("heading_level"), F.col("style_id"), F.col("style_name")).isNotNull()
    reasons = {
        "bibliography_like": (in_notes & (like_bibliography > 0)) | (like_bibliography >= F.greatest(F.lit(2), F.floor(n / 2))),
        "caption_or_reference": agg(F.bool_or, P.caption_or_reference(s)),
        "chronology_like": agg(F.bool_or, P.chronology_line(s)),
        "heading_all_caps": agg(F.bool_and, P.allcaps_title(s)),
        "heading_explicit": agg(F.bool_or, explicit),
        "list_like": agg(F.bool_or, P.list_item(s)),
        "passage_reference": agg(F.bool_or, P.passage_reference(s)),
        "technical_markup": agg(F.bool_or, P.technical_markup(s)),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in reasons.items())))


NEAR = {"prev": F.lag, "next": F.lead}
BESIDE = ("text", "block_type", "ind_left", "blank_before")


def _beside(df: DataFrame) -> DataFrame:
    """Adds what stands next to each row, and whether there is a next one."""
    w = order()
    return df.withColumns({f"__{side}_{c}": f(c).over(w) for side, f in NEAR.items() for c in BESIDE} | {"__has_next": F.lead(F.lit(True)).over(w)})


def _verse_measures(over: WindowSpec | None = None) -> dict[str, Column]:
    """What a sequence's score is made of: aggregates of its rows, or window functions (over), which look only at rows in sequences."""
    s, inside = F.col("s"), F.col("verse").isNotNull()

    def agg(f, c: Column, *by) -> Column:
        return f(c, *by) if over is None else f(F.when(inside, c), *by).over(over)

    n = agg(F.count, F.lit(1))
    spoken = fold(F.col("__prev_text")).rlike(V.SPEECH_BEFORE) | rstrip(F.col("__prev_text")).endswith(":")
    before_hit = F.coalesce((F.col("__prev_block_type") == "paragraph") & spoken, F.lit(False)).cast("int")
    within_hit = (F.lower(s).rlike(V.SPEECH_WITHIN) | s.endswith(":")).cast("int")
    first = lambda c: agg(F.min_by, c, "pos")
    last = lambda c: agg(F.max_by, c, "pos")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kinds = lambda c: F.count_distinct(c) if over is None else F.size(agg(F.collect_set, c))  # noqa: E731  # windows can't count distinct values
    return {
        "n_lines": n, "first_pos": agg(F.min, F.col("pos")), "avg_length": agg(F.avg, F.length(s)), "sd_length": agg(F.stddev_pop, F.length(s)), "avg_words": agg(F.avg, word_count(s)),
        "upper": agg(F.avg, _on(starts_upper(s))), "ends": agg(F.avg, _on(ends_with_any(s, V.VERSE_ENDINGS))), "before_hit": first(before_hit), "within_hits": agg(F.sum, within_hit),
        "indents": kinds(zero("ind_left")), "alignments": kinds(F.nullif(F.lower("alignment"), F.lit(""))),
        "first_indent": first(zero("ind_left")), "prev_indent": first(zero("__prev_ind_left")), "next_indent": last(zero("__next_ind_left")),
        "blank": first(F.coalesce("blank_before", F.lit(False))), "has_next": last(F.coalesce("__has_next", F.lit(False))), "next_blank": last(F.coalesce("__next_blank_before", F.lit(False))),
        "in_notes": agg(F.bool_or, P.note_zone(F.col("style_name"), F.col("style_id"), F.col("xml_tag"))), "vetoes": verse_vetoes(n, over, None if over is None else inside),
        "excerpt": F.array_join(F.transform(F.slice(F.array_sort(agg(F.collect_list, F.struct("pos", "s"))), 1, 3), lambda x: x["s"]), " | "),
    }


def score_verse(df: DataFrame, t: Thresholds) -> DataFrame:
    """blocks with `s` and `verse` -> one row for each sequence: doc_id, verse, first_pos, n_lines, score, vetoes, decision, ai, excerpt."""
    grouped = _beside(df).where("verse is not null").groupBy("doc_id", "verse").agg(*(c.alias(k) for k, c in _verse_measures().items()))
    scored, columns = _verse_score(grouped, t)
    return scored.select("doc_id", "verse", *(c.alias(k) for k, c in columns.items()))


def with_verse_scores(df: DataFrame, t: Thresholds) -> DataFrame:
    """Adds verse_found, what score_verse says of the row's sequence (null outside sequences), as windows over the exchange that is there."""
    over = Window.partitionBy("doc_id", "verse").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    measures = {f"__m_{k}": c for k, c in _verse_measures(over).items()}
    df, columns = _verse_score(_beside(df).withColumns(measures), t, "__m_")
    df = df.withColumn("verse_found", F.when(F.col("verse").isNotNull(), F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.drop(*measures, "__m_score", *(f"__{side}_{c}" for side in NEAR for c in BESIDE), "__has_next")


def _verse_score(df: DataFrame, t: Thresholds, prefix: str = "") -> tuple[DataFrame, dict[str, Column]]:
    """df with score, and score_verse's columns, from the measures in columns with the prefix.  The score is a column before anything
    is decided by it: as a part of each decision it would make the optimiser's constraints many times larger."""
    m = lambda c: F.col(prefix + c)
    length, cv, nw = m("avg_length"), F.when((m("n_lines") > 1) & (m("avg_length") > 0), m("sd_length") / m("avg_length")).otherwise(0.0), m("avg_words")
    one_indent, one_alignment = m("indents") <= 1, m("alignments") <= 1
    set_in = (m("first_indent") > 0) & (m("prev_indent") == 0) & (~m("has_next") | (m("next_indent") == 0))
    alone = m("blank") & (~m("has_next") | m("next_blank"))
    summed = F.round(
        0.15 * F.least(F.lit(1.0), m("n_lines") / 4.0)
        + 0.12 * F.when(length.between(18, 90), 1.0).when(length.between(12, 120), 0.35).otherwise(0.0)
        + 0.12 * F.when(cv <= 0.35, 1.0).when(cv <= 0.60, 0.45).otherwise(0.0)
        + 0.12 * m("upper")
        + 0.12 * m("ends")
        + 0.14 * F.when(nw.between(3, 16), 1.0).when(nw.between(2, 18), 0.5).otherwise(0.0)
        + 0.10 * F.least(F.lit(1.0), (m("before_hit") + m("within_hits")) / m("n_lines"))
        + 0.08 * F.when(one_indent & one_alignment, 1.0).when(one_indent | one_alignment, 0.65).otherwise(0.0)
        + 0.05 * _on(set_in | alone),
        3,
    )
    df, score = df.withColumn(prefix + "score", summed), m("score")
    transform = F.when(m("in_notes"), F.greatest(F.lit(t.verse_transform), F.lit(0.95))).otherwise(F.lit(t.verse_transform))
    diagnostic = F.when(m("in_notes"), F.greatest(F.lit(t.verse_diagnostic), F.lit(0.80))).otherwise(F.lit(t.verse_diagnostic))
    decision = _decided(F.size(m("vetoes")) > 0, score, transform, diagnostic) if t.enabled else F.lit("ignore")
    ai = F.lit(t.enabled) & (score >= t.verse_diagnostic) & (score < t.verse_transform)
    return df, {"first_pos": m("first_pos"), "n_lines": m("n_lines"), "score": score, "vetoes": m("vetoes"), "decision": decision, "ai": ai, "excerpt": F.substring(m("excerpt"), 1, 240)}
