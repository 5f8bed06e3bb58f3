"""Arbitration of uncertain cases by a classifier that the caller brings.

A provider is a function from a DataFrame with `prompt` to the same with `reply` (a JSON string); `stub` is a
deterministic one.  Candidates are chosen within a budget of calls for each document before the provider runs, and
replies are parsed strictly, with named errors instead of exceptions.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import fixed_values as V
from ..functions.text import word_count
from . import sequences
from .blocks import complete, stripped
from .notes import with_text
from .structure import merge_runs

CLASSES = ["heading", "poetry_quote", "paragraph", "reference", "list_item", "caption", "bibliography", "isolated_reference", "uncertain"]
ACTIONS = ["transform", "diagnostic", "ignore"]
REPLY = "classification string, confidence string, reason string, recommended_action string"

Provider = Callable[[DataFrame], DataFrame]


def budget(level: str | None, calls: int = 6) -> tuple[float, int]:
    """Confidence that an action needs, and calls for each document."""
    factor, needed = V.CALL_FACTORS.get(str(level or "").strip().lower(), V.CALL_FACTORS["conservative"])
    return needed, max(1, int(max(1, calls) * factor))


def parse_reply(raw: Column) -> Column:
    """struct(classification, confidence, reason, recommended_action, error): error is null for a valid reply."""
    text = F.trim(F.regexp_replace(F.trim(raw), r"(?s)^```(?:json)?\s*|\s*```$", ""))
    body = F.when(text.rlike(r"(?s)^\{.*\}$"), text).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    value = F.from_json(body, REPLY, {"mode": "PERMISSIVE"})
    numeric = F.regexp_extract(body, r'"confidence"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*[,}]', 1).try_cast("double")
    cls, action = F.trim(F.coalesce(value["classification"], F.lit(""))), F.trim(F.coalesce(value["recommended_action"], F.lit("")))
    broken = F.coalesce(F.get_json_object(body, "$").isNull(), F.lit(True))
    error = (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "empty_response").when((body == "") & text.rlike(r"(?s)^(\[.*\]|\".*\"|[-0-9.]+|true|false|null)$"), "non_object_json").when(broken, "invalid_json")
        .when(~cls.isin(CLASSES), "unknown_classification").when(~action.isin(ACTIONS), "unknown_recommended_action").when(numeric.isNull(), "invalid_confidence_type")
        .when(~numeric.between(0, 1), "confidence_out_of_range")
    )
    ok = lambda c: F.when(error.isNull(), c)
    return F.struct(ok(cls).alias("classification"), ok(numeric).alias("confidence"), ok(F.trim(F.coalesce(value["reason"], F.lit("")))).alias("reason"), ok(action).alias("recommended_action"), error.alias("error"))


def stub(prompts: DataFrame) -> DataFrame:
    """A deterministic stand-in: short excerpts are headings, lines are verse, anything else stays undecided."""
    verse, short = F.col("excerpt").contains("\n"), F.length("excerpt") <= 60
    kind = F.when(verse, "poetry_quote").when(short, "heading").otherwise("uncertain")
    confidence = F.when(verse, 0.95).when(short, 0.88).otherwise(0.4)
    action = F.when(verse, "transform").when(short, "diagnostic").otherwise("ignore")
    reply = F.to_json(F.struct(kind.alias("classification"), confidence.alias("confidence"), F.lit("stub").alias("reason"), action.alias("recommended_action")))
    return prompts.withColumn("reply", reply)


def prompt(kind: Column, excerpt: Column, before: Column, after: Column) -> Column:
    return F.format_string("Candidate: %s\nBefore: %s\nText: %s\nAfter: %s\nAnswer with one JSON object: classification, confidence, reason, recommended_action.", kind, before, excerpt, after)


def cluster_prompt(excerpt: Column, n: Column) -> Column:
    """Asks what several short paragraphs in a row are together; their first lines are shown."""
    return F.format_string("Candidate: %d short paragraphs in a row, verse or a list\nLines:\n%s\nAnswer for all of them with one JSON object: classification, confidence, reason, recommended_action.", n, F.coalesce(excerpt, F.lit("")))


def editorial_prompt(text: Column, before: Column, after: Column) -> Column:
    """Asks for corrections of a paragraph as `suggestions` reads them."""
    given = [F.coalesce(c, F.lit("")) for c in (before, text, after)]
    return F.format_string("Correct spelling, grammar and typography, nothing else; keep the wording.\nBefore: %s\nText: %s\nAfter: %s\nAnswer with one JSON object: corrections, an array of objects with original (occurring once in the text), corrected, raison.", *given)


def candidates(diagnostics: DataFrame) -> DataFrame:
    """What a classifier may be asked about: undecided headings and verse, and every entry found by pattern; other modules' findings never."""
    undecided = F.col("category").isin("heading", "verse") & (F.col("decision") == "diagnostic")
    return diagnostics.where(undecided | (F.col("category") == "bibliography"))


def arbitrate(diagnostics: DataFrame, blocks: DataFrame, provider: Provider = stub, level: str | None = None, calls: int = 6) -> DataFrame:
    """Asks about each document's first candidates (diagnostics with a decision of `diagnostic`) and gives parsed replies; the texts stay as they are."""
    _, limit = budget(level, calls)
    chosen = sequences.first_k(candidates(diagnostics), F.lit(True), limit).where("chosen")
    # a document's few candidates come to its blocks, for blocks with their contexts are many times the text
    by_doc = chosen.groupBy("doc_id").agg(F.collect_list(F.struct(*chosen.columns)).alias("__asked"))
    near = sequences.context(blocks.select("doc_id", "pos", "s").join(by_doc, "doc_id"), 3)
    here = F.filter("__asked", lambda x: x["pos"] == F.col("pos"))
    chosen = near.select("before", "after", F.inline(here)).select(*chosen.columns, "before", "after")
    asked = provider(chosen.withColumn("prompt", prompt(F.col("category"), F.col("excerpt"), F.col("before"), F.col("after"))))
    return asked.withColumn("parsed", parse_reply(F.col("reply"))).select("doc_id", "pos", "category", "parsed.*")


def cluster_table(blocks: DataFrame) -> DataFrame:
    """One row for each cluster of short paragraphs: doc_id, cluster, pos, n, excerpt (its first eight lines), positions."""
    rows = sequences.clusters(blocks).where("cluster is not null")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "s")))
    return rows.groupBy("doc_id", "cluster").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.slice(ordered, 1, 8), lambda x: x["s"]), "\n").alias("excerpt"), F.transform(ordered, lambda x: x["pos"]).alias("positions")
    )


def refusals(clusters: DataFrame, needed: float) -> DataFrame:
    """Adds reason: why a classified cluster isn't applied (null: it is); clusters of other classes are left out."""
    kind = F.col("classification")
    reason = (
        F.when(kind == "list_item", "list_not_supported").when(F.col("recommended_action") != "transform", "action_not_transform").when(F.col("confidence") < needed, "confidence_below_threshold")
        .when(F.size("positions") == 0, "missing_targets").when(F.col("n_found") < F.size("positions"), "missing_block").when(F.col("n_paragraphs") < F.size("positions"), "block_type_not_supported")
        .when(F.col("n_protected") > 0, "protected_zone_veto")
    )
    return clusters.where(kind.isin("poetry_quote", "list_item")).withColumn("reason", reason)


def apply_clusters(blocks: DataFrame, provider: Provider = stub, level: str | None = None, calls: int = 6) -> tuple[DataFrame, DataFrame]:
    """Blocks with accepted clusters merged into stanzas, and the clusters with reasons."""
    needed, limit = budget(level, calls)
    table = cluster_table(blocks)
    table = sequences.first_k(table, F.lit(True), limit).where("chosen").drop("chosen")
    asked = provider(table.withColumn("prompt", cluster_prompt(F.col("excerpt"), F.col("n"))))
    parsed = asked.withColumn("parsed", parse_reply(F.col("reply"))).select("doc_id", "cluster", "positions", "parsed.classification", "parsed.confidence", "parsed.recommended_action")
    zone = F.lower(F.coalesce("protected_zone", F.lit("")))
    state = blocks.select(F.col("doc_id").alias("__doc"), F.col("pos").alias("__pos"), (F.col("block_type") == "paragraph").alias("__paragraph"), (~zone.isin("", "poetry")).alias("__protected"))
    targets = parsed.select("doc_id", "cluster", F.explode("positions").alias("p")).join(state, (F.col("doc_id") == F.col("__doc")) & (F.col("p") == F.col("__pos")), "left")
    counts = targets.groupBy("doc_id", "cluster").agg(F.count("__pos").alias("n_found"), F.count_if("__paragraph").alias("n_paragraphs"), F.count_if("__protected").alias("n_protected"))
    judged = refusals(parsed.join(counts, ["doc_id", "cluster"]), needed)
    accepted = judged.where("reason is null").select(F.col("doc_id").alias("__doc"), F.col("cluster").alias("__cluster"))
    marked = sequences.clusters(blocks).join(accepted, (F.col("doc_id") == F.col("__doc")) & (F.col("cluster") == F.col("__cluster")), "left")
    merged = merge_runs(marked, "cluster", "stanza.arbitrated", F.col("__cluster").isNotNull())
    poetry = F.col("semantic").withField("genre_hint", F.lit("poetry")).withField("genre_source", F.lit("ai"))
    return merged.withColumn("semantic", F.when(F.col("rule") == "stanza.arbitrated", poetry).otherwise(F.col("semantic"))).drop("__doc", "__cluster", "cluster"), judged


def editorial_prompts(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, text, before, after and the prompt that asks about it, of every paragraph long enough to be looked at."""
    near = sequences.context(stripped(complete(blocks)), 3)
    return near.where((F.col("block_type") == "paragraph") & (F.length("s") >= V.EDITORIAL_LENGTH)).select("doc_id", "pos", "text", "before", "after", editorial_prompt(F.col("text"), F.col("before"), F.col("after")).alias("prompt"))


def ask_editor(prompts: DataFrame, call: Callable[[str, str, str], str], calls: int = V.EDITORIAL_CALLS) -> DataFrame:
    """doc_id, pos, reply of each document's first `calls` prompts for which call(text, before, after) succeeds.

    A call that raises doesn't count, and what comes after the last one that counts is never asked: each document is
    walked in order in one pass over its sorted partition, whatever its length, with a count as the only state.
    """
    schema = T.StructType([prompts.schema["doc_id"], prompts.schema["pos"], T.StructField("reply", T.StringType())])

    def run(batches):
        doc_id, used = None, 0
        for batch in batches:
            replies = []
            for row in batch.to_pylist():
                doc_id, used = (row["doc_id"], 0) if row["doc_id"] != doc_id else (doc_id, used)
                if used >= calls:
                    continue
                try:
                    reply = call(row["text"], row["before"], row["after"])
                except Exception:  # noqa: BLE001  # whatever the caller's function raises is a failed call
                    continue
                used += 1
                replies.append({"doc_id": doc_id, "pos": row["pos"], "reply": reply})
            yield pa.RecordBatch.from_pylist(replies, schema=to_arrow_schema(schema))

    return prompts.where("doc_id is not null").repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(run, schema)


def suggestions(replies: DataFrame) -> DataFrame:
    """doc_id, pos, original, replacement, reason of the corrections in replies, in order; those that change nothing are left out."""
    wanted = F.from_json("reply", "corrections array<struct<original:string,corrected:string,raison:string>>")["corrections"]
    rows = replies.select("doc_id", "pos", F.posexplode(wanted).alias("k", "c"))
    rows = rows.select("doc_id", "pos", "k", F.col("c.original").alias("original"), F.col("c.corrected").alias("replacement"), F.col("c.raison").alias("reason"))
    return rows.where("original <> '' and replacement <> '' and original <> replacement")


CORRECTED = "cast(array() as array<struct<original:string,replacement:string,reason:string,before:string,after:string>>)"


def corrections(blocks: DataFrame, suggested: DataFrame, max_words: int = 15) -> DataFrame:
    """Blocks with suggested(doc_id, pos, original, replacement, and k and reason where known) applied one after another, by k (else by
    original): each where original occurs exactly once in the text as those before left it, and both are short.

    Adds applied (whether any was) and corrected, the applied ones with the texts before and after each.  Spans go with the text.
    """
    given = {c: (F.col(c) if c in suggested.columns else F.lit(None)).cast(t).alias(c) for c, t in (("k", "long"), ("original", "string"), ("replacement", "string"), ("reason", "string"))}
    wanted = suggested.select("doc_id", "pos", *given.values()).where("original <> '' and replacement <> '' and original <> replacement")
    wanted = wanted.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct(*given))).alias("__wanted"))
    df = blocks.join(wanted, ["doc_id", "pos"], "left")
    start = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.expr(CORRECTED).alias("done"))

    def step(state: Column, c: Column) -> Column:
        text, old, new = state["text"], c["original"], c["replacement"]
        times = (F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)
        ok = (times == 1) & (word_count(old) <= max_words) & (word_count(new) <= max_words)
        after = F.replace(text, old, new)
        entry = F.struct(old.alias("original"), new.alias("replacement"), c["reason"].alias("reason"), text.alias("before"), after.alias("after"))
        return F.struct(F.when(ok, after).otherwise(text).alias("text"), F.when(ok, F.array_append(state["done"], entry)).otherwise(state["done"]).alias("done"))

    df = df.withColumn("__folded", F.when(F.size("__wanted") > 0, F.aggregate("__wanted", start, step)))
    df = df.withColumns({"corrected": F.coalesce(F.col("__folded.done"), F.expr(CORRECTED)), "__text": F.coalesce("__folded.text", "text")})
    return with_text(df, F.col("__text")).withColumn("applied", F.size("corrected") > 0).drop("__wanted", "__folded", "__text")


def correction_changes(corrected: DataFrame) -> DataFrame:
    """Transformations of blocks after corrections: one row for each that was applied, in order."""
    rows = corrected.select("doc_id", "pos", F.col("block_id").alias("target"), F.posexplode("corrected").alias("k", "c"))
    return rows.select("doc_id", "pos", "target", F.lit("editorial").alias("module"), "c.before", "c.after", F.lit(V.CORRECTION_RULE).alias("rule"), "k", "c.reason")
