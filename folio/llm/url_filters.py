"""URL filters: fixed host and path rules first, mined association rules for the rest.

The fixed rules judge what they fit (the longest wins).  Those verdicts are labels: Spark's FP-growth mines which
combinations of URL tokens go with which verdict, and rules are kept by support and confidence, without those that a
shorter rule makes idle, without those whose verdict is no likelier than among all labels (lift), and without those whose labels come from fewer than MIN_SOURCES fixed rules: what one fixed rule
alone says about its own URLs is no evidence about others.  The number of rules is bounded by the settings, not by the corpus: a URL has at most
ITEMS tokens, so at most 2**ITEMS / MIN_SUPPORT token sets can be frequent.  URLs that no fixed rule fits look up
their tokens in an inverted index of the mined rules (each rule under its rarest token) and take the verdict of the
most confident rule that fits; without one they are allowed.

Defined results: a null url or one without :// has empty host and path and no tokens, so it is allowed; repeated
rows each get a row; without labelled rows no rules are mined; an empty table gives an empty result.  Columns other
than page_id and url are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Fixed rules: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
MIN_SOURCES = 2  # fixed rules whose URLs a mined rule must fit, with its verdict
ITEMS = 9  # kinds of tokens below, the verdict included


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ://."""
    whole = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fixed rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # longer ones are asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """What a URL says, at most one token of each kind: scheme, suffix, domain, first label, first and last part of the path, extension, query."""
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^=&#]*)", 1)
    last = F.when(F.size(parts) > 1, F.regexp_replace(F.get(parts, F.size(parts) - 1), "[0-9]+", "0"))
    kinds = {
        "scheme": F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1),
        "suffix": F.get(labels, F.size(labels) - 1),
        "domain": F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")),
        "label": F.when(F.size(labels) > 2, F.get(labels, F.lit(0))),
        "first": F.get(parts, F.lit(0)),
        "last": last,
        "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1),
        "query": query,
    }
    listed = F.array(*(F.when(v != "", F.concat(F.lit(k + "="), v)) for k, v in kinds.items()))
    return F.when(host != "", F.array_compact(listed)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[dict]:
    """labelled(tokens, verdict, rule) -> rules {tokens, verdict, confidence, support}, the most confident first."""
    from pyspark.ml.fpm import FPGrowth

    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    if not items.head(1):
        return []
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.get("consequent", F.lit(0)).startswith("verdict=")).where(F.col("lift") > 1 + 1e-9)
    found = found.select("antecedent", "consequent", "confidence", "support").collect()
    rules = [{"tokens": frozenset(r["antecedent"]), "verdict": r["consequent"][0].removeprefix("verdict="), "confidence": round(r["confidence"], 9), "support": round(r["support"], 9)} for r in found]
    rules = several_sources(labelled, rules)
    rules.sort(key=lambda r: (-r["confidence"], -r["support"], len(r["tokens"]), sorted(r["tokens"])))
    shorter: dict[frozenset, tuple[float, str]] = {r["tokens"]: (r["confidence"], r["verdict"]) for r in rules}
    return [r for r in rules if not any(shorter.get(r["tokens"] - {t}, (0.0, ""))[0] >= r["confidence"] for t in r["tokens"])]


def several_sources(labelled: DataFrame, rules: list[dict]) -> list[dict]:
    """The rules whose verdict at least MIN_SOURCES different fixed rules gave to URLs that have all its tokens."""
    index = inverted_index(rules)

    def run(batches):
        for batch in batches:
            seen = set()
            for own, verdict, source in zip(*(c.to_pylist() for c in batch.columns)):
                own = set(own)
                seen |= {(k, source) for t in own for k, needed, says in index.get(t, ()) if says == verdict and needed <= own}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([x for _, x in seen], pa.string())], names=["k", "source"])

    found = labelled.select("tokens", "verdict", "rule").mapInArrow(run, "k int, source string").groupBy("k").agg(F.count_distinct("source").alias("n"))
    many = {r["k"] for r in found.where(F.col("n") >= MIN_SOURCES).collect()}  # at most one row a mined rule
    return [r for k, r in enumerate(rules) if k in many]


def inverted_index(rules: list[dict]) -> dict[str, list[tuple[int, frozenset, str]]]:
    """Each rule under the one of its tokens that the fewest rules have: (rank, tokens, verdict)."""
    common_ = Counter(t for r in rules for t in r["tokens"])
    index: dict[str, list] = {}
    for rank, r in enumerate(rules):
        index.setdefault(min(r["tokens"], key=lambda t: (common_[t], t)), []).append((rank, r["tokens"], r["verdict"]))
    return index


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("hit", fixed(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "hit.rule", "hit.verdict", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    rows = common.durable(rows, "urls")
    index = inverted_index(mine(rows.where("verdict is not null")))
    schema = T.StructType([T.StructField("page_id", rows.schema["page_id"].dataType), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def mined(found: list[str]) -> str:
        own = set(found)
        fitting = [(rank, verdict) for t in own for rank, needed, verdict in index.get(t, ()) if needed <= own]
        return min(fitting)[1] if fitting else default

    def run(batches):
        for batch in batches:
            verdicts = [v or mined(t) for v, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES = {"op8_url_filters": op8_url_filters}
ORACLE_SQL: dict[str, str] = {}
