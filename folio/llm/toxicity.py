"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, and a linear classifier.

Voters are mined from a bounded sample of labelled rows: words and word beginnings that go with the label (lexicon
voters), and patterns, which are beginnings that several different words of one text share and the forms in PATTERNS
(spelling out, masking, stretching, shouting, repeated signs, repeated words).  A voter votes or abstains.  The label
model has a hidden class for each document; each voter's rate in either class, and the correlations of voters within a
class, are estimated by expectation maximisation, the given label being one more (noisy) voter.  A voter's evidence is
divided by how much of it others of its class repeat.  The posterior of the hidden class, not the given label, trains a
logistic regression over the voters' counts, and that linear classifier scores every document.

Defined results: null and empty texts have no votes and get the classifier's intercept; repeated rows, and rows with a
null doc_id, each get a row; without labelled rows every score is 0; an empty table gives an empty result.  Columns
other than doc_id and text, and other columns of the labels, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE = 9000  # labelled rows that the model may be fitted on
PREFIXES = (4, 5, 6, 7)  # lengths of word beginnings
VOTERS, PER_STEM = 240, 6
LEAST_SUPPORT = 4
LEVELS = 3  # a beginning that 1, 2, 3 or more different words share; a form that occurs so often
TOXIC = 0.3
MEMO = 200_000

WORD = re.compile(r"[^\W\d_]+")
PATTERNS = {
    "~spelled": re.compile(r"(?<!\w)(?:[^\W\d_][ .*-]){3,}[^\W\d_](?!\w)"),
    "~masked": re.compile(r"[^\W\d_][*#@$%]+[^\W\d_]"),
    "~stretched": re.compile(r"([^\W\d_])\1{3,}"),
    "~shouted": re.compile(r"(?<!\w)[A-Z]{2,}(?:\W+[A-Z]{2,}(?!\w)){2,}"),
    "~signs": re.compile(r"[!?]{3,}"),
    "~again": re.compile(r"(?<!\w)(\w{3,})\W+\1(?!\w)"),
}


def features_of(word: str) -> list[str]:
    """`=word`, and `^beginning` for each length of beginning that the word reaches."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def _document_counts(rows: DataFrame, wanted) -> list[tuple[str, int]]:
    """In how many texts each feature occurs: those in at least LEAST_SUPPORT texts, or the wanted ones."""
    wanted = None if wanted is None else frozenset(wanted)
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                found = {f for w in set(WORD.findall(text.lower())) for f in features_of(w)} | {f for f, p in PATTERNS.items() if p.search(text)}
                counts.update(found if wanted is None else found & wanted)
                if len(counts) > MEMO:
                    yield made(counts)
                    counts = Counter()
        yield made(counts)

    def made(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=schema.names)

    summed = rows.select("text").mapInArrow(run, schema).groupBy("feature").agg(F.sum("n").alias("n"))
    return [(r["feature"], r["n"]) for r in summed.where(F.col("n") >= (LEAST_SUPPORT if wanted is None else 1)).collect()]


def mine(sample: DataFrame) -> list[str]:
    """Features that go with label 1, strongest first (by the G statistic); of nested ones that say the same the
    shortest, and at most PER_STEM with the same first four letters, so that rarer stems get voters too."""
    totals = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    n_pos, n = int(totals[0] or 0), int(totals[1])
    if not 0 < n_pos < n:
        return []
    n_neg = n - n_pos
    # what goes with label 1 often enough (the sample bounds how much that can be), then how often it goes with label 0
    pos = {f: c for f, c in _document_counts(sample.where("label = 1"), None) if c >= LEAST_SUPPORT}
    neg = dict(_document_counts(sample.where("label = 0"), pos.keys()))

    def part(k: float, expected: float) -> float:
        return k * math.log(k / expected) if k else 0.0

    top = []
    for feature, a in pos.items():
        b = neg.get(feature, 0)
        share = (a + b) / n
        if a / n_pos > 2 * b / n_neg:
            g = 2 * (part(a, share * n_pos) + part(b, share * n_neg) + part(n_pos - a, n_pos * (1 - share)) + part(n_neg - b, n_neg * (1 - share)))
            top.append({"feature": feature, "pos": a, "neg": b, "g": g})
    kept: list[str] = []
    counts: dict[str, tuple[int, int]] = {}
    stems: Counter = Counter()
    for r in sorted(top, key=lambda r: (-round(r["g"], 6), len(r["feature"]), r["feature"])):
        name, own = r["feature"], (r["pos"], r["neg"])
        nested = (k for k in kept if k[0] == "^" and name[1:].startswith(k[1:]))
        if stems[name[1:5]] < PER_STEM and not any(abs(counts[k][0] - own[0]) <= 0.02 * own[0] and counts[k][1] <= own[1] + 1 for k in nested):
            kept.append(name)
            counts[name] = own
            stems[name[1:5]] += 1
        if len(kept) == VOTERS:
            break
    return kept


def voter_counts(texts, voters: dict[str, int], memo: dict[str, tuple]) -> np.ndarray:
    """For each text and voter the number of different words, or of places, that it matches, up to LEVELS."""
    out = np.zeros((len(texts), len(voters)), np.uint8)
    forms = [(v, PATTERNS[f]) for f, v in voters.items() if f in PATTERNS]
    for row, text in zip(out, texts):
        for v, form in forms:
            row[v] = sum(1 for _ in islice(form.finditer(text), LEVELS))
        for word in set(WORD.findall(text.lower())):
            hits = memo.get(word)
            if hits is None:
                if len(memo) >= MEMO:
                    memo.clear()
                hits = memo[word] = tuple(voters[f] for f in features_of(word) if f in voters)
            for v in hits:
                row[v] += row[v] < LEVELS
    return out


def expand(counts: np.ndarray) -> np.ndarray:
    """Votes: for each voter `at least 1`, ..., `at least LEVELS`."""
    return np.concatenate([counts >= level for level in range(1, LEVELS + 1)], axis=1).astype(np.float32)


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Posterior probability of class 1 for each row, from voters of unknown accuracy and correlation.

    A voter has a rate in either class, so votes and abstentions both are evidence.  Voters that vote together within a
    class repeat each other: the evidence of each is divided by its summed correlations with all, itself included.  The
    given label is one more voter, independent of the others given the class.
    """
    votes = votes.astype(np.float64)
    q = np.where(given > 0, 0.9, 0.02)
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        rates, covariance = [], np.zeros((votes.shape[1], votes.shape[1]))
        for weight in (q, 1 - q):
            rate = np.clip((weight @ votes + 0.01) / (weight.sum() + 0.5), 1e-5, 1 - 1e-5)
            centred = (votes - rate) * np.sqrt(weight / len(votes))[:, None]
            covariance += centred.T @ centred
            rates.append(rate)
        spread = np.sqrt(np.diag(covariance)) + 1e-9
        share = 1 / np.clip(covariance / spread / spread[:, None], 0, 1).sum(axis=1)
        one, zero = rates
        hit = np.clip(q @ given / max(q.sum(), 1e-9), 0.5, 0.99)
        false = np.clip((1 - q) @ given / max((1 - q).sum(), 1e-9), 0.002, 0.5)
        logit = np.log(prior / (1 - prior)) + votes @ (share * np.log(one / zero)) + (1 - votes) @ (share * np.log((1 - one) / (1 - zero)))
        logit += np.where(given > 0, np.log(hit / false), np.log((1 - hit) / (1 - false)))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.1, rounds: int = 8) -> np.ndarray:
    """Weights (the intercept last) of a ridge logistic regression on soft targets, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float64)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + penalty * w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(sample: DataFrame, weak: bool = True) -> dict | None:
    """The voters, and the linear classifier's weights on their expanded counts; weak=False trains on the given labels instead."""
    totals = sample.agg(F.avg("label")).first()[0]
    if totals is None:
        return None
    voters = {name: i for i, name in enumerate(mine(sample))}
    if not voters:
        return {"voters": {}, "weights": np.array([np.log(max(totals, 1e-3) / max(1 - totals, 1e-3))])}
    schema = T.StructType([sample.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches):
        memo: dict[str, tuple] = {}
        for batch in batches:
            counts = voter_counts(batch.column(1).to_pylist(), voters, memo)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([c.tobytes() for c in counts], pa.binary())], names=schema.names)

    rows = sample.select("doc_id", "text", "label").mapInArrow(run, schema).collect()  # at most SAMPLE rows of VOTERS bytes
    rows.sort(key=lambda r: r["doc_id"])  # sums of floats depend on the order
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), np.uint8).reshape(len(rows), -1)
    votes, given = expand(counts), np.array([r["label"] for r in rows])
    used = votes.sum(axis=0) >= LEAST_SUPPORT
    target = label_model(votes[:, used], given) if weak else given.astype(np.float64)
    weights = np.zeros(votes.shape[1] + 1)
    weights[np.append(used, True)] = logistic(votes[:, used], target)
    return {"voters": voters, "weights": weights}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier)."""
    docs = common.documents(docs)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches):
        memo: dict[str, tuple] = {}
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                counts = voter_counts(part.column(1).to_pylist(), model["voters"], memo)
                logit = expand(counts) @ model["weights"][:-1] + model["weights"][-1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))), pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC) -> DataFrame:
    """docs without the rows whose score reaches threshold; all columns as they are.  Scored where the rows are: no shuffle."""
    model = fit(common.training_sample(common.documents(docs), labels, "toxic", SAMPLE))
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        memo: dict[str, tuple] = {}
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                counts = voter_counts([t or "" for t in part.column(at).to_pylist()], model["voters"], memo)
                logit = expand(counts) @ model["weights"][:-1] + model["weights"][-1]
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(common.training_sample(common.documents(docs), common.read(spark, sf_dir, "labels"), "toxic", SAMPLE))
    scored = score(docs, model)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
