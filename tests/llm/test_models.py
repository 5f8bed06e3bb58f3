"""Classifiers: held-out accuracy on the small tables, and awkward rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from folio.llm import common, quality, toxicity

from .data import AWKWARD, empty, frame

SF = "/root/testdata/sf0.01"


def auc(rows, labels):
    pos = np.array([r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 1])
    neg = np.array([r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 0])
    return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op2_quality, "quality", 0.95), (toxicity.op4_toxicity, "toxic", 0.8)])
def test_held_out_accuracy(spark, query, label, least):
    rows = query(spark, SF).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in rows) and auc(rows, labels) >= least


@pytest.mark.parametrize(("module", "cut"), [(quality, 0.5), (toxicity, 0.0)])
def test_without_labels(spark, module, cut):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.fit(common.training_sample(common.documents(frame(spark)), labels, "toxic", 10))
    assert model is None
    assert {r["score"] for r in module.score(frame(spark), model).collect()} == {cut}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows_and_one_class(spark, module):
    labels = spark.createDataFrame([(i, 1, 1) for i, _ in AWKWARD] + [(None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(common.training_sample(common.documents(frame(spark)), labels, "toxic", 100))
    got = module.score(frame(spark), model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert module.score(empty(spark), model).collect() == []


def test_sample_is_bounded_and_never_held_out(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in AWKWARD] * 2, "doc_id long, quality int, toxic int")
    got = common.training_sample(common.documents(frame(spark)), labels, "quality", 5).withColumn("out", common.held_out(common.F.col("doc_id"))).collect()
    assert len(got) == 5 and not any(r["out"] for r in got) and len({r["doc_id"] for r in got}) == 5


def test_toxic_rows_go_and_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    scored = {r["doc_id"] for r in toxicity.op4_toxicity(spark, SF).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == scored


def test_vote_is_the_weighted_mean_of_the_nearest():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    model = {"vectors": v, "labels": rng.integers(0, 2, 200).astype(np.float32)}
    q = rng.normal(size=(20, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    for row, got in zip(q, quality.vote(q, model)):
        cosines = row.astype(np.float32) @ v.T
        near = np.argsort(-cosines)[: quality.NEIGHBOURS]
        w = np.maximum(cosines[near], 1e-3).astype(float) ** quality.SHARPNESS
        assert abs(got - (w * model["labels"][near]).sum() / w.sum()) < 1e-6


def sampled(spark, label, sf="/root/testdata/sf0.001"):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, common.training_sample(common.documents(docs), labels, label, 10_000)


def test_quality_scores_against_brute_force(spark):
    """The whole query anew: term counts, tf-idf, singular vectors and the vote, from every text and every label."""
    sf = "/root/testdata/sf0.001"
    docs, sample = sampled(spark, "quality", sf)
    table, bare = quality._shape_table(), quality.BARE
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    labels = {r["doc_id"]: r["label"] for r in sample.collect()}
    assert labels and not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in labels)

    def kinds(t):
        return Counter(t.lower().translate(bare).split()), quality.terms(t, table)[1]

    found = {i: kinds(t) for i, t in texts.items()}
    parts = []
    for kind, (most, weight) in enumerate(zip(quality.SIZES, quality.WEIGHTS)):
        df = Counter(t for i in labels for t, n in found[i][kind].items() if n)
        top = {t: k for k, (t, _) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0]))[: most - 1])}
        idf = np.array([math.log((1 + len(labels)) / (1 + df[t])) + 1 for t in top] + [1.0])
        rows = {}
        for i, f in found.items():
            x = np.zeros(len(idf))
            for t, n in f[kind].items():
                x[top.get(t, len(top))] += n
            x = np.sqrt(x / max(x.sum(), 1)) * idf
            rows[i] = weight * x / max(np.linalg.norm(x), 1e-12)
        parts.append(rows)
    x = {i: np.concatenate([p[i] for p in parts]) for i in texts}
    known = sorted(labels)
    _, _, v = np.linalg.svd(np.array([x[i] for i in known]), full_matrices=False)
    low = {i: x[i] @ v[: quality.DIMENSIONS].T for i in texts}
    low = {i: r / max(np.linalg.norm(r), 1e-12) for i, r in low.items()}
    for r in quality.op2_quality(spark, sf).collect():
        near = sorted(((float(low[r["doc_id"]] @ low[i]), labels[i]) for i in known), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 1e-3) ** quality.SHARPNESS, y) for c, y in near]
        expected = sum(w * y for w, y in votes) / sum(w for w, _ in votes) if texts[r["doc_id"]].split() else np.mean([labels[i] for i in known])
        assert abs(r["score"] - expected) < 0.02, r
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)


def test_mined_voters_against_brute_force(spark):
    _, sample = sampled(spark, "toxic", "/root/testdata/sf0.01")
    rows = [(r["text"], r["label"]) for r in sample.collect()]
    pos, neg = Counter(), Counter()
    for t, y in rows:
        words = {w for w in toxicity.WORD.findall(t.lower())}
        found = {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in toxicity.PREFIXES if len(w) >= n} | {n for n, p in toxicity.PATTERNS.items() if p.search(t)}
        (pos if y else neg).update(found)
    n_pos = sum(y for _, y in rows)
    n_neg = len(rows) - n_pos

    def g(a, b):
        cells = [(a, n_pos), (b, n_neg), (n_pos - a, n_pos), (n_neg - b, n_neg)]
        share = (a + b) / len(rows)
        return 2 * sum(k * math.log(k / (m * s)) for (k, m), s in zip(cells, [share, share, 1 - share, 1 - share]) if k)

    voters = toxicity.mine(sample)
    assert len(voters) == len(set(voters)) > 5
    scores = [g(pos[v], neg[v]) for v in voters]
    assert all(a >= b - 1e-5 for a, b in zip(scores, scores[1:]))
    assert all(pos[v] >= toxicity.LEAST_SUPPORT and pos[v] / n_pos > 2 * neg[v] / n_neg for v in voters)
    left_out = [f for f in pos if pos[f] >= toxicity.LEAST_SUPPORT and pos[f] / n_pos > 2 * neg[f] / n_neg and f not in voters]
    best = scores[-1] if len(voters) == toxicity.VOTERS else 0.0
    for f in left_out:  # weaker than all, a stem that has its voters, or nested in a voter that says the same
        stem = sum(v[1:5] == f[1:5] for v in voters) >= toxicity.PER_STEM
        nested = any(v[0] == "^" and f[1:].startswith(v[1:]) and abs(pos[v] - pos[f]) <= 0.02 * pos[f] and neg[v] <= neg[f] + 1 for v in voters)
        assert stem or nested or g(pos[f], neg[f]) <= best + 1e-5, f


def test_label_model_mends_noisy_labels():
    """Voters of different accuracy, six of them copies of one: the posterior is nearer to the truth than the given labels."""
    rng = np.random.default_rng(8)
    truth = rng.random(4000) < 0.2
    voters = [rng.random(4000) < np.where(truth, p, f) for p, f in zip(rng.uniform(0.3, 0.8, 14), rng.uniform(0.01, 0.1, 14))]
    bad = rng.random(4000) < 0.3  # knows nothing, but votes six times over
    votes = np.stack([*voters, *(bad ^ (rng.random(4000) < 0.02) for _ in range(6))], axis=1).astype(np.float32)
    given = (truth ^ (rng.random(4000) < np.where(truth, 0.15, 0.02))).astype(int)
    q = toxicity.label_model(votes, given)
    wrong, wrong_given = ((q > 0.5) != truth).sum(), (given != truth).sum()
    assert wrong < 0.5 * wrong_given, (wrong, wrong_given)
    assert np.allclose(toxicity.label_model(votes, given, rounds=1), toxicity.label_model(votes, given, rounds=1))


def test_pattern_voters():
    forms = {"~spelled": "you i d i o t there", "~masked": "an id*ot", "~stretched": "stuuuuupid", "~shouted": "GO AWAY NOW please", "~signs": "what?!!", "~again": "very very odd"}
    for name, t in forms.items():
        assert toxicity.PATTERNS[name].search(t), name
        assert not toxicity.PATTERNS[name].search("An ordinary sentence, with NATO in it: a b and 3.5 %."), name
    counts = toxicity.voter_counts(["a*b c*d e*f g*h", "none"], {"~masked": 0, "^none": 1}, {})
    assert counts.tolist() == [[toxicity.LEVELS, 0], [0, 1]]
    for form in toxicity.PATTERNS.values():  # long runs don't blow up
        form.search("a " * 100_000 + "A" * 100_000 + "!a" * 100_000)


def test_null_ids_and_texts_that_share_an_id(spark):
    rows = [(None, "x y"), (1, "b"), (1, "a"), (1, None)]
    labels = spark.createDataFrame([(1, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    assert [(r["text"], r["label"]) for r in common.training_sample(common.documents(frame(spark, rows)), labels, "toxic", 5).collect()] == [("", 1)]
    got = frame(spark, rows).select(common.held_out(common.F.col("doc_id")).alias("h")).collect()
    assert {r["h"] for r in got} == {False}
