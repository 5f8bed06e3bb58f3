"""Stages that are written hold each text once, and nothing that works by document deals their rows again."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from folio.functions.spans import STYLES
from folio.operators.blocks import lines
from folio.plans.pipeline import Options, run_corpus

TEXTS = ["Un mot , deux\n\n  Trois ... quatre \n\n5", "Au XIXe siècle\nvoir p. 3\nfin", "", "a\nb\nc\nd\ne"]


def corpus(spark):
    off = [F.lit(False).alias(f) for f in STYLES]
    own = F.struct("text", *off, F.lit("text").alias("kind"), F.lit(None).cast("string").alias("note_ref"))
    called = F.struct(F.lit("[n]").alias("text"), *off, F.lit("note_call").alias("kind"), F.concat(F.lit("n"), F.col("pos").cast("string")).alias("note_ref"))
    documents = spark.createDataFrame([(d, t) for d, t in enumerate(TEXTS * 5)], "doc_id long, text string")
    df = lines(documents).withColumns({"spans": F.when(F.col("pos") % 2 == 0, F.array(own, called)).when(F.col("pos") % 3 == 0, F.array()), "s": F.when(F.col("pos") == 1, "other")})
    df = df.withColumn("text", F.when(F.size("spans") > 0, F.array_join(F.transform("spans", lambda x: x["text"]), "")).otherwise(F.col("text")))
    kept = lines(documents).where("pos % 2 = 0").select("doc_id", F.concat(F.lit("n"), F.col("pos").cast("string")).alias("note_id"), F.lit("voir , p. 3").alias("text"))
    return df, kept.withColumn("spans", F.array(own))


def exchanges(df) -> int:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue().count("Exchange ")


@pytest.mark.parametrize("mode, tables, exports", [("deterministic", ["blocks", "transformations", "notes"], ["latex", "pivot"]), ("heuristic", ["blocks", "diagnostics"], [])])
def test_stages_change_no_result(spark, tmp_path, mode, tables, exports):
    blocks, notes = corpus(spark)
    run_corpus(blocks.limit(1), Options(mode="deterministic", stage_path=str(tmp_path)))  # whose files are replaced
    staged, plain = (run_corpus(blocks, Options(mode=mode, stage_path=p), notes) for p in (str(tmp_path), None))
    for name in tables + exports:
        got, wanted = (getattr(x, name) if name in tables else getattr(x, name)() for x in (staged, plain))
        assert sorted(got.columns) == sorted(wanted.columns)
        assert sorted(map(str, got.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect())), name
    assert spark.catalog.listTables() == []


def test_stages_are_dealt_once(spark, tmp_path):
    blocks, notes = corpus(spark)
    done = run_corpus(blocks, Options(mode="deterministic", stage_path=str(tmp_path)), notes)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [exchanges(x) for x in (done.tei(), done.latex(), done.docx(), done.gate)] == [0, 0, 0, 0]
        assert exchanges(done.pivot()) == 2  # what was found and changed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_stages_hold_texts_once(spark, tmp_path):
    blocks, notes = corpus(spark)
    run_corpus(blocks, Options(mode="deterministic", stage_path=str(tmp_path)), notes)
    stored = spark.read.parquet(f"{tmp_path}/typography")
    assert stored.where("size(spans) > 0 AND text IS NOT NULL").count() < stored.where("size(spans) > 0").count() / 4
    assert 0 < stored.where("before_typography IS NOT NULL").count() < stored.count() / 2
