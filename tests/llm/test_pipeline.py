import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from folio.llm import decontamination, secrets, simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = corpus_pipeline.common.read(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.common.durable(stage(spark, docs, SF), name)
        assert docs.columns == before.columns
        ids, left = {r["doc_id"] for r in before.select("doc_id").collect()}, [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(left) <= ids and len(left) == len(set(left))
        if name == "toxicity":
            rejected = {r["doc_id"] for r in toxicity.op4_toxicity(spark, SF).where("predicted = 1").collect()}
            assert set(left) == ids - rejected and rejected
            twice = stage(spark, before.union(before), SF)  # repeated rows are judged alike
            assert sorted(r["doc_id"] for r in twice.select("doc_id").collect()) == sorted(2 * list(left))
        if name == "simhash":
            texts = {r["doc_id"]: simhash.shingles((r["text"] or "").encode(), 5) for r in before.collect()}
            same = lambda a, b: len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])
            kept = sorted(left)
            assert not any(same(a, b) for k, a in enumerate(kept) for b in kept[:k])  # nothing is left to remove
            assert all(any(same(x, y) for y in ids if y != x) for x in ids - set(left))  # and nothing else went
        if name == "decontamination":
            found = {r["doc_id"] for r in decontamination.contaminated(before, corpus_pipeline.common.read(spark, SF, "benchmark")).collect()}
            assert set(left) == ids - found
        if name == "secrets":
            assert set(left) == ids
            assert secrets.scan(docs).where("size(base) > 0").count() == 0
            assert docs.where("n_chars <> char_length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert {r["doc_id"] for r in packed} == set(left) and all(r["sum(length)"] == r["doc_tokens"] for r in packed)


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


def test_awkward_rows(spark, tmp_path):
    from .data import frame

    docs = frame(spark).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    docs.unionByName(docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars").limit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
