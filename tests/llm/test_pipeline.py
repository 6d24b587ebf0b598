import corpus_pipeline
from plumbline.llm import ngram_join, quality


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    kept = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, data)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "packing":
            assert set(ids) == set(before)
            break
        assert docs.columns == names and set(ids) <= set(before)
        if name == "quality_rules":
            assert set(ids) == kept
        if name == "ngram_join":
            found = ngram_join.near_duplicates(docs)
            assert found.where("doc_id <> component_id").count() == 0
        if name in ("ngram_join", "language_id", "quality_rules"):
            assert len(ids) == len(set(ids))


def test_odd_documents(spark, odd):
    """Stages take nulls, repeated rows, clashing names and empty tables; filters drop whole rows alone."""
    clash = odd.withColumnRenamed("uid", "gone_id").withColumn("__doc_id", odd["n"]).withColumn("key", odd["n"])
    before = [tuple(r) for r in clash.collect()]
    for name, stage in corpus_pipeline.STAGES:
        if name == "packing":
            assert stage(spark, clash, "").selectExpr("count(distinct sequence_id)").first()[0] > 0 and stage(spark, clash.limit(0), "").count() == 0
            continue
        got = stage(spark, clash, "")
        rows = [tuple(r) for r in got.collect()]
        assert got.columns == clash.columns and stage(spark, clash.limit(0), "").count() == 0
        if name == "secret_scan":
            assert len(rows) == len(before)
        else:
            assert not set(rows) - set(before)
