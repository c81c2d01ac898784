import corpus_pipeline


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.count() > 100
    assert docs.where("text like '%AKIA%'").count() == 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(rows) == docs.count() and all(r.n_tokens == len(r.ids) for r in rows)
    assert len(corpus_pipeline.run(spark, sf).columns) == 6
