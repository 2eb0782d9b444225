"""The pipeline's stages on a small corpus."""

import pyarrow as pa
import pyarrow.parquet as pq


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert docs.where("not round_trip").count() == 0
    whole = corpus_pipeline.run(spark, d)
    assert whole.exceptAll(docs).count() == 0 and whole.count() == docs.count()


def test_pipeline_empty(spark, tmp_path):
    import corpus_pipeline

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(schema.empty_table(), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
