import corpus_pipeline
import pytest

from test_operators_data import DOCS, rows_and_tables


def test_stages(spark, tmp_path):
    documents, labels, bench, passage = rows_and_tables(spark)
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        docs = after
    text = "\n".join(r["text"] for r in docs.collect() if r["text"])
    assert passage not in text and "vilea" not in text
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


@pytest.mark.parametrize("k", range(5))
def test_stage_on_an_empty_table(spark, tmp_path, k):
    documents, labels, bench, _ = rows_and_tables(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], DOCS), str(tmp_path)).count() == 0
