"""The pipeline keeps what operator 10 accepts."""

from pyspark.sql import functions as F

import corpus_pipeline
from pointlake.llm import quality


def test_the_quality_stage_keeps_what_operator_10_accepts(spark, monkeypatch):
    scores = {1: 0.0, 2: 0.49, 3: 0.5, 4: 0.69, 5: 0.7, 6: 0.95}
    docs = spark.createDataFrame([(i, str(s)) for i, s in scores.items()], "doc_id long, text string")
    given = lambda d, model, column="score": d.withColumn(column, F.col("text").cast("double"))
    monkeypatch.setattr(corpus_pipeline, "fit_quality", lambda *a: None)
    monkeypatch.setattr(corpus_pipeline, "score_quality", given)
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *a: docs)
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert kept == {5, 6} and quality.ACCEPT_FROM == 0.7
