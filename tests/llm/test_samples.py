"""What of the training sample comes to the driver."""

from pathlib import Path

from pyspark.sql import functions as F

from pointlake.llm.sampling import labelled_sample, one_text_each


def test_a_repeated_doc_id_is_one_row(spark):
    hot = spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = hot.union(spark.createDataFrame([(1, None), (1, "b"), (2, "c"), (None, "d"), (9, "e")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    sample = labelled_sample(labels, "toxic", F.lit(True), 10)
    got = one_text_each(docs, sample).collect()
    assert sorted((r.doc_id, r.y) for r in got) == [(1, 0), (2, 1), (3, 1)]
    again = one_text_each(docs.repartition(3), sample).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_fits_read_one_row_each(spark):
    """A hot doc_id must not outweigh the others in either classifier."""
    from pointlake.llm.quality import fit_quality, score_quality
    from pointlake.llm.toxicity import fit_toxicity, score_toxicity

    rows = [(i, "awful words !!! $$$" if i % 2 else "fine and plain words here") for i in range(60)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    hot = once.union(spark.createDataFrame([rows[1]] * 400, "doc_id long, text string"))
    for fit, score, label in ((fit_toxicity, score_toxicity, "toxic"), (fit_quality, score_quality, "quality")):
        labels = spark.createDataFrame([(i, i % 2) for i in range(60)], f"doc_id long, {label} int")
        a, b = (sorted(map(tuple, score(once, fit(d, labels)).select("doc_id", "score").collect())) for d in (once, hot))
        assert a == b


def test_scratch(spark, odd_docs, tmp_path):
    from pointlake.llm.common import scratch, shared_dir
    from pointlake.llm.suffixes import remove_repeats

    here = Path(shared_dir(spark).removeprefix("file://"))
    before, tables = set(here.iterdir()), {t.name for t in spark.catalog.listTables()}
    with scratch(spark):
        remove_repeats(odd_docs, 50).write.parquet(f"file://{tmp_path}/kept")
        assert set(here.iterdir()) > before
    assert set(here.iterdir()) == before and {t.name for t in spark.catalog.listTables()} == tables
    assert spark.read.parquet(f"file://{tmp_path}/kept").count() == odd_docs.count()
