"""The pipeline's stages on the small tables."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = [before]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[1] < before
    assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_runs_on_odd_rows_and_on_none(spark, odd, empty, tmp_path):
    """Nulls in every column, empty texts, clashing names, no labels; then no rows at all."""
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for k, (docs, marks) in enumerate(((odd, labels), (empty, labels.limit(0)))):
        d = str(tmp_path / str(k))
        docs.write.parquet(f"{d}/documents.parquet")
        marks.write.parquet(f"{d}/labels.parquet")
        packed = corpus_pipeline.run(spark, d).collect()
        assert bool(packed) == (k == 0) and all(r.offset + r.length <= 1024 for r in packed)
        # one of the equal rows stays, and so do all rows without words, as one token each at least
        assert k or {r.doc_id for r in packed} >= {1, None, 3, 6, 7, 8, 9}
