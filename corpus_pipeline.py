"""Corpus pipeline: documents in, packed token sequences out.

Each stage works on everything that its predecessor kept, and all but the
last return the columns of ``documents``:

1. toxicity: documents scored 0.5 or more go;
2. line dedup: of near-equal lines the first stays, and documents that lose
   their last visible line go;
3. MinHash: one document of each group of near-duplicates stays (five-word
   shingles, similarity 0.8 or more);
4. secrets: random-looking credentials that are no examples are blanked out,
   all documents stay;
5. packing: what is left becomes sequences of at most 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import lines, minhash, packing, secrets, toxicity
from granary.llm.common import materialise, read_table

ORACLE_SQL = None  # letter models, edit joins and tokenizers are beyond SQL


def recounted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, as the length of the text now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    mark = "score_of_" + "_".join(docs.columns)  # a name that no column has
    return toxicity.score(docs, model, keep=docs.columns, name=mark).filter(F.col(mark) < 0.5).drop(mark)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(docs)
    left = found.filter((F.size("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    return recounted(left.drop("removed_lines"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(secrets.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
