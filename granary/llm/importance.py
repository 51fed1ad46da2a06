"""Importance resampling of documents towards a target collection.

Texts become runs of one to ``n`` consecutive words, and each run the bucket
of its crc32. One scan of a document keeps a ring with the running zlib states
of the last ``n`` starts: a word extends each state by a space and itself,
opens a state of its own, and every state then is the crc32 of a run that ends
here, so no run is ever built as a string. The scan writes each document's
bucket counts (at most ``buckets`` of them, however long the text); corpus
counts, gains, weights and the draw read that narrow table only.

A bucket's gain is the logarithm of its share in the target over its share in
the corpus, in thousandths. A document's score is the sum of its gains plus
Gumbel noise that follows from its id, so the highest scores are a sample
without replacement in proportion to the importance weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import discard, list_array, materialise, read_table, released
from granary.llm.ordering import numbered

#: A-Z lower, digits, a-z and all bytes of characters beyond ASCII kept, the rest a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SEGMENT_BYTES = 1 << 20
COUNTS = "doc_id long, n_words long, n_features long, bucket array<int>, times array<long>"


def words_of(text: bytes, size: int = SEGMENT_BYTES) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, those of about ``size`` bytes at a time."""
    text = text.translate(FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size) if len(text) - at > size else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def run_states(words: Iterable[bytes], n: int, ring: list[int]) -> list[int]:
    """The crc32 of every run of 1 to ``n`` words that ends in one of ``words``; ``ring`` holds the open states and is moved on."""
    found: list[int] = []
    for word in words:
        spaced = b" " + word
        ring[:] = [crc32(spaced, state) for state in ring]
        ring.append(crc32(word))
        found += ring
        if len(ring) == n:
            del ring[0]
    return found


def bucket_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 1, buckets: int = 10000) -> DataFrame:
    """One row for each row of ``docs``: its id, words, features, and how often each bucket occurs.

    Null and empty texts have no words. Repeated rows and null ids are rows
    like any other; extra columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, sizes, keys, times = [], [], [], []
            for text in batch.column("text"):
                ring: list[int] = []
                seen: Counter[int] = Counter()
                words = 0
                for segment in words_of(text.as_py() or b""):
                    words += len(segment)
                    seen.update([state % buckets for state in run_states(segment, n, ring)])
                n_words.append(words)
                sizes.append(len(seen))
                keys.extend(seen.keys())
                times.extend(seen.values())
            bucket, many, lengths = np.array(keys, np.int32), np.array(times, np.int64), np.array(sizes, np.int64)
            features = sums_of(many, lengths)
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(features), list_array(bucket, lengths), list_array(many, lengths)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "bucket", "times"])

    return source.mapInArrow(released(run), COUNTS)


def sums_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each of the consecutive runs of ``values``."""
    ends = np.cumsum(lengths)
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[ends] - running[ends - lengths]


def flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def totals(counts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows of ``counts``; tasks add up what they read, and ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(whole, flat(batch, "bucket"), flat(batch, "times"))
        at = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(whole[at])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for bucket, n in counts.select("bucket", "times").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return found


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the smoothed corpus share) of each bucket."""
    s_all, t_all, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: (float(t + 1) * float(s_all + buckets)) / (float(s + 1) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weighed(counts: DataFrame, gains: np.ndarray) -> DataFrame:
    """``counts`` with ``weight``, the sum of the gains over a row's features, in place of the bucket columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("bucket").offsets.to_numpy())
            weight = sums_of(gains[flat(batch, "bucket")] * flat(batch, "times"), lengths)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return counts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> F.Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256(``seed:id``); a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    n: int = 1,
    buckets: int = 10000,
    min_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
) -> DataFrame:
    """Score every document and draw ``percent`` of those with ``min_words`` words or more.

    Returns doc_id, n_features, weight, score and rank (1, 2, 3, ... over the
    drawn by descending score, null for the rest) for each row of ``docs``.
    Ties go to the smaller id, null ids last, then to fewer features, then to
    the row read first, so repeated rows get ranks of their own. A text without
    words weighs 0. An empty target makes every gain that of t = T = 0; with
    empty ``docs`` there are no rows.
    """
    counts = materialise(bucket_counts(docs, id_col=id_col, text_col=text_col, n=n, buckets=buckets), "importance-counts")
    sought = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text_col).alias("text")), n=n, buckets=buckets)
    gains = gains_of(totals(counts, buckets), totals(sought, buckets))
    scored = weighed(counts, gains).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scores = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    discard(docs.sparkSession, counts)
    fit = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    able = numbered(scores.filter(fit), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")], name="place", label="importance-order")
    drawn = able.count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return able.select(*columns, rank.alias("rank")).unionByName(scores.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: crc32 of UTF-8 text as a DuckDB expression over its 256-entry table, which is built from the polynomial.
CRC_TABLE = "(SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b))"


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of the text expression; ``t`` must be the list of CRC_TABLE."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = f"""
WITH said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), sought AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark
), spoken AS (
  SELECT doc_id, unnest(words) AS word FROM said
), every AS (
  SELECT word, {crc_sql("word")} % 10000 AS bucket FROM (SELECT word FROM spoken UNION SELECT word FROM sought), {CRC_TABLE}
), s AS (
  SELECT bucket, count(*)::DOUBLE AS s FROM spoken JOIN every USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*)::DOUBLE AS t FROM sought JOIN every USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM spoken) + 10000)::DOUBLE) / ((s + 1) * ((SELECT count(*) FROM sought) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), sums AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM spoken JOIN every USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM said LEFT JOIN sums USING (doc_id)
), ordered AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ordered USING (doc_id)
"""
