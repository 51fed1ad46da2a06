"""Secret scan with corpus-wide ownership frequency.

Patterns find candidate credentials in each whole text. Every candidate value
is hashed, and its distinct owners and repositories are counted over the
corpus. A value that many owners hold is a widely copied example; one that a
single owner holds, in any number of repositories, and that looks random is
live. Random values of a few owners, more than one but too few for an example,
are unsure; they are reported and redacted like live ones.

Pattern spans always stay. The corpus counts add spans of kind ``bare``: long
mixed tokens outside any pattern span that look random and are no example.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import join_spread, masked, materialise, read_table, released, texts_of

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the same runs as AKIA[A-Z0-9]+ of 20 or more characters
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as [0-9a-f]+ of 24 or more characters
BARE = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")
KINDS = ("assign", "access", "hex", "bare")
LEAST_ASSIGN = 6

SPAN = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("kind_no", T.IntegerType()),
        T.StructField("end", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("random", T.BooleanType()),
        T.StructField("value_start", T.LongType()),
    ]
)


def looks_random(value: str) -> bool:
    """Letters and digits both, and at least 2.5 bits a character."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 2.5


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every candidate, by start and kind; the value ends where the span does."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base, at, covered = sorted((a, b) for a, _, b, _ in found), 0, 0
    for m in BARE.finditer(text):  # both lists ascend, so one sweep knows how far the spans that begin before this token's end reach
        while at < len(base) and base[at][0] < m.end():
            covered = max(covered, base[at][1])
            at += 1
        value = m[0]
        if covered <= m.start() and any(c.isupper() for c in value) and any(c.islower() for c in value):
            found.append((m.start(), 3, m.end(), value))
    return sorted(found)


def scan(docs: DataFrame, text_col: str, passed: list[str]) -> DataFrame:
    """``passed`` columns with ``__row`` (unique) and ``__spans``."""
    source = docs.select(*passed, F.col(text_col).cast("string").alias("__text"))
    fields = [source.schema[c] for c in passed]
    schema = T.StructType([*fields, T.StructField("__row", T.LongType()), T.StructField("__spans", T.ArrayType(SPAN))])
    arrow_span = pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("end", pa.int64()), ("hash", pa.string()), ("random", pa.bool_()), ("value_start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            spans = [
                [{"start": a, "kind_no": k, "end": b, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32], "random": looks_random(v), "value_start": b - len(v)} for a, k, b, v in candidates(text)]
                for text in texts_of(batch, "__text")
            ]
            columns = [batch.column(c) for c in passed]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(row, row + batch.num_rows), pa.int64()), pa.array(spans, pa.list_(arrow_span))], names=[*passed, "__row", "__spans"])
            row += batch.num_rows

    return source.mapInArrow(released(run), schema)


def ownership(spans: DataFrame) -> DataFrame:
    """Owners, repositories and occurrences (n) of each value hash; ``spans`` has hash, owner, repo.

    Both counts go through distinct pairs, which every task folds before the
    shuffle, so a value that a third of all rows hold is a few rows by then.
    """
    owners = spans.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repos = spans.select("hash", "repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repos"))
    return owners.join(repos, "hash").join(spans.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hash")


def judged(scanned: DataFrame, owner: F.Column, repo: F.Column, live_owners: int, example_owners: int) -> DataFrame:
    """One row per candidate: __row, start, kind_no, end, value_start, owners, repos, verdict, and ``hide``: random and no example."""
    each = scanned.select("__row", owner.alias("owner"), repo.alias("repo"), F.explode("__spans").alias("s")).select("__row", "owner", "repo", "s.*")
    verdict = (
        F.when(F.col("owners") >= example_owners, "example")
        .when((F.col("owners") <= live_owners) & F.col("random"), "live")
        .otherwise("unsure")
    )
    return join_spread(each, materialise(ownership(each), "owners"), "hash", "n").select("__row", "start", "kind_no", "end", "value_start", "owners", "repos", verdict.alias("verdict"), (F.col("random") & (verdict != "example")).alias("hide"))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", live_owners: int = 1, example_owners: int = 3) -> DataFrame:
    """Per row: doc_id and ``found``, an array of (start, kind_no, end, owners, repos, verdict) sorted by start and kind.

    ``bare`` candidates are kept only if they look random and are no example. Null text is
    empty; a null owner or repository is one owner or repository of its own;
    repeated rows give repeated results; extra columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("__owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("__repo"), F.col(text_col).alias("__body"))
    scanned = materialise(scan(source, "__body", ["doc_id", "__owner", "__repo"]), "candidates")
    each = judged(scanned.filter(F.size("__spans") > 0), F.col("__owner"), F.col("__repo"), live_owners, example_owners)
    kept = each.filter((F.col("kind_no") < 3) | F.col("hide"))
    per_row = kept.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "owners", "repos", "verdict"))).alias("found"))
    some = scanned.filter(F.size("__spans") > 0).select("__row", "doc_id").join(per_row, "__row", "left").select("doc_id", "found")
    none = scanned.filter(F.size("__spans") == 0).select("doc_id", F.lit(None).cast(some.schema["found"].dataType).alias("found"))
    return some.unionByName(none).withColumn("found", F.coalesce("found", F.array().cast(some.schema["found"].dataType)))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mark: str = "<secret>", live_owners: int = 1, example_owners: int = 3) -> DataFrame:
    """The rows and columns of ``docs`` with all random-looking values that are no widely copied examples replaced by ``mark``.

    Overlapping values are replaced as one. Rows without such values come back
    unchanged; null texts stay null.
    """
    plain, names, (text_col, owner_col, repo_col) = masked(docs, text_col, owner_col, repo_col)
    scanned = materialise(scan(plain, text_col, plain.columns), "candidates")
    hit = scanned.filter(F.size("__spans") > 0)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    hidden = judged(hit, key(owner_col), key(repo_col), live_owners, example_owners).filter("hide")
    spans = hidden.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(F.col("value_start").alias("start"), "end"))).alias("__hidden"))
    changed = hit.join(spans, "__row", "left").select(*plain.columns, "__hidden")

    def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for text, hidden in zip(b.column(text_col).to_pylist(), b.column("__hidden").to_pylist(), strict=True):
                parts, at = [], 0
                for s in hidden or ():
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], mark]
                    at = max(at, s["end"])
                left.append("".join(parts) + text[at:] if hidden else text)
            yield b.set_column(b.schema.get_field_index(text_col), text_col, pa.array(left, pa.string()))

    changed = changed.mapInArrow(blank, changed.schema)
    return changed.select(plain.columns).unionByName(scanned.filter(F.size("__spans") == 0).select(plain.columns)).toDF(*names)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])
    count = lambda k: F.size(F.filter("found", lambda s: s["kind_no"] == k)).cast("long")
    having = lambda v: F.size(F.filter("found", lambda s: s["verdict"] == v)).cast("long")
    base = F.array_join(F.transform(F.filter("found", lambda s: s["kind_no"] < 3), text), ",")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("found", text), ",").alias("spans"),
        having("live").alias("n_live"),
        having("example").alias("n_example"),
    )
