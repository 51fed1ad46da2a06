"""Near-duplicate lines by a segment-partition edit join.

How many edits two lines may differ in depends on the length of the shorter:
one for each ten characters, two at most, so lines under ten characters go by
equality alone. Two lines within edit distance t differ in at most t of the
t + 1 segments of the shorter, so one segment of it occurs unchanged in the
longer. Every line
indexes its own segments under (its length, segment number, segment text) and
probes, for each length from its own down to t less, those substrings whose
position a segment can still have (the multi-match-aware windows). Lines that
meet under a key are verified with a banded bit-parallel edit distance.

Equal lines are one node throughout. A key's lines are first verified against
its smallest line only; lines still in different components are then compared
in cells of bounded size, from which only links that join two components
leave. Lines travel as hashes; texts join where two lines are compared. Of
each group the first occurrence, by document id, stays; all others leave
their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.blocks import Bloom, cells, links_across
from granary.llm.common import join_spread, masked, materialise, mix64, read_table, released, schema_with, texts_of
from granary.llm.components import components


BASE = np.uint64(0x9E3779B97F4A7C15)
FEW = 24  # pairs up to which one after the other costs less
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Params:
    """One edit for each ``per_edit`` characters of the shorter of two stripped lines, ``distance`` at most.

    ``cell`` bounds the characters (with 256 more a line) of the part of a key's lines that one task compares with another part.
    """

    distance: int = 2
    per_edit: int = 10
    cell: int = 1 << 21


def allowed(chars: np.ndarray, t: int, per_edit: int) -> np.ndarray:
    """The edits that a line of so many characters may differ in from a longer one."""
    return np.minimum(np.maximum(chars, 0) // per_edit, t)


def all_keys(lines: list[str], t: int, per_edit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, position in ``lines`` and own segment or not, for all lines at once; a line may give a key twice, and a short one none.

    Substring hashes are differences of running sums of mixed characters times
    the powers of an odd base, divided by the power at the substring's start.
    Lines whose hashes collide only meet once more: every pair is verified.
    """
    size = np.array([len(x) for x in lines], dtype=np.int64)
    begins = np.cumsum(size) - size
    char = mix64(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + BASE)
    powers = lambda base: np.cumprod(np.full(len(char) + 1, base, dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(char * powers(BASE)[:-1])))
    back = powers(INVERSE)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for d, delta in ((d, delta) for d in range(1, t + 1) for delta in range(d + 1)):
        rows = np.flatnonzero(allowed(size - delta, t, per_edit) == d)
        length = size[rows] - delta
        short, more = np.divmod(length, d + 1)
        for i in range(d + 1):
            n = short + (i >= d + 1 - more)
            start = short * i + np.maximum(i - (d + 1 - more), 0)
            low = np.maximum(np.maximum(start - i, start + delta - (d - i)), 0)
            high = np.minimum(np.minimum(start + i, start + delta + (d - i)), size[rows] - n)
            for shift in range(int((high - low).max(initial=-1)) + 1):
                some = np.flatnonzero(low + shift <= high)
                at = begins[rows[some]] + low[some] + shift
                part = (sums[at + n[some]] - sums[at]) * back[at]
                kind = (length[some] * (t + 1) + i).astype(np.uint64)
                found.append((mix64(part + mix64(kind * BASE)), rows[some], np.full(len(some), delta == 0) & (low[some] + shift == start[some])))
    key, at, own = map(np.concatenate, zip(*found, strict=True))
    return key, at, own


def merged(key: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's keys once, own where any of its equal ones is."""
    order = np.lexsort((~own, key, at))
    key, at, own = key[order], at[order], own[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    return key[first], at[first], own[first]


def keys(line: str, t: int) -> list[tuple[int, bool]]:
    """(key, own segment or not) of one line."""
    key, _, own = merged(*all_keys([line], t))
    return list(zip(key.tolist(), own.tolist(), strict=True))


def by_chars(lines: list[str], most: int = 1 << 17) -> Iterator[list[str]]:
    """Runs of whole lines of about ``most`` characters in all."""
    held, chars = [], 0
    for x in lines:
        held.append(x)
        chars += len(x)
        if chars >= most:
            yield held
            held, chars = [], 0
    if held:
        yield held


def padded(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as rows filled up with 0, and the lengths."""
    size = np.array([len(x) for x in lines], dtype=np.int64)
    out = np.zeros((len(lines), int(size.max()) if len(lines) else 0), dtype=np.uint32)
    for row, x in enumerate(lines):
        out[row, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out, size


def within(left: list[str], right: list[str], t: int) -> np.ndarray:
    """Which pairs are within edit distance ``t``.

    The band of 2t + 1 cells around the diagonal is one word per pair; its
    vertical differences move down one row with each character of the text,
    so a column costs a few word operations for all pairs at once. Pairs
    whose distance can no longer come down to ``t`` leave early.
    """
    result = np.zeros(len(left), dtype=bool)
    same = np.array([a == b for a, b in zip(left, right, strict=True)], dtype=bool)
    result[same] = True
    todo = np.array([i for i in range(len(left)) if not same[i] and abs(len(left[i]) - len(right[i])) <= t], dtype=np.int64)
    if len(todo) <= FEW:
        for i in todo:
            result[i] = _one(left[i], right[i], t)
        return result
    todo = todo[np.argsort([len(left[i]) for i in todo], kind="stable")]
    for k in range(0, len(todo), 2048):
        part = todo[k : k + 2048]
        result[part] = _band([left[i] for i in part], [right[i] for i in part], t)
    return result


def near(left: list[str], right: list[str], p: Params) -> np.ndarray:
    """Which pairs of lines are within the edits that the shorter of each allows."""
    if min((len(x) for x in (*left, *right)), default=0) >= p.distance * p.per_edit:
        return within(left, right, p.distance)
    edits = allowed(np.array([min(len(a), len(b)) for a, b in zip(left, right, strict=True)], dtype=np.int64), p.distance, p.per_edit)
    result = np.zeros(len(left), dtype=bool)
    for t in np.unique(edits).tolist():
        some = np.flatnonzero(edits == t)
        result[some] = within([left[k] for k in some], [right[k] for k in some], t)
    return result


def _one(pattern: str, text: str, t: int) -> bool:
    """As ``_band`` for a single pair, the pattern's matches looked up by character."""
    m, n, width = len(pattern), len(text), 2 * t + 1
    if not n:
        return m <= t
    full, at = (1 << width) - 1, {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << (i + t)
    vp, vn, dist = full & ~((1 << t) - 1), 0, min(m, t)
    for j, c in enumerate(text):
        eq = at.get(c, 0) >> j & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j + t < m:
            dist += 1 - (d0 >> (width - 1) & 1)
        else:
            bit = min(max(m - j - 1 + t, 0), width - 1)
            dist += (hp >> bit & 1) - (hn >> bit & 1)
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
        if dist > 2 * t + abs(n - m):
            return False
    return dist <= t


def _band(pattern: list[str], text: list[str], t: int) -> np.ndarray:
    (p, m), (s, n) = padded(pattern), padded(text)
    width, one = 2 * t + 1, np.uint64(1)
    full = np.uint64((1 << width) - 1)
    columns = int(n.max())
    wide = np.zeros((len(p), t + max(p.shape[1], columns) + t + 1), dtype=np.uint32)
    wide[:, t : t + p.shape[1]] = p  # 0 before, behind and nowhere inside a text
    alive = np.arange(len(p))
    vp = np.full(len(p), full & ~np.uint64((1 << t) - 1), dtype=np.uint64)
    vn = np.zeros(len(p), dtype=np.uint64)
    dist = np.minimum(m, t)
    final = np.full(len(p), t + 1, dtype=np.int64)
    final[n == 0] = m[n == 0]
    for j in range(columns):
        eq = np.zeros(len(alive), dtype=np.uint64)
        char = s[alive, j]
        for k in range(width):
            eq |= (wide[alive, j + k] == char).astype(np.uint64) << np.uint64(k)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        down = j + t < m[alive]  # the lowest cell of the band is still inside the pattern
        bit = np.clip(m[alive] - j - 1 + t, 0, width - 1).astype(np.uint64)
        side = (hp >> bit & one).astype(np.int64) - (hn >> bit & one).astype(np.int64)
        dist = dist + np.where(down, 1 - (d0 >> np.uint64(width - 1) & one).astype(np.int64), np.where(j < n[alive], side, 0))
        vp = (hn | ~((d0 >> one) | hp)) & full
        vn = (d0 >> one) & hp
        ended = n[alive] == j + 1
        if ended.any():
            final[alive[ended]] = dist[ended]
        if ended.any() or j % 16 == 15:
            stay = ~ended & (dist <= 2 * t + np.abs(n[alive] - m[alive]))
            alive, vp, vn, dist = alive[stay], vp[stay], vn[stay], dist[stay]
            if not len(alive):
                break
    return final <= t


def line_hash(line: str) -> int:
    """64 bits that stand for a line, as a signed integer."""
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def occurrences(base: DataFrame) -> DataFrame:
    """__row, __id, line_no and line (hash) of every line with a visible character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ids, no, line = [], [], [], []
            for r, i, text in zip(b.column("__row").to_pylist(), b.column("__id").to_pylist(), texts_of(b, "__text"), strict=True):
                for k, x in enumerate(text.split("\n")):
                    x = x.strip()
                    if x:
                        row.append(r)
                        ids.append(i)
                        no.append(k)
                        line.append(line_hash(x))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, ids, no, line)], names=["__row", "__id", "line_no", "line"])

    return base.select("__row", "__id", "__text").mapInArrow(released(run), "__row long, __id long, line_no long, line long")


def key_rows(base: DataFrame, p: Params, only: Bloom | None = None) -> DataFrame:
    """key, line, own.

    With ``only``, the rows whose key passes it, with weight; and for each of
    their lines a row with its text and no key.
    """
    columns = "key long, line long, own boolean" + (", weight long, text string" if only else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                lines = {x.strip() for text in texts_of(whole.slice(i, 500), "__text") for x in text.split("\n")}
                for part in by_chars([x for x in lines if len(x) >= p.per_edit]):
                    line = np.array([line_hash(x) for x in part], dtype=np.int64)
                    key, at, own = all_keys(part, p.distance, p.per_edit)
                    if only is None:
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(line[at]), pa.array(own)], names=["key", "line", "own"])
                        continue
                    stays = only.passes(key.view(np.int64))
                    key, at, own = merged(key[stays], at[stays], own[stays])
                    some = np.unique(at)
                    weight = np.array([len(x) for x in part], dtype=np.int64) + 256
                    columns_ = [
                        pa.array(np.concatenate([key.view(np.int64), np.zeros(len(some), np.int64)]), mask=np.arange(len(key) + len(some)) >= len(key)),
                        pa.array(line[np.concatenate([at, some])]),
                        pa.array(np.concatenate([own, np.zeros(len(some), bool)])),
                        pa.array(weight[np.concatenate([at, some])]),
                        pa.array([None] * len(key) + [part[k] for k in some], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns_, names=["key", "line", "own", "weight", "text"])

    return base.select("__text").mapInArrow(released(run), columns)


class _Cell:
    """The lines of a cell: pruned by counts of characters, verified by edit distance."""

    def __init__(self, held: pa.Table, p: Params) -> None:
        self.p, self.own, self.text = p, held.column("own").to_numpy(), held.column("text").to_pylist()
        self.counts = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 31, minlength=32) for x in self.text]).astype(np.int32)

    def likely(self, i: int, others: np.ndarray) -> np.ndarray:
        """An edit changes two counts by one at most."""
        others = others[self.own[i] | self.own[others]]
        return others[np.abs(self.counts[others] - self.counts[i]).sum(axis=1) <= 2 * self.p.distance]

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return near([self.text[i] for i in a], [self.text[j] for j in b], self.p)


def links(base: DataFrame, p: Params) -> DataFrame:
    """(u, root) over line hashes: which lines belong together, as ``components`` gives it."""
    meet = key_rows(base, p).groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.bool_or("own").alias("own"), F.count(F.lit(1)).alias("n"))
    open_ = materialise(meet.filter(F.col("own") & (F.col("a") != F.col("b"))).select("key", F.col("a").alias("least"), "n"), "open_keys")
    again = materialise(key_rows(base, p, Bloom(open_, "key")), "key_rows")
    members = again.filter(F.col("key").isNotNull()).drop("text").dropDuplicates(["key", "line"])
    members = materialise(join_spread(members, open_, "key", "n").select("key", F.col("line").alias("node"), "own", "weight", "least"), "members")
    texts = again.filter(F.col("key").isNull()).select(F.col("line").alias("node"), "text").dropDuplicates(["node"])
    texts = materialise(texts.join(members.select("node").distinct(), "node", "left_semi"), "line_texts")

    stars = members.filter(F.col("node") != F.col("least")).select(F.col("least").alias("u"), F.col("node").alias("v")).distinct()
    both = stars.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select(["u", "v"]).filter(pa.array(near(b.column("tu").to_pylist(), b.column("tv").to_pylist(), p)))

    roots = components(materialise(both.select("u", "v", "tu", "tv").mapInArrow(verify, "u long, v long"), "line_links"))
    rooted = members.join(roots.withColumnRenamed("u", "node"), "node", "left").select("key", "node", "own", "weight", F.coalesce("root", "node").alias("root"))
    met = materialise(cells(materialise(rooted, "rooted"), p.cell), "cells")
    if met.isEmpty():
        return roots
    more = materialise(links_across(met, texts, lambda held: _Cell(held, p)), "line_links")
    return components(more.unionByName(roots.select("u", F.col("root").alias("v"))))


def dedup_lines(docs: DataFrame, params: Params | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of their texts, and ``removed_lines``, the numbers of those.

    The first occurrence of each group of lines near each other (directly or
    over others; short lines only if equal) stays: that of the smallest id, null last,
    then of the first row and line. Repeated rows lose their lines like any
    other copies. Null and empty texts, and lines without a visible character, come
    back as they were; a column named removed_lines is replaced.
    """
    p = params or Params()
    docs = docs.drop("removed_lines")
    plain, names, (id_at, text_at) = masked(docs, id_col, text_col)
    source = plain.withColumns({"__id": F.col(id_at).cast("long"), "__text": F.col(text_at).cast("string")}).drop(text_at)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            yield b.append_column("__row", pa.array(np.arange(row, row + b.num_rows)))
            row += b.num_rows

    base = materialise(source.mapInArrow(number, schema_with(source, "__row long")), "lines")
    seen = materialise(occurrences(base), "occurrences")
    place = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"), F.col("line_no").alias("no"))
    each = seen.groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    linked = links(base, p)
    named = linked.select("u", "root").unionByName(linked.select(F.col("root").alias("u"), "root").distinct())
    grouped = each.join(named.withColumnRenamed("u", "line"), "line", "left").filter((F.col("n") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "line"))
    size = grouped.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).filter(F.col("all") > 1)
    repeated = materialise(grouped.join(size, "root").select("line", "kept"), "repeated")
    gone = seen.join(repeated, "line").filter(~((F.col("kept.row") == F.col("__row")) & (F.col("kept.no") == F.col("line_no"))))
    gone = materialise(gone.groupBy("__row").agg(F.array_sort(F.collect_list("line_no")).alias("removed_lines")), "gone")

    touched = Bloom(gone, "__row")
    some = touched.rows(base, "__row").join(gone.hint("merge"), "__row", "left")  # the list grows with the corpus
    none = touched.rows(base, "__row", passing=False).withColumn("removed_lines", F.lit(None).cast("array<long>"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for text, lines in zip(b.column("__text").to_pylist(), b.column("removed_lines").to_pylist(), strict=True):
                out = set(lines or ())
                left.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in out) if out else text)
            yield b.set_column(b.schema.get_field_index("__text"), "__text", pa.array(left, pa.string()))

    both = some.select(*none.columns).mapInArrow(released(cut), none.schema).unionByName(none)
    return both.select(*[F.col("__text" if c == text_at else c).alias(n) for c, n in zip(plain.columns, names, strict=True)], F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
