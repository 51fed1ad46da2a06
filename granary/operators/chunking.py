"""Splitting texts into overlapping chunks, with tables and question-answer pairs kept whole.

What must stay together is decided first: a text becomes units, each with a
text that goes before all of its chunks, a body, and whether the body is a
chunk as it is. Question-answer units are array expressions, table units come
from the prefix sums of block lengths. Every other body is cut by ``recursive``,
in one pass that looks each row's splitter, size and overlap up and gives
parents, their children, and rows that need no cutting.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import stripped
from granary.sources.schemas import schema_with

SEPARATORS = ("\n\n", "\n", ".", " ")
CHILD_SIZE, CHILD_OVERLAP = 500, 50
OPTIONAL_LEAST = 3500

# What opens a question and an answer.
QUESTION, ANSWER = "질의", "회시"

Unit = tuple[str, str, bool]


def packed(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Pieces joined up to ``size`` characters; a chunk begins with as many last pieces of the one before as ``overlap`` holds."""
    held: list[str] = []
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            yield "".join(held).strip()
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    yield "".join(held).strip()


def recursive(text: str, size: int = 1500, overlap: int = 150, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks cut at the first separator that occurs, which stays at the start of what follows it.

    Runs of pieces under ``size`` are packed; a piece of ``size`` or more is cut
    by itself with the separators that are left, and stays whole without any.
    """
    level = next((k for k, mark in enumerate(separators) if mark in text), len(separators) - 1)
    mark, rest = separators[level], separators[level + 1 :]
    first, *others = text.split(mark)
    parts = [p for p in (first, *(mark + x for x in others)) if p]
    found: list[str] = []
    for is_long, run in groupby(parts, lambda p: len(p) >= size):
        if not is_long:
            found += filter(None, packed(run, size, overlap))
        else:
            found += [c for p in run for c in (recursive(p, size, overlap, rest) if rest else [p])]
    return found


def table_units(text: str, size: int) -> Iterator[Unit]:
    """Runs of lines between pipes are blocks, and so is what stands between them.

    A unit takes as many blocks as have ``size`` characters together, line ends
    between blocks not counted. A table over ``size`` is a unit by itself and is
    never cut; the last unit is not cut either unless it exceeds ``size``.
    """
    in_table = lambda line: line.strip()[:1] == "|" == line.strip()[-1:]
    blocks = [(is_table, "\n".join(lines)) for is_table, lines in groupby(text.split("\n"), in_table)]
    ends = [0, *accumulate(len(block) for _, block in blocks)]
    at = 0
    while at < len(blocks):
        end = max(at + 1, bisect_right(ends, ends[at] + size) - 1)
        body = "\n".join(block for _, block in blocks[at:end])
        large_table = blocks[at][0] and len(blocks[at][1]) > size
        yield "", body, large_table or (end == len(blocks) and len(body) <= size)
        at = end


UNITS = "array<struct<before:string,body:string,whole:boolean>>"


def pair_units(text: Column, size: Column) -> Column:
    """Question-answer pairs as units: an answer too long is cut, with its question before each part.

    The last part that is neither question nor answer stands before all pairs.
    A question without an answer is a pair, and so is an answer without a question.
    """
    parts = F.filter(F.transform(F.split(text, rf"(?U)(?=(?:{QUESTION}|{ANSWER})\s*:)"), stripped), lambda p: p != "")
    opens = lambda p, mark: F.coalesce(F.startswith(p, F.lit(mark)), F.lit(False))
    marked = F.filter(parts, lambda p: opens(p, QUESTION) | opens(p, ANSWER))
    loose = F.filter(parts, lambda p: ~(opens(p, QUESTION) | opens(p, ANSWER)))
    title = F.when(F.size(loose) > 0, F.concat(F.element_at(loose, -1), F.lit("\n\n"))).otherwise("")

    def pair(p: Column, k: Column) -> Column:
        """What an answer, or a question that no answer follows, makes; null for a question whose answer comes next."""
        earlier, later = F.get(marked, k - 1), F.get(marked, k + 1)
        question = F.when(opens(earlier, QUESTION), earlier).otherwise("")
        before = F.concat(title, question, F.lit("\n\n"))
        whole = F.length(before) + F.length(p) <= size
        answered = F.when(whole, unit(F.lit(""), F.concat(before, p), True)).otherwise(unit(before, p, False))
        alone = F.concat(title, p)
        return F.when(opens(p, ANSWER), answered).when(~opens(later, ANSWER), unit(F.lit(""), alone, F.length(alone) <= size))

    unit = lambda before, body, whole: F.struct(before.alias("before"), body.alias("body"), (whole if isinstance(whole, Column) else F.lit(whole)).alias("whole"))
    pairs = F.filter(F.transform(marked, pair), lambda u: u.isNotNull())
    return F.when(F.size(parts) > 1, pairs).otherwise(F.array(unit(F.lit(""), text, False))).cast(UNITS)


SPLITTERS = ("default", "table_aware", "qa_aware")


def chunks_of(units: Iterable[Unit], size: int, overlap: int) -> list[str]:
    found = (before + c for before, body, whole in units for c in ([body] if whole else recursive(body, size, overlap)))
    return [c for c in found if c.strip()]


def children_of(parent: str) -> list[str]:
    return [parent] if len(parent) <= CHILD_SIZE else recursive(parent, CHILD_SIZE, CHILD_OVERLAP)


def should_chunk(length: Column, policy: Column) -> Column:
    """``always``, ``optional`` (from 3501 characters) or anything else: never."""
    return F.when(policy == "always", True).when(policy == "optional", length > OPTIONAL_LEAST).otherwise(False)


def cut(docs: DataFrame, text: Column, *, splitter: Column, size: Column, overlap: Column, eligible: Column, children: bool) -> DataFrame:
    """The columns of ``docs`` with chunk_type (parent, child, standalone), chunk_index, child_index and chunk.

    One pass: a row is cut by its own splitter (an unknown or null one is the
    default) and gives its parents, each followed by its children if asked
    for; a row that is not ``eligible`` gives its text as it is. An eligible
    text that is null or without visible characters gives no row.
    """
    known = F.when(splitter.isin(*SPLITTERS), splitter).otherwise("default")
    body = F.coalesce(text, F.lit(""))
    units = F.when(eligible & (known == "qa_aware"), pair_units(body, size))
    wide = docs.select("*", body.alias("__text"), known.alias("__splitter"), units.alias("__units"), size.cast("int").alias("__size"), overlap.cast("int").alias("__overlap"), F.coalesce(eligible, F.lit(False)).alias("__eligible"))
    names, step = docs.columns, 500

    def rows_of(text: str, splitter: str, units: list[dict] | None, size: int, overlap: int, eligible: bool) -> list[tuple]:
        if not eligible:
            return [("standalone", None, None, text)]
        if splitter == "qa_aware":
            found = [(u["before"], u["body"], u["whole"]) for u in units or ()]
        else:
            found = table_units(text, size) if splitter == "table_aware" else [("", text, False)]
        rows = []
        for k, parent in enumerate(chunks_of(found, size, overlap)):
            rows.append(("parent", k, None, parent))
            if children:
                rows += [("child", k, c, child) for c, child in enumerate(children_of(parent))]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                told = zip(*(b.column(c).to_pylist() for c in ("__text", "__splitter", "__units", "__size", "__overlap", "__eligible")), strict=True)
                found = [rows_of(*row) for row in told]
                flat = [row for rows in found for row in rows]
                kept = b.select(names).take(pa.array([k for k, rows in enumerate(found) for _ in rows], pa.int64()))
                for k, (name, kind) in enumerate((("chunk_type", pa.string()), ("chunk_index", pa.int32()), ("child_index", pa.int32()), ("chunk", pa.string()))):
                    kept = kept.append_column(name, pa.array([row[k] for row in flat], kind))
                yield kept

    return wide.mapInArrow(run, schema_with(docs, "chunk_type string, chunk_index int, child_index int, chunk string"))


def chunk(docs: DataFrame, *, text_col: str = "text", size: int = 1500, overlap: int = 150, splitter: str | Column = "default") -> DataFrame:
    """One row per chunk with ``chunk_index`` and ``chunk``; other columns repeat. Empty and null texts give none.

    ``splitter`` names one for all rows, or is a column that names each row's.
    """
    rest = docs.drop("chunk_type", "chunk_index", "child_index", "chunk")
    by = splitter if isinstance(splitter, Column) else F.lit(splitter)
    found = cut(rest, F.col(text_col), splitter=by, size=F.lit(size), overlap=F.lit(overlap), eligible=F.lit(True), children=False)
    return found.drop("chunk_type", "child_index")


def dispatched(docs: DataFrame, policy: str, **how) -> DataFrame:
    """``chunk`` with the splitter that each row names; any other name means the default one."""
    return chunk(docs, splitter=F.col(policy), **how)


def index_rows(docs: DataFrame, *, id_col: str, text_col: str, prefix: Column, policy: Column, splitter: Column, size: Column, overlap: Column, children: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """id, chunk_type, parent_id, chunk_index, child_index, body and ``keep``: what an index stores of a collection's records.

    ``policy`` says whether a text is cut (``should_chunk``); if not it is one
    stand-alone row. Children are cut from the parent without the prefix; all
    bodies carry it, a space behind it. A parent's id is the record's with the
    chunk's number, a null id counting as empty.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("__body"), F.coalesce(prefix, F.lit("")).alias("__prefix"), policy.alias("__policy"), splitter.alias("__by"), size.alias("__most"), overlap.alias("__over"), *keep)
    eligible = should_chunk(F.length(F.coalesce("__body", F.lit(""))), F.col("__policy"))
    found = cut(base, F.col("__body"), splitter=F.col("__by"), size=F.col("__most"), overlap=F.col("__over"), eligible=eligible, children=children)
    body = F.when(F.col("__prefix") != "", F.concat("__prefix", F.lit(" "), "chunk")).otherwise(F.col("chunk"))
    parent = F.when(F.col("chunk_type") != "standalone", F.concat("id", F.lit("_"), F.col("chunk_index").cast("string")))
    return found.select("id", "chunk_type", parent.alias("parent_id"), "chunk_index", "child_index", body.alias("body"), *keep)


def parents_and_children(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 1500, overlap: int = 150, prefix: Column | None = None) -> DataFrame:
    """id, chunk_type (parent or child), parent_id, child_index, body of records that are all cut."""
    whole = {"policy": F.lit("always"), "splitter": F.lit("default"), "size": F.lit(size), "overlap": F.lit(overlap)}
    return index_rows(docs, id_col=id_col, text_col=text_col, prefix=F.lit("") if prefix is None else prefix, **whole).drop("chunk_index")


def case_parts(docs: DataFrame, head: str, points: str, gist: str, full: str) -> DataFrame:
    """Two rows for each case, ``part`` and ``body``: its summary always, its full text where there is one."""
    some = lambda c, label: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}:\n"), F.col(c)))
    lines = F.array_compact(F.array(F.col(head), F.lit(""), some(points, "판시사항"), F.when(some(points, "").isNotNull(), F.lit("")), some(gist, "판결요지")))
    detail = F.concat(F.col(head), F.lit("\n\n"), some(full, "판례내용"))
    parts = F.array_compact(F.array(F.struct(F.lit("summary").alias("part"), F.array_join(lines, "\n").alias("body")), F.when(detail.isNotNull(), F.struct(F.lit("detail").alias("part"), detail.alias("body")))))
    return docs.select("*", F.explode(parts).alias("__p")).select(*docs.columns, "__p.part", "__p.body")
