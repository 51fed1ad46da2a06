"""Chunks against golden rows and plain versions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary import plans
from granary.functions import tables, text
from granary.operators import chunking
from granary.plans import chunk_queries

MARKS = ["\n\n", "\n", ".", " "]


def plain_split(raw, size, overlap, marks=MARKS):
    """The public description of the splitter, one step after the other."""
    mark = marks[-1]
    left = []
    for k, m in enumerate(marks):
        if m in raw:
            mark, left = m, marks[k + 1 :]
            break
    out, short = [], []

    def merge():
        held = []
        for p in short:
            if held and sum(map(len, held)) + len(p) > size:
                out.append("".join(held).strip())
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held.pop(0)
            held.append(p)
        out.append("".join(held).strip())
        short.clear()

    pieces = re.split(f"(?={re.escape(mark)})", raw) if mark != "\n\n" else [x if k == 0 else mark + x for k, x in enumerate(raw.split(mark))]
    for p in [x for x in pieces if x]:
        if len(p) < size:
            short.append(p)
            continue
        merge()
        out.extend(plain_split(p, size, overlap, left) if left else [p])
    merge()
    return [c for c in out if c]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(1, 60), st.integers(0, 9))
def test_recursive_equals_the_plain_version(raw, size, overlap):
    assert chunking.recursive(raw, size, overlap) == plain_split(raw, size, overlap)


@pytest.mark.parametrize(
    "raw, size, overlap, chunks",
    [
        ("aaa\n\nx one. y two. z three. w four\n\nbbb", 20, 0, ["aaa", "x one. y two", ". z three. w four", "bbb"]),
        ("aaa\n\nbbb\n\nccc", 10, 5, ["aaa\n\nbbb", "bbb\n\nccc"]),
        ("abcde fgh", 5, 0, ["abcde", "fgh"]),  # a piece of exactly the size is long
        ("abcdefghij", 4, 0, ["abcdefghij"]),
        ("", 4, 0, []),
        (" \n\n . ", 4, 0, ["."]),
    ],
)
def test_golden_chunks(raw, size, overlap, chunks):
    assert chunking.recursive(raw, size, overlap) == chunks


GRID = "\n".join(f"| {k} | {'x' * 8} |" for k in range(6))


@pytest.mark.parametrize(
    "raw, size, units",
    [
        ("intro\n" + GRID + "\nafter", 50, [("", "intro", False), ("", GRID, True), ("", "after", True)]),
        ("a b\n| c |\nd e", 50, [("", "a b\n| c |\nd e", True)]),
        ("0123456789\n| c |\nd e", 12, [("", "0123456789", False), ("", "| c |\nd e", True)]),
        ("01234\n| c |", 10, [("", "01234\n| c |", False)]),  # 5 + 5 fit, the line end makes 11: cut after all
        (GRID, 20, [("", GRID, True)]),
        ("", 20, [("", "", True)]),
    ],
)
def test_golden_table_units(raw, size, units):
    assert list(chunking.table_units(raw, size)) == units


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["| a |", "| bbbbbbbbbb |", "t", "text text text", "", "x" * 30]), max_size=20), st.integers(5, 60))
def test_table_units_keep_blocks_in_order(lines, size):
    raw = "\n".join(lines)
    units = list(chunking.table_units(raw, size))
    assert "\n".join(body for _, body, _ in units) == raw
    groups, held = [], []
    for is_table, block in _blocks(lines):  # fill up, one block after the other
        if held and sum(len(b) for _, b in held) + len(block) > size:
            groups.append(held)
            held = []
        held.append((is_table, block))
        if is_table and len(block) > size:
            groups.append(held)
            held = []
    groups += [held] if held else []
    assert [body for _, body, _ in units] == ["\n".join(b for _, b in g) for g in groups]


def _blocks(lines):
    found = []
    for line in lines or [""]:
        kind = line.startswith("|")
        if found and found[-1][0] == kind:
            found[-1][1].append(line)
        else:
            found.append((kind, [line]))
    return [(kind, "\n".join(rows)) for kind, rows in found]


Q, A = chunking.QUESTION, chunking.ANSWER


def units_of(spark, raw, size):
    df = spark.createDataFrame([(raw,)], "t string").select(chunking.pair_units(F.col("t"), F.lit(size)).alias("u"))
    return [tuple(u) for u in df.first().u]


@pytest.mark.parametrize(
    "raw, size, units",
    [
        ("no marks here", 50, [("", "no marks here", False)]),
        (f"title\n{Q} : q1\n{A} : a1", 50, [("", f"title\n\n{Q} : q1\n\n{A} : a1", True)]),
        (f"title\n{Q} : q1\n{A} : a1", 15, [(f"title\n\n{Q} : q1\n\n", f"{A} : a1", False)]),
        (f"{Q}: q1 {Q} : q2 {A}: a2 {A}: a3", 99, [("", f"{Q}: q1", True), ("", f"{Q} : q2\n\n{A}: a2", True), ("", f"\n\n{A}: a3", True)]),
        (f"{Q}: {'q' * 30} {Q}: q2", 20, [("", f"{Q}: {'q' * 30}", False), ("", f"{Q}: q2", True)]),
        (f" \n{A}: a1 ", 20, [("", f" \n{A}: a1 ", False)]),  # one part only
        (f"one {Q} no colon\n{Q}: q", 50, [("", f"one {Q} no colon\n\n{Q}: q", True)]),
    ],
)
def test_golden_pairs(spark, raw, size, units):
    assert units_of(spark, raw, size) == units


def test_children():
    assert chunking.children_of("a" * 500) == ["a" * 500]
    assert chunking.children_of(" " + "a b. " * 20) == [" " + "a b. " * 20]
    long = " ".join(f"word{k}" for k in range(200))
    assert chunking.children_of(long) == plain_split(long, 500, 50) and len(chunking.children_of(long)) > 2


def plain_rows(r, policy):
    """What one record becomes."""
    kind, splitter, size, overlap = policy
    raw, title = r["content"] or "", r["title"] or ""
    prefix = "[" + r["source_file"] + (" > " + (title[:50] + "…" if len(title) > 50 else title) if title else "") + "]"
    if kind == "never" or (kind == "optional" and len(raw) <= 3500):
        return [(str(r["id"]), "standalone", None, None, None, f"{prefix} {raw}")]
    if splitter == "table_aware":
        units = list(chunking.table_units(raw, size))
    elif splitter == "qa_aware":
        head, question, answer = re.fullmatch(rf"(?s)(.*?)({Q}\s*:.*?)({A}\s*:.*)", raw).groups()
        head, question, answer = head.strip(), question.strip(), answer.strip()
        before = (head + "\n\n" if head else "") + question + "\n\n"
        units = [("", before + answer, True)] if len(before + answer) <= size else [(before, answer, False)]
    else:
        units = [("", raw, False)]
    parents = [b + c for b, body, whole in units for c in ([body] if whole else plain_split(body, size, overlap)) if (b + c).strip()]
    rows = []
    for k, parent in enumerate(parents):
        rows.append((str(r["id"]), "parent", f"{r['id']}_{k}", k, None, f"{prefix} {parent}"))
        rows += [(str(r["id"]), "child", f"{r['id']}_{k}", k, c, f"{prefix} {x}") for c, x in enumerate([parent] if len(parent) <= 500 else plain_split(parent, 500, 50))]
    return rows


def test_the_scan_equals_a_plain_version(spark, sf):
    import hashlib

    found = plans.QUERIES["s02_chunking_scan"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1 and "Exchange" not in plan
    got = sorted(tuple(str(x) for x in (r.id, r.chunk_type, r.parent_id, r.chunk_index, r.child_index, r.length, r.body_md5)) for r in found.collect())
    want = []
    for r in chunk_queries.records(spark, sf).collect():
        for *row, body in plain_rows(r, chunk_queries.POLICIES.get(r["source_file"], ("never", None, 0, 0))):
            want.append(tuple(str(x) for x in (*row, len(body), hashlib.md5(body.encode()).hexdigest())))
    assert got == sorted(want)
    assert len({r[1] for r in got}) == 3


@pytest.mark.parametrize("name", ["h01_recursive_split", "h02_dispatched_split", "h03_table_aware_split", "h04_pair_preserving_split", "h05_parents_and_children"])
def test_splits_are_one_pass(spark, sf, name):
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1


def test_whole_table_through_the_splitter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sorted((r.doc_id, r.chunk_index, r.chunk) for r in chunking.chunk(docs).collect())
    want = sorted((r.doc_id, k, c) for r in docs.collect() for k, c in enumerate(plain_split(r.text or "", 1500, 150)))
    assert got == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "qa_aware", 7), (1, None, "qa_aware", 7), (None, "a", None, 8), (2, "", "table_aware", 9), (3, "b", "x", None)], "id long, text string, by string, chunk_index int")
    found = chunking.chunk(df, splitter=F.col("by"))
    assert sorted((r.id is None, r.id or 0, r.chunk_index, r.chunk) for r in found.collect()) == [(False, 3, 0, "b"), (True, 0, 0, "a")]
    assert chunking.chunk(df.limit(0)).count() == 0
    rows = chunking.index_rows(df, id_col="id", text_col="text", prefix=F.lit(None), policy=F.lit("never"), splitter=F.col("by"), size=F.lit(9), overlap=F.lit(0))
    assert sorted((r.id, r.chunk_type, r.body) for r in rows.collect()) == [("", "standalone", "a"), ("1", "standalone", ""), ("1", "standalone", ""), ("2", "standalone", ""), ("3", "standalone", "b")]


def test_bracketed(spark):
    df = spark.createDataFrame([("a", "b" * 51), ("", "b"), (None, None), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(text.bracketed(F.col("x"), F.col("y"))).collect()] == ["[a > " + "b" * 50 + "…]", "[b]", "", "[a]"]


@pytest.mark.parametrize(
    "above, row, filled",
    [
        (["a", "b", "1"], ["", "c", "2"], ["a", "a(c)", "2"]),
        (["a", "b", "1"], ["", "", "2"], ["a", "b", "b(2)"]),
        (["a", "b", "1"], ["x", "", "2"], ["x", "", "2"]),
        (["a", "b", "1"], ["a", "", "2"], ["a", "", "2"]),
        (["a", "b"], ["a", "a"], ["a", "a"]),
        (["", "b"], ["", "c"], ["", "c"]),
        (["a", "b"], ["a", "b"], ["a", "b"]),
    ],
)
def test_rows_of_a_table_are_filled_from_above(above, row, filled):
    assert tables._filled(above, row) == filled
