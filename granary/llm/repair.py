"""Repair of conversations whose turns were lost, emptied, cut, repeated or mislabelled.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Every
turn can be kept, given another role, or deleted, and empty turns can be
inserted; the cheapest edits win, of equal cost those whose initials come first
in ASCII. All turns are numbered once in the order of their conversations,
which cuts the table into batches of bounded size and each long conversation
into segments. A task takes a batch, and one recursive DuckDB query advances
all segments of it by one turn at each recursion, keeping the least (cost,
audit) for each grammar state. A segment that may continue a conversation is
walked from every state it may be entered in, so the segments of a conversation
join like matrices of least costs, however long the conversation is.

Neither numbering nor faults need texts: they use a digest of role and text.
Texts are shuffled once, when repaired turns are written out in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialise, read_table, released
from granary.llm.importance import CRC_TABLE, crc_sql
from granary.llm.ordering import numbered

SEGMENT, BATCH = 256, 8192  # turns; a batch holds whole segments
WHITE = " \t\n\x0b\f\r"

#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. A complete reading ends in 0 or 3.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DELETE, INSERT, REROLE, UNDELETED = 2, 5, 1, 5


def fill(state: int) -> str:
    """The initial that an inserted or renamed turn takes in this state."""
    return "a" if state == 2 else "u"


def steps() -> list[tuple[int, str, str, int, int]]:
    """(state, letters, initial needed or '', cost, next state) of everything that can be done with one turn, insertions before it included.

    More than two insertions in a row come back to a state that fewer reach.
    """
    found = []
    for state in range(4):
        at = state
        for inserts in range(3):
            letters, cost = "I" * inserts, INSERT * inserts
            found.append((state, letters + "D", "", cost + DELETE, at))
            found.append((state, letters + "R", "", cost + REROLE, NEXT[at, fill(at)]))
            found += [(state, letters + "K", c, cost, to) for (s, c), to in NEXT.items() if s == at]
            at = NEXT[at, fill(at)]
    return found


#: Letters that complete a reading which ends in the state.
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}

WALK = f"""
WITH RECURSIVE walk AS (
  SELECT seg, entry, entry AS state, 0::BIGINT AS i, 0::BIGINT AS cost, '' AS audit FROM segments, range(4) AS r(entry) WHERE entry = 0 OR may_continue
  UNION ALL
  SELECT seg, entry, state, i, best.cost, best.audit FROM (
    SELECT w.seg, w.entry, s.next_state AS state, w.i + 1 AS i,
      min({{'cost': w.cost + s.cost + CASE WHEN t.truncated AND NOT s.deletes THEN {UNDELETED} ELSE 0 END, 'audit': w.audit || s.letters}}) AS best
    FROM walk AS w JOIN turns AS t ON t.seg = w.seg AND t.i = w.i
      JOIN steps AS s ON s.state = w.state AND (s.deletes OR NOT t.must_go) AND (s.initial = '' OR s.initial = t.initial)
    GROUP BY w.seg, w.entry, s.next_state, w.i)
), ends AS (
  SELECT seg, list({{'entry': entry::INT, 'state': state::INT, 'cost': cost, 'audit': audit}}) AS paths FROM walk JOIN segments USING (seg) WHERE i = n GROUP BY seg
)
SELECT conv_id, block, first, last, illegal, blank, duplicate, truncated, paths FROM segments JOIN ends USING (seg)
"""
SET_UP = (
    "CREATE OR REPLACE TABLE steps(state BIGINT, letters VARCHAR, initial VARCHAR, cost BIGINT, next_state BIGINT, deletes BOOLEAN)",
    f"""CREATE OR REPLACE TEMP TABLE turns AS
    SELECT *, number // {SEGMENT} AS block, dense_rank() OVER (ORDER BY number // {SEGMENT}, conv_id NULLS FIRST) AS seg,
      row_number() OVER (PARTITION BY number // {SEGMENT}, conv_id ORDER BY number) - 1 AS i,
      lag(initial) OVER (PARTITION BY number // {SEGMENT}, conv_id ORDER BY number) AS before FROM batch""",
    f"""CREATE OR REPLACE TEMP TABLE segments AS
    SELECT seg, any_value(conv_id) AS conv_id, any_value(block) AS block, count(*) AS n, min(number) % {SEGMENT} = 0 AS may_continue,
      arg_min(initial, number) AS first, arg_max(initial, number) AS last, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
      count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated
    FROM turns GROUP BY seg""",
)
PATHS = "paths array<struct<entry:int,state:int,cost:bigint,audit:string>>"
SUMS = "illegal long, blank long, duplicate long, truncated long"


def walked(batch: pa.Table) -> pa.Table:
    """The segments of one batch with their least (cost, audit) for each pair of entry and end state."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    try:
        con.register("batch", batch)
        con.execute(SET_UP[0])
        con.executemany("INSERT INTO steps VALUES (?, ?, ?, ?, ?, ?)", [(*s, s[1][-1] == "D") for s in steps()])
        for statement in SET_UP[1:]:
            con.execute(statement)
        return con.sql(WALK).to_arrow_table()
    finally:
        con.close()


Paths = dict[tuple[int, int], tuple[int, str]]


def joined(left: Paths, right: Paths) -> Paths:
    """Least (cost, audit) of walking ``left`` and then ``right``."""
    best: Paths = {}
    for (entry, middle), (cost, audit) in left.items():
        for (start, end), (more, rest) in right.items():
            if start == middle and ((entry, end) not in best or cost + more <= best[entry, end][0]):
                found = (cost + more, audit + rest)
                best[entry, end] = min(found, best.get((entry, end), found))
    return best


class Conversation:
    """Adds up the segments of one conversation in their order; equal sizes join first, so long audits are copied few times."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, Paths]] = []
        self.sums = [0, 0, 0, 0]
        self.last: str | None = None

    def add(self, first: str, last: str, sums: list[int], paths: list[dict]) -> None:
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]
        if self.last is not None:
            self.sums[0] += self.last + first not in ("su", "ua", "au")
        self.last = last
        self.parts.append((1, {(p["entry"], p["state"]): (p["cost"], p["audit"]) for p in paths}))
        while len(self.parts) > 1 and self.parts[-1][0] >= self.parts[-2][0]:
            (m, right), (n, left) = self.parts.pop(), self.parts.pop()
            self.parts.append((n + m, joined(left, right)))

    def row(self) -> tuple:
        whole: Paths = {(0, 0): (0, "")}
        for _, paths in self.parts:
            whole = joined(whole, paths)
        cost, audit = min((cost + INSERT * len(CLOSING[state]), audit + CLOSING[state]) for (_, state), (cost, audit) in whole.items())
        return (*self.sums, cost, audit)


def spoken(column: str) -> F.Column:
    return F.coalesce(F.col(column), F.lit(" "))


def digest_of() -> F.Column:
    """sha256 that no two pairs of role and text share."""
    return F.sha2(F.concat(F.length(spoken("role")).cast("string"), F.lit(":"), spoken("role"), spoken("text")), 256)


def judged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) without texts: role initial, digest of role and text, and the faults that one turn shows by itself."""
    role, text = spoken("role"), spoken("text")
    last = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    return turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        digest_of().alias("digest"),
        F.substring(role, 1, 1).alias("initial"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~last.isin(".", "!", "?")).alias("unfinished"),
    )


ORDER = ("turn", "role", "digest")  # nulls first


def report(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns``: its faults, and the cheapest edits.

    ``turns`` has conv_id long, turn long, role string and text string; extra
    columns are ignored. Nulls of role and text are one space. Turns are taken
    by number, nulls first, equal numbers by role and then by the sha256 of
    role and text; repeated rows are turns of their own. A null conv_id is one
    conversation. Returns conv_id, gaps, illegal, blank, duplicate, truncated,
    cost and audit. An empty table gives no rows.
    """
    rows = judged(turns).withColumn("row", F.monotonically_increasing_id())  # equal rows, however many, go to several tasks
    placed = materialise(numbered(rows, [F.asc_nulls_first(c) for c in ("conv_id", *ORDER)] + [F.asc("row")], name="number", label="repair-order"), "repair-turns")
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("is_first"))
    known = placed.join(firsts, "number", "left")
    again = ~F.col("blank") & F.col("is_first").isNull()
    flags = known.select(
        "conv_id",
        "number",
        "initial",
        "blank",
        again.alias("duplicate"),
        (~F.col("blank") & ~again & F.col("unfinished")).alias("truncated"),
        (F.col("blank") | again).alias("must_go"),
    )
    segments = flags.groupBy(F.floor(F.col("number") / BATCH).alias("batch")).applyInArrow(walked, f"conv_id long, block long, first string, last string, {SUMS}, {PATHS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        rows: list[tuple] = []
        at = Conversation()
        for batch in batches:
            for s in batch.to_pylist():
                if ids and s["conv_id"] != ids[-1]:
                    rows.append(at.row())
                if not ids or s["conv_id"] != ids[-1]:
                    ids.append(s["conv_id"])
                    at = Conversation()
                at.add(s["first"], s["last"], [s[c] for c in ("illegal", "blank", "duplicate", "truncated")], s["paths"])
            if len(rows) > 1000:
                yield rows_of(ids[: len(rows)], rows)
                ids, rows = ids[len(rows) :], []
        if ids:
            yield rows_of(ids, [*rows, at.row()])

    def rows_of(ids: list[int | None], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:5]), pa.array([r[5] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "illegal", "blank", "duplicate", "truncated", "cost", "audit"])

    by_conversation = segments.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    edits = by_conversation.mapInArrow(run, f"conv_id long, {SUMS}, cost long, audit string")
    spans = placed.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    return edits.join(spans.withColumnRenamed("conv_id", "same"), F.col("conv_id").eqNullSafe(F.col("same"))).select("conv_id", "gaps", "illegal", "blank", "duplicate", "truncated", "cost", "audit")


def repaired(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns of every conversation after the edits of ``report``: conv_id, place (from 0), edit (K, R or I), role, text.

    A conversation lies in one partition, in order. It streams through its
    task turn by turn behind its audit, so only the audit is held whole.
    """
    said = turns.select("conv_id", F.lit(1).alias("kind"), "turn", spoken("role").alias("role"), digest_of().alias("digest"), spoken("text").alias("text"))
    heads = edits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    stream = heads.unionByName(said).repartition("conv_id").sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv_id", "kind", *ORDER)]).select("conv_id", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        audit, at, state, place, conv = "", 0, 0, 0, None

        def put(edit: str, role: str, text: str) -> None:
            nonlocal at, state, place
            out.append((conv, place, edit, role, text))
            at, place, state = at + 1, place + 1, NEXT[state, role[0]]

        def insert() -> None:
            while audit[at : at + 1] == "I":
                put("I", "assistant" if state == 2 else "user", "")

        for batch in batches:
            for conv_id, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    insert()
                    conv, audit, at, state, place = conv_id, text, 0, 0, 0
                    continue
                insert()
                if audit[at] == "D":
                    at += 1
                elif audit[at] == "K":
                    put("K", role, text)
                else:
                    put("R", "assistant" if state == 2 else "user", text)
            if out:
                yield turn_rows(out)
                out = []
        insert()
        if out:
            yield turn_rows(out)

    return stream.mapInArrow(released(run), "conv_id long, place long, edit string, role string, text string")


def turn_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "place", "edit", "role", "text"])


def digests(turns: DataFrame) -> DataFrame:
    """sha256 of ``role:text``, joined by newlines, for each conversation of ``repaired``, read in the order in which it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        found: list[str] = []
        at = hashlib.sha256()
        for batch in batches:
            for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if ids:
                        found.append(at.hexdigest())
                    ids.append(conv_id)
                    at = hashlib.sha256()
                at.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
            if len(found) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], pa.int64()), pa.array(found)], names=["conv_id", "repaired_sha256"])
                ids, found = ids[-1:], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([*found, at.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with every twentieth turn lost, emptied, cut, repeated or mislabelled, each by the crc32 of ``conv_id:turn``; nulls are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.filter(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_report(originals: DataFrame, turns: DataFrame) -> DataFrame:
    """``report`` and digest for each conversation of ``originals``; those without turns have zeros, no audit and the digest of nothing."""
    edits = materialise(report(turns), "repair-edits")
    found = digests(repaired(turns, edits)).withColumnRenamed("conv_id", "id")
    every = originals.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    known = edits.withColumnRenamed("conv_id", "same")
    joined_rows = every.join(known, F.col("conv_id").eqNullSafe(F.col("same")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined_rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return repair_report(rows, damage(rows))


_STEPS = ", ".join(f"({state}, '{letters}', '{initial}', {cost}, {to})" for state, letters, initial, cost, to in steps())
#: Walks each conversation as a whole and carries its repaired text along.
SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS mark FROM conversations
), drawn AS (
  SELECT *, {crc_sql("mark")} % 20 AS kind FROM keyed, {CRC_TABLE}
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS unfinished FROM ordered
), turns AS (
  SELECT conv_id, turn, role, text, i, n, before, blank, again AND NOT blank AS duplicate, unfinished AND NOT again AND NOT blank AS truncated FROM judged
), steps(state, letters, initial, cost, next_state) AS (VALUES {_STEPS}
), walk AS (
  SELECT DISTINCT conv_id, 0 AS state, 0::BIGINT AS i, 0::BIGINT AS cost, '' AS audit, '' AS said FROM turns
  UNION ALL
  SELECT conv_id, state, i, best.cost, best.audit, best.said FROM (
    SELECT w.conv_id, s.next_state AS state, w.i + 1 AS i, min({{
      'cost': w.cost + s.cost + CASE WHEN truncated AND NOT ends_with(s.letters, 'D') THEN 5 ELSE 0 END, 'audit': w.audit || s.letters,
      'said': w.said || repeat(chr(10) || CASE w.state WHEN 2 THEN 'assistant:' ELSE 'user:' END, least(1, length(s.letters) - 1))
        || repeat(chr(10) || CASE w.state WHEN 2 THEN 'user:' ELSE 'assistant:' END, greatest(0, length(s.letters) - 2))
        || CASE right(s.letters, 1) WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || t.role || ':' || t.text ELSE chr(10) || CASE s.next_state WHEN 3 THEN 'assistant:' ELSE 'user:' END || t.text END
    }}) AS best
    FROM walk AS w JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i
      JOIN steps AS s ON s.state = w.state AND (ends_with(s.letters, 'D') OR NOT (blank OR duplicate)) AND (s.initial = '' OR s.initial = t.role[1])
    GROUP BY w.conv_id, s.next_state, w.i)
), closed AS (
  SELECT conv_id, min({{'cost': cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'said': said || CASE state WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}}) AS best
  FROM walk JOIN (SELECT DISTINCT conv_id AS id, n FROM turns) ON id IS NOT DISTINCT FROM conv_id AND n = i GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN closed ON closed.conv_id IS NOT DISTINCT FROM c.conv_id
"""
