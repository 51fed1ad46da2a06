"""Chat sessions as state: appended turns, inactivity, and hand-over to a store.

A session holds its last messages and its last turns. It ends when nobody has
added a turn for ``ttl``: then its turns are handed over as rows and its state
is gone. In a stream each session is a key of ``transformWithState``; a timer
on event time, set anew by each turn, ends it, so the state of a finished input
empties as its watermark moves on. ``held_table`` and ``ended_table`` give the
rows of a finished table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# The agent of a turn that names none; seconds, messages and turns that a session is kept for and keeps.
NO_AGENT = "A0000001"
TTL, MESSAGES, TURNS = 4500, 20, 50

#: session_id, user_id, agent, question, answer, at: what a turn is.
HELD = "session_id long, n_turns int, messages array<struct<role:string,content:string>>"
ENDED = "session_id long, user_id long, agent string, question string, answer string, at_ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upgraded(version: int | None, messages: list[Any] | None, turns: list[Any] | None) -> tuple[list[tuple], list[tuple]]:
    """(messages, turns) of a stored session; version 1 was a list of messages only."""
    said = [(m["role"], m["content"]) for m in messages or []]
    return said, [] if version == 1 else [(t["agent"], t["question"], t["answer"], t["at_ms"]) for t in turns or []]


class Sessions(StatefulProcessor):
    """Appends turns to their session; gives the session after each batch (``held``), or its turns once it has ended (``ended``)."""

    def __init__(self, gives: str, ttl: int, messages: int, turns: int) -> None:
        self.gives, self.ttl_ms, self.most_messages, self.most_turns = gives, 1000 * ttl, messages, turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "user_id long, last_ms long")
        self.messages = handle.getListState("messages", "role string, content string")
        self.turns = handle.getListState("turns", "agent string, question string, answer string, at_ms long")

    def keep(self, user: int | None, last: int, messages: list[tuple], turns: list[tuple]) -> None:
        """The session as it now is, and its one timer."""
        self.about.update((user, last))
        for state, rows in ((self.messages, messages[-self.most_messages :]), (self.turns, turns[-self.most_turns :])):
            state.clear()
            if rows:
                state.put(rows)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(last + self.ttl_ms)

    def load(self) -> tuple[int | None, int | None, list[tuple], list[tuple]]:
        if not self.about.exists():
            return None, None, [], []
        return (*self.about.get(), list(self.messages.get()), list(self.turns.get()))

    def rows(self, session: int, user: int | None, turns: list[tuple]) -> Iterator[Row]:
        """What a session that has ended leaves; nothing if no user owns it."""
        if self.gives == "ended" and user is not None:
            for agent, question, answer, at in turns[-self.most_turns :]:
                if question and answer:
                    yield Row(session_id=session, user_id=user, agent=agent or NO_AGENT, question=question, answer=answer, at_ms=at)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        messages, turns = upgraded(initialState["version"], initialState["messages"], initialState["turns"])
        self.keep(initialState["user_id"], initialState["last_ms"], messages, turns)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        user, last, messages, turns = self.load()
        for r in sorted(rows, key=lambda r: (r["at_ms"], r["question"], r["answer"])):
            if last is not None and r["at_ms"] - last >= self.ttl_ms:  # it ended before this turn, though its timer is yet to fire
                yield from self.rows(key[0], user, turns)
                user, messages, turns = None, [], []
            user, last = r["user_id"] if r["user_id"] is not None else user, max(last or 0, r["at_ms"])
            messages = [*messages, ("user", r["question"]), ("assistant", r["answer"])][-self.most_messages :]
            turns = [*turns, (r["agent"], r["question"], r["answer"], r["at_ms"])][-self.most_turns :]
        self.keep(user, last, messages, turns)
        if self.gives == "held":
            yield Row(session_id=key[0], n_turns=len(turns), messages=[Row(role=a, content=b) for a, b in messages])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        user, _, _, turns = self.load()
        yield from self.rows(key[0], user, turns)
        for state in (self.about, self.messages, self.turns):
            state.clear()

    def close(self) -> None:
        pass


def stripped(column: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^\s+|\s+$", "")


def valid(turns: DataFrame) -> DataFrame:
    """Turns whose question and answer, without outer blanks, are both there."""
    clean = turns.withColumns({"question": stripped("question"), "answer": stripped("answer")}).filter("question <> '' AND answer <> ''")
    return clean.select("session_id", "user_id", "agent", "question", "answer", "at", F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"))


def run_sessions(turns: DataFrame, gives: str, *, ttl: int = TTL, messages: int = MESSAGES, max_turns: int = TURNS, late: str = "10 minutes", stored: DataFrame | None = None) -> DataFrame:
    """A stream of turns as ``HELD`` or ``ENDED`` rows.

    ``stored`` (session_id, version, user_id, last_ms, messages, turns) are the
    sessions that were there before; those of version 1 are upgraded. Turns of
    one batch are taken by time; those more than ``late`` behind the newest may
    come after their session has ended and then open another.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = valid(turns).withWatermark("at", late)
    before = None if stored is None else stored.groupBy("session_id")
    mode = {"held": "update", "ended": "append"}[gives]
    return timed.groupBy("session_id").transformWithState(Sessions(gives, ttl, messages, max_turns), {"held": HELD, "ended": ENDED}[gives], mode, "eventTime", before)


def into_store(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch to a folder of its own and stop when the input is read.

    A batch that failed is written again in whole, from the same state, so
    what the sink could not take stays and nothing is there twice.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    mode = "append" if "at_ms" in rows.columns else "update"
    return rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def runs(turns: DataFrame, ttl: int) -> DataFrame:
    """Valid turns with ``run``, which counts the times that their session had ended before them, and their place from its end."""
    in_order = Window.partitionBy("session_id").orderBy("at_ms", "question", "answer")
    new = F.coalesce((F.col("at_ms") - F.lag("at_ms").over(in_order) >= 1000 * ttl).cast("int"), F.lit(0))
    numbered = valid(turns).withColumn("new", new).withColumn("run", F.sum("new").over(in_order))
    back = Window.partitionBy("session_id", "run").orderBy(F.desc("at_ms"), F.desc("question"), F.desc("answer"))
    return numbered.withColumn("back", F.row_number().over(back)).drop("new")


def held_table(turns: DataFrame, *, ttl: int = TTL, messages: int = MESSAGES, max_turns: int = TURNS) -> DataFrame:
    """The last state of each session of a finished table, as ``HELD`` rows."""
    found = runs(turns, ttl)
    last = found.join(found.groupBy("session_id").agg(F.max("run").alias("run")), ["session_id", "run"])
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    wanted = last.filter(F.col("back") <= max(max_turns, messages)).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("n"), pair.alias("pair")))).alias("t"))
    said = F.flatten(F.transform("t", lambda x: x["pair"]))
    return wanted.select("session_id", F.least(F.size("t"), F.lit(max_turns)).alias("n_turns"), F.slice(said, -F.least(F.size(said), F.lit(messages)), messages).alias("messages"))


def ended_table(turns: DataFrame, *, ttl: int = TTL, max_turns: int = TURNS, late: int = 600) -> DataFrame:
    """The turns that ended sessions of a finished table leave: those of earlier runs, and of last runs that the end of the table left behind by ``ttl`` and ``late`` seconds."""
    found = runs(turns, ttl)
    in_run = Window.partitionBy("session_id", "run")
    by_time = in_run.orderBy("at_ms", "question", "answer").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = found.withColumns({"last": F.max("at_ms").over(in_run), "owner": F.last("user_id", True).over(by_time), "later": F.max("run").over(Window.partitionBy("session_id")) > F.col("run")})
    end = valid(turns).agg((F.max("at_ms") - 1000 * late).alias("end"))
    over = F.col("later") | (F.col("last") + 1000 * ttl < F.col("end"))
    kept = known.crossJoin(F.broadcast(end)).filter(over & F.col("owner").isNotNull() & (F.col("back") <= max_turns))
    return kept.select("session_id", F.col("owner").alias("user_id"), F.coalesce("agent", F.lit(NO_AGENT)).alias("agent"), "question", "answer", "at_ms")
