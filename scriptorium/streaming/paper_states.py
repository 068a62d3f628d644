"""Papers of a batch as a stream of status changes, each paper's state kept by the stream.

Changes (``key, status, at, seq``) come by micro-batches. A paper's state is its status, how often it
was begun and since when; the table of valid transitions decides whether a change is taken over. A failed paper may
be begun once more (the retry), after which it stays failed. One that was begun and not heard of for 24 hours is
pending again: by a timer when the stream's event time has passed that moment, or by its next
change, whichever comes first, with the same result. States live in the stream's checkpoint, so
a stream that is stopped and started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from scriptorium.streaming.waves import TRANSITIONS

STALE_MS = 24 * 3600 * 1000
MOST_ATTEMPTS = 2  # the first one and the retry
LATE = "1 hour"

CHANGES = "key string, seq long, at_ms long, old string, new string, accepted boolean, attempts int, reason string"
_STATE = StructType([StructField("status", StringType()), StructField("attempts", IntegerType()), StructField("since", LongType())])


def step(state: tuple[str, int, int | None], status: str | None, at: int) -> tuple[tuple[str, int, int | None], str]:
    """(the state after a change, why it was not taken over or '')."""
    old, attempts, since = state
    if status not in TRANSITIONS.get(old, ()):
        return state, "no such transition"
    if status == "in-progress":
        if attempts >= MOST_ATTEMPTS:
            return state, "no third attempt"
        return (status, attempts + 1, at), ""
    return (status, attempts, None), ""


def stale_at(state: tuple[str, int, int | None]) -> int | None:
    """When a begun paper is given up, in milliseconds."""
    return state[2] + STALE_MS if state[0] == "in-progress" and state[2] is not None else None


class PaperStates(StatefulProcessor):
    """The state of one paper after another change; see the module's text.

    Papers have few changes each, so these come and go as rows: a data frame for each paper would be most of the work.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)

    def _now(self) -> tuple[str, int, int | None]:
        held = self.state.get()  # one call; asking whether there is one would be another
        return ("pending", 0, None) if held is None else tuple(held)

    def _given_up(self, key: str, state: tuple[str, int, int | None]) -> tuple[tuple, tuple]:
        """A stale paper is pending again; the attempt doesn't count, as it had no result."""
        after = ("pending", state[1] - 1, None)
        return after, (key, None, stale_at(state), state[0], "pending", True, after[1], "stale")

    def _keep(self, before: tuple, after: tuple) -> None:
        self.state.update(after)
        if (old := stale_at(before)) is not None and old != stale_at(after):
            self.handle.deleteTimer(old)
        if (new := stale_at(after)) is not None and new != old:
            self.handle.registerTimer(new)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = state = self._now()
        out = []
        for at, _, seq, status in sorted(((r.at_ms, r.seq is None, r.seq, r.status) for r in rows), key=_by_time):
            if (limit := stale_at(state)) is not None and at > limit:
                state, row = self._given_up(key[0], state)
                out.append(row)
            after, reason = step(state, status, at)
            out.append((key[0], seq, at, state[0], status, not reason, after[1], reason))
            state = after
        self._keep(first, state)
        yield from map(_row, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state = self._now()
        if (limit := stale_at(state)) is None or limit > expiredTimerInfo.getExpiryTimeInMs():
            return
        after, row = self._given_up(key[0], state)
        self.state.update(after)
        yield _row(row)

    def close(self) -> None:
        pass


_NAMES = [c.split()[0] for c in CHANGES.split(", ")]


def _row(change: tuple) -> Row:
    return Row(**dict(zip(_NAMES, change)))


def _by_time(change: tuple) -> tuple:
    """Order of a paper's changes: time, then ``seq``, rows without one last."""
    at, lacking, seq, _ = change
    return at, lacking, 0 if lacking else seq


def status_changes(stream: DataFrame) -> DataFrame:
    """Every change of a stream (``key, status, at, seq``) with the status it met and whether it was taken over.

    Rows without a key or a time are passed over; unknown and null statuses are no transitions. Papers given up
    appear as changes without ``seq``. Rows of one batch are taken in order of time, then ``seq``.
    """
    own = stream.where("key IS NOT NULL AND at IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("status").cast("string").alias("status"), F.col("at"), F.col("seq").cast("long").alias("seq"))
    timed = own.withWatermark("at", LATE).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("key").transformWithState(statefulProcessor=PaperStates(), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def run_states(stream: DataFrame, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """The changes of all that has come, appended to ``folder`` once each; started again, it takes what came since.

    A batch's rows stand under its number, and a batch that is run again replaces its own.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if handle:
            handle(batch, number)

    return status_changes(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_states(changes: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """``(key, status, attempts, n_changes, n_refused)`` after all changes; begun papers of over 24 hours before ``now_ms`` are pending.

    Papers are compared by their own last accepted change, so it doesn't matter which batch made it.
    """
    taken = F.when(F.col("accepted"), F.struct("at_ms", F.col("seq").isNotNull().alias("own"), "seq"))
    last = changes.groupBy("key").agg(
        F.max_by(F.struct("new", "attempts", "at_ms"), taken).alias("x"), F.count_if(F.col("accepted")).alias("n_changes"), F.count_if(~F.col("accepted")).alias("n_refused")
    )
    stale = F.lit(False) if now_ms is None else F.coalesce((F.col("x.new") == "in-progress") & (F.col("x.at_ms") + STALE_MS < now_ms), F.lit(False))
    return last.select(
        "key",
        F.when(stale | F.col("x").isNull(), "pending").otherwise(F.col("x.new")).alias("status"),
        F.when(stale, F.col("x.attempts") - 1).otherwise(F.coalesce("x.attempts", F.lit(0))).alias("attempts"),
        (F.col("n_changes") + stale.cast("int")).alias("n_changes"),
        "n_refused",
    )
