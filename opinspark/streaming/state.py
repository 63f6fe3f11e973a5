"""Keyed state that streams keep: locks of jobs, and contexts with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLASS = "spark.sql.streaming.stateStore.providerClass"


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def spaced(times: list[int], last: int | None, gap: int) -> tuple[list[bool], int | None]:
    """Which of ascending times pass when each must be ``gap`` or more after the last that did, and the last one then."""
    keep = []
    for t in times:
        keep.append(last is None or t - last >= gap)
        last = t if keep[-1] else last
    return keep, last


class Locks(StatefulProcessor):
    """Lets a key's row pass and locks the key for ``seconds`` from that row's time on (``at``); rows meanwhile fall.

    Rows are judged as they arrive, those of one batch in order of time; a row older than the last one that passed falls, for
    that one is newer. A key's state is one number, and stays: there is one a product or user.
    """

    def __init__(self, at: str, tie: str, seconds: int):
        self.at, self.tie, self.gap = at, tie, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.at, self.tie], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        keep, last = spaced(_micros(batch[self.at]), last, self.gap)
        if any(keep):
            self.last.update((last,))
            yield batch[keep]

    def close(self) -> None:
        pass


class OrderedLocks(StatefulProcessor):
    """The same in strict order of time: rows wait in state until the watermark is past them, and a timer judges them then."""

    def __init__(self, at: str, tie: str, seconds: int, schema: StructType):
        self.at, self.tie, self.gap, self.schema = at, tie, seconds * 1_000_000, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else None if pd.isna(x) else x for x in r) for r in frame.astype(object).itertuples(index=False)])
            for t in _micros(frame[self.at]):
                self.handle.registerTimer(-(-t // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.schema.names) if self.waiting.exists() else pd.DataFrame(columns=self.schema.names)
        last = self.last.get()[0] if self.last.exists() else None
        if len(rows):
            rows = rows.sort_values([self.at, self.tie], kind="stable")
            ready = [t <= done for t in _micros(rows[self.at])]
            due, rest = rows[ready], rows[[not r for r in ready]]
            if len(due):
                keep, last = spaced(_micros(due[self.at]), last, self.gap)
                if any(keep):
                    self.last.update((last,))
                    self.handle.registerTimer(-(-(last + self.gap) // 1000))
                if len(rest):
                    self.waiting.put([tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else None if pd.isna(x) else x for x in r) for r in rest.astype(object).itertuples(index=False)])
                else:
                    self.waiting.clear()
                yield due[keep]
                rows = rest
        if not len(rows) and last is not None and last + self.gap <= done:
            self.last.clear()  # the lock has ended, and whatever may still come is later

    def close(self) -> None:
        pass


class Contexts(StatefulProcessor):
    """What was last put for a key answers its asks for ``seconds``; rows of one batch count in order of time, puts first.

    A timer clears what has lived its time once the watermark is past that.
    """

    def __init__(self, seconds: int):
        self.gap = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.put = handle.getValueState("put", "at long, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch.assign(_t=_micros(batch["at"]), _ask=batch["ask_id"].notna()).sort_values(["_t", "_ask", "payload"], kind="stable")
        held = self.put.get() if self.put.exists() else None
        fresh, answers = False, []
        for t, ask, ask_id, payload in zip(batch["_t"], batch["_ask"], batch["ask_id"], batch["payload"], strict=True):
            if not ask:
                if held is None or t >= held[0]:
                    held, fresh = (t, payload), True
            elif held is not None and held[0] <= t and t - held[0] < self.gap:
                answers.append((key[0], int(ask_id), held[1]))
        if fresh:
            self.put.update(tuple(held))
            self.handle.registerTimer(-(-(held[0] + self.gap) // 1000))
        yield pd.DataFrame(answers, columns=["context_id", "ask_id", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.put.exists() and self.put.get()[0] + self.gap <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.put.clear()
        return iter(())

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame) -> DataFrame:
    rows.sparkSession.conf.set(CLASS, STORE)  # the only store that keeps timers and lists
    return rows


def locked(rows: DataFrame, key: str, at: str, seconds: int, late: int = 0) -> DataFrame:
    """A stream's rows that pass: of a key, each ``seconds`` or more after the last one that did.

    With ``late`` 0 a row is judged when it arrives. Else rows wait until nothing older than them can come (``late`` seconds
    behind the newest row), so that the result is that of a batch in whatever order rows come; rows later than that go
    the way of all late rows: Spark drops them, so set it to what the source may be behind.
    """
    tie = "tie_of_row"  # names that begin with an underscore don't reach Python state
    rows = _keyed(rows).withColumn(tie, F.xxhash64(*[c for c in rows.columns if c not in (key, at, "force")]))
    if not late:
        found = rows.groupBy(key).transformWithStateInPandas(Locks(at, tie, seconds), rows.schema, "Append", "None")
    else:
        rows = rows.withWatermark(at, f"{late} seconds")
        schema = StructType.fromJson(rows.schema.jsonValue())
        for field in schema.fields:
            field.metadata = {}
        found = rows.groupBy(key).transformWithStateInPandas(OrderedLocks(at, tie, seconds, schema), schema, "Append", "EventTime")
    return found.drop(tie)


def contexts(rows: DataFrame, seconds: int = 1800, late: int = 86_400) -> DataFrame:
    """A stream of puts (``context_id, at, payload``; ``ask_id`` null) and asks (``ask_id``) -> answered asks: ``context_id, ask_id, payload``.

    Rows may be ``late`` seconds behind the newest one; by then no context of their time is alive.
    """
    rows = _keyed(rows.select("context_id", F.col("ask_id").cast("long").alias("ask_id"), "at", "payload")).withWatermark("at", f"{late} seconds")
    return rows.groupBy("context_id").transformWithStateInPandas(Contexts(seconds), "context_id string, ask_id long, payload string", "Append", "EventTime")
