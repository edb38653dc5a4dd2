"""Work queues with time: claims by priority, retries that come due, leases that run out, as state with timers.

Commands of a queue are applied in order of time. Before each, whatever has come due by its time is applied, so the
changes do not depend on how commands fall into micro-batches; timers see to it where no command comes. A queue's
items are a map in the state store. Beside it stand the best of those that could be claimed, HEAD at most, so
a claim reads no other item, and the times at which waiting or claimed items come due.

A queue is sequential by definition: work that needs no common order belongs in several queues.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from siltstone.streaming.events import TERMINAL, moved

HEAD = 1_000  # claimable items that stand beside the map; when they are used up they are drawn from it again
CHANGES = "queue long, at timestamp, item string, state string, attempts int, next_retry_at timestamp, reason string"
_ITEM = "state string, attempts int, priority double, since double"
#: Fixed value: what is said of work that a crash left running.
INTERRUPTED = "interrupted_run_reset"


class Queue:
    """The rules, over a store with ``get``, ``put`` and ``all`` of items (state, attempts, priority, since)."""

    def __init__(self, store, head=(), more=False, later=(), most=3, base=30.0, cap=3600.0, lease=600.0, retry_first=False, size=HEAD):
        self.store, self.head, self.more, self.later = store, list(head), more, list(later)
        self.most, self.base, self.cap, self.lease, self.retry_first, self.size = most, base, cap, lease, retry_first, size
        self.out: list[tuple] = []

    def _said(self, at: float, item: str, state: str, attempts: int, due: float | None, reason: str) -> None:
        self.out.append((at, item, state, attempts, due, reason))

    def _rank(self, item: str, state: str, priority: float) -> tuple:
        """Claims take the least: retries first, or the highest priority; then the least item."""
        return (0.0 if state == "retry" else 1.0, item) if self.retry_first else (-priority, item)

    def _open(self, item: str, state: str, priority: float) -> None:
        rank = self._rank(item, state, priority)
        if self.more and self.head and rank > tuple(self.head[-1]):
            return  # worse than what the head holds: the map knows it
        if self.more and not self.head:
            return
        insort(self.head, rank)
        if len(self.head) > self.size:
            self.head.pop()
            self.more = True

    def _refill(self, at: float) -> None:
        waiting = {i for _, i in self.later}
        ranks = sorted(self._rank(i, s, p) for i, (s, a, p, _) in self.store.all() if s in ("pending", "retry") and i not in waiting and a < self.most)
        self.head, self.more = ranks[: self.size], len(ranks) > self.size

    def _wait(self, time: float, item: str) -> None:
        insort(self.later, (time, item))

    def _close(self, item: str) -> None:
        """Nothing waits for the item any more, and it can't be claimed."""
        self.later = [x for x in self.later if x[1] != item]
        self.head = [x for x in self.head if x[1] != item]

    def due(self, until: float) -> None:
        """Apply what comes due up to ``until``: leases end, retries can be claimed."""
        while self.later and self.later[0][0] <= until:
            at, item = self.later.pop(0)
            state, attempts, priority, _ = self.store.get(item)
            if state == "in_progress":
                self._interrupted(at, item, attempts, priority)
            else:
                self._open(item, state, priority)
                self._said(at, item, state, attempts, None, "due")

    def _interrupted(self, at: float, item: str, attempts: int, priority: float) -> None:
        state = "retry" if attempts < self.most else "failed"
        self.store.put(item, (state, attempts, priority, at))
        if state == "retry":
            self._open(item, state, priority)
        self._said(at, item, state, attempts, None, INTERRUPTED)

    def add(self, at: float, item: str, priority: float) -> None:
        """A new item; one that is there keeps state and attempts, and its priority rises if the new one is greater."""
        old = self.store.get(item)
        if old is None:
            self.store.put(item, ("pending", 0, priority, at))
            self._open(item, "pending", priority)
            self._said(at, item, "pending", 0, None, "added")
        elif priority > old[2]:
            self.store.put(item, (old[0], old[1], priority, old[3]))
            if old[0] in ("pending", "retry") and not any(i == item for _, i in self.later):
                self.head = [x for x in self.head if x[1] != item]
                self._open(item, old[0], priority)

    def claim(self, at: float, n: int) -> None:
        """Up to ``n`` items, best first; a claim is an attempt and lasts for the lease."""
        for _ in range(n):
            if not self.head and self.more:
                self._refill(at)
            if not self.head:
                return
            item = self.head.pop(0)[1]
            state, attempts, priority, _ = self.store.get(item)
            state, attempts, _ = moved(state, attempts, "claim", at, self.most, self.base, self.cap)
            self.store.put(item, (state, attempts, priority, at))
            self._wait(at + self.lease, item)
            self._said(at, item, state, attempts, None, "claimed")

    def finish(self, at: float, item: str, outcome: str) -> None:
        """An outcome (ok, skip, error) of an item that is in progress; any other item's counts for nothing."""
        old = self.store.get(item)
        if old is None or old[0] != "in_progress":
            return
        state, attempts, retry = moved(old[0], old[1], outcome, at, self.most, self.base, self.cap)
        self._close(item)
        self.store.put(item, (state, attempts, old[2], at))
        if state == "retry":
            self._wait(retry, item)
        self._said(at, item, state, attempts, retry if state == "retry" else None, outcome)

    def reset(self, at: float) -> None:
        """After a crash: all that is in progress goes back to retry."""
        for item in sorted(i for _, i in self.later):
            state, attempts, priority, _ = self.store.get(item)
            if state == "in_progress":
                self._close(item)
                self._interrupted(at, item, attempts, priority)

    def apply(self, at: float, kind: str, item: str | None, number: float | None) -> None:
        self.due(at)
        if kind == "add":
            self.add(at, item, number or 0.0)
        elif kind == "claim":
            self.claim(at, 1 if number is None else int(number))
        elif kind == "reset":
            self.reset(at)
        elif kind in ("ok", "skip", "error"):
            self.finish(at, item, kind)
        else:
            raise ValueError(f"no command {kind!r}")


def _frame(name: int, queue: Queue) -> pd.DataFrame:
    """The changes that a queue noted, as rows."""
    stamp = lambda x: None if x is None else pd.Timestamp(round(x * 1e6), unit="us")
    rows = [(name, stamp(at), item, state, attempts, stamp(due), reason) for at, item, state, attempts, due, reason in queue.out]
    return pd.DataFrame(rows, columns=["queue", "at", "item", "state", "attempts", "next_retry_at", "reason"]).astype({"at": "datetime64[us]", "next_retry_at": "datetime64[us]"})


class _Store:
    """A queue's items in the state store, those of this batch at hand."""

    def __init__(self, items):
        self.items, self.near, self.changed = items, {}, set()

    def get(self, item: str):
        if item not in self.near:
            self.near[item] = tuple(self.items.getValue((item,))) if self.items.containsKey((item,)) else None
        return self.near[item]

    def put(self, item: str, value: tuple) -> None:
        self.near[item] = value
        self.changed.add(item)

    def all(self) -> Iterator[tuple]:
        for (item,), value in self.items.iterator():
            if item not in self.near:
                yield item, tuple(value)
        yield from ((i, v) for i, v in self.near.items() if v is not None)

    def save(self) -> None:
        for item in sorted(self.changed):
            self.items.updateValue((item,), self.near[item])


class _Processor(StatefulProcessor):
    def __init__(self, rules: dict):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item string", _ITEM)
        self.beside = handle.getValueState("beside", "ranks array<double>, names array<string>, more boolean, times array<double>, waiting array<string>")

    def _run(self, key, work) -> pd.DataFrame:
        store = _Store(self.items)
        ranks, names, more, times, waiting = self.beside.get() if self.beside.exists() else ([], [], False, [], [])
        queue = Queue(store, zip(ranks, names, strict=True), more, zip(times, waiting, strict=True), **self.rules)
        before = set(queue.later)
        work(queue)
        store.save()
        ranks, names = map(list, zip(*queue.head, strict=True)) if queue.head else ([], [])
        times, waiting = map(list, zip(*queue.later, strict=True)) if queue.later else ([], [])
        self.beside.update((ranks, names, queue.more, times, waiting))
        for time in {t for t, _ in set(queue.later) - before}:
            self.handle.registerTimer(int(time * 1000) + 1)
        return _frame(key[0], queue)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        commands = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")  # one queue's of one batch

        def work(queue: Queue) -> None:
            for at, kind, item, number in zip(commands["at"], commands["kind"], commands["item"], commands["number"], strict=True):
                queue.apply(at, kind, None if pd.isna(item) else item, None if pd.isna(number) else float(number))

        yield self._run(key, work)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = min(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() or expiredTimerInfo.getExpiryTimeInMs()) / 1000
        yield self._run(key, lambda queue: queue.due(until))

    def close(self) -> None:
        pass


def _rocks(spark: SparkSession) -> None:
    """Timers need the RocksDB state store: the session gets it if it has Spark's default."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def changes(commands: DataFrame, late: str = "0 seconds", most: int = 3, base: float = 30.0, cap: float = 3600.0, lease: float = 600.0, retry_first: bool = False) -> DataFrame:
    """(queue, at, item, state, attempts, next_retry_at, reason): every change of ``commands`` (queue, at, seq, kind, item, number), a stream or a table.

    Commands: add (``number``: priority), claim (``number``: how many), ok, skip, error of an item, reset. Of equal times the
    least ``seq`` goes first. An item is claimed ``most`` times at most and waits between by doubling from ``base`` up to ``cap`` seconds; a claim
    that has no outcome within ``lease`` seconds counts as interrupted. ``retry_first``: retries before new items, each by
    name, instead of by priority. A stream drops commands that come more than ``late`` behind the newest.
    Rows without queue, time or kind, and outcomes without an item, count for nothing.
    """
    known = commands.where("queue IS NOT NULL AND at IS NOT NULL AND kind IS NOT NULL AND (item IS NOT NULL OR kind IN ('claim', 'reset'))")
    rows = known.select(F.col("queue").cast("long").alias("queue"), F.col("at").alias("_time"), (F.unix_micros("at") / 1e6).alias("at"), "seq", "kind", F.col("item").cast("string").alias("item"), F.col("number").cast("double").alias("number"))
    rules = {"most": most, "base": base, "cap": cap, "lease": lease, "retry_first": retry_first}
    if not commands.isStreaming:
        return _all_at_once(rows.drop("_time"), rules)
    _rocks(commands.sparkSession)
    return rows.withWatermark("_time", late).groupBy("queue").transformWithStateInPandas(_Processor(rules), CHANGES, "Append", "EventTime")


def _all_at_once(rows: DataFrame, rules: dict) -> DataFrame:
    """The same changes of a table: each queue's commands stream through its task in order."""

    class Kept(dict):
        put = dict.__setitem__

        def all(self):
            return iter(self.items())

    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue = Queue(Kept(), **rules)
        for part in parts:
            for at, kind, item, number in zip(part["at"], part["kind"], part["item"], part["number"], strict=True):
                queue.apply(at, kind, None if pd.isna(item) else item, None if pd.isna(number) else float(number))
            yield _frame(key[0], queue)
            queue.out = []

    return rows.repartition("queue").sortWithinPartitions("queue", "at", "seq").groupBy("queue").applyInPandas(run, CHANGES)
