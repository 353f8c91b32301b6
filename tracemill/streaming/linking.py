"""Parent links as a stream: an account's last requests as typed state.

Rows wait until the watermark has passed their time, so an account's requests are linked in order of (end_ms, request_id) whatever
order and micro-batch they came in, and the links are those of `lineage.links` over the same rows. State is a list of waiting
rows, a map of the last LOOKBACK linked requests by number, and the number of the last; nothing older is kept.

An account is one key, so its links are made one after another: linking looks 128 requests back and each moves the window.
Rows later than the watermark allows are dropped by Spark and counted in its progress; `windows.route_late` keeps such rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lineage import LOOKBACK, SHARED_TENTHS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGNALS = "request_id string, end_ms long, emitted_ids array<string>, replayed_ids array<string>, answer_shingles array<string>, replayed_shingles array<string>"
HELD = "request_id string, emitted_ids array<string>, answer_shingles array<string>"
LINKS = "request_id string, parent_request_id string, link string"
_COLUMNS = [c.split()[0] for c in SIGNALS.split(", ")]


class Recent:
    """The last requests of an account by number, and where each key of theirs was last seen."""

    def __init__(self, held: dict[int, tuple], lookback: int) -> None:
        self.held, self.lookback = held, lookback
        self.emitted: dict[str, int] = {}
        self.phrases: dict[str, set[int]] = {}
        for rn in sorted(held):
            self._index(rn)

    def _index(self, rn: int) -> None:
        _, ids, answers = self.held[rn]
        self.emitted |= dict.fromkeys(ids, rn)
        for phrase in set(answers):
            self.phrases.setdefault(phrase, set()).add(rn)

    def parent(self, replayed: set[str], text: set[str]) -> tuple[str | None, str | None]:
        """The nearest request that emitted a replayed id, else the nearest whose answer the text holds to nine tenths."""
        near = max((self.emitted[k] for k in replayed if k in self.emitted), default=None)
        if near is not None:
            return self.held[near][0], "tool_id"
        shared = Counter(rn for phrase in text for rn in self.phrases.get(phrase, ()))
        near = max((rn for rn, n in shared.items() if 10 * n >= SHARED_TENTHS * len(set(self.held[rn][2]))), default=None)
        return (None, None) if near is None else (self.held[near][0], "text")

    def add(self, rn: int, row: tuple) -> int | None:
        """Takes a request in; the number of the one that leaves."""
        self.held[rn] = row
        self._index(rn)
        gone = rn - self.lookback
        if gone not in self.held:
            return None
        _, ids, answers = self.held.pop(gone)
        for k in ids:
            if self.emitted.get(k) == gone:
                del self.emitted[k]
        for phrase in set(answers):
            self.phrases[phrase].discard(gone)
            if not self.phrases[phrase]:
                del self.phrases[phrase]
        return gone


class Links(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", SIGNALS)
        self.recent = handle.getMapState("recent", "rn long", HELD)
        self.last = handle.getValueState("last", "rn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [tuple(list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v for v in r) for batch in rows for r in batch[_COLUMNS].itertuples(index=False)]
        self.waiting.appendList(came)
        first = min(int(r[1]) for r in came)
        if first not in list(self.handle.listTimers()):
            self.handle.registerTimer(first)
        yield pd.DataFrame({"request_id": [], "parent_request_id": [], "link": []}, dtype=str)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[1], r[0]))
        due = [r for r in rows if r[1] <= until]
        later = rows[len(due) :]
        out = list(self._link(due)) if due else []
        if later:
            self.waiting.put(later)
            if int(later[0][1]) not in list(self.handle.listTimers()):
                self.handle.registerTimer(int(later[0][1]))
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["request_id", "parent_request_id", "link"], dtype=object)

    def _link(self, rows: list[tuple]) -> Iterator[tuple]:
        number = self.last.get()[0] if self.last.exists() else 0
        recent = Recent({int(k[0]): (v[0], list(v[1]), list(v[2])) for k, v in self.recent.iterator()}, LOOKBACK)
        new: dict[int, tuple] = {}
        for request_id, _, emitted, replayed, answers, text in rows:
            number += 1
            yield request_id, *recent.parent(set(replayed or ()), set(text or ()))
            row = (request_id, list(emitted or ()), list(answers or ()))
            gone = recent.add(number, row)
            new[number] = row
            if gone is not None and new.pop(gone, None) is None:
                self.recent.removeKey((gone,))
        for rn, row in new.items():
            self.recent.updateValue((rn,), row)
        self.last.update((number,))

    def close(self) -> None:
        pass


def linked(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Signals (request_id, user_id, end_ms, emitted_ids, replayed_ids, answer_shingles, replayed_shingles) to links. delay: how late a row may come.
    A null account is one account. State is kept in RocksDB."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = stream.select(F.coalesce("user_id", F.lit("\x00")).alias("account"), *_COLUMNS, F.timestamp_millis("end_ms").alias("at")).withWatermark("at", delay)
    return timed.groupBy("account").transformWithStateInPandas(statefulProcessor=Links(), outputStructType=LINKS, outputMode="Append", timeMode="EventTime")
