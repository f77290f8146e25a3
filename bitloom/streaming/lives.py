"""Records with a time to live, kept as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def add_writes(lives: list[tuple[int, int, int]], writes: list[int], ttl: int) -> list[tuple[int, int, int]]:
    """Open lives (first, end, n) after more writes, all in microseconds.

    A write lives for ``ttl`` and renews a life that it falls into; one that comes
    late may join two lives. A write at the very end of a life starts another.
    """
    out: list[tuple[int, int, int]] = []
    for first, end, n in sorted([*lives, *((at, at + ttl, 1) for at in writes)]):
        if out and first < out[-1][1]:
            before = out[-1]
            out[-1] = (before[0], max(before[1], end), before[2] + n)
        else:
            out.append((first, end, n))
    return out


class Lives(StatefulProcessor):
    """Per key the lives that may still be renewed, and one timer, for the first end among them.

    When the timer fires, all lives whose end the watermark has passed are put out at
    once and their state goes, and the timer is set for the first end that is left. So
    a key is visited once for each step of the watermark, however many lives it has; a
    key without open lives has no state at all.
    """

    def __init__(self, ttl_us: int, key: str):
        self._ttl, self._key = ttl_us, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "firsts array<long>, ends array<long>, counts array<long>")

    def _held(self) -> list[tuple[int, int, int]]:
        state = self._open.get()
        return [] if state is None else [tuple(map(int, life)) for life in zip(*state)]

    def _keep(self, lives: list[tuple[int, int, int]]) -> None:
        if lives:
            self._open.update(tuple(list(part) for part in zip(*lives)))
        else:
            self._open.clear()

    def _time(self, before: list[tuple[int, int, int]], after: list[tuple[int, int, int]]) -> None:
        # A timer counts milliseconds; rounded up, it never fires before the end.
        old, new = ({-(-min(end for _, end, _ in part) // 1000)} if part else set() for part in (before, after))
        for at in old - new:
            self._handle.deleteTimer(at)
        for at in new - old:
            self._handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        writes = [int(at) for batch in rows for at in batch["at_us"]]
        lives = add_writes(held, writes, self._ttl)
        self._time(held, lives)
        self._keep(lives)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The timer that fired goes by itself.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        lives = self._held()
        left = [life for life in lives if life[1] > now]
        self._time([], left)
        self._keep(left)
        over = [life for life in lives if life[1] <= now]
        if over:
            firsts, ends, counts = zip(*over)
            yield pd.DataFrame({self._key: [key[0]] * len(over), "first_us": firsts, "end_us": ends, "n": counts})

    def close(self) -> None:
        pass
