"""Counters of a session that the console shows: statement times, errors, key-range locks and steps of moves."""

from __future__ import annotations

import time
from collections import Counter, deque
from contextlib import contextmanager

#: Quantiles of statement times, and the statements that they look back on.
QUANTILES, KEPT = (0.75, 0.9, 0.999, 0.9999), 10_000


def duration(seconds: float) -> str:
    """A time as the console writes it."""
    return "0s" if not seconds else f"{seconds * 1000:.3f}ms" if seconds < 1 else f"{seconds:.3f}s"


class Statistics:
    def __init__(self):
        self.router, self.shard = deque(maxlen=KEPT), deque(maxlen=KEPT)
        self.errors: Counter = Counter()
        self.locked: dict[str, float] = {}
        self.locks, self.lock_time = 0, 0.0
        self.steps: dict[str, list[float]] = {}

    @contextmanager
    def timed(self, times: deque):
        """Counts the time of a block in milliseconds, and an error under its type."""
        began = time.perf_counter()
        try:
            yield
        except Exception as e:
            self.errors[type(e).__name__] += 1
            raise
        finally:
            times.append((time.perf_counter() - began) * 1000)

    def lock(self, key_range: str, on: bool) -> None:
        if on:
            self.locked[key_range] = time.perf_counter()
        elif (began := self.locked.pop(key_range, None)) is not None:
            self.locks, self.lock_time = self.locks + 1, self.lock_time + time.perf_counter() - began

    @contextmanager
    def step(self, name: str):
        began = time.perf_counter()
        yield
        self.steps.setdefault(name, []).append(time.perf_counter() - began)

    @staticmethod
    def _quantile(times: deque, share: float) -> float:
        """The smallest time that at least this share of the statements didn't exceed."""
        ordered = sorted(times)
        return ordered[min(len(ordered) - 1, max(0, -int(-share * len(ordered) // 1) - 1))] if ordered else 0.0

    def rows(self, target: str) -> list[tuple[str, ...]]:
        if target == "time_quantiles":
            return [(f"{kind}_time_{q:.2f}" if q < 0.99 else f"{kind}_time_{q}", f"{self._quantile(times, q):.2f}") for q in QUANTILES for kind, times in (("router", self.router), ("shard", self.shard))]
        if target == "errors":
            return [(k, str(n)) for k, n in sorted(self.errors.items())]
        if target == "mean_key_range_lock_time":
            return [(duration(self.lock_time / self.locks if self.locks else 0.0),)]
        if target == "move_stats":
            return [(k, duration(sum(v) / len(v))) for k, v in sorted(self.steps.items())]
        return []
