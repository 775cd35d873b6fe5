"""Results that are kept for a while: least recently used ones go first, old ones expire, hits are counted."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class CacheMetrics:
    hits: int = 0
    misses: int = 0
    evictions: int = 0

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class FrameCache:
    """Persisted DataFrames by key, at most ``capacity`` of them, each for ``ttl`` seconds; what leaves is unpersisted."""

    def __init__(self, capacity: int = 64, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.ttl, self.clock, self.metrics = capacity, ttl, clock, CacheMetrics()
        self._held: OrderedDict[Hashable, tuple[float, DataFrame]] = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def get(self, key: Hashable, make: Callable[[], DataFrame] | None = None) -> DataFrame | None:
        """The frame of a key; where it is missing or expired that of ``make``, which is then kept, or None."""
        held = self._held.get(key)
        if held is not None and self.clock() - held[0] < self.ttl:
            self._held.move_to_end(key)
            self.metrics.hits += 1
            return held[1]
        self.metrics.misses += 1
        if held is not None:
            self.invalidate(key)
        if make is None:
            return None
        self.put(key, make())
        return self._held[key][1]

    def put(self, key: Hashable, frame: DataFrame) -> None:
        self.invalidate(key)
        while len(self._held) >= max(1, self.capacity):
            _, (_, old) = self._held.popitem(last=False)
            old.unpersist()
            self.metrics.evictions += 1
        self._held[key] = (self.clock(), frame.persist())

    def invalidate(self, key: Hashable) -> None:
        if key in self._held:
            self._held.pop(key)[1].unpersist()

    def clear(self) -> None:
        for key in list(self._held):
            self.invalidate(key)
