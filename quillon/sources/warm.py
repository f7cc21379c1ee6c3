"""Segments that are kept in the executors' storage, the least recently used going first, and what to load ahead.

Only names and counts are on the driver. The blocks are Spark's: one that is lost with its executor is read from Parquet
again. Segments that searches use together are counted, and those that most often went with a segment are loaded ahead.
"""

from __future__ import annotations

import time
from collections import Counter, OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from quillon.errors import InvalidConfig
from quillon.operators import knn
from quillon.sources.collection import Collection


class WarmCache:
    """At most capacity segments of a collection; one that nobody has used for idle_seconds goes at evict_stale()."""

    def __init__(self, collection: Collection, capacity: int = 50, idle_seconds: float = 300.0, ahead: int = 3):
        if capacity < 1 or ahead < 0:
            raise InvalidConfig("capacity must be positive and ahead not negative")
        self.collection, self.capacity, self.idle_seconds, self.ahead = collection, capacity, idle_seconds, ahead
        self._held: OrderedDict[str, tuple[DataFrame, float]] = OrderedDict()
        self._together: dict[str, Counter] = {}
        self.counts = Counter(hits=0, misses=0, evictions=0, prefetches=0)

    def _load(self, segment_id: str) -> DataFrame:
        df = self.collection.vectors([segment_id]).persist(StorageLevel.MEMORY_AND_DISK)
        self._held[segment_id] = df, time.monotonic()
        while len(self._held) > self.capacity:
            self._drop(next(iter(self._held)))
            self.counts["evictions"] += 1
        return df

    def _drop(self, segment_id: str) -> None:
        self._held.pop(segment_id)[0].unpersist()

    def get(self, segment_id: str) -> DataFrame:
        """The vectors of a segment, kept from their first use on."""
        if segment_id in self._held:
            self.counts["hits"] += 1
            self._held.move_to_end(segment_id)
            df = self._held[segment_id][0]
            self._held[segment_id] = df, time.monotonic()
            return df
        self.counts["misses"] += 1
        return self._load(segment_id)

    def record(self, segments: list[str]) -> None:
        """Counts that one search used these segments."""
        for a in set(segments):
            self._together.setdefault(a, Counter()).update(b for b in set(segments) if b != a)

    def predict(self, segment_id: str) -> list[str]:
        """The segments that most searches used with this one, ties by name."""
        near = self._together.get(segment_id, Counter())
        return [x for x, _ in sorted(near.items(), key=lambda x: (-x[1], x[0]))[: self.ahead]]

    def prefetch(self, segment_id: str) -> list[str]:
        """Loads what predict() names and isn't held; the names."""
        new = [x for x in self.predict(segment_id) if x not in self._held and self.collection.router_contains(x)]
        for x in new:
            self._load(x).count()  # fills the blocks
            self.counts["prefetches"] += 1
        return new

    def evict_stale(self) -> int:
        """Lets go of idle segments and of those that compaction has removed; how many."""
        now = time.monotonic()
        old = [x for x, (_, used) in self._held.items() if now - used > self.idle_seconds or not self.collection.router_contains(x)]
        for x in old:
            self._drop(x)
        self.counts["evictions"] += len(old)
        return len(old)

    def clear(self) -> None:
        for x in list(self._held):
            self._drop(x)

    def stats(self) -> dict[str, int]:
        return dict(self.counts) | {"segments": len(self._held)}

    def search(self, query: list[float], k: int = 10, nprobe: int = 4, top_m: int = 0) -> DataFrame:
        """(id, distance) as Collection.search() gives it, from kept segments: the top_m nearest, or all."""
        c = self.collection
        self.evict_stale()
        names = [r["segment_id"] for r in knn.select_segments(c.router(), query, top_m, c.config.metric).collect()]
        self.record(names)
        parts = [knn.search(c.staging(), query, k, c.config.metric)]
        for name in names:
            parts.append(knn.ivf_search(self.get(name), c.centroids([name]), query, k, nprobe, c.config.metric, ["segment_id"]))
        return knn.merge(parts, k)
