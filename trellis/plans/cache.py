"""A cache of parsed queries: least recently used, with a time to live."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field


@dataclass
class PlanCache:
    most: int = 1000
    ttl: float = 3600.0
    clock: Callable[[], float] = time.monotonic
    entries: OrderedDict = field(default_factory=OrderedDict)
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def get(self, key: Hashable, make: Callable[[], object]) -> object:
        with self.lock:
            found = self.entries.get(key)
            if found is not None and self.clock() - found[1] < self.ttl:
                self.hits += 1
                self.entries.move_to_end(key)
                return found[0]
            self.misses += 1
        value = make()
        with self.lock:
            self.entries[key] = (value, self.clock())
            self.entries.move_to_end(key)
            while len(self.entries) > self.most:
                self.entries.popitem(last=False)
                self.evictions += 1
        return value

    def clear(self) -> int:
        with self.lock:
            n = len(self.entries)
            self.entries.clear()
            return n

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"entries": len(self.entries), "max_entries": self.most, "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "hit_rate": self.hits / asked if asked else 0.0, "ttl_seconds": self.ttl}
