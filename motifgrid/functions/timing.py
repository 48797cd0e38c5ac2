"""Phase times and throughput of a run."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

log = logging.getLogger("motifgrid")


@dataclass
class Phases:
    """Seconds by phase; a phase that runs again adds up."""

    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield self
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
            log.debug("%s: %.3f s", name, self.seconds[name])

    def throughput(self, n: int, m: int, name: str = "evaluate") -> dict[str, float]:
        """Matrix entries a second (both triangles outside the band) and cells that were really computed."""
        p, band = n - m + 1, m // 4
        took = max(self.seconds.get(name, 0.0), 1e-9)
        return {"entries_per_s": (p - band) ** 2 / took, "cells_per_s": max(0, p - band - 1) * (p - band) / 2 / took}
