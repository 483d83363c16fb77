"""How long the phases of a build take: kept by name, and logged."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

logger = logging.getLogger("sieveline")


class Phases:
    """Seconds by phase, summed where a phase recurs. Outermost phases are logged as information, inner ones for debugging."""

    def __init__(self, clock=time.perf_counter):
        self.clock, self.seconds, self._depth = clock, {}, 0

    @contextmanager
    def phase(self, name: str):
        began = self.clock()
        self._depth += 1
        try:
            yield
        finally:
            self._depth -= 1
            took = self.clock() - began
            self.seconds[name] = self.seconds.get(name, 0.0) + took
            logger.log(logging.DEBUG if self._depth else logging.INFO, "%s: %.2f s", name, took)
