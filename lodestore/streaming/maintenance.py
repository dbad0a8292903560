"""Maintenance of streamed collections: all of them and all their levels, once or every so often."""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence

from ..operators.topology import COMPACT_RATIO
from .ingest import Ingest


class Maintenance:
    """Compacts collections by name; a collection is one Ingest, or one for each of its levels.

    The mapping may change between passes.  start() makes a pass every `period`
    seconds, of one second where it isn't positive, until stop().
    """

    def __init__(self, collections: Mapping[str, Ingest | Sequence[Ingest]], period: float = 1.0, ratio: float = COMPACT_RATIO) -> None:
        self.collections, self.period, self.ratio = collections, period if period > 0 else 1.0, ratio
        self._ended, self._thread, self._error = threading.Event(), None, None

    def once(self) -> dict[str, int]:
        """One pass: how many levels of each collection were written anew."""
        levels = {name: [c] if isinstance(c, Ingest) else list(c) for name, c in list(self.collections.items())}
        return {name: sum(level.compact(self.ratio) for level in parts) for name, parts in levels.items()}

    def start(self) -> None:
        """Starts passes in the background, unless they run."""
        if self._thread is None:
            self._ended.clear()
            self._thread = threading.Thread(target=self._passes, daemon=True)
            self._thread.start()

    def _passes(self) -> None:
        while not self._ended.wait(self.period):
            try:
                self.once()
            except Exception as e:  # noqa: BLE001  stop() raises it
                self._error = e
                return

    def stop(self) -> None:
        """Waits for the pass that runs, and ends; an error of a pass is raised here."""
        self._ended.set()
        if self._thread is not None:
            self._thread.join()
        self._thread, error, self._error = None, self._error, None
        if error is not None:
            raise error
