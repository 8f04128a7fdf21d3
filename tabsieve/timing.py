"""A stop-watch for queries."""

from __future__ import annotations

import time


class Timer:
    """Runs from start() or the beginning of a `with` block; `seconds` is the time until stop(), or until now."""

    def __init__(self) -> None:
        self._from: float | None = None
        self._to: float | None = None

    def start(self) -> Timer:
        self._from, self._to = time.perf_counter(), None
        return self

    def stop(self) -> float:
        if self._from is None:
            raise RuntimeError("the timer was not started")
        self._to = time.perf_counter()
        return self.seconds

    @property
    def seconds(self) -> float:
        if self._from is None:
            return 0.0
        return (time.perf_counter() if self._to is None else self._to) - self._from

    def __enter__(self) -> Timer:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()
