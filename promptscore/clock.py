"""The one clock of a run: what is due, when calls are stamped, how long to wait."""

from __future__ import annotations

import time
from datetime import datetime, timezone


class SystemClock:
    """UTC wall clock; answers are stamped with the time they arrive."""

    stamps_calls = True

    def now(self) -> datetime:
        return datetime.now(timezone.utc).replace(tzinfo=None)

    def sleep_until(self, moment: datetime) -> None:
        wait = (moment - self.now()).total_seconds()
        if wait > 0:
            time.sleep(wait)


class ScriptedClock:
    """A clock that moves only when it is waited on, for repeatable runs; calls take no time."""

    stamps_calls = False

    def __init__(self, start: datetime):
        self._now = start

    def now(self) -> datetime:
        return self._now

    def sleep_until(self, moment: datetime) -> None:
        self._now = max(self._now, moment)
