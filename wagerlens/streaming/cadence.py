"""Refresh classes at their own intervals, each turn from one snapshot of the log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..config import REFRESH_CLASSES
from . import refresh


def run(
    read: Callable[[], DataFrame], out: str, classes: tuple[int, ...] = (1, 2, 3), *, where: str | None = None, turns: int | None = None,
    check: Callable[[dict], list[str]] = lambda made: [], clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
) -> list[tuple[int, ...]]:
    """Refresh what is due, again and again; returns the classes of each turn (turns None: for ever).

    A turn reads the log once for all classes that are due then, so that their artifacts agree.  A class is due its
    interval after its last turn began; one that takes longer than that runs again at once and never twice at a time.  A turn whose
    artifacts fail check() is not written: what was there stays, and the class is due at the next turn.
    """
    due, done = {c: clock() for c in classes}, []
    while turns is None or len(done) < turns:
        now = clock()
        mine = tuple(c for c in classes if due[c] <= now)
        if mine:
            made = refresh.refresh(read(), mine, where=where)
            if not check(made):
                refresh.write(made, out)
            for c in mine:
                due[c] = now + REFRESH_CLASSES[c][0]
            done.append(mine)
        else:
            sleep(max(0.0, min(due.values()) - now))
    return done
