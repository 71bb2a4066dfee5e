"""A GET that tries again where that can help, and its rule as expressions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers worth another try, tries in all, first delay, its growth and its bound in seconds.
AGAIN, ATTEMPTS, BASE, GROWTH, LONGEST = (429, 500, 502, 503, 504), 4, 1.5, 2, 20.0


class HttpError(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def delay(attempt: int, base: float = BASE) -> float:
    """Seconds to wait after this attempt (from 1)."""
    return min(base * GROWTH ** (attempt - 1), LONGEST)


def get(send: Callable[[], tuple[int, bytes]], attempts: int = ATTEMPTS, base: float = BASE, wait: Callable[[float], None] = time.sleep) -> bytes:
    """send() -> (status, body), or OSError where the connection failed. Faults that stay (404) are raised at once."""
    for n in range(1, attempts + 1):
        try:
            status, body = send()
            if status < 400:
                return body
            if status not in AGAIN or n == attempts:
                raise HttpError(status)
        except OSError:
            if n == attempts:
                raise
        wait(delay(n, base))
    raise AssertionError("not reached")


def outcome(statuses: Column) -> Column:
    """What get does with these answers (0: the connection failed): struct<calls, status>."""
    first = F.slice(statuses, 1, ATTEMPTS)
    settled = F.filter(F.transform(first, lambda s, i: F.when((s != 0) & ~s.isin(*AGAIN), i + 1)), lambda i: i.isNotNull())
    calls = F.coalesce(F.get(settled, F.lit(0)), F.size(first))
    return F.struct(calls.alias("calls"), F.element_at(first, calls).alias("status"))
