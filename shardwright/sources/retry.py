"""Opening what a network may lend out late: passing errors are waited out inside the task, lasting ones aren't."""

from __future__ import annotations

import gzip
import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
#: Seconds between tries.
DELAYS = (0.2, 0.8, 2.0)
#: Errors that no waiting mends.
LASTING = (FileNotFoundError, PermissionError, IsADirectoryError, NotADirectoryError, gzip.BadGzipFile)


def retrying(call: Callable[[], T], delays: tuple[float, ...] = DELAYS, sleep: Callable[[float], None] = time.sleep) -> tuple[T, str | None]:
    """What ``call`` gives, and a note if it took more than one try. Lasting errors, and the last try's, are raised."""
    said = None
    for n, delay in enumerate([*delays, None], 1):
        try:
            return call(), said
        except LASTING:
            raise
        except OSError as e:
            if delay is None:
                raise
            said = f"opened at try {n + 1} after {type(e).__name__}"
            sleep(delay)
    raise AssertionError("unreachable")
