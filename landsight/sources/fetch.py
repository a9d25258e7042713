"""What a fetch needs before its files are read: calls that are tried again, and lists that come in pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import TypeVar

Answer = TypeVar("Answer")


def retried(call: Callable[[], Answer], tries: int = 4, wait_s: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """The answer of a call, tried again after waits that grow by the same step; the last failure is raised."""
    for n in range(1, tries):
        try:
            return call()
        except Exception:  # whatever a client raises
            sleep(wait_s * n)
    return call()


def pages(page_at: Callable[[int], dict], tries: int = 4, wait_s: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Pages of a feature service: each starts after the features so far; the last is empty or says that no more follow."""
    seen, more = 0, True
    while more:
        start = seen
        page = retried(lambda: page_at(start), tries, wait_s, sleep)
        yield page
        seen += len(page.get("features") or ())
        more = seen > start and bool(page.get("exceededTransferLimit"))
