"""Calls of services elsewhere: which errors pass, which ask for smaller requests, and retries."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

T = TypeVar("T")
# HTTP statuses that pass by themselves, and what messages of lack of memory and of time contain.
PASSING = (408, 429, 500, 502, 503, 504, *range(520, 528), 530)
MEMORY = r"out of memory|cuda oom|cuda.*memory|memory.*cuda"
TIME = r"timeout|timed out|http 408|http 504"


class RemoteError(RuntimeError):
    """An error of a service, with its HTTP status if there was one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def error_class(message: Column, status: Column) -> Column:
    """`memory` or `time` (a smaller request may do), `passing` (the same request may do later), else `final`."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return F.when(text.rlike(f"(?s){MEMORY}"), "memory").when(text.rlike(TIME), "time").when(status.isin(*PASSING), "passing").otherwise("final")


def class_of(fault: Exception) -> str:
    """The class of one error, as `error_class` says it for rows."""
    import re

    text = f"{type(fault).__name__} {fault}".lower()
    if re.search(MEMORY, text, re.S):
        return "memory"
    if re.search(TIME, text):
        return "time"
    status = getattr(fault, "status", None)
    return "passing" if status in PASSING or isinstance(fault, ConnectionError) else "final"


def retried(call: Callable[[], T], times: int = 4, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; errors that pass are waited out, longer each time, `times` calls at most."""
    for n in range(1, times + 1):
        try:
            return call()
        except Exception as fault:
            if n == times or class_of(fault) != "passing":
                raise
            sleep(pause * n)
    raise AssertionError("unreachable")


def halved(call: Callable[[list], list], items: list, **retry) -> list:
    """The results of `call` on a list; lack of memory or time halves the request down to one item."""
    if not items:
        return []
    try:
        return retried(lambda: call(items), **retry)
    except Exception as fault:
        if len(items) < 2 or class_of(fault) not in ("memory", "time"):
            raise
    middle = (len(items) + 1) // 2
    return halved(call, items[:middle], **retry) + halved(call, items[middle:], **retry)
