"""How many requests were made on a day, over all runs, and who may make them now.

The ledger is a folder with one small file for every reservation: a run reserves requests before it makes them, so what a stopped run has reserved
stays counted, and runs on one day together stay within the day's budget. The lease is a file that only one run can create; it names
its holder and when it ends, and an ended one can be taken over.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .stores import _read_text, _write_text
from .writers import _fs

DAILY = 9500  # of the 10,000 that the free service allows a day


class LeaseHeld(RuntimeError):
    """Another run holds the lease."""


def today() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d")


def used(spark: SparkSession, path: str, day: str | None = None) -> int:
    """Requests reserved on a day (UTC), by all runs."""
    folder = f"{path}/_requests/{day or today()}"
    jpath, fs = _fs(spark, folder)
    if not fs.exists(jpath):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    return sum(json.loads(_read_text(spark, f"{folder}/{n}"))["requests"] for n in names if not n.startswith((".", "_")))


def reserve(spark: SparkSession, path: str, requests: int, daily: int = DAILY, run: str = "") -> int:
    """Reserve as many of the requests as the day has left, and say how many. Call it under the lease."""
    granted = max(0, min(requests, daily - used(spark, path)))
    if granted:
        day = f"{path}/_requests/{today()}"
        staged, name = f"{path}/_requests/_new-{uuid.uuid4().hex}", f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        _write_text(spark, staged, json.dumps({"requests": granted, "run": run}))
        folder, fs = _fs(spark, day)
        fs.mkdirs(folder)
        if not fs.rename(_fs(spark, staged)[0], _fs(spark, f"{day}/{name}")[0]):
            raise OSError(f"cannot write to {day}")
    return granted


def _ends(spark: SparkSession, path: str, seconds: float) -> float:
    """When a lease ends; one whose holder has not written it yet counts from its creation."""
    jpath, fs = _fs(spark, path)
    try:
        text = _read_text(spark, path)
        return float(json.loads(text)["ends"]) if text else fs.getFileStatus(jpath).getModificationTime() / 1000 + seconds
    except Exception:  # noqa: BLE001  gone meanwhile
        return 0.0 if not fs.exists(jpath) else time.time() + 1


@contextmanager
def lease(spark: SparkSession, path: str, seconds: float = 3600, wait: float = 0, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Hold the lease of a store for the block, for ``seconds`` at most; wait that long for another holder, then raise."""
    file, holder, until = f"{path}/_lease", uuid.uuid4().hex, time.time() + wait
    jpath, fs = _fs(spark, file)
    while not fs.createNewFile(jpath):
        if _ends(spark, file, seconds) <= time.time():
            # Moved aside, which one of several takers can do, then created anew.
            aside = _fs(spark, f"{path}/_lease-{uuid.uuid4().hex}")[0]
            try:
                if fs.rename(jpath, aside):
                    fs.delete(aside, False)
            except Exception as error:  # noqa: BLE001
                if fs.exists(jpath):
                    raise LeaseHeld(path) from error
            continue
        if time.time() >= until:
            raise LeaseHeld(f"another run works on {path}")
        sleep(min(5.0, max(0.05, until - time.time())))
    _write_text(spark, file, json.dumps({"holder": holder, "ends": time.time() + seconds}))
    try:
        yield holder
    finally:
        if fs.exists(jpath) and holder in _read_text(spark, file):
            fs.delete(jpath, False)
