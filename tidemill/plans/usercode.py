"""User transforms in Python, for trusted users: the code sees ``df``, ``F``, ``Window`` and ``spark`` and sets ``df``."""

from __future__ import annotations

import contextlib
import ctypes
import io
import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InputError

SECONDS = 30
PREVIEW = 20
#: Seconds that a cancelled thread is waited for.
PATIENCE = 10


class _Printed(io.TextIOBase):
    """Standard output that keeps what one thread prints and passes on what all others do."""

    def __init__(self):
        self.held: dict[int, io.StringIO] = {}
        self.others = sys.stdout

    def write(self, text: str) -> int:
        return (self.held.get(threading.get_ident()) or self.others).write(text)

    def flush(self) -> None:
        self.others.flush()


@contextlib.contextmanager
def _printing() -> Iterator[io.StringIO]:
    """What this thread prints meanwhile."""
    with _swapping:
        if not isinstance(sys.stdout, _Printed):
            sys.stdout = _Printed()
        out = sys.stdout
        out.held[threading.get_ident()] = printed = io.StringIO()
    try:
        yield printed
    finally:
        with _swapping:
            out.held.pop(threading.get_ident(), None)
            if not out.held and sys.stdout is out:
                sys.stdout = out.others


_swapping = threading.Lock()


class _OutOfTime(BaseException):
    """Raised inside a thread whose time is over; user code that catches all exceptions doesn't catch it."""


def _within(spark: SparkSession, seconds: float, work: Callable[[], object]) -> object:
    """What ``work`` returns if it is done in time; if it isn't, its Spark jobs are cancelled and its thread is stopped.

    All jobs that the thread starts carry a tag of their own, so no other job is touched, and running tasks are interrupted.
    """
    context, tag = spark.sparkContext, f"usercode-{uuid.uuid4().hex}"
    found: list = []
    failed: list[BaseException] = []

    def run():
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            found.append(work())
        except BaseException as e:  # handed to the caller's thread
            failed.append(e)
        finally:
            context.removeJobTag(tag)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        ctypes.pythonapi.PyThreadState_SetAsyncExc(ctypes.c_ulong(thread.ident), ctypes.py_object(_OutOfTime))
        # a job may be about to start: cancel until the thread has ended
        until = time.monotonic() + PATIENCE
        while thread.is_alive() and time.monotonic() < until:
            context.cancelJobsWithTag(tag)
            thread.join(0.1)
        raise InputError(f"the code took more than {seconds} seconds")
    if failed:
        e = failed[0]
        raise e if isinstance(e, InputError) else InputError(f"{type(e).__name__}: {e}") from e
    return found[0]


def run_code(df: DataFrame, code: str, seconds: float = SECONDS, action: Callable[[DataFrame], object] | None = None) -> tuple:
    """(result, what was printed). The result must be a DataFrame with columns; with ``action`` it is what this makes of that DataFrame.

    ``seconds`` is the time for the code, all Spark jobs that it starts, and ``action``; without one the DataFrame is lazy, and
    its own work is not in that time. Code that defines ``pandas_batch(frame)`` instead is applied to batches of rows as pandas
    frames of the session's batch size; the columns stay as they are.
    """
    scope = {"df": df, "F": F, "Window": Window, "spark": df.sparkSession}

    def work():
        with _printing() as printed:
            exec(compile(code, "<transform>", "exec"), scope)  # noqa: S102  the feature itself
            batch = scope.get("pandas_batch")
            if callable(batch):
                out = df.mapInPandas(lambda frames: (batch(f) for f in frames), df.schema)
            else:
                out = scope.get("result", scope["df"])
            if not isinstance(out, DataFrame) or not out.columns:
                raise InputError("the code must leave a DataFrame in df or result")
            return (action(out) if action else out), printed.getvalue()

    return _within(df.sparkSession, seconds, work)


def _not_empty(out: DataFrame) -> DataFrame:
    if out.isEmpty():
        raise InputError("no row would be left")
    return out


def apply_code(df: DataFrame, code: str, save: Callable[[DataFrame], object], seconds: float = SECONDS) -> object:
    """What ``save`` makes of the result, which must have rows; all of the work is in the time."""
    return run_code(df, code, seconds, lambda out: save(_not_empty(out)))[0]


def preview(df: DataFrame, code: str, seconds: float = SECONDS) -> DataFrame:
    """The first rows of the result, worked out in the time."""
    return run_code(df, code, seconds, lambda out: df.sparkSession.createDataFrame(out.limit(PREVIEW).collect(), out.schema))[0]
