"""Time limits for a step's Spark jobs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

LIMIT_SECONDS = 3600


class TimedOut(Exception):
    pass


def limited(spark: SparkSession, step: Callable, seconds: float = LIMIT_SECONDS):
    """Run ``step()``; cancel its jobs after the limit and raise TimedOut. Returns (value, seconds taken)."""
    sc = spark.sparkContext
    tag = f"gapweave-{uuid.uuid4().hex}"
    over = threading.Event()

    done = threading.Event()

    def stop():
        over.set()
        # A step may start further jobs after the limit: they are cancelled too, until it gives up.
        while not done.is_set():
            sc.cancelJobsWithTag(tag)
            done.wait(0.2)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    start = time.monotonic()
    sc.addJobTag(tag)
    timer.start()
    try:
        value = step()
    except Exception as e:
        if over.is_set():
            raise TimedOut(f"step took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        done.set()
        sc.removeJobTag(tag)
    if over.is_set():
        raise TimedOut(f"step took more than {seconds} s")
    return value, time.monotonic() - start
