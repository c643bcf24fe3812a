"""Independent fits at the same time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")


def together(spark: SparkSession, jobs: Sequence[Callable[[], Result]], parallel: int = 4) -> list[Result]:
    """Results of the jobs in their order, ``parallel`` at a time.

    A fit is a chain of small jobs with the driver in between; several chains keep the cluster
    busy. Spark schedules their tasks itself. The first error is raised after the running ones end.
    """
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [job.result() for job in waiting]
