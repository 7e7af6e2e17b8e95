"""Name of the worker that ran a row."""

from __future__ import annotations

import os
import socket
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, SparkSession
from pyspark.sql.pandas.functions import pandas_udf

from rastertables.shipping import ship_package


def local_worker_name() -> str:
    """host:pid, and inside a task also its partition and attempt."""
    name = f"{socket.gethostname()}:{os.getpid()}"
    task = TaskContext.get()
    return name if task is None else f"{name}:p{task.partitionId()}:a{task.attemptNumber()}"


def worker_name(any_column: Column) -> Column:
    """The worker that evaluates the row; one call per Arrow batch."""
    ship_package(SparkSession.getActiveSession())

    @pandas_udf("string")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([local_worker_name()] * len(batch))

    return named(any_column)
