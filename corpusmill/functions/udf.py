"""Vectorised Python functions that can be defined before there is a session."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: bound a Python worker's memory, however many and long the texts of a partition are.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to BATCH_ROWS and BATCH_BYTES; smaller settings stay, 0 and less mean no bound."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def vectorised(kind: str):
    """A pandas UDF of the given SQL type, made when it is first applied; the session's Arrow batches are bounded from then on."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns) -> Column:
            bounded_batches(SparkSession.active())
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
