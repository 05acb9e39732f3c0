"""Housekeeping between the steps of an operator."""

from __future__ import annotations

import gc
import time

from pyspark.sql import SparkSession


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are written and done.

    The scheduler holds on to its last job until the next one, so a job of one row comes
    first; then unreachable plans are collected, which is what starts the removal.
    """
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)
