"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.scratch import discard, shared_dir
from textloom.plans.scratch import settled as settle

__all__ = ["ascii_lower", "discard", "freeing", "give_back", "read", "settle", "shared_dir"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def give_back() -> None:
    """Return what this process has freed to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def freeing(run):
    """A map over batches that gives its memory back when its task ends: Python workers live on, beside the tasks of later stages."""

    @functools.wraps(run)
    def map_(batches, *args, **options):
        try:
            yield from run(batches, *args, **options)
        finally:
            give_back()

    return map_
