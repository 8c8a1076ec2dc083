"""Scratch tables, column bundles and Arrow helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.session import scratch_path

ROW = "row"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` cut from its lineage: written once to the shared folder and read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bundled(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``row`` (a struct of ``keep``) and ``text`` (null read as empty), so no kept name can clash with an operator's own."""
    columns = [df[c] for c in keep] or [F.lit(0).alias("_none")]
    return df.select(F.struct(*columns).alias(ROW), F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))


def spread(df: DataFrame, keep: Sequence[str], *own: str) -> DataFrame:
    """The kept columns again, then the operator's own; an own column replaces a kept one of the same name."""
    return df.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in keep if c not in own], *own)


def give_back() -> None:
    """Returns freed memory of this process to the system, where its allocators can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``, giving memory back when a task ends: workers live on, beside whatever runs next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run
