"""Helpers shared by the training-data operators; storage and graph steps are the library's own."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.operators.graph import components, cut, forget_at_exit, scratch_path, shared_dir, ship

__all__ = ["bounded_broadcast", "components", "cut", "forget_at_exit", "fresh", "normal_words", "ordinals", "read_table", "release", "scratch_path", "shared_dir", "ship", "small"]


def normal_words(text: Column) -> Column:
    """Lower-cased words: maximal runs of letters, marks and digits; null text has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.array_remove(parts, "")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, most: int = 32 << 20) -> bool:
    """Whether the values of ``df`` take ``most`` bytes or fewer as text, 8 at least each."""
    taken = sum((F.greatest(F.lit(8), F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(8))) for c in df.columns), F.lit(0))
    return (df.agg(F.sum(taken.cast("long"))).first()[0] or 0) <= most


def bounded_broadcast(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df``, a written table, to be broadcast if it takes ``most`` bytes or fewer; else joined as Spark sees fit."""
    return F.broadcast(df) if small(df, most) else df


def ordinals(df: DataFrame, order: Sequence[Column], name: str, group: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: a row's number, from 0, in ``order``, within its ``group`` if one is named; ties get numbers in any order.

    Rows are dealt by ranges, ties between several tasks, each task numbers its own, and the counts of the
    tasks before it are added: neither one task nor the driver sees all rows of a group.
    """
    part, at, salt = (fresh(df, c) for c in ("__part", "__at", "__salt"))
    keys = [F.col(f"`{g}`").asc_nulls_first() for g in group]
    dealt = df.withColumn(salt, F.rand(42)).repartitionByRange(*keys, *order, F.col(salt)).sortWithinPartitions(*keys, *order, F.col(salt))
    held = cut(dealt.drop(salt).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    alike = lambda g: F.col(f"`{g}`").eqNullSafe(F.col(f"`{g}{part}`"))
    runs = held.groupBy(*(F.col(f"`{g}`").alias(f"{g}{part}") for g in group), F.col(part).alias(f"p{part}")).agg(
        F.min(at).alias(f"f{part}"), F.count(F.lit(1)).alias(f"n{part}")
    )
    before = F.sum(f"n{part}").over(Window.partitionBy(*(f"`{g}{part}`" for g in group)).orderBy(f"p{part}").rowsBetween(Window.unboundedPreceding, -1))
    first = runs.withColumn(f"f{part}", F.col(f"f{part}") - F.coalesce(before, F.lit(0))).drop(f"n{part}")
    on = F.col(part) == F.col(f"p{part}")
    for g in group:
        on &= alike(g)
    return held.join(bounded_broadcast(cut(first)), on).select(*df.columns, (F.col(at) - F.col(f"f{part}")).alias(name))


def release() -> None:
    """Give a Python worker's free memory back: workers live on after their task, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        return


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
