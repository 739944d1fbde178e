"""Keeping first or last rows, and order-dependent greedy merging of rows that share keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.graph import cut
from dossier.operators.precedence import first_known, roots_of


def keep(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, as a combined minimum rather than a window.

    Each map task sends one row a key, so a common key doesn't meet in one task.  ``order``
    must tell rows apart, or equal ones are interchangeable; nulls are equal keys.
    """
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    top = df.groupBy(*keys).agg(F.min(ordering).alias("top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"top.{c}").alias(c) for c in df.columns])


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the groups that have more than one, repeated keys counted before the join."""
    named = {k: f"__{k}" for k in keys}
    counts = df.groupBy(*[F.col(k).alias(n) for k, n in named.items()]).agg(F.count(F.lit(1)).alias("group_size"))
    on = F.lit(True)
    for k, n in named.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return df.join(counts.filter("group_size > 1"), on).drop(*named.values())


def greedy_groups(rows: DataFrame, order_col: str, keys_col: str) -> DataFrame:
    """``(order_col, group)``: rows merged one by one, in order, by the first key already seen.

    A row's keys are looked up in their order; the first known one names the group it joins, else it
    starts a group, named by its own order value.  All its keys then point to that group
    unless they point elsewhere.  This depends on the order: rows {A}, {B}, {A, B} make
    two groups, not one.  The group of a row is that of the earliest row with its first known key, so
    groups are found by following these, in doubling steps, without a fold.  Rows without keys, and null keys, are
    groups of their own; ``order_col`` tells rows apart.
    """
    own = cut(rows.select(F.col(order_col).cast("long").alias("o"), F.col(keys_col).alias("keys")))
    roots = roots_of(cut(first_known(own, "o", "keys")), "o")
    return own.join(roots, "o", "left").select(F.col("o").alias(order_col), F.coalesce("root", "o").alias("group"))


def renumber(df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """Numbers 1 to n within each partition, in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
