"""Samples under constraints: one row a category, drawn in hash order, with quotas across categories."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dossier.operators.audit import hash_sample, sample_rank
from dossier.operators.graph import cut


@dataclass(frozen=True)
class Limit:
    """No more than ``most`` picks share a value of ``column``; a soft limit gives way where no row meets it."""

    column: str
    most: int
    soft: bool = False


def _free(row: Mapping, key: str, limits: Sequence[Limit], used: Mapping[str, Counter]) -> bool:
    return not used[key][row[key]] and all(used[v.column][row[v.column]] < v.most for v in limits)


def _still_free(key: str, limits: Sequence[Limit], used: Mapping[str, Counter]) -> Column:
    """``_free`` as a filter: the values that are used up are as many as the picks at most."""
    full = [(key, list(used[key]))] + [(v.column, [x for x, n in used[v.column].items() if n >= v.most]) for v in limits]
    barred = [~reduce(Column.__or__, [F.col(c).eqNullSafe(F.lit(x)) for x in values]) for c, values in full if values]
    return reduce(Column.__and__, barred, F.lit(True))


def pick(
    rows: DataFrame, rules: Mapping[str, Column], key: str, seed: str, limits: Sequence[Limit] = (), prefix: str = "sample", exclude: Sequence | None = None, head: int = 64
) -> DataFrame:
    """One row for each of ``rules`` in their order: ``sample_id``, ``category``, ``key`` and the limits' columns.

    A category takes its first row in hash order that no earlier one took and that keeps all
    limits; if there is none, the first that keeps the limits that aren't soft; if there is none
    either, ``ValueError``.  Rows with a null key, or with a key in ``exclude``, aren't taken.

    Only the first ``head`` rows of each category come to the driver.  Where they do not decide,
    the one row wanted is searched among all of the category, with what is used up as a filter, so
    the result doesn't depend on ``head``.  ``key`` should tell rows apart.
    """
    columns = list(dict.fromkeys([key, *(v.column for v in limits)]))
    kept = rows.filter(F.col(key).isNotNull())
    if exclude:
        kept = kept.filter(~F.col(key).isin(list(exclude)))
    named = F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))
    fitting = cut(kept.select(*columns, named.alias("category")))
    heads: dict[str, list] = {name: [] for name in rules}
    for row in hash_sample(fitting, "category", key, seed, head).orderBy("category", "place").collect():
        heads[row["category"]].append(row)
    order = [sample_rank(seed, F.col(key)), F.col(key)]

    def first(name: str, kept_limits: Sequence[Limit]):  # noqa: ANN202
        if found := next((r for r in heads[name] if _free(r, key, kept_limits, used)), None):
            return found
        if len(heads[name]) < head:
            return None
        rest = fitting.filter((F.col("category") == name) & _still_free(key, kept_limits, used))
        return next(iter(rest.orderBy(*order).limit(1).collect()), None)

    used: dict[str, Counter] = {c: Counter() for c in columns}
    out = []
    for name in rules:
        row = first(name, limits) or first(name, [v for v in limits if not v.soft])
        if row is None:
            raise ValueError(f"no row is left for the category {name}")
        for c in columns:
            used[c][row[c]] += 1
        out.append((f"{prefix}_{len(out) + 1:02d}", name, *(row[c] for c in columns)))
    schema = StructType([StructField("sample_id", StringType()), StructField("category", StringType()), *(rows.schema[c] for c in columns)])
    return rows.sparkSession.createDataFrame(out, schema)
