"""Audits of results: transitions, violations, coverage; samples and agreement with labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transitions(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """How many rows went from which level to which."""
    return rows.groupBy(F.concat_ws(" -> ", old, new).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows there are and how many break each rule."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(broken).alias(n) for n, broken in rules.items()])


def fingerprint(*columns: Column) -> Column:
    """A hash of a row's content; nulls differ from empty strings."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns]), 256)


def checkpoint_state(rows: DataFrame, saved: DataFrame, key: str, mark: str) -> DataFrame:
    """Rows with ``state``: valid, stale (another fingerprint was saved) or missing."""
    known = saved.select(key, F.col(mark).alias("__saved"))
    state = F.when(F.col("__saved").isNull(), "missing").when(F.col("__saved") == F.col(mark), "valid").otherwise("stale")
    return rows.join(known, key, "left").withColumn("state", state).drop("__saved")


def coverage(stated: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    counts = {s: F.count_if(F.col("state") == s) for s in ("valid", "stale", "missing")}
    return stated.agg(
        total.alias("total"), *[c.alias(s) for s, c in counts.items()],
        F.round(counts["valid"] / F.when(total > 0, total), 4).alias("coverage"),
    )


def require_full(stated: DataFrame, partial: bool = False) -> DataFrame:
    """The rows as they are; the query fails at a row without a valid checkpoint unless ``partial``."""
    if partial:
        return stated
    checked = F.assert_true(F.col("state") == "valid", F.lit("a row has no valid checkpoint"))
    return stated.withColumn("__ok", checked).filter(F.col("__ok").isNull()).drop("__ok")


def sample_rank(seed: str, key: Column) -> Column:
    """A place in a random order that depends on seed and key alone."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def hash_sample(rows: DataFrame, stratum: str, key: str, seed: str, size: int) -> DataFrame:
    """The first ``size`` rows of each stratum in hash order; a row limit that Spark applies before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy(stratum).orderBy("sample_rank", key)
    ranked = rows.withColumn("sample_rank", sample_rank(seed, F.col(key)))
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)


def constrained_pick(ranked: list[dict], categories: Sequence[str], size: int, most_per_school: int = 2) -> list[dict]:
    """Pick from each category in order, preferring unused targets and schools used less than twice.

    ``ranked``: the bounded head of each category in hash order, as hash_sample gives.  The
    target preference is relaxed if it can't be met, the school bound isn't.
    """
    out: list[dict] = []
    for category in categories:
        own = [r for r in ranked if r["category"] == category]
        for _ in range(size):
            used = {r["id"] for r in out}
            schools = [r["school"] for r in out]
            free = [r for r in own if r["id"] not in used and schools.count(r["school"]) < most_per_school]
            fresh = [r for r in free if r["target"] not in {p["target"] for p in out}]
            if not (choice := (fresh or free)[:1]):
                raise ValueError(f"too few candidates in {category}")
            out += choice
    return out


def agreement(rows: DataFrame, truth: Column, found: Column, weight: Column | None = None) -> DataFrame:
    """Exact and within-one agreement, weighted error, and promotions of two levels; nulls don't count."""
    off = F.abs(truth - found)
    w = weight if weight is not None else F.lit(1)
    return rows.filter(truth.isNotNull() & found.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(off == 0).alias("exact"), F.count_if(off <= 1).alias("within_one"),
        F.sum(off * w).cast("long").alias("weighted_error"), F.count_if(found - truth >= 2).alias("severe_promotions"),
    )
