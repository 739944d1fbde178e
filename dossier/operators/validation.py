"""Validation against people's judgement: blinded samples, the comparison, its report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.operators.audit import hash_sample
from dossier.operators.ranking import LEVELS

SENTINEL = "zero_weight_sentinel"


def level_place(level: Column) -> Column:
    """Levels as numbers from the lowest, 0 for the last."""
    return F.array_position(F.array(*[F.lit(v) for v in reversed(LEVELS)]), level).cast("int") - 1


def export(samples: DataFrame, public: Sequence[str], hidden: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The queue that a judge sees and the baseline that stays aside, both by ``sample_id``."""
    return samples.select("sample_id", *public), samples.select("sample_id", *hidden)


def categories(rows: DataFrame, rules: Mapping[str, Column], key: str, seed: str, size: int) -> DataFrame:
    """The head of each category in hash order, from which a constrained pick chooses; a row may be in several."""
    named = F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))
    return hash_sample(rows.withColumn("category", named), "category", key, seed, size)


def compare(queue: DataFrame, baseline: DataFrame, manual: DataFrame, current: DataFrame) -> DataFrame:
    """One row a sample with levels of old, new and manual judgement and both errors.

    A sample that one of the tables lacks fails the query, as a comparison of fewer samples
    would look better than it is.  Tables hold a sample once.
    """
    out = queue.join(baseline, "sample_id", "left").join(manual, "sample_id", "left").join(current, "sample_id", "left")
    whole = F.col("old_level").isNotNull() & F.col("manual_level").isNotNull() & F.col("new_level").isNotNull()
    error = lambda c: F.abs(level_place(F.col(c)) - level_place(F.col("manual_level")))
    checked = F.assert_true(whole, F.concat(F.lit("sample without all judgements: "), F.col("sample_id").cast("string")))
    out = out.withColumn("__ok", checked).filter(F.col("__ok").isNull()).drop("__ok")
    return out.withColumns({"old_error": error("old_level"), "new_error": error("new_level")})


def metrics(compared: DataFrame) -> DataFrame:
    """One row of counts; the sentinel category counts only for priorities without an anchor."""
    main = F.col("category") != SENTINEL
    listed = F.col("new_level").isin(*LEVELS[:2])
    return compared.agg(
        F.count_if(main).alias("main_samples"), F.count_if(main & (F.col("old_error") == 0)).alias("old_exact"),
        F.count_if(main & (F.col("new_error") == 0)).alias("new_exact"),
        F.coalesce(F.sum(F.when(main, F.col("old_error"))), F.lit(0)).cast("long").alias("old_weighted_error"),
        F.coalesce(F.sum(F.when(main, F.col("new_error"))), F.lit(0)).cast("long").alias("new_weighted_error"),
        F.count_if(main & (F.col("new_error") <= 1)).alias("new_within_one_level"),
        F.count_if(main & (F.col("manual_level") == LEVELS[2]) & (F.col("new_level") == LEVELS[0])).alias("new_severe_promotions"),
        F.count_if(listed & ~F.col("new_anchor")).alias("priority_without_anchor"),
    )


def report(title: str, counts: Mapping[str, int], lines: DataFrame) -> DataFrame:
    """The report as text lines in order, ``(place, line)``: the counts, then a table row for each sample."""
    spark = lines.sparkSession
    head = [f"# {title}", "", "## Metrics", "", *[f"- {k}: {v}" for k, v in counts.items()], "", "## Samples", "", "| sample | category | manual | old | new | anchor |", "|---|---|---|---|---|---|"]
    top = spark.createDataFrame([(i - len(head), "", line) for i, line in enumerate(head)], "place long, sample_id string, line string")
    cells = F.concat_ws(" | ", F.col("sample_id").cast("string"), "category", "manual_level", "old_level", "new_level", F.when(F.col("new_anchor"), "yes").otherwise("no"))
    body = lines.select(F.lit(0).cast("long").alias("place"), F.col("sample_id").cast("string").alias("sample_id"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    return top.unionByName(body).orderBy("place", "sample_id").select("line")
