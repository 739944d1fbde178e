"""Author disambiguation: additive scores, the margin to the runner-up, a confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What each signal adds, by source.
SIGNALS = {
    "dblp": {"direct": 120, "exact_name": 65, "near_name": 25, "affiliation": 90, "city": 25, "homepage": 100},
    "zbmath": {"name": 4, "orcid": 12, "homepage": 10, "orcid_conflict": -100},
    "openalex": {"name": 4, "orcid": 12, "affiliation": 5, "orcid_conflict": -100},
}
OVERLAP_EACH, OVERLAP_MOST = 5, 3


def additive(signals: Mapping[str, Column], weights: Mapping[str, int], overlap: Column | None = None) -> Column:
    """The sum of the weights of the signals that hold, and of up to three overlapping titles."""
    total = F.lit(0)
    for name, weight in weights.items():
        if name in signals:
            total = total + F.when(F.coalesce(signals[name], F.lit(False)), weight).otherwise(0)
    if overlap is not None:
        total = total + F.least(overlap, F.lit(OVERLAP_MOST)) * OVERLAP_EACH
    return total


def best_with_margin(candidates: DataFrame, by: Sequence[str], score: Column, ties: Sequence[Column]) -> DataFrame:
    """The best candidate of each group and the lead over the second; ``margin`` is null without one.

    The two best are kept by a row limit that Spark applies before the shuffle.
    """
    order = Window.partitionBy(*by).orderBy(score.desc_nulls_last(), *ties)
    two = candidates.withColumn("candidate_score", score).withColumn("place", F.row_number().over(order)).filter("place <= 2")
    lead = Window.partitionBy(*by).orderBy("place")
    return (
        two.withColumn("margin", F.col("candidate_score") - F.lead("candidate_score").over(lead))
        .filter("place = 1").drop("place")
    )


def dblp_confidence(direct: Column, homepage: Column, exact: Column, near: Column, affiliation: Column, margin: Column) -> Column:
    """``高``, ``中``, ``低`` or null for not adopted."""
    lead = F.coalesce(margin, F.lit(1 << 20))
    return (
        F.when(direct | homepage, "高")
        .when(exact & affiliation & (lead >= 20), "高")
        .when(exact & (lead >= 20), "中")
        .when(near & affiliation & (lead >= 30), "低")
    )


def catalogue_confidence(source: str, score: Column, strong: Column, overlap: Column, margin: Column) -> Column:
    """``high``, ``medium`` or ``low`` for zbMATH and OpenAlex candidates."""
    ambiguous = (F.coalesce(margin, F.lit(1 << 20)) < 3) & ~strong
    if source == "zbmath":
        medium = (score >= 8) & (overlap >= 1) & ~ambiguous
    else:
        medium = (score >= 9) & ~ambiguous
    return F.when(strong | (score >= 12), "high").when(medium, "medium").otherwise("low")
