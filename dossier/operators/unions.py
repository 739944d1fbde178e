"""Works merged from the records of several sources: what stands for the work, and all that its records say, each once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import norm_text, normalized_title
from dossier.operators.works import PRIORITY

#: Lists of a record that are joined, and texts of which the first that says something counts.
LISTS = ("authors", "classifications", "topics")
TEXTS = ("doi", "arxiv_id", "venue", "publication_date", "url")


def record_order(rows: DataFrame) -> Column:
    """The order of a work's records: with a DOI, no preprint, better source, longer title first; then by ``record_id``."""
    rank = F.lit(0)
    for name, value in PRIORITY.items():
        rank = F.when(F.col("source") == name, value).otherwise(rank)
    return F.struct(
        (F.coalesce("doi", F.lit("")) == "").alias("a"), F.coalesce("is_preprint", F.lit(False)).alias("b"), (-rank).alias("c"), (-F.length(norm_text("title"))).alias("d"), F.col("record_id").alias("e")
    )


def folded_union(rows: DataFrame, by: str, order: str, lists: Sequence[str]) -> DataFrame:
    """``by`` and the ``lists`` joined over a group's rows: by ``order``, then as listed; alike values in any case of letters once, as first written.

    Values are told apart before they are gathered: the first of those alike is a combined minimum, so
    a value that a million rows repeat travels once a task, and a group meets only as what it differs in.
    Values that say nothing go; a group without any has empty lists.
    """
    none = F.array().cast("array<string>")
    named = F.array(*[F.struct(F.lit(i).alias("list"), F.coalesce(F.col(c).cast("array<string>"), none).alias("values")) for i, c in enumerate(lists)])
    each = rows.select(by, order, F.inline(named)).select(by, order, "list", F.posexplode("values").alias("at", "value"))
    said = each.withColumn("value", norm_text("value")).filter(F.col("value") != "")
    first = said.groupBy(by, "list", F.lower("value").alias("folded")).agg(F.min(F.struct(order, "at", "value")).alias("v"))
    gathered = first.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("list", "v"))).alias("all"))
    groups = rows.select(F.col(by).alias("by_")).distinct().join(gathered, F.col("by_").eqNullSafe(F.col(by)), "left")
    of = lambda i: F.transform(F.filter(F.coalesce("all", F.array().cast(gathered.schema["all"].dataType)), lambda x: x["list"] == i), lambda x: x["v"]["value"])
    return groups.select(F.col("by_").alias(by), *[of(i).alias(c) for i, c in enumerate(lists)])


def merged_works(records: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a work of ``groups`` (record_id, work_id): what its records (a record once) say together.

    ``records``: record_id, source, source_id, doi, arxiv_id, title, year, venue, publication_date, url, is_preprint, authors,
    classifications and topics, ids in normal form.  The first record in order gives the title, the first that has one the other
    texts; the year is the latest; lists are unions; only a preprint is what no record contradicts.  The id
    is the DOI, else the arXiv id, else the first source's, else the title.  Records without a title, or in no group, are left out.
    """
    rows = records.filter(norm_text("title") != "").join(groups.select(F.col("record_id").alias("id_"), "work_id"), F.col("record_id") == F.col("id_")).drop("id_")
    own = F.when(norm_text("source_id") != "", F.array(F.concat_ws(":", "source", "source_id")))
    rows = rows.withColumns({"order_": record_order(rows), "sources": F.array("source"), "source_ids": own})
    first = {c: F.min_by(norm_text(c), F.when(norm_text(c) != "", F.col("order_"))) for c in TEXTS}
    told = rows.groupBy("work_id").agg(
        F.min_by(norm_text("title"), "order_").alias("title"), F.max("year").alias("year"), *[F.coalesce(v, F.lit("")).alias(c) for c, v in first.items()],
        F.bool_and(F.coalesce("is_preprint", F.lit(False))).alias("is_preprint"), F.count(F.lit(1)).alias("n_records"),
    )
    lists = folded_union(rows, "work_id", "order_", ["sources", "source_ids", *LISTS])
    out = told.join(lists.withColumnRenamed("work_id", "work_id_"), F.col("work_id").eqNullSafe(F.col("work_id_")))
    name = (
        F.when(F.col("doi") != "", F.concat(F.lit("doi:"), "doi"))
        .when(F.col("arxiv_id") != "", F.concat(F.lit("arxiv:"), "arxiv_id"))
        .otherwise(F.coalesce(F.get("source_ids", F.lit(0)), F.concat(F.lit("title:"), normalized_title(F.col("title")))))
    )
    return out.select("work_id", name.alias("canonical_id"), "title", "year", *TEXTS, "is_preprint", "n_records", "sources", "source_ids", *LISTS)
