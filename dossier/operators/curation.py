"""Search results and curated evidence: host classes, acceptance, the row an item applies to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import YEAR, norm_text
from dossier.operators.evidence import RELIABLE

# Parts of addresses that are never evidence, and hosts by class.
BLOCKED = ("baidu.com", "bing.com", "duckduckgo.com", "google.com/search", "sogou.com", "so.com")
OFFICIAL_ENDS = ("edu.cn", ".edu")
SCHOOL_ENDS = {"sjtu": ("sjtu.edu.cn", "sjtu.edu")}
PROJECT_END, PROJECT_HOSTS = "github.io", ("github.com", "sites.google.com")
PAPER_PARTS = ("dblp", "arxiv", "aclanthology", "openreview", "ieee", "acm.org", "springer")
# What a confirmed item sets.
CONFIRMED = "人工确认-本地证据"


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def host_class(url: Column, school: Column) -> Column:
    """``blocked``, ``official``, ``personal_or_project``, ``paper`` or ``other`` by the address."""
    whole = F.lower(norm_text(url))
    host = F.regexp_extract(whole, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    own = any_of([(school == s) & any_of([F.endswith(host, F.lit(e)) for e in ends]) for s, ends in SCHOOL_ENDS.items()])
    return (
        F.when(any_of([F.contains(whole, F.lit(p)) for p in BLOCKED]), "blocked")
        .when(own | any_of([F.endswith(host, F.lit(e)) for e in OFFICIAL_ENDS]), "official")
        .when(F.endswith(host, F.lit(PROJECT_END)) | host.isin(*PROJECT_HOSTS), "personal_or_project")
        .when(any_of([F.contains(host, F.lit(p)) for p in PAPER_PARTS]), "paper")
        .otherwise("other")
    )


def holds_quoted(query: Column, texts: Column) -> Column:
    """Whether some quoted term of the query, of two characters or more, is in one of the texts.

    Without quoted terms it is enough that there are texts.
    """
    terms = F.filter(F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1)), lambda t: F.length(t) >= 2)
    everything = F.array_join(texts, " ")
    return F.when(F.size(terms) == 0, F.size(texts) > 0).otherwise(F.exists(terms, lambda t: F.contains(everything, t)))


def choose_results(primary: Column, fallback: Column, query: Column, text: str = "title", most: int = 8) -> Column:
    """The first results of the primary search if they hold the query's terms, else of the other one; null is empty."""
    first, second = (F.slice(F.coalesce(r, F.slice(fallback, 1, 0)), 1, most) for r in (primary, fallback))
    second = F.coalesce(second, F.slice(first, 1, 0))
    good = (F.size(first) > 0) & holds_quoted(query, F.transform(first, lambda r: F.coalesce(r[text], F.lit(""))))
    return F.when(good, first).otherwise(second)


def acceptable(kind: Column, confidence: Column, keywords: Column, text: Column) -> Column:
    """Whether a result counts as evidence: not blocked, surely of the person, and with keywords or a year."""
    return (kind != "blocked") & confidence.isin(*RELIABLE) & ((norm_text(keywords) != "") | F.rlike(text, F.lit(YEAR)))


def curated(items: DataFrame, people: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Items with ``row_id`` of the one person each applies to; items that fit none or several go.

    An item that names an id applies to that person, any other to the person of its name.
    People are counted by id and by name before either join, so no name is expanded.
    ``items`` holds ``item``, ``id_col`` and ``name_col`` besides other columns.
    """
    known = people.select(F.col(id_col).cast("string").alias("i"), F.col(name_col).alias("n"))
    by_id = known.filter("i IS NOT NULL").groupBy("i").agg(F.count(F.lit(1)).alias("c_i")).withColumn("p_i", F.col("i"))
    by_name = known.filter("n IS NOT NULL").groupBy("n").agg(F.count(F.lit(1)).alias("c_n"), F.min("i").alias("p_n"))
    given = norm_text(F.col(id_col).cast("string"))
    out = items.withColumns({"i": F.nullif(given, F.lit("")), "n": F.when(given == "", F.col(name_col))})
    out = out.join(by_id, "i", "left").join(by_name, "n", "left")
    found = F.when(F.col("c_i") == 1, F.col("p_i")).when(F.col("i").isNull() & (F.col("c_n") == 1), F.col("p_n"))
    return out.withColumn("row_id", found).filter("row_id IS NOT NULL").select(*items.columns, "row_id")


def apply_curated(current: Column, urls: Column) -> Column:
    """``struct<status, count, links>``: what a curated item with these addresses leaves behind."""
    links = F.filter(F.transform(F.split(norm_text(urls), ";"), lambda u: F.trim(u)), lambda u: u != "")
    return F.struct(F.lit(CONFIRMED).alias("status"), F.greatest(F.coalesce(current, F.lit(0)), F.size(links)).alias("count"), links.alias("links"))


def evidence_rows(people: DataFrame, evidence: str, kept: Sequence[str]) -> DataFrame:
    """One row for each entry of an array of evidence structs, behind the person's own columns."""
    return people.select(*kept, F.explode(evidence).alias("e")).select(*kept, "e.*")


def only_reliable(rows: DataFrame, confidence: str) -> DataFrame:
    return rows.filter(F.col(confidence).isin(*RELIABLE))
