"""Which author of a bibliography a person is: scores, verification of the best by their pages, the margin, a decision."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.authors import SIGNALS, additive, dblp_confidence

# How many of the best are verified, from which score on, unless the best has this one or more; scores of overrides.
VERIFIED, WORTH, CERTAIN = 3, 50, 150
OVERRIDDEN, NAMED = ("高", 200), ("中", 90)
STATUSES = {"adopted": "已匹配-", "ambiguous": "歧义/未采用", "none": "未匹配"}
WEIGHTS = SIGNALS["dblp"]


def domain_key(url: Column) -> Column:
    """Host without www and path of a URL in lower case, without a slash at its end; empty without a host."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1)
    key = F.concat(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lower(F.regexp_replace(path, "/+$", "")))
    return F.when(F.coalesce(host, F.lit("")) != "", key).otherwise("")


def _either_holds(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def pages_meet(left: Column, right: Column) -> Column:
    """Whether a URL of one array and one of the other are the same page, or one lies below the other."""
    keys = F.transform(right, domain_key)
    return F.coalesce(F.exists(left, lambda a: F.exists(keys, lambda b: _either_holds(domain_key(a), b))), F.lit(False))


def scored(candidates: DataFrame, affiliations: Sequence[str], cities: Sequence[str]) -> DataFrame:
    """``candidates`` with ``exact``, ``near``, ``known`` (an affiliation) and ``score``.

    ``direct`` says that the person's page names the author, ``author_key`` is the author's name, ``query_keys`` lists
    the person's names, ``affiliation`` is a text.
    """
    names = F.coalesce(F.col("query_keys"), F.array().cast("array<string>"))
    key, place = F.coalesce(F.col("author_key"), F.lit("")), F.lower(F.coalesce(F.col("affiliation"), F.lit("")))
    held = lambda words: reduce(Column.__or__, [F.contains(place, F.lit(w)) for w in words], F.lit(False))
    exact = F.array_contains(names, key)
    near = ~exact & F.exists(names, lambda n: (n != "") & (F.contains(key, n) | F.contains(n, key)))
    known = held(affiliations)
    signals = {"direct": F.col("direct"), "exact_name": exact, "near_name": near, "affiliation": known, "city": ~known & held(cities)}
    return candidates.withColumns({"exact": exact, "near": near, "known": known, "score": additive(signals, WEIGHTS)})


def verified(candidates: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """The three best candidates of each person, with ``homepage``, and ``score`` raised where the author's page is the person's.

    Pages (``author_id``, ``urls``; an author once) are looked up only for people with homepages whose best candidate isn't certain,
    and there for those of the three that are worth it.  More than three can't matter: verification
    raises scores of these alone, so the best and the one behind it are among them.  The row limit is
    applied before the shuffle; equal scores go by ``place``, then ``author_id``.
    """
    rank = Window.partitionBy(by).orderBy(F.desc("score"), "place", "author_id")
    top = candidates.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= VERIFIED)
    best = F.max("score").over(Window.partitionBy(by))
    asked = (F.size("homepages") > 0) & (best < CERTAIN) & (F.col("score") >= WORTH)
    top = top.withColumn("lookup", F.when(asked, F.col("author_id")))
    told = pages.select(F.col("author_id").alias("lookup_"), F.col("urls").alias("urls_"))
    met = top.join(told, F.col("lookup") == F.col("lookup_"), "left")
    homepage = F.coalesce(pages_meet(F.col("urls_"), F.col("homepages")), F.lit(False))
    return met.withColumn("homepage", homepage).withColumn("score", F.col("score") + F.when(homepage, WEIGHTS["homepage"]).otherwise(0)).drop("lookup", "lookup_", "urls_")


def identified(people: DataFrame, candidates: DataFrame, pages: DataFrame, by: str, affiliations: Sequence[str] = (), cities: Sequence[str] = (), overrides: DataFrame | None = None) -> DataFrame:
    """One row a person: ``by``, ``author_id`` (null if none is adopted), ``score``, ``margin``, ``confidence``, ``status``.

    ``people`` has ``by`` (each once), ``name``, ``query_keys`` and ``homepages`` (arrays), ``candidates`` has ``by``, ``author_id``,
    ``author_key``, ``affiliation``, ``direct`` and ``place``, ``pages`` has ``author_id`` and ``urls``.  ``overrides`` (``by`` or, where that is null,
    ``name``, ``author_id``) come first: one for the person is certain, one for its name alone is not.  A person without names or
    candidates is not found.  An author that is a candidate twice counts once, as the first by ``direct`` and ``place``.
    """
    none = F.array().cast("array<string>")
    people = people.select(by, "name", F.coalesce("query_keys", none).alias("query_keys"), F.coalesce("homepages", none).alias("homepages"))
    once = candidates.groupBy(by, "author_id").agg(
        F.min_by(F.struct("author_key", "affiliation", "direct", "place"), F.struct((~F.coalesce("direct", F.lit(False))).alias("d"), "place")).alias("c")
    )
    rows = once.select(by, "author_id", "c.*").join(people.filter(F.size("query_keys") > 0), by)
    top = verified(scored(rows, affiliations, cities), pages, by)
    order = Window.partitionBy(by).orderBy(F.desc("score"), "rank")
    margin = F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0))
    best = top.withColumns({"margin": margin, "at": F.row_number().over(order)}).filter("at = 1")
    confidence = dblp_confidence(F.coalesce("direct", F.lit(False)), F.col("homepage"), F.col("exact"), F.col("near"), F.col("known"), F.col("margin"))
    best = best.select(F.col(by).alias("by_"), "author_id", "score", "margin", confidence.alias("confidence"))
    if overrides is None:
        overrides = people.limit(0).select(by, "name", F.lit(None).cast(candidates.schema["author_id"].dataType).alias("author_id"))
    own = overrides.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("own_")).agg(F.min("author_id").alias("own_author"))
    named = overrides.filter(F.col(by).isNull() & F.col("name").isNotNull()).groupBy(F.col("name").alias("named_")).agg(F.min("author_id").alias("named_author"))
    out = people.join(best, F.col(by) == F.col("by_"), "left").join(own, F.col(by) == F.col("own_"), "left").join(named, F.col("name") == F.col("named_"), "left")
    fixed = F.when(F.col("own_author").isNotNull(), F.struct(F.col("own_author").alias("a"), F.lit(OVERRIDDEN[0]).alias("c"), F.lit(OVERRIDDEN[1]).alias("s")))
    fixed = fixed.when(F.col("named_author").isNotNull(), F.struct(F.col("named_author").alias("a"), F.lit(NAMED[0]).alias("c"), F.lit(NAMED[1]).alias("s")))
    out = out.withColumn("fixed", fixed)
    given = F.col("fixed").isNotNull()
    sure = F.coalesce("fixed.c", F.col("confidence"))
    status = F.when(sure.isNotNull(), F.concat(F.lit(STATUSES["adopted"]), sure)).when(F.col("by_").isNotNull(), STATUSES["ambiguous"]).otherwise(STATUSES["none"])
    return out.select(
        by, F.coalesce("fixed.a", F.when(F.col("confidence").isNotNull(), F.col("author_id"))).alias("author_id"), F.coalesce("fixed.s", F.col("score")).cast("int").alias("score"),
        F.when(~given, F.col("margin")).cast("int").alias("margin"), sure.alias("confidence"), status.alias("status"),
    )
