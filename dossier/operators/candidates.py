"""Author candidates of a source: signals, conflicts, decisions, and what a source's run came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.names import unused
from dossier.functions.text import norm_text

# The score from which a candidate is probable, and the words of the results.
PROBABLE = {"zbmath": 8, "openalex": 9}
OVERRIDDEN = "private_override_rejected_source_id"
MISMATCH = "orcid_mismatch"


def terms(value: Column) -> Column:
    """Parts of a list between semicolons of either width, normalised and in lower case."""
    parts = F.transform(F.split(F.replace(F.coalesce(value, F.lit("")), F.lit("；"), F.lit(";")), ";"), lambda v: F.lower(norm_text(v)))
    return F.filter(parts, lambda v: v != "")


def source_ids(value: Column) -> Column:
    """Identifiers of a list, the last part of each if it is an address."""
    return F.array_distinct(F.transform(terms(value), lambda v: F.substring_index(v, "/", -1)))


def text_of(value: Column) -> Column:
    """The text of a JSON string, or of an object's first of title, text, name and display_name; else empty."""
    own = F.trim(F.coalesce(value, F.lit("")))
    fields = [F.nullif(F.get_json_object(own, f"$.{k}"), F.lit("")) for k in ("title", "text", "name", "display_name")]
    inner = F.get_json_object(F.concat(F.lit('{"v":'), own, F.lit("}")), "$.v")
    return norm_text(F.when(F.startswith(own, F.lit("{")), F.coalesce(*fields, F.lit(""))).when(F.startswith(own, F.lit('"')), inner).otherwise(""))


def as_list(value: Column) -> Column:
    """A JSON array's elements as texts; any other value as the only element; null as none."""
    own = F.trim(value)
    return (
        F.when(own.isNull() | (own == "null"), F.array().cast("array<string>"))
        .when(F.startswith(own, F.lit("[")), F.from_json(own, "array<string>"))
        .otherwise(F.array(own))
    )


def notes_text(value: Column) -> Column:
    """Texts of a JSON list of notes, objects by their ``text``, joined by blanks."""

    def one(note: Column) -> Column:
        plain = F.when(F.startswith(F.trim(note), F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), note, F.lit("}")), "$.v")).otherwise(note)
        return norm_text(F.when(F.startswith(F.trim(note), F.lit("{")), F.coalesce(F.get_json_object(note, "$.text"), F.lit(""))).otherwise(plain))

    return F.array_join(F.transform(as_list(value), one), " ")


def signals(name: Column, orcid: Column, affiliation: Column, overlap: Column) -> Column:
    """Names of the signals that speak for a candidate, in the order of listing."""
    return F.array_compact(
        F.array(
            F.when(name, "name"), F.when(orcid, "orcid"), F.when(affiliation, "affiliation"),
            F.when(overlap > 0, F.concat(F.lit("official_title_overlap:"), overlap.cast("string"))),
        )
    )


def decision(source: str, conflict: Column, strong: Column, score: Column, overlap: Column, n_signals: Column) -> Column:
    """``rejected``, ``confirmed``, ``probable`` or ``review``."""
    enough = overlap >= 1 if source == "zbmath" else n_signals >= 2
    return (
        F.when(conflict, "rejected").when(strong, "confirmed").when((score >= PROBABLE[source]) & enough, "probable").otherwise("review")
    )


def judge(candidates: DataFrame, source: str, people: DataFrame, by: str) -> DataFrame:
    """Candidates with ``signals``, ``conflicts`` and ``decision``; those a person has rejected say so and nothing else.

    ``candidates``: ``by``, ``author_id``, ``score``, ``overlap`` and booleans ``name``,
    ``orcid``, ``affiliation``, ``conflict``, ``strong``.  ``people``: ``by`` and
    ``rejected_ids`` (an array, lower case).
    """
    out = candidates.join(people.select(by, "rejected_ids"), by, "left")
    refused = F.coalesce(F.array_contains("rejected_ids", F.lower(norm_text(F.col("author_id")))), F.lit(False))
    found = signals(F.col("name"), F.col("orcid"), F.col("affiliation"), F.col("overlap"))
    own = decision(source, F.col("conflict"), F.col("strong"), F.col("score"), F.col("overlap"), F.size(found))
    none = F.array().cast("array<string>")
    conflicts = F.when(refused, F.array(F.lit(OVERRIDDEN))).when(F.col("conflict"), F.array(F.lit(MISMATCH))).otherwise(none)
    return out.select(
        by, "author_id", F.when(refused, 0).otherwise(F.col("score")).alias("score"),
        F.when(refused, none).otherwise(found).alias("signals"), conflicts.alias("conflicts"),
        F.when(refused, "rejected").otherwise(own).alias("decision"),
    )


def search_status(people: DataFrame, judged: DataFrame, by: str) -> DataFrame:
    """``(by, status)`` of a person's search, from what is known before it and the candidates it brought.

    ``people``: ``by``, ``review_status``, ``n_names`` (names to ask for), ``confirmed_id``.
    A rejected person isn't searched; nor one without names; a confirmed id stands; else no
    candidate, all of them rejected by hand, or candidates to choose from.
    """
    counts = judged.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("conflicts", OVERRIDDEN)).alias("n_refused")
    )
    none = F.coalesce("n", F.lit(0))
    status = (
        F.when(F.lower(norm_text(F.col("review_status"))) == "rejected", "identity_rejected")
        .when(F.coalesce("n_names", F.lit(0)) == 0, "missing_identity_seed")
        .when(norm_text(F.col("confirmed_id")) != "", "identity_confirmed")
        .when(none == 0, "no_candidate")
        .when(F.col("n_refused") == none, "identity_rejected")
        .otherwise("candidates")
    )
    return people.join(counts, by, "left").select(by, status.alias("status"))


def official_status(records: DataFrame, by: str, year: str, first: int, last: int) -> DataFrame:
    """``(by, status, confidence, n_records, n_recent)`` of people's own publication lists; ``by`` with a null year alone is a person without records."""
    recent = F.count_if(F.col(year).between(first, last))
    known = F.count_if(F.col("is_record"))
    out = records.groupBy(by).agg(known.alias("n_records"), recent.alias("n_recent"))
    status = F.when(F.col("n_recent") > 0, "success").when(F.col("n_records") > 0, "no_recent_record").otherwise("no_record")
    return out.select(by, status.alias("status"), F.when(F.col("n_recent") > 0, "high").otherwise("").alias("confidence"), "n_records", "n_recent")


def discovered(source: Column, author_id: Column, target: str, current: Column) -> Column:
    """The id column of one source: a discovered id of that source replaces what is there."""
    return F.when((source == target) & (F.coalesce(author_id, F.lit("")) != ""), author_id).otherwise(current)


def pick_author(candidates: DataFrame, overrides: DataFrame, by: str, name: str) -> DataFrame:
    """The candidate that an override names, for people that have one; ``direct`` marks it.

    Overrides (``by`` or ``name``, ``author_id``) for a person go before those for a name.
    """
    p = unused(candidates, overrides)
    own = overrides.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min("author_id").alias(f"{p}own"))
    shared = overrides.filter(F.col(by).isNull()).groupBy(name).agg(F.min("author_id").alias(f"{p}shared"))
    out = candidates.join(own, by, "left").join(shared, name, "left")
    wanted = F.coalesce(f"{p}own", f"{p}shared")
    return out.withColumn("direct", F.coalesce(wanted == F.col("author_id"), F.lit(False))).drop(f"{p}own", f"{p}shared")
