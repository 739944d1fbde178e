"""What was found about people's works: their keywords, their audit, the last of alike entries, and checks of entries against titles known elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import norm_text
from dossier.operators.dedup import duplicated
from dossier.operators.rows import summary
from dossier.operators.scoring import Profile, matched_terms, score

# How sure an entry is, the confidences that count as verified, and the shortest title that may be looked for.
IN_CATALOGUE, IN_DBLP, BY_NAME = "中-学术库题名交叉确认", "中-DBLP交叉确认", "低-姓名未消歧"
VERIFIED = ("high", "medium", "高", "中")
LONG_TITLE = 12
REVIEW = ("review", "unresolved")


def letters(value: Column) -> Column:
    """Lower-cased ASCII letters, digits and Chinese characters."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9一-鿿]", "")


def person_findings(works: DataFrame, by: str, year: str, venue: str, title: str, order: str, profile: Profile) -> DataFrame:
    """``by``, ``n``, ``years``, ``venues``, ``titles``, ``keywords``, ``score`` and ``has_core`` of each person's works.

    Titles go by what title and venue score, then year.  Keywords are those of all titles and venues together: the terms
    of the profile that each work holds are put together before they are weighed against each other, so a person meets
    as no more than the profile's terms.  A term that would begin in one work and end in the next isn't seen.  Null
    titles and venues are empty.
    """
    text = F.concat_ws(" ", title, venue)
    own = works.withColumn("score_", score(text, profile)["score"])
    shown = summary(own, by, year, venue, title, "score_", order)
    terms = [kw for kw, weight in profile.weights if weight > 0]
    held = own.select(F.col(by).alias("by_"), F.explode(matched_terms(F.lower(norm_text(text)), terms)).alias("term")).distinct()
    # In the profile's order, so that equal terms make equal texts.
    place = F.array_position(F.array(*map(F.lit, terms)), F.col("term"))
    held = held.groupBy("by_").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), "term"))), lambda t: t["term"]), " ; ").alias("terms_"))
    out = shown.join(held, F.col(by).eqNullSafe(F.col("by_")), "left").withColumn("found_", score(F.coalesce("terms_", F.lit("")), profile))
    core = F.array(*map(F.lit, profile.core)).cast("array<string>")
    return out.select(*shown.columns, F.array_join("found_.keywords", "; ").alias("keywords"), F.col("found_.score").alias("score"), F.arrays_overlap("found_.keywords", core).alias("has_core"))


def publication_audit(people: DataFrame, details: DataFrame, candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """``(metric, n)``: how complete and traceable a run's works are; ``ok`` is 1 if nothing is missing, twice or blank.

    ``people`` has ``seed_hash``; ``details`` has ``person``, ``canonical_id``, ``title``, ``trace_id`` and ``url``, ``candidates`` has
    ``needs_review`` (是 or not; null where only ``decision`` tells), ``sources`` has ``source`` and ``status``, each pair a metric of its own.
    Nulls are blank.  Empty tables give zeros, and ``ok``.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    main = people.agg(F.count(F.lit(1)).alias("people"), F.count_if(~blank("seed_hash")).alias("seeds"))
    own = details.agg(F.count(F.lit(1)).alias("works"), F.count_if(blank("title")).alias("blank_titles"), F.count_if(blank("trace_id") & blank("url")).alias("missing_trace"))
    named = details.filter(~blank("canonical_id")).select(F.trim(F.coalesce("person", F.lit(""))).alias("person"), F.trim("canonical_id").alias("canonical_id"))
    twice = duplicated(named, ["person", "canonical_id"]).agg(F.count(F.lit(1)).alias("twice"))
    asked = F.when(F.col("needs_review").isNotNull(), F.col("needs_review") == "是").otherwise(F.coalesce(F.col("decision").isin(*REVIEW), F.lit(False)))
    queue = candidates.agg(F.count_if(asked).alias("review_queue"))
    names = {"people": "people", "seeds": "identity_seed_coverage", "works": "publication_rows", "blank_titles": "blank_titles", "twice": "duplicate_canonical_rows", "missing_trace": "missing_trace_rows", "review_queue": "review_queue"}
    rows = None
    for counts in (main, own, twice, queue):
        listed = counts.select(F.inline(F.array(*[F.struct(F.lit(names[c]).alias("metric"), F.col(c).alias("n")) for c in counts.columns])))
        rows = listed if rows is None else rows.unionAll(listed)
    of = lambda name: F.max(F.when(F.col("metric") == names[name], F.col("n")))
    fine = (of("seeds") == of("people")) & (of("blank_titles") + of("twice") + of("missing_trace") == 0)
    rows = rows.unionAll(rows.agg(fine.cast("long").alias("n")).select(F.lit("ok").alias("metric"), "n"))
    pairs = sources.groupBy(F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("status", F.lit(""))).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionAll(pairs)


def last_entries(entries: DataFrame, by: str, order: str) -> DataFrame:
    """The last by ``order`` of a person's entries that share a link or, without one, a title in any case; ``place`` counts them from the latest.

    ``entries`` has ``link``, ``title`` and ``published``; equal dates go by the order in which their kind came first.
    """
    kind = F.coalesce(F.nullif("link", F.lit("")), F.lower(F.coalesce("title", F.lit(""))))
    rest = [c for c in entries.columns if c not in (by, order)]
    last = entries.groupBy(by, kind.alias("kind_")).agg(F.max_by(F.struct(order, *rest), order).alias("last_"), F.min(order).alias("first_"))
    rank = Window.partitionBy(by).orderBy(F.desc_nulls_last("last_.published"), "first_")
    return last.select(by, "last_.*", (F.row_number().over(rank) - 1).alias("place"))


def cross_checked(people: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """``by``, ``n``, ``confidence`` of people with entries: whether titles known elsewhere, or author and titles, confirm them.

    ``people`` has ``by`` (each once), ``dblp_author``, ``dblp_confidence``, ``dblp_titles``, ``publication_confidence`` and ``publication_titles``; ``entries``
    has ``by``, ``title`` and ``authors`` (``; `` between them).  Each entry is compared with its own person's texts, as letters
    only; titles of fewer than 12 are not looked for.  The checks are combined maxima, so entries aren't gathered.
    """
    only = lambda c: F.regexp_replace(F.lower(norm_text(c)), "[^a-z]", "")
    known = people.select(
        F.col(by).alias("by_"), only(F.coalesce("dblp_author", F.lit(""))).alias("author_"), (norm_text("dblp_confidence") == "高").alias("dblp_"), letters(norm_text("dblp_titles")).alias("in_dblp_"),
        norm_text("publication_confidence").isin(*VERIFIED).alias("verified_"), letters(norm_text("publication_titles")).alias("in_works_"),
    )
    key = letters(F.col("title"))
    # As in the rule, the length is that of a title without letters in capitals.
    long = F.length(F.regexp_replace(F.coalesce("title", F.lit("")), "[^a-z0-9一-鿿]", "")) >= LONG_TITLE
    own = entries.select(by, key.alias("key_"), long.alias("long_"), F.split(F.coalesce("authors", F.lit("")), "; ").alias("names_")).join(known, F.col(by) == F.col("by_"))
    same = (F.col("author_") != "") & F.exists("names_", lambda n: F.regexp_replace(F.lower(n), "[^a-z]", "") == F.col("author_"))
    held = lambda text: F.col("long_") & (F.col(text) != "") & F.contains(F.col(text), F.col("key_"))
    told = own.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.max(same).alias("same"), F.max(held("in_dblp_")).alias("dblp"), F.max(held("in_works_")).alias("works"), F.max("dblp_").alias("sure"), F.max("verified_").alias("verified")
    )
    confidence = F.when(F.col("verified") & F.col("works"), IN_CATALOGUE).when(F.col("sure") & F.col("same") & F.col("dblp"), IN_DBLP).otherwise(BY_NAME)
    return told.select(by, "n", confidence.alias("confidence"))
