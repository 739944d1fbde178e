"""What is asked for in outside sources: identity seeds, affiliations, profile ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import let, norm_text
from dossier.operators.graph import cut

ORCID_PREFIX = "https://orcid.org/"
# Fixed value: the form of a profile's id.
PROFILE_ID = r"^[a-z0-9][a-z0-9_-]{0,63}$"
OVERRIDES = (
    "canonical_english_name string, aliases array<string>, affiliations array<string>, orcid string, openalex_id string, "
    "zbmath_author_id string, dblp_pid string, known_titles array<string>, review_status string"
)


def distinct_texts(values: Column) -> Column:
    """Normalised, not empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, norm_text), lambda v: v != ""))


def first_given(*values: Column) -> Column:
    """The first value that isn't empty, normalised; else the empty string."""
    return F.coalesce(*[F.nullif(norm_text(v), F.lit("")) for v in values], F.lit(""))


def seeds(people: DataFrame, overrides: DataFrame, id_col: str) -> DataFrame:
    """Identity seeds: what overrides say goes before what the person's row says.

    ``people``: ``id_col``, ``name``, ``english_name``, ``english_aliases`` (semicolons between),
    ``found_names`` and ``generated_names`` (arrays), ``institutes`` (an array), ``orcid``,
    ``openalex_id``, ``zbmath_author_id``, ``dblp_pid``, ``titles`` (an array; five count).
    ``overrides`` holds ``id_col`` once and the columns of ``OVERRIDES``.  Gives ``query_names``
    (two at most) and ``seed_hash`` besides.
    """
    held = overrides.select(id_col, F.struct(*[p.split()[0] for p in OVERRIDES.split(", ")]).alias("o"))
    rows = people.join(held, id_col, "left")
    none = F.array().cast("array<string>")
    many = lambda c: F.coalesce(F.col(c), none)
    canonical = first_given(F.col("o.canonical_english_name"), F.col("english_name"))
    aliases = distinct_texts(
        F.concat(F.array(canonical), many("o.aliases"), F.split(norm_text(F.col("english_aliases")), ";"), many("found_names"), many("generated_names"))
    )
    ids = {c: first_given(F.col(f"o.{c}"), F.col(c)) for c in ("openalex_id", "zbmath_author_id", "dblp_pid")}
    out = rows.select(
        id_col, norm_text(F.col("name")).alias("name"), canonical.alias("canonical_english_name"), aliases.alias("aliases"),
        distinct_texts(F.concat(many("o.affiliations"), many("institutes"))).alias("affiliations"),
        F.replace(first_given(F.col("o.orcid"), F.col("orcid")), F.lit(ORCID_PREFIX), F.lit("")).alias("orcid"),
        *[v.alias(c) for c, v in ids.items()],
        distinct_texts(F.concat(many("o.known_titles"), F.slice(many("titles"), 1, 5))).alias("known_titles"),
        first_given(F.col("o.review_status"), F.lit("automatic")).alias("review_status"),
    )
    names = F.slice(distinct_texts(F.concat(F.array("canonical_english_name"), F.col("aliases"), F.array("name"))), 1, 2)
    parts = [F.array_join(c, "\u001f") if c in ("aliases", "affiliations", "known_titles") else F.col(c).cast("string") for c in out.columns]
    return out.withColumns({"query_names": names, "seed_hash": F.sha2(F.concat_ws("\u001e", *parts), 256)})


def affiliations(
    people: DataFrame, id_col: str, department: Column, text: Column, home: tuple[str, Sequence[str]], rules: Mapping[str, Sequence[str]],
    overrides: DataFrame | None = None,
) -> DataFrame:
    """``(id_col, target, status, method)``: where people belong, a row for each target.

    A department of the ``home`` target confirms it; a text that matches one of a target's
    patterns confirms that target and replaces what the department said; an override
    (``id_col``, ``target``, ``status``) replaces either; who has none of them awaits review
    under the home target.
    """
    target, departments = home
    stated = F.when(norm_text(department).isin(*departments), F.struct(F.lit(target).alias("target"), F.lit(1).alias("rank"), F.lit("department").alias("method")))

    def found(own: Column) -> list[Column]:
        return [
            F.when(F.rlike(own, F.lit("|".join(f"(?:{p})" for p in patterns))), F.struct(F.lit(t).alias("target"), F.lit(2).alias("rank"), F.lit("profile").alias("method")))
            for t, patterns in rules.items()
        ]

    given = let(norm_text(text), lambda own: F.array_compact(F.array(stated, *found(own))))
    rows = people.select(id_col, F.explode(given).alias("a")).select(id_col, "a.*", F.lit("confirmed").alias("status"))
    if overrides is not None:
        rows = rows.unionByName(overrides.select(id_col, "target", F.lit(3).alias("rank"), F.lit("override").alias("method"), first_given(F.col("status"), F.lit("reviewed")).alias("status")))
    best = rows.groupBy(id_col, "target").agg(F.max(F.struct("rank", "method", "status")).alias("b"))
    # Written, as it is read twice: for what it says and for who is left.
    told = cut(best.select(id_col, "target", "b.status", "b.method"))
    left = people.select(id_col).join(told.select(id_col).distinct(), id_col, "left_anti")
    return told.unionByName(left.select(id_col, F.lit(target).alias("target"), F.lit("pending").alias("status"), F.lit("directory").alias("method")))


def is_profile_id(value: Column) -> Column:
    return F.rlike(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit(PROFILE_ID))


def custom_profile_id(content: Column) -> Column:
    """The id of a profile that is given by its path: from the hash of its content."""
    return F.concat(F.lit("custom-"), F.left(F.sha2(content, 256), F.lit(12)))


def active_profile(profiles: DataFrame, explicit: str = "", legacy: str = "legacy-default") -> DataFrame:
    """The profile that is asked for, else the active one, else the old default; of several the first by id."""
    rank = F.when(F.col("profile_id") == explicit, 0).when(F.col("active"), 1).when(F.col("profile_id") == legacy, 2)
    ranked = profiles.withColumn("rank", rank).filter("rank IS NOT NULL")
    if explicit:
        ranked = ranked.filter("rank = 0")
    return ranked.orderBy("rank", "profile_id").limit(1).drop("rank")


def keyword_split(keywords: Column, groups: Mapping[str, Sequence[str]], bridging: Sequence[str]) -> Column:
    """``struct<bridge, core>``: keywords of the ``bridging`` direction groups, and the rest."""
    own = sorted({t.lower() for g in bridging for t in groups.get(g, ())})
    listed = F.array(*[F.lit(t) for t in own]).cast("array<string>")
    inside = lambda k: F.array_contains(listed, F.lower(norm_text(k)))
    return F.struct(F.filter(keywords, inside).alias("bridge"), F.filter(keywords, lambda k: ~inside(k)).alias("core"))
