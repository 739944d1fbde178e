"""Merging rows of one person: columns folded together, and duplicates across targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.extract import clean_name
from dossier.functions.names import unused
from dossier.functions.text import norm_text
from dossier.operators.graph import cut
from dossier.operators.precedence import first_known, owners_of

# The columns that a merge folds, and what the notes say.
MERGED = (
    "title", "directory_institute", "homepage_institute", "department", "position", "part_time", "email", "phone", "address",
    "personal_url", "profile_url", "direction", "registry_direction", "registry_team", "team_evidence", "registry_pdf", "bio",
)
SAME_TARGET = "同目标重复记录合并："
KEPT_BOTH = "跨目标多学院归属保留："
SAME_NAME = "同校同名待人工复核："
ACROSS = "跨目标重复记录合并（identity）："


def merge_rows(rows: DataFrame, group: str, order: str, columns: Sequence[str], name: str, target: str, note: str = "note") -> DataFrame:
    """One row a group: its first row, ``columns`` with the distinct values of all its rows in order, and a note.

    Values are normalised; each appears once, where it was seen first, ``; `` between them.
    Other columns are those of the first row.  The first occurrence of a value is found by a
    combined minimum before anything is collected, so repeats of a value never meet.
    """
    p = unused(rows)
    rest = [c for c in rows.columns if c not in (group, *columns, note)]
    reason = F.concat(F.lit(SAME_TARGET), norm_text(F.col(name)), F.lit(" @ "), F.col(target))
    own = rows.withColumn(f"{p}text", F.array(*[F.struct(F.lit(i).alias("c"), norm_text(F.col(c)).alias("v")) for i, c in enumerate(columns)]))
    first = own.groupBy(group).agg(F.min(F.struct(F.col(order).alias(f"{p}o"), *[F.col(c) for c in rest])).alias(f"{p}f"), F.count(F.lit(1)).alias("n_merged"))
    values = own.select(group, F.col(order).alias(f"{p}o"), F.explode(f"{p}text").alias(f"{p}t")).filter(f"{p}t.v <> ''")
    values = values.groupBy(group, F.col(f"{p}t.c").alias(f"{p}c"), F.col(f"{p}t.v").alias(f"{p}v")).agg(F.min(f"{p}o").alias(f"{p}o"))
    notes = own.join(first.select(group, F.col(f"{p}f.{p}o").alias(f"{p}first")), group).filter(F.col(order) > F.col(f"{p}first"))
    notes = notes.groupBy(group, F.lit(len(columns)).alias(f"{p}c"), reason.alias(f"{p}v")).agg(F.min(order).alias(f"{p}o"))
    joined = values.unionByName(notes).groupBy(group, f"{p}c").agg(F.array_sort(F.collect_list(F.struct(f"{p}o", F.col(f"{p}v").alias("v")))).alias(f"{p}l"))
    joined = joined.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(f"{p}c", F.array_join(F.transform(f"{p}l", lambda x: x["v"]), "; ").alias("t")))).alias(f"{p}m"))
    out = first.join(joined, group, "left")

    def text(i: int) -> Column:
        return F.coalesce(F.element_at(f"{p}m", F.lit(i)), F.lit(""))

    return out.select(
        group, *[F.col(f"{p}f.{c}").alias(c) for c in rest], *[text(i).alias(c) for i, c in enumerate(columns)],
        text(len(columns)).alias(note), "n_merged",
    )


def name_key(school: Column, name: Column) -> Column:
    """A key by which people of a school are compared by name: Chinese names of 2 to 8 characters only, else null."""
    own = clean_name(name)
    return F.when(F.rlike(own, F.lit(r"^[一-鿿]{2,8}$")), F.concat_ws(":", F.lit("name"), school, own))


def across_targets(rows: DataFrame) -> DataFrame:
    """``(o, owner, note)``: into which row each one is merged across targets, itself if it is kept.

    ``rows``: ``o`` (the place of a row in the order of targets, from the most important, and
    of rows within), ``target``, ``overlap`` (group of targets that share people on purpose,
    or empty), ``name``, ``keys`` (its identity keys in order) and ``by_name`` (``name_key``).

    The first key that an earlier row has names the owner.  Between targets of one overlap group both rows stay
    and both say so; a row without an owner that shares a name within its school with an earlier one stays, and
    both ask for review; else it is merged, and its owner says so.  Owners are found by pointers to earlier rows
    (``precedence``), notes by joins on them: no task holds more than a row and the notes it ends with.
    """
    own = rows.select(
        F.col("o").cast("long").alias("o"), "target", F.coalesce("overlap", F.lit("")).alias("overlap"), norm_text(F.col("name")).alias("name"),
        F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), F.coalesce("by_name", F.lit("")).alias("by_name"),
    )
    own = cut(own)
    pointers = cut(first_known(own, "o", "keys"))
    owners = cut(owners_of(own, pointers, "o", "overlap"))
    targets = own.select(F.col("o").alias("who"), F.col("target").alias("their"))
    led = own.join(pointers, "o")

    def facing(met: DataFrame, text: Column, both: bool) -> DataFrame:
        """Notes about rows and those that they face (``who``, ``their`` target): for these, or for both."""
        to = F.array("who", "o") if both else F.array("who")
        return met.join(targets, "who").select("o", text.alias("note"), F.explode(to).alias("row"))

    said = lambda start, *parts: F.concat(F.lit(start), "name", F.lit(" @ "), *parts)
    # The owner that a row would have joined is that of its parent.
    above = led.join(owners.select(F.col("o").alias("parent"), F.col("owner").alias("who")), "parent").join(owners, "o")
    merged = facing(above.filter("owner <> o"), said(ACROSS, "target", F.lit(" -> "), "their"), False)
    kept = facing(above.filter("owner = o"), said(KEPT_BOTH, "their", F.lit(" / "), "target"), True)
    named = own.filter("by_name <> ''")
    firsts = named.groupBy("by_name").agg(F.min("o").alias("first"))
    alike = named.join(pointers, "o", "left_anti").join(firsts, "by_name").filter("first < o")
    alike = alike.join(owners.select(F.col("o").alias("first"), F.col("owner").alias("who")), "first")
    review = facing(alike, said(SAME_NAME, "target", F.lit(" / "), "their"), True)
    notes = merged.unionAll(kept).unionAll(review).groupBy("row", "note").agg(F.min("o").alias("at"))
    joined = notes.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda n: n["note"]), "; ").alias("note"))
    return owners.join(joined.withColumnRenamed("row", "o"), "o", "left").select("o", "owner", F.coalesce("note", F.lit("")).alias("note"))
