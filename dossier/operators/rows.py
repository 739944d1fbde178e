"""Row shaping: ordered projection, columns moved and kept, overrides, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import norm_text, unique_join


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; those that are absent are empty strings."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def insert_after(df: DataFrame, anchor: str, columns: Sequence[str], note: str | None = None, legacy: Sequence[str] = ()) -> DataFrame:
    """Move ``columns`` right behind ``anchor``, making those that are absent; fold legacy columns into ``note``.

    Without the anchor column nothing changes.
    """
    if anchor not in df.columns:
        return df
    old = [c for c in legacy if c in df.columns]
    if note and old:
        parts = [F.col(c) for c in (note, *old) if c in df.columns]
        df = df.withColumn(note, unique_join(F.array(*[norm_text(p) for p in parts])))
    order = []
    for name in df.columns:
        if name not in old and name not in columns:
            order.append(name)
        if name == anchor:
            order.extend(columns)
    return project(df, order)


def keep_previous(rows: DataFrame, previous: DataFrame, key: str, columns: Sequence[str], again: Column) -> DataFrame:
    """Values of ``columns`` from an earlier output, but for rows that are worked out ``again``.

    An earlier row counts even where its value is null; ``previous`` holds a key once.
    """
    held = previous.select(key, F.struct(*[c for c in columns if c in previous.columns]).alias("__held"))
    out = rows.withColumn("__again", again).join(held, key, "left")
    kept = F.col("__held").isNotNull() & ~F.coalesce("__again", F.lit(False))
    shared = [c for c in columns if c in previous.columns]
    values = {c: F.when(kept, F.col(f"__held.{c}")).otherwise(F.col(c) if c in rows.columns else F.lit(None)) for c in shared}
    return out.withColumns(values).drop("__held", "__again")


def override(rows: DataFrame, overrides: DataFrame, keys: Sequence[str], value: str, target: str) -> DataFrame:
    """The value of the override that fits; a key that is empty in an override fits anything.

    Overrides are split by which of their keys are given, so each kind is an equi-join; those
    with more keys given win, and of equal ones the smallest value.
    """
    kinds = sorted(range(1, 1 << len(keys)), key=lambda m: (-bin(m).count("1"), m))
    out, found = rows, []
    for mask in kinds:
        given = [k for i, k in enumerate(keys) if mask >> i & 1]
        fits = overrides
        for k in keys:
            fits = fits.filter((F.coalesce(F.col(k), F.lit("")) != "") == F.lit(k in given))
        name = f"__o{mask}"
        out = out.join(fits.groupBy(*given).agg(F.min(value).alias(name)), given, "left")
        found.append(name)
    own = F.col(target) if target in rows.columns else F.lit(None)
    return out.withColumn(target, F.coalesce(*[F.col(n) for n in found], own)).drop(*found)


def summary(rows: DataFrame, by: str, year: str, venue: str, title: str, score: str, order: str, most: int = 10) -> DataFrame:
    """Publications of each person: count, years, main venues, best titles.

    ``n``; ``years``: ``year:count`` from the latest; ``venues``: the ``most`` commonest as
    ``venue(count)``, of equal counts the one seen first; ``titles``: the ``most`` best by
    score, then year, then order of appearance.  Counts are combined before they are ranked
    and ranks are cut before anything is collected, so no person's rows are gathered whole.
    """
    years = rows.groupBy(by, year).agg(F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(":", F.col(year).cast("string"), F.col("n").cast("string"))
    per_year = years.groupBy(by).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(year).alias("y"), text.alias("t"))), False).alias("ys"))
    named = rows.filter(F.coalesce(F.col(venue), F.lit("")) != "")
    venues = named.groupBy(by, venue).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = venues.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first", venue))).filter(F.col("r") <= most)
    shown = F.concat(F.col(venue), F.lit("("), F.col("n").cast("string"), F.lit(")"))
    per_venue = best.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("r", shown.alias("t")))).alias("vs"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.desc(year), order))).filter(F.col("r") <= most)
    line = F.concat(F.lit("["), F.concat_ws(" ", F.col(year).cast("string"), venue), F.lit("] "), F.col(title))
    per_title = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("r", line.alias("t")))).alias("ts"))
    joined = per_year.join(per_venue, by, "left").join(per_title, by, "left")

    def joined_text(name: str, sep: str) -> Column:
        return F.coalesce(F.array_join(F.transform(name, lambda x: x["t"]), sep), F.lit(""))

    return joined.select(by, "n", joined_text("ys", "; ").alias("years"), joined_text("vs", "; ").alias("venues"), joined_text("ts", "；").alias("titles"))


def identity_decision(status: Column, confidence: Column) -> Column:
    """What an adapter's status and confidence say about a person's identity."""
    searched = status.isin("success", "no_recent_record")
    return (
        F.when((status == "identity_confirmed") | (searched & (confidence == "high")), "confirmed")
        .when((status == "identity_probable") | (searched & (confidence == "medium")), "probable")
        .when(status == "identity_uncertain", "review")
        .when(status == "identity_rejected", "rejected")
        .otherwise("unresolved")
    )


def syllables(people: DataFrame, id_col: str, name_col: str, sounds: DataFrame) -> DataFrame:
    """``(id_col, syllables)``: the sound of each Chinese character of a name, in order.

    ``sounds`` (``character``, ``sound``) is cut to single characters of the CJK block, at
    most 20,992 rows, and sounds to 16 letters, which bounds what is broadcast.
    """
    table = sounds.filter(F.rlike("character", F.lit(r"^[一-鿿]$")) & (F.length("sound") <= 16)).groupBy("character").agg(F.min("sound").alias("sound"))
    marks = F.posexplode(F.regexp_extract_all(norm_text(F.col(name_col)), F.lit(r"[一-鿿]"), F.lit(0))).alias("at", "character")
    heard = people.select(id_col, marks).join(F.broadcast(table), "character")
    found = heard.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "sound"))).alias("s"))
    return found.select(id_col, F.transform("s", lambda x: x["sound"]).alias("syllables"))
