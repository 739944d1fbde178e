"""Dashboard queries: search, weak evidence, progress, calendar, drill-down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.names import unused


def search(rows: DataFrame, query: str, columns: Sequence[str], *filters: Column | None) -> DataFrame:
    """Rows whose columns, joined by blanks, hold the query in any case, and that pass all filters given."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    out = rows.filter(F.contains(text, F.lit(query.strip().lower()))) if query.strip() else rows
    for condition in filters:
        if condition is not None:
            out = out.filter(condition)
    return out


def number(value: Column) -> Column:
    """A number from anything, zero for what isn't one."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def is_weak(*counts: Column) -> Column:
    """Whether all evidence counts together come to one at most."""
    return sum((number(c) for c in counts), F.lit(0.0)) <= 1


def progress(rows: DataFrame, by: Sequence[str], contacted: Column, progressed: Column, met: Column) -> DataFrame:
    """Totals and a whole percentage, halves up, for each group."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(contacted).alias("contacted"),
        F.count_if(progressed).alias("progressed"), F.count_if(met).alias("interviews"),
        F.floor(F.count_if(contacted) * 100.0 / F.count(F.lit(1)) + 0.5).cast("long").alias("pct"),
    )


def calendar(records: DataFrame, dates: Sequence[Column], first: str, days: int = 28) -> DataFrame:
    """A row for each day of the range, with the number of records that have it among their dates."""
    spark = records.sparkSession
    day = F.explode(F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(first).cast("date"), days - 1)))
    grid = spark.range(1).select(day.alias("day"))
    seen = (
        records.select(F.explode(F.array_distinct(F.array_compact(F.array(*dates)))).alias("day"))
        .groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    )
    return grid.join(seen, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def response_counts(rows: DataFrame, responses: Column, nothing: str) -> DataFrame:
    """How often each response was recorded; rows without any count under ``nothing``."""
    own = F.when(F.coalesce(F.size(responses), F.lit(0)) > 0, responses).otherwise(F.array(F.lit(nothing)))
    return rows.select(F.explode(own).alias("response")).groupBy("response").agg(F.count(F.lit(1)).alias("n"))


def first_present(values: Column, priority: Sequence[str]) -> Column:
    """The first of the priorities that an array holds, else null."""
    return F.coalesce(*[F.when(F.array_contains(values, p), F.lit(p)) for p in priority])


def details(people: DataFrame, rows: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Each person's detail rows: those with the same id; for a person without such, those of the name.

    By name only rows without an id count.
    """
    by_id = people.join(rows.drop(name_col), id_col)
    without = people.join(rows.select(id_col).distinct(), id_col, "left_anti")
    nameless = rows.filter(F.col(id_col).isNull()).drop(id_col)
    return by_id.unionByName(without.join(nameless, name_col))


def neighbours(rows: DataFrame, by: Sequence[str], order: Sequence[Column], id_col: str) -> DataFrame:
    """The record before and after each one in a list's order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"previous_id": F.lag(id_col).over(w), "next_id": F.lead(id_col).over(w)})


def status_by_prefix(rows: DataFrame, store: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows with ``entry`` of the store: that of their key, else the only one whose key begins with ``target|name|``.

    ``store`` holds ``row_key`` once, of the form ``target|name|rest``, and ``entry``.  Prefixes
    are cut off the store's keys and counted, so both lookups are equi-joins.
    """
    p = unused(rows, store)
    exact = store.select(F.col("row_key").alias(key), F.col("entry").alias(f"{p}a"))
    parts = F.split("row_key", r"\|")
    heads = store.filter(F.col("entry").isNotNull() & (F.size(parts) >= 3))
    heads = heads.groupBy(F.concat_ws("|", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.lit("")).alias(prefix))
    only = heads.agg(F.count(F.lit(1)).alias(f"{p}n"), F.min("entry").alias(f"{p}b")).filter(f"{p}n = 1").drop(f"{p}n")
    out = rows.join(exact, key, "left").join(only, prefix, "left")
    return out.withColumn("entry", F.coalesce(f"{p}a", f"{p}b")).drop(f"{p}a", f"{p}b")


def merge_entries(base: Column, stored: Column, fields: Sequence[str], kept: str = "responses") -> Column:
    """A stored entry over a row's own; an empty list of responses keeps the row's."""
    values = [F.coalesce(stored[f], base[f]).alias(f) for f in fields]
    own = F.when(F.coalesce(F.size(stored[kept]), F.lit(0)) == 0, base[kept]).otherwise(stored[kept])
    return F.struct(*values, own.alias(kept))


def header(rows: DataFrame, shown: Column, status: Column, contacted: str, blocked: Sequence[str]) -> DataFrame:
    """One row: how many records there are, are shown, were contacted and are ruled out."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(shown).alias("shown"), F.count_if(status == contacted).alias("contacted"),
        F.count_if(status.isin(*blocked)).alias("blocked"),
    )


def choices(rows: DataFrame, value: str, within: Column | None = None) -> DataFrame:
    """The distinct values of a filter in order, those of the rows ``within`` only."""
    own = rows if within is None else rows.filter(within)
    return own.select(value).filter(F.coalesce(F.col(value), F.lit("")) != "").distinct().orderBy(value)


def page(rows: DataFrame, order: Sequence[Column], number_: int, size: int = 120) -> DataFrame:
    """One page of a list, from 1, with ``place``: a limit that Spark keeps as a bounded heap."""
    first = (number_ - 1) * size
    top = rows.orderBy(*order).limit(first + size)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).filter(F.col("place") > first)


def change_status(entry: Column, status: Column, today: Column, contacted: str, sent: str) -> Column:
    """``struct<status, contacted_at, responses>`` after a change; a first contact fills in date and response."""
    first = status == contacted
    return F.struct(
        F.nullif(status, F.lit("")).alias("status"),
        F.when(first & (F.coalesce(entry["contacted_at"], F.lit("")) == ""), today).otherwise(entry["contacted_at"]).alias("contacted_at"),
        F.when(first & (F.coalesce(F.size(entry["responses"]), F.lit(0)) == 0), F.array(F.lit(sent))).otherwise(entry["responses"]).alias("responses"),
    )


def canonical_signal(value: Column) -> Column:
    """A signal as it is compared: full-width letters, digits and marks as ASCII, lower case, no closing stop."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "
    text = F.regexp_replace(F.lower(F.translate(F.trim(value), wide, plain)), r"\s+", " ")
    return F.trim(F.regexp_replace(text, r"[。.]$", ""))


def signals_of(value: Column) -> Column:
    """The signals of a field: parts between separators, labels of sources taken out."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?i)(?:DBLP|arXiv|WebSearch|网页)(?:近三年)?关键词\s*[:：]", ";")
    return F.filter(F.transform(F.split(text, r"[;；,，、|\n]+"), lambda v: F.trim(v)), lambda v: v != "")


def new_signals(groups: Sequence[tuple[str, Column]]) -> Column:
    """``array<struct<source, signals>>``: of each source the signals that no earlier source showed."""
    none = F.array().cast("array<string>")

    def keyed(v: Column) -> Column:
        return F.struct(canonical_signal(v).alias("k"), v.alias("v"))

    def unseen(own: Column, known: Column) -> Column:
        def first(x: Column, i: Column) -> Column:
            return (F.array_position(keys_of(own), x["k"]) == i + 1) & (x["k"] != "") & ~F.array_contains(known, x["k"])

        return F.transform(F.filter(own, first), lambda x: x["v"])

    def keys_of(own: Column) -> Column:
        return F.transform(own, lambda y: y["k"])

    out, seen = [], none
    for name, value in groups:
        own = F.transform(signals_of(value), keyed)
        out.append(F.struct(F.lit(name).alias("source"), unseen(own, seen).alias("signals")))
        seen = F.concat(seen, keys_of(own))
    return F.filter(F.array(*out), lambda g: F.size(g["signals"]) > 0)


def breakdown(scores: Sequence[tuple[str, Column]], counts: Sequence[tuple[str, Column]]) -> Column:
    """``array<struct<label, value>>``: a row's scores, or where it has none at all its counts; empty is 0."""

    def entries(pairs: Sequence[tuple[str, Column]]) -> Column:
        zero = lambda v: F.coalesce(F.nullif(F.trim(v.cast("string")), F.lit("")), F.lit("0"))
        return F.array(*[F.struct(F.lit(name).alias("label"), zero(v).alias("value")) for name, v in pairs])

    given = F.lit(False)
    for _, v in scores:
        given = given | (F.coalesce(F.trim(v.cast("string")), F.lit("")) != "")
    return F.when(given, entries(scores)).otherwise(entries(counts))


def combined_direction(direction: Column, sources: Sequence[tuple[str, Column]], most: int = 1200) -> Column:
    """The official direction and what each source adds, behind its label, distinct and cut to a length."""
    said = [F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(label), F.trim(v))) for label, v in sources]
    parts = F.filter(F.array_compact(F.array(F.trim(F.coalesce(direction, F.lit(""))), *said)), lambda v: v != "")
    return F.left(F.array_join(F.array_distinct(parts), "; "), F.lit(most))


def undated(rows: DataFrame, done: Column, date: Column) -> DataFrame:
    """Rows that are marked as done but have no date of it."""
    return rows.filter(done & (F.coalesce(F.trim(date.cast("string")), F.lit("")) == ""))


def within(rows: DataFrame, dates: Sequence[Column], first: str, last: str) -> DataFrame:
    """Rows with some date in a range of days, both ends in it; times count as their day."""
    inside = F.lit(False)
    for date in dates:
        inside = inside | F.coalesce(F.to_date(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))
    return rows.filter(inside)


# Statuses of a source that failed, and of one that was never asked.
FAILED, NOT_ASKED = ("request_failed", "schema_changed", "terms_required"), "not_configured"


def source_report(rows: DataFrame, source: str, accepted: Column, status: Column, truncated: Column) -> DataFrame:
    """``(source, raw, accepted, rejected, truncated, health)``: what each source brought, how much of it counts, and how it went.

    A source is degraded if some status of its rows says that it failed, not configured if all say that it wasn't asked, else ok.
    """
    out = rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(accepted).alias("accepted"), F.max(F.coalesce(truncated, F.lit(False))).alias("truncated"),
        F.max(F.coalesce(status.isin(*FAILED), F.lit(False))).alias("failed"), F.min(F.coalesce(status == NOT_ASKED, F.lit(False))).alias("silent"),
    )
    rejected = F.greatest(F.lit(0).cast("long"), F.col("raw") - F.col("accepted"))
    health = F.when(F.col("silent"), NOT_ASKED).when(F.col("failed"), "degraded").otherwise("ok")
    return out.withColumns({"rejected": rejected, "health": health}).drop("failed", "silent")
