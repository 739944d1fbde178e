"""The status store: normal entries, overlay on results, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import minute, valid_date
from dossier.functions.names import unused
from dossier.functions.text import norm_text

# The statuses, an old name of one, the separators of response lists.
STATUSES = ("已套磁", "先不考虑", "不可能", "不匹配")
OLD_STATUS = {"不考虑": "先不考虑"}
RESPONSE_SPLIT = "[；;、,]"
FIELDS = ("status", "contacted_at", "responses", "interview_at", "note")


def status(value: Column) -> Column:
    text = norm_text(value)
    for old, new in OLD_STATUS.items():
        text = F.when(text == old, new).otherwise(text)
    return F.when(text.isin(*STATUSES), text).otherwise("")


def responses(value: Column) -> Column:
    """Distinct responses of a delimited list, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(norm_text(value), RESPONSE_SPLIT), lambda v: F.trim(v)), lambda v: v != ""))


def normalize(entries: DataFrame) -> DataFrame:
    """Statuses, dates and response lists in normal form; entries with nothing in them go."""
    out = entries.withColumns(
        {
            "status": status(F.col("status")),
            "contacted_at": F.coalesce(valid_date(F.col("contacted_at")), F.lit("")),
            "responses": responses(F.col("responses")),
            "interview_at": minute(F.coalesce(F.col("interview_at"), F.lit(""))),
            "note": norm_text(F.col("note")),
        }
    )
    said = (F.size("responses") > 0) | F.lit(False)
    for name in ("status", "contacted_at", "interview_at", "note"):
        said = said | (F.col(name) != "")
    return out.filter(said)


def overlay(
    rows: DataFrame, store: DataFrame, key: str, fallback: str, fields: Sequence[str], authoritative: bool = False
) -> DataFrame:
    """Lay stored entries over rows: by the first key, and where it has none, by the other.

    ``store`` holds ``row_key`` once and the fields.  An authoritative store replaces the
    fields of every row, by nulls where it has no entry; else its non-null fields win.
    Columns with the fields' names in ``rows`` are what is kept below.
    """
    p = unused(rows, store)
    entry = F.struct(*fields)
    first = store.select(F.col("row_key").alias(key), entry.alias(f"{p}a"))
    second = store.select(F.col("row_key").alias(fallback), entry.alias(f"{p}b"))
    out = rows.join(first, key, "left").join(second, fallback, "left")
    found = F.coalesce(f"{p}a", f"{p}b")
    own = {f: F.col(f) if f in rows.columns and not authoritative else F.lit(None) for f in fields}
    return out.withColumn(f"{p}e", found).withColumns({f: F.coalesce(F.col(f"{p}e.{f}"), own[f]) for f in fields}).drop(f"{p}a", f"{p}b", f"{p}e")


def upsert(store: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last entry of each key by sequence number; a change that is a deletion removes it.

    ``changes`` has the store's columns and ``deleted``; the newest row of a key wins as a
    combined maximum, so a key that changes often doesn't meet in one task.
    """
    both = store.withColumn("deleted", F.lit(False)).unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, seq)]
    last = both.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("t"))
    return last.filter(~F.coalesce("t.deleted", F.lit(False))).select(key, *[f"t.{c}" for c in store.columns if c != key])
