"""Status columns of result tables: moved to their place, old ones folded in, brought in line with a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import minute
from dossier.functions.names import unused
from dossier.functions.text import norm_text
from dossier.operators import contact
from dossier.operators.rows import insert_after
from dossier.operators.stores import JOINT, KNOWN_RESPONSES, response_texts

# The status columns of a sheet, in order, and what they hold; the column they stand behind; an old name of the note.
COLUMNS = {"套磁情况": "status", "套磁时间": "contacted_at", "回复情况": "responses", "约面试时间": "interview_at", "回复情况备注": "note"}
NAME, NOTE, OLD_NOTES = "姓名", "回复情况备注", ("套磁备注",)


def migrated(rows: DataFrame) -> DataFrame:
    """The status columns right behind the name, made where they are absent; old notes joined to the note.  Tables without a name column stay."""
    return insert_after(rows, NAME, list(COLUMNS), NOTE, OLD_NOTES)


def row_entry() -> Column:
    """The entry that a migrated row holds, as a struct of texts; responses that aren't known go to the note."""
    text = lambda c: F.coalesce(norm_text(F.col(c).cast("string")), F.lit(""))
    known = F.array(*map(F.lit, KNOWN_RESPONSES))
    said = response_texts(text("回复情况"))
    notes = F.filter(F.array(text(NOTE), F.array_join(F.array_except(said, known), JOINT)), lambda n: n != "")
    values = {
        "status": contact.status(F.col("套磁情况").cast("string")), "contacted_at": text("套磁时间"), "responses": F.array_join(F.filter(said, lambda r: F.array_contains(known, r)), JOINT),
        "interview_at": minute(text("约面试时间")), "note": F.array_join(F.array_distinct(notes), JOINT),
    }
    return F.struct(*[v.alias(n) for n, v in values.items()])


def synced(rows: DataFrame, store: DataFrame, key: Callable[[DataFrame], Column], fallback: Callable[[DataFrame], Column], authoritative: bool = False) -> DataFrame:
    """``rows`` migrated, with the status columns as ``store`` (``row_key`` once, and the fields of an entry) has them.

    An entry is found by the row's ``key``, and where there is none by the other.  An ``authoritative`` store clears rows
    that it doesn't know; else what it says goes field by field over what the row says in normal form.
    Rows map one to one; null keys find nothing; tables without a name column stay as they are.
    """
    if NAME not in rows.columns:
        return rows
    out = migrated(rows)
    fields = list(COLUMNS.values())
    text = lambda c: F.array_join(c, JOINT) if c == "responses" else F.coalesce(F.col(c), F.lit(""))
    p = unused(out)
    entries = store.filter("row_key IS NOT NULL").select("row_key", F.struct(*[text(c).alias(c) for c in fields]).alias("entry"))
    first, second = (entries.select(F.col("row_key").alias(f"{p}key{i}"), F.col("entry").alias(f"{p}entry{i}")) for i in (1, 2))
    out = out.withColumns({f"{p}k1": key(out), f"{p}k2": fallback(out)})
    out = out.join(first, F.col(f"{p}k1") == F.col(f"{p}key1"), "left").join(second, F.col(f"{p}k2") == F.col(f"{p}key2"), "left")
    own = row_entry()
    out = out.withColumns({f"{p}stored": F.coalesce(f"{p}entry1", f"{p}entry2"), f"{p}own": own})
    said = lambda f: F.coalesce(F.nullif(F.col(f"{p}stored.{f}"), F.lit("")), F.lit("") if authoritative else F.col(f"{p}own.{f}"))
    return out.withColumns({c: said(f) for c, f in COLUMNS.items()}).select(*migrated(rows).columns)
