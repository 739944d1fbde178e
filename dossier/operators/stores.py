"""Status stores as JSON documents of any age: aliases of fields, lists or texts, known and own responses.

Documents are read as variants, so an entry may be a text or an object, a field a text, a
number or a list, from one row to the next, and no schema is inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import minute
from dossier.functions.text import norm_text
from dossier.operators.contact import RESPONSE_SPLIT, status

# Where each field may be found, first wins, and the responses that are known.
ALIASES = {
    "status": ("status", "contactStatus", "套磁情况"),
    "contacted_at": ("contacted_at", "contactedAt", "date", "套磁时间"),
    "responses": ("responses", "reply_statuses", "replyStatuses", "回复情况"),
    "interview_at": ("interview_at", "interviewAt", "约面试时间"),
}
NOTES = ("note", "contact_note", "回复情况备注", "套磁备注")
PLAIN = ("name", "school", "college", "teacher_url", "updated_at")
KNOWN_RESPONSES = ("已发", "官回", "添加微信", "约面试", "考核", "已满")
ENTRIES, STORE_UPDATED = ("statuses", "records"), ("updated_at", "updatedAt")
VERSION = 4
JOINT = "；"


def _path(name: str) -> str:
    return f'$["{name}"]'


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DECIMAL or the like; null for a missing value, VOID for a JSON null."""
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def _said(v: Column) -> Column:
    """``v`` unless it says nothing: missing, null, false, zero, or an empty text, list or object."""
    text = v.try_cast("string")
    empty = F.when(_kind(v) == "STRING", text == "").otherwise(text.rlike(r"^(false|-?0+(\.0+)?(E[+-]?[0-9]+)?|\[\]|\{\})$"))
    return F.when(v.isNotNull() & (_kind(v) != "VOID") & ~F.coalesce(empty, F.lit(False)), v)


def first_said(v: Column, names: Sequence[str]) -> Column:
    """The first of the fields ``names`` of an object that says something, as a variant."""
    return F.coalesce(*[_said(F.try_variant_get(v, _path(n), "variant")) for n in names])


def text_of(v: Column) -> Column:
    """A variant as normal text; missing as empty."""
    return F.coalesce(norm_text(F.try_variant_get(v, "$", "string")), F.lit(""))


def _distinct(texts: Column) -> Column:
    clean = F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda r: F.coalesce(norm_text(r), F.lit("")))
    return F.array_distinct(F.filter(clean, lambda r: r != ""))


def response_texts(text: Column) -> Column:
    """Distinct responses of a text with separators, in order."""
    return _distinct(F.split(text, RESPONSE_SPLIT))


def response_list(v: Column) -> Column:
    """Distinct responses in order, of a list or of a text with separators."""
    return _distinct(F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<string>")).otherwise(F.split(text_of(v), RESPONSE_SPLIT)))


def entry(v: Column) -> Column:
    """A normal entry of a text or an object, as a struct; empty texts and lists where nothing is said."""
    is_object = _kind(v) == "OBJECT"
    of = lambda names: F.when(is_object, first_said(v, names))
    said = response_list(of(ALIASES["responses"]))
    known = F.array(*map(F.lit, KNOWN_RESPONSES))
    notes = F.array(*[text_of(F.when(is_object, F.try_variant_get(v, _path(n), "variant"))) for n in NOTES])
    own = F.array_join(F.array_except(said, known), JOINT)
    notes = F.array_distinct(F.filter(F.concat(notes, F.array(own)), lambda n: n != ""))
    return F.struct(
        status(text_of(F.when(_kind(v) == "STRING", v).otherwise(of(ALIASES["status"])))).alias("status"),
        text_of(of(ALIASES["contacted_at"])).alias("contacted_at"),
        F.filter(said, lambda r: F.array_contains(known, r)).alias("responses"),
        minute(text_of(of(ALIASES["interview_at"]))).alias("interview_at"),
        F.array_join(notes, JOINT).alias("note"),
        *[text_of(F.when(is_object, F.try_variant_get(v, _path(n), "variant"))).alias(n) for n in PLAIN],
    )


def version_of(v: Column) -> Column:
    """The version of a store, 4 at least; what is no whole number counts as 4."""
    given = first_said(v, ("version",))
    text = F.trim(F.try_variant_get(given, "$", "string"))
    whole = F.when(_kind(given) == "STRING", text.try_cast("int")).otherwise(F.try_variant_get(given, "$", "double").try_cast("int"))
    return F.greatest(F.coalesce(whole, F.lit(VERSION)), F.lit(VERSION))


def normal_stores(documents: DataFrame, by: Sequence[str], text: str, strict: bool = True) -> DataFrame:
    """``by``, ``version``, ``store_updated_at``, ``row_key`` and the fields of an entry: a row for each entry that says something.

    A document that is no JSON fails the query, or is passed over unless ``strict``: it never counts as an empty
    store by accident.  A null document, one that is no object, and one whose entries are no object have no rows.
    Of keys that are alike in normal form the last in code-point order wins.  Columns other than ``by`` go.
    """
    parse = F.parse_json if strict else F.try_parse_json
    stores = documents.select(*by, parse(F.col(text)).alias("__store")).filter(_kind(F.col("__store")) == "OBJECT")
    entries = first_said(F.col("__store"), ENTRIES)
    stores = stores.select(*by, version_of(F.col("__store")).alias("version"), text_of(first_said(F.col("__store"), STORE_UPDATED)).alias("store_updated_at"), entries.alias("__entries"))
    stores = stores.filter(_kind(F.col("__entries")) == "OBJECT")
    each = stores.select(*by, "version", "store_updated_at", F.explode(F.try_variant_get("__entries", "$", "map<string,variant>")).alias("__key", "__v"))
    told = each.select(*by, "version", "store_updated_at", norm_text("__key").alias("row_key"), "__key", entry(F.col("__v")).alias("__e"))
    fields = ("status", "contacted_at", "responses", "interview_at", "note", *PLAIN)
    silent = F.lit(True)
    for name in fields:
        silent &= F.size(f"__e.{name}") == 0 if name == "responses" else F.col(f"__e.{name}") == ""
    last = told.filter(~silent).groupBy(*by, "version", "store_updated_at", "row_key").agg(F.max_by("__e", "__key").alias("__e"))
    return last.select(*by, "version", "store_updated_at", "row_key", *[F.col(f"__e.{n}").alias(n) for n in fields])


#: What an entry may say, and what is added to it from the person it is about.
SAID, ABOUT = ("status", "contacted_at", "responses", "interview_at", "note"), ("name", "school", "college", "teacher_url")


def patched(store: DataFrame, patches: DataFrame, people: DataFrame) -> DataFrame:
    """``store`` (``row_key`` once, the fields, and ``updated_at``) after ``patches``: entries changed field by field, deleted where nothing is left.

    ``patches`` has ``row_key``, ``seq``, ``at`` (a text) and the fields that an entry may say, null where one isn't touched; of several the last by
    ``seq`` counts, each field for itself, and an empty text clears it.  A changed entry gets what ``people`` (``row_key`` once) say of themselves,
    and ``at`` of its last patch.  Patches for keys that no one has are passed over.  Last values are combined maxima, so a key that
    is patched often doesn't meet in one task.
    """
    named = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in SAID}
    last = patches.filter("row_key IS NOT NULL").groupBy("row_key").agg(*named.values(), F.max_by("at", "seq").alias("updated_at"))
    wanted = last.select(F.col("row_key").alias("k_"), *[F.col(c).alias(f"new_{c}") for c in SAID], F.col("updated_at").alias("new_at"))
    asked = people.select("row_key", *ABOUT).join(wanted, F.col("row_key") == F.col("k_")).drop("k_")
    held = store.select(F.col("row_key").alias("k_"), *[F.col(c).alias(f"old_{c}") for c in SAID])
    met = asked.join(held, F.col("row_key") == F.col("k_"), "left")
    text = lambda c: F.coalesce(f"new_{c}", f"old_{c}", F.lit(""))
    said = F.coalesce("new_responses", "old_responses", F.array().cast("array<string>"))
    entry = {"status": status(text("status")), "contacted_at": norm_text(text("contacted_at")), "responses": _distinct(said), "interview_at": minute(text("interview_at")), "note": norm_text(text("note"))}
    changed = met.select("row_key", *[v.alias(c) for c, v in entry.items()], *[F.coalesce(norm_text(c), F.lit("")).alias(c) for c in ABOUT], F.col("new_at").alias("updated_at"))
    kept = changed.filter((F.concat("status", "contacted_at", "interview_at", "note") != "") | (F.size("responses") > 0))
    rest = store.join(asked.select(F.col("row_key").alias("k_")), F.col("row_key") == F.col("k_"), "left_anti")
    return rest.select(*changed.columns).unionByName(kept)
