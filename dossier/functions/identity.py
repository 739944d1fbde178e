"""URL normal forms, stable identifiers and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import emails, norm_text

SPLIT = r"[;；,，\s]+"
# Paths that name no person, and a host whose list pages do.
GENERIC_PATHS = ("", "/", "/index.htm", "/index.html", "/system/caslogin.jsp")
GENERIC_ENDS = ("/list.htm", "/list.html", "/index.htm")
PERSONAL_LISTS = ("ai.fudan.edu.cn", r"^/[^/]+/list\.htm$")


def _parts(url: Column) -> dict[str, Column]:
    pattern = r"^(https?)://([^/?#]*)([^?#;]*)[^?#]*(?:\?([^#]*))?"
    return {n: F.regexp_extract(url, pattern, i + 1) for i, n in enumerate(("scheme", "host", "path", "query"))}


def _query(query: Column, dropped: Sequence[str]) -> Column:
    """Parameters sorted by name and value, those with a dropped prefix left out, encoded anew."""

    def pair(item: Column) -> Column:
        def text(part: Column) -> Column:
            # A percent sign without two hex digits stays as it is.
            return F.url_decode(F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25"))

        at = F.instr(item, "=")
        key = F.when(at > 0, F.substring_index(item, "=", 1)).otherwise(item)
        value = F.when(at > 0, F.call_function("substring", item, at + 1, F.length(item))).otherwise("")
        return F.struct(text(key).alias("k"), text(value).alias("v"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    def kept(pair_: Column) -> Column:
        out = F.lit(True)
        for prefix in dropped:
            out = out & ~F.startswith(F.lower(pair_["k"]), F.lit(prefix))
        return out

    pairs = F.filter(pairs, kept)
    quoted = F.transform(F.array_sort(pairs), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"])))
    return F.array_join(quoted, "&")


def normalize_url(value: Column, dropped: Sequence[str] = ("utm_",)) -> Column:
    """The identity form of a URL, empty for anything but http(s).

    The first of several URLs counts; host in lower case; no trailing slash, fragment or
    path parameters; query parameters sorted, tracking parameters left out.
    """
    text = F.trim(F.substring_index(norm_text(value), ";", 1))
    p = _parts(text)
    path = F.regexp_replace(p["path"], "/+$", "")
    query = _query(p["query"], dropped)
    whole = F.concat(
        p["scheme"], F.lit("://"), F.lower(p["host"]), F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(p["host"] != "", whole).otherwise("")


def dedup_url(value: Column) -> Column:
    """The form that directory rows are matched by: parameters stay, any scheme will do."""
    text = norm_text(value)
    p = _parts(text)
    path = F.regexp_replace(p["path"], "/+$", "")
    whole = F.concat(
        p["scheme"], F.lit("://"), F.lower(p["host"]), path,
        F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])),
    )
    return F.when(p["host"] != "", whole).otherwise(F.regexp_replace(text, "[/#]+$", ""))


def is_generic_url(url: Column) -> Column:
    """Whether a normalised URL names a list or a start page rather than a person."""
    p = _parts(url)
    path = F.regexp_replace(F.lower(p["path"]), "/+$", "")
    ends = F.lit(False)
    for end in GENERIC_ENDS:
        ends = ends | F.endswith(path, F.lit(end))
    personal = (p["host"] == PERSONAL_LISTS[0]) & F.rlike(path, F.lit(PERSONAL_LISTS[1]))
    return (url == "") | path.isin(*GENERIC_PATHS) | (ends & ~personal)


def personal_urls(value: Column) -> Column:
    """Normalised URLs of a field that aren't generic, distinct and sorted."""
    urls = F.transform(F.split(norm_text(value), SPLIT), lambda u: normalize_url(u))
    return F.array_sort(F.array_distinct(F.filter(urls, lambda u: ~is_generic_url(u))))


def identity_basis(school: Column, college: Column, row: dict[str, Column]) -> Column:
    """``struct<kind, basis>``: profile URL, else personal URL, else e-mail, else what is known.

    ``row``: profile_url, personal_url, email, name, title, department, ordinal.
    """

    def least(name: str) -> Column:
        return F.array_min(personal_urls(row[name]))

    def basis(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("basis"))

    def scoped(value: Column) -> Column:
        return F.concat(school, F.lit("|"), value)

    url = F.coalesce(least("profile_url"), least("personal_url"))
    email = F.get(emails(row["email"]), F.lit(0))
    source = F.coalesce(*[F.when(normalize_url(row[n]) != "", normalize_url(row[n])) for n in ("profile_url", "personal_url")], F.lit(""))
    known = F.concat_ws(
        "|", school, college, F.regexp_replace(F.lower(norm_text(row["name"])), r"\s+", ""), source,
        F.lower(norm_text(row["title"])), F.lower(norm_text(row["department"])), norm_text(row["ordinal"].cast("string")),
    )
    return (
        F.when(url.isNotNull(), basis("url", scoped(url)))
        .when(email.isNotNull(), basis("email", scoped(email)))
        .otherwise(basis("provisional", known))
    )


def person_id(basis: Column, existing: Column | None = None) -> Column:
    """A stable identifier of 24 hex digits behind its prefix; an existing one is kept."""
    prefix = F.when(basis["kind"] == "provisional", "provisional_").otherwise("teacher_")
    made = F.concat(prefix, F.left(F.sha2(F.concat_ws("|", basis["kind"], basis["basis"]), 256), F.lit(24)))
    if existing is None:
        return made
    return F.when(norm_text(existing) != "", norm_text(existing)).otherwise(made)


def identity_confidence(basis: Column) -> Column:
    return F.when(basis["kind"] == "url", "高").when(basis["kind"] == "email", "中").otherwise("低-待复核")


def record_key(school: Column, college: Column, person: Column) -> Column:
    return F.concat(school, F.lit("/"), college, F.lit("|"), person)
