"""Paged interfaces of catalogues: a client that tries again, pages that name the next, and the works on them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import norm_text
from dossier.operators.graph import cut, ship

# Answers after which it is worth trying again, and what pages say that ask for consent.
AGAIN = (429, 500, 502, 503, 504)
TERMS = ("terms and conditions", "accept the terms", "terms of use", "nutzungsbedingungen")
RETRIES, BACKOFF, LONGEST_WAIT = 2, 1.0, 30.0
MOST_PAGES = 3


@dataclass(frozen=True)
class Response:
    """What a ``fetch`` gives: a status, a text and the headers that matter here."""

    status: int
    text: str = ""
    content_type: str = ""
    retry_after: str = ""
    date: str = ""


class SourceError(Exception):
    """``kind`` is request_failed, terms_required or schema_changed."""

    def __init__(self, kind: str, message: str, status: int | None = None) -> None:
        super().__init__(f"{kind}: {message}" + (f" (HTTP {status})" if status else ""))
        self.kind, self.message, self.status = kind, message, status


def wait_for(response: Response, otherwise: float, longest: float, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> float:
    """Seconds to wait by Retry-After, which gives seconds or a date (against the answer's own date, if it has one); never more than ``longest``."""
    said, seconds = response.retry_after.strip(), otherwise
    try:
        if said:
            seconds = float(said)
    except ValueError:
        try:
            since = parsedate_to_datetime(response.date) if response.date else now()
            seconds = (parsedate_to_datetime(said) - since).total_seconds()
        except (TypeError, ValueError):  # no date, or one with a zone and one without
            seconds = otherwise
    return min(max(seconds, 0.0), longest) if seconds == seconds else min(otherwise, longest)


def read_json(response: Response, expected: Sequence[str] = ()) -> dict:
    """The object that an answer holds, or a ``SourceError`` that says what it is instead."""
    text = response.text.lstrip()
    html = "html" in response.content_type.lower() or text.lower().startswith(("<!doctype html", "<html"))
    if html and any(mark in text.lower() for mark in TERMS):
        raise SourceError("terms_required", "the source asks to accept its terms", response.status or None)
    if not 200 <= response.status < 300:
        raise SourceError("request_failed", "the source answered without success", response.status or None)
    if html:
        raise SourceError("schema_changed", "HTML came where JSON was expected", response.status)
    try:
        data = json.loads(text)
    except ValueError as error:
        raise SourceError("schema_changed", "the answer is no JSON", response.status) from error
    if not isinstance(data, dict) or (expected and not any(key in data for key in expected)):
        raise SourceError("schema_changed", "the answer lacks " + (", ".join(expected) or "an object"), response.status)
    return data


@dataclass(frozen=True)
class Client:
    """Asks ``fetch`` until an answer is final: after a failed connection or a busy source again, each time after twice the wait."""

    fetch: Callable[[str, dict], Response]
    retries: int = RETRIES
    backoff: float = BACKOFF
    longest: float = LONGEST_WAIT
    sleep: Callable[[float], None] = time.sleep
    now: Callable[[], datetime] = lambda: datetime.now(UTC)

    def get(self, url: str, params: dict, expected: Sequence[str] = ()) -> dict:
        for attempt in range(self.retries + 1):
            wait, last = self.backoff * 2**attempt, attempt == self.retries
            try:
                response = self.fetch(url, params)
            except OSError as error:
                if last:
                    raise SourceError("request_failed", f"{type(error).__name__}: {error}") from error
                self.sleep(min(wait, self.longest))
                continue
            if response.status not in AGAIN or last:
                return read_json(response, expected)
            self.sleep(wait_for(response, wait, self.longest, self.now))
        raise SourceError("request_failed", "no answer")


def follow(client: Client, url: str, params: dict, items: str, most: int = MOST_PAGES, first: str = "*") -> Iterator[tuple[str, str | None, list]]:
    """(cursor, next cursor, items) of one source's pages, each named by the one before it, ``most`` at most."""
    cursor: str | None = first
    for _ in range(most):
        data = client.get(url, params | {"cursor": cursor}, (items,))
        found, after = list(data.get(items) or []), str((data.get("meta") or {}).get("next_cursor") or "").strip()
        yield cursor, after or None, found
        if not after or not found:
            return
        cursor = after


def collect(people: DataFrame, by: str, request: Callable[[object], tuple[str, dict]], make_client: Callable[[], Client], items: str = "results", most: int = MOST_PAGES) -> DataFrame:
    """Pages of all ``people``: ``by``, ``place`` (from 0), ``cursor``, ``next``, ``items`` (JSON texts), ``state``, ``message``.

    Each task asks for the people it holds, one after the other, with a client of its own.  ``request`` gives a person's address and
    parameters.  A source that fails is a row with its kind as ``state`` and no items behind the pages that came before; tasks
    don't fail.  People with a null key are not asked for.
    """
    ship(people.sparkSession)
    kind = people.schema[by].dataType.simpleString()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            for person in frame[by]:
                rows = []
                try:
                    for cursor, after, found in follow(client, *request(person), items, most):
                        rows.append((person, len(rows), cursor, after, [json.dumps(i, ensure_ascii=False) for i in found], "ok", None))
                except SourceError as error:
                    rows.append((person, len(rows), None, None, None, error.kind, str(error)))
                yield pd.DataFrame(rows, columns=["by", "place", "cursor", "next", "items", "state", "message"])

    schema = f"by {kind}, place int, cursor string, next string, items array<string>, state string, message string"
    return people.select(by).filter(F.col(by).isNotNull()).mapInPandas(ask, schema).withColumnRenamed("by", by)


def walk(people: DataFrame, pages: DataFrame, by: str, most: int = MOST_PAGES, first: str = "*") -> DataFrame:
    """The same from a table of stored pages (``by``, ``cursor``, ``next``, ``items``): from the page ``first`` on, each page that the one before names.

    One join a page, ``most`` at most, for all people at once, written in between.  A page that names none, or has no items, is a
    person's last; people without a first page have none.  A page should be stored once.
    """
    now = people.select(F.col(by).alias("by_"), F.lit(first).alias("at_")).filter(F.col(by).isNotNull()).distinct()
    out = None
    for place in range(most):
        found = cut(now.join(pages, (F.col(by) == F.col("by_")) & (F.col("cursor") == F.col("at_"))).select(by, F.lit(place).alias("place"), "cursor", "next", "items"))
        out = found if out is None else out.unionAll(found)
        goes_on = (F.trim(F.coalesce("next", F.lit(""))) != "") & (F.size("items") > 0)
        now = found.filter(goes_on).select(F.col(by).alias("by_"), F.trim("next").alias("at_"))
    return out.withColumns({"state": F.lit("ok"), "message": F.lit(None).cast("string")})


def works(pages: DataFrame, by: str, schema: str, title: Column, source_id: Column, keep: Column | None = None) -> DataFrame:
    """Works on ``pages``: ``by``, ``place``, ``item`` and the fields of ``schema``; of works that are alike the last one found.

    Alike are works of one ``source_id``, and without one those of one title in any case of letters.  Works without a title go, and
    those for which ``keep`` doesn't hold; all three are columns over the fields.  Items that don't parse go too.
    """
    each = pages.select(by, "place", F.posexplode("items").alias("item", "__text"))
    read = each.select(by, "place", "item", F.from_json("__text", schema).alias("__e")).select(by, "place", "item", "__e.*")
    named = read.withColumns({"__title": norm_text(title), "__id": norm_text(source_id.cast("string"))}).filter(F.col("__title") != "")
    if keep is not None:
        named = named.filter(keep)
    alike = F.when(F.col("__id") != "", F.concat(F.lit("i"), "__id")).otherwise(F.concat(F.lit("t"), F.lower("__title")))
    fields = [c for c in read.columns if c not in (by, "place", "item")]
    last = named.groupBy(by, alike.alias("__alike")).agg(F.max_by(F.struct("place", "item", *fields), F.struct("place", "item")).alias("__w"))
    return last.select(by, "__w.*")


def allowed(value: Column, only: Sequence[str] = (), never: Sequence[str] = ()) -> Column:
    """The field filter of a directory interface: one of ``only``, where that is given, and none of ``never``; null is no value."""
    text = F.coalesce(norm_text(value), F.lit(""))
    return (text.isin(list(only)) if only else F.lit(True)) & ~text.isin(list(never))


def reading(pages: DataFrame, accepted: DataFrame, by: str, most: int = MOST_PAGES) -> DataFrame:
    """``by``, ``pages``, ``raw_count``, ``accepted_count``, ``truncated`` and ``state``: how the reading of each person's pages went.

    Truncated is who has a full set of pages whose last one has items and names a next one.
    """
    more = (F.trim(F.coalesce("next", F.lit(""))) != "") & (F.size("items") > 0) & (F.col("place") == most - 1)
    read = pages.groupBy(by).agg(
        F.count_if(F.col("state") == "ok").alias("pages"), F.coalesce(F.sum(F.when(F.col("items").isNotNull(), F.size("items"))), F.lit(0)).cast("long").alias("raw_count"),
        F.max(more).alias("truncated"), F.max_by("state", "place").alias("state"),
    )
    kept = accepted.groupBy(F.col(by).alias("by_")).agg(F.count(F.lit(1)).alias("accepted_count"))
    joined = read.join(kept, F.col(by) == F.col("by_"), "left")
    return joined.select(by, "pages", "raw_count", F.coalesce("accepted_count", F.lit(0)).cast("long").alias("accepted_count"), "truncated", "state")
