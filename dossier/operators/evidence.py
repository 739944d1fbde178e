"""Gates before expensive sources, and what several sources say together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import norm_text
from dossier.operators.dashboard import number

# Statuses after which works are worth asking for, and confidences that count.
IDENTIFIED = ("identity_confirmed", "identity_probable")
TRUSTED = ("high", "medium")
RELIABLE = ("高", "中")


def first_number(*values: Column) -> Column:
    """The first of the values that is a number other than zero, else zero."""
    out = F.lit(0.0)
    for value in reversed(values):
        out = F.when(number(value) != 0, number(value)).otherwise(out)
    return out


def wants_deep_query(can_contact: Column, score: Column, papers: Column, personal_url: Column, relevant: Column) -> Column:
    """Whether a row is worth the deep sources: on the list, promising, published, with a page, or relevant by text."""
    return (can_contact == "是") | (number(score) >= 20) | (papers > 0) | (norm_text(personal_url) != "") | relevant


def wants_web_search(
    searched: Column, can_contact: Column, low: Column, score: Column, counts: Sequence[Column], web: Column,
    personal_url: Column, relevant: Column,
) -> Column:
    """Whether a web search could add something: not done yet, and evidence thin where it matters."""
    thin = (sum((number(c) for c in counts), F.lit(0.0)) + number(web) <= 1) | (number(web) == 0)
    unsure = low & number(score).between(10, 45) & relevant
    homeless = (norm_text(personal_url) == "") & (number(score) >= 10) & relevant
    return ~searched & (((can_contact == "是") & thin) | unsure | homeless)


def works_wanted(status: Column, confidence: Column) -> Column:
    return status.isin(*IDENTIFIED) & confidence.isin(*TRUSTED)


def works_accepted(status: Column, source: Column, confidence: Column) -> Column:
    return (status == "success") & ((source == "official") | confidence.isin(*TRUSTED))


def arxiv_confidence(in_catalogue: Column, verified: Column, same_author: Column, in_dblp: Column) -> Column:
    """How far an arXiv match is confirmed by titles known elsewhere."""
    return (
        F.when(in_catalogue, "中-学术库题名交叉确认")
        .when(verified & same_author & in_dblp, "中-DBLP交叉确认")
        .otherwise("低")
    )


def web_confidence(official: Column, personal: Column, paper: Column, name: Column, school: Column) -> Column:
    """Confidence that a page is about the person, by its host and whether it names person and school."""
    known = name | school
    return (
        F.when((official & known) | (name & school), "高")
        .when((personal | paper) & known, "中")
        .when(known, "低")
        .otherwise("")
    )


def best_confidence(values: Column, order: Sequence[str] = ("高", "中", "低")) -> Column:
    """The best of an array of confidences; empty if it holds none of them."""
    return F.coalesce(*[F.when(F.array_contains(values, v), F.lit(v)) for v in order], F.lit(""))


def needs_review(rank: Column, decision: Column, asked: Column, score: Column) -> Column:
    """Whether a best candidate should be looked at: rejected, or unresolved with a telling score."""
    open_ = decision.isin("review", "unresolved") & asked & (score > 4)
    return (rank == 1) & ((decision == "rejected") | open_)


def source_health(status: Column) -> Column:
    """A source's class by the status of its run."""
    return (
        F.when(status.isin("success", "no_recent_record", "no_record"), "healthy")
        .when(status.isin("terms_required", "schema_changed", "request_failed"), status)
        .otherwise("review")
    )


def response_class(status: Column, content_type: Column, body: Column) -> Column:
    """What an HTTP response is: retry, failed, terms page, HTML where JSON was asked for, or ok."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    html = F.contains(kind, F.lit("html")) | F.rlike(body, F.lit(r"(?i)^\s*<(!doctype|html)"))
    return (
        F.when(status.isin(429, 500, 502, 503, 504), "retry")
        .when(status >= 400, "request_failed")
        .when(html & F.rlike(body, F.lit("(?i)terms (of use|and conditions)|accept the terms")), "terms_required")
        .when(html, "schema_changed")
        .otherwise("ok")
    )


def unwrap_redirect(url: Column) -> Column:
    """The target behind a search engine's redirect link; other links stay as they are."""
    uddg = F.regexp_extract(url, r"[?&]uddg=([^&#]+)", 1)
    packed = F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_-]+)", 1)
    standard = F.translate(packed, "-_", "+/")
    padded = F.rpad(standard, F.ceil(F.length(standard) / 4).cast("int") * 4, F.lit("="))
    plain = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(uddg != "", F.url_decode(uddg)).when((packed != "") & plain.startswith("http"), plain).otherwise(url)


def entries_text(entries: Column, most: int = 10) -> Column:
    """``[date] title (classes) link`` of the first entries, joined; entries hold date, title, classes, link."""
    shown = F.transform(
        F.slice(entries, 1, most),
        lambda e: F.concat_ws(" ", F.concat(F.lit("["), e["date"], F.lit("]")), e["title"], F.concat(F.lit("("), e["classes"], F.lit(")")), e["link"]),
    )
    return F.array_join(shown, "；")


def wants_catalogue(can_contact: Column, level: Column, name: Column, levels: Sequence[str] = (), names: Sequence[str] = ()) -> Column:
    """Whether a catalogue is asked: on the list, and of the levels and names given, where any are."""
    out = norm_text(can_contact) == "是"
    for value, wanted in ((level, levels), (name, names)):
        if wanted:
            out = out & norm_text(value).isin(*wanted)
    return F.coalesce(out, F.lit(False))


def wants_publications(anchored: Column, score: Column) -> Column:
    """Whether outside publication sources are asked: an official anchor or any score."""
    return (norm_text(anchored) == "是") | (number(score) > 0)


def evidence_columns(results: Column, accepted: Column, keywords: Column, bridging: Column) -> Column:
    """The columns of evidence from a person's results and accepted works, as a struct.

    ``results``: array of ``struct<source, status, confidence, author_id, author_url, orcid,
    classes array<string>, reason>`` in the order of the sources; ``accepted``: titles.
    The best identified outside source decides id and confidence, else the official one.
    """
    text = lambda v: F.coalesce(v, F.lit(""))
    searched = F.filter(results, lambda r: (r["source"] != "official") & r["status"].isin("success", "no_recent_record") & r["confidence"].isin(*TRUSTED))
    high = F.get(F.filter(searched, lambda r: r["confidence"] == "high"), F.lit(0))
    official = F.get(F.filter(results, lambda r: (r["source"] == "official") & (r["status"] == "success")), F.lit(0))
    best = F.coalesce(high, F.get(searched, F.lit(0)), official)
    of = lambda s: F.get(F.filter(results, lambda r: r["source"] == s), F.lit(0))
    shown = F.transform(
        results, lambda r: F.concat(r["source"], F.lit(":"), r["status"], F.when(text(r["confidence"]) != "", F.concat(F.lit("/"), r["confidence"])).otherwise(""))
    )
    classes = F.flatten(F.transform(F.filter(results, lambda r: r["status"] == "success"), lambda r: F.coalesce(r["classes"], F.array().cast("array<string>"))))
    orcid = F.coalesce(*[F.nullif(text(v["orcid"]), F.lit("")) for v in (best, of("zbmath"), of("openalex"))], F.lit(""))
    reasons = F.transform(F.filter(results, lambda r: text(r["reason"]) != ""), lambda r: F.concat(r["source"], F.lit(":"), r["reason"]))
    return F.struct(
        F.array_join(shown, "; ").alias("status"), text(best["confidence"]).alias("confidence"), text(best["author_id"]).alias("author_id"),
        text(of("zbmath")["author_url"]).alias("zbmath_url"), text(of("openalex")["author_id"]).alias("openalex_id"), orcid.alias("orcid"),
        F.array_join(F.slice(F.array_distinct(F.filter(classes, lambda c: c != "")), 1, 12), "；").alias("classes"),
        F.array_join(F.filter(keywords, lambda k: ~F.array_contains(bridging, k)), "；").alias("core_keywords"),
        F.array_join(F.filter(keywords, lambda k: F.array_contains(bridging, k)), "；").alias("bridge_keywords"),
        F.size(accepted).alias("n_works"), F.array_join(F.slice(accepted, 1, 5), "；").alias("titles"), F.array_join(reasons, "; ").alias("reasons"),
    )
