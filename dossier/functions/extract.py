"""Extractors for names, links, labels, snippets and search phrases, as column expressions.

Null counts as the empty string throughout, and gives an empty string or array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import CJK, norm_text, normalized_name, split_entries, unique_join

# The patterns of what is extracted.
PHONE = r"(?:\+?86[- ]?)?(?:0\d{2,3}[- ]?)?\d{7,8}"
LINK = r"https?://[^\s，,；;。)）]+"
LOOSE_LINK = r"https?://[^\s;，,]+|(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}[^\s;，,]*"
PARENTHESES = r"[（(].*?[）)]"
DIRECTIONS = (
    r"(?i)(研究方向[为：:，, ]+[^。；;\n]{4,180})",
    r"(?i)(主要研究方向[为：:，, ]+[^。；;\n]{4,180})",
    r"(?i)(科研方向[为：:，, ]+[^。；;\n]{4,180})",
    r"(?i)(研究兴趣[为包括：:，, ]+[^。；;\n]{4,180})",
    r"(?i)(研究领域[为包括：:，, ]+[^。；;\n]{4,180})",
    r"(?i)((?:focus|focused|interests?|research interests?)[^。；;\n]{8,220})",
)
AUTHOR = r"(?<![A-Za-z])((?:[A-Z]\.|[A-Z][A-Za-z'-]+)(?:\s+|,\s*)(?:[A-Z]\.|[A-Z][A-Za-z'-]+))(?![A-Za-z])"
SENTENCE_END = r"(?<=[。！？；;.!?])\s*"
LINE_END = r"[\n\r]+|(?<=\.)\s{2,}"


def _all(value: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(pattern), F.lit(group))


def _some(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def phones(value: Column, most: int = 3) -> Column:
    """Distinct numbers among the first ``most`` found."""
    found = F.array_distinct(F.slice(_all(value, PHONE), 1, most))
    return F.when(F.rlike(value, F.lit("[0-9]{7}")), found).otherwise(F.array().cast("array<string>"))


def links(value: Column) -> Column:
    """Distinct http(s) links in order of appearance."""
    return F.array_distinct(_all(value, LINK))


def link_list(value: Column) -> Column:
    """Links of a field, bare domains among them, which get ``https://``; repeats stay."""

    def whole(url: Column) -> Column:
        bare = F.regexp_replace(url, r"^[ ;,，]+|[ ;,，]+$", "")
        return F.when(F.rlike(bare, F.lit(r"(?i)^https?://")) | (bare == ""), bare).otherwise(F.concat(F.lit("https://"), bare))

    return _some(F.transform(_all(norm_text(value), LOOSE_LINK), whole))


def host_key(url: Column) -> Column:
    """Host without ``www.`` and path without trailing slashes, in lower case; a text without ``//`` is a path."""
    text = F.lower(norm_text(url))
    host = F.regexp_replace(F.regexp_extract(text, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), r"^www\.", "")
    path = F.regexp_extract(text, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    return F.concat(host, F.regexp_replace(path, "/+$", ""))


def homepage_overlap(left: Column, right: Column) -> Column:
    """Whether the key of some link of one array holds the key of one of the other."""
    own, other = _some(F.transform(left, host_key)), _some(F.transform(right, host_key))
    return F.exists(own, lambda a: F.exists(other, lambda b: F.contains(a, b) | F.contains(b, a)))


def direction(value: Column) -> Column:
    """The stated research direction: the first pattern that is found decides."""
    text = norm_text(value)
    return F.coalesce(*[F.nullif(norm_text(F.regexp_extract(text, p, 1)), F.lit("")) for p in DIRECTIONS], F.lit(""))


def clean_name(value: Column) -> Column:
    """A name without parentheses; blanks inside a Chinese name of 2 to 8 characters go as well."""
    bare = F.trim(F.regexp_replace(norm_text(value), PARENTHESES, ""))
    return F.when(F.rlike(bare, F.lit(r"^[一-鿿 ]{2,8}$")), F.replace(bare, F.lit(" "), F.lit(""))).otherwise(bare)


def name_titles(value: Column, category: Column, ignored: Sequence[str] = ("博士",), no_titles: Sequence[str] = ("跨学科博导",)) -> Column:
    """Titles in the parentheses behind a name, after the category of the list it stands in."""
    inside = F.flatten(F.transform(_all(norm_text(value), r"[（(]([^）)]+)[）)]", 1), lambda v: F.split(v, r"[、,，/ ]+")))
    first = F.when(category.isin(*no_titles), "").otherwise(F.coalesce(category, F.lit("")))
    bits = F.transform(F.concat(F.array(first), inside), norm_text)
    return unique_join(F.filter(bits, lambda b: ~b.isin(*ignored)))


def label_value(value: Column) -> Column:
    """``struct<label, value>``, cut at the first full-width colon, or if there is none at the first plain one."""
    text = norm_text(value)
    colon = F.when(F.contains(text, F.lit("：")), F.lit("：")).otherwise(F.lit(":"))
    at = F.instr(text, colon)
    label = F.when(at > 0, F.replace(F.call_function("substring", text, F.lit(1), at - 1), F.lit(" "), F.lit(""))).otherwise("")
    rest = F.when(at > 0, norm_text(F.call_function("substring", text, at + 1, F.length(text)))).otherwise(text)
    return F.struct(label.alias("label"), rest.alias("value"))


def snippets(value: Column, wanted: Sequence[str], splitter: str = LINE_END, least: int = 25, most: int = 18, width: int = 500) -> Column:
    """The first ``most`` pieces of a text that are long enough and match one of the patterns."""
    pieces = F.transform(F.split(F.coalesce(value, F.lit("")), splitter), norm_text)
    hit = lambda v: (F.length(v) >= least) & F.rlike(v, F.lit("|".join(f"(?:{p})" for p in wanted)))
    return F.transform(F.slice(F.filter(pieces, hit), 1, most), lambda v: F.left(v, F.lit(width)))


def sentence_snippet(value: Column, wanted: Sequence[str], most: int = 3, total: int = 900) -> Column:
    """Up to ``most`` sentences that match, in one string of ``total`` characters at most."""
    return F.left(F.array_join(snippets(value, wanted, SENTENCE_END, 24, most), "；"), F.lit(total))


def pattern_keywords(value: Column, patterns: Sequence[str], most: int = 12) -> Column:
    """Matches of the patterns, one pattern after the other; of spellings that differ in case the first stays."""
    found = _some(F.transform(F.concat(*[_all(value, p) for p in patterns]), norm_text))
    lowered = F.transform(found, F.lower)
    firsts = F.filter(F.transform(found, lambda v, i: F.when(F.array_position(lowered, F.lower(v)) == i + 1, v)), lambda v: v.isNotNull())
    return F.array_join(F.slice(firsts, 1, most), "; ")


def search_phrases(name: Column, school: Column, keywords: Column, default: str, templates: Sequence[str]) -> Column:
    """Templates with ``{name}``, ``{school}`` and ``{keywords}`` (the first three) filled in."""
    parts = F.array_join(F.slice(_some(F.transform(F.split(norm_text(keywords), "[;；,，]"), F.trim)), 1, 3), " ")
    values = {"{name}": norm_text(name), "{school}": norm_text(school), "{keywords}": F.when(parts == "", default).otherwise(parts)}

    def fill(template: str) -> Column:
        out = F.lit(template)
        for mark, value in values.items():
            out = F.replace(out, F.lit(mark), value)
        return out

    return F.array(*[fill(t) for t in templates])


def catalogue_id(url: Column, host: str = "dblp.org") -> Column:
    """The person id in a catalogue's ``/pid/`` link; empty for other links."""
    text = norm_text(url)
    path = F.regexp_replace(F.regexp_extract(text, r"^[^:/?#]+://[^/?#]*([^?#;]*)", 1), r"\.(html|xml)$", "")
    named = F.contains(F.regexp_extract(text, r"^[^:/?#]+://([^/?#]*)", 1), F.lit(host))
    return F.when(named, F.regexp_extract(path, r"/pid/(.+)$", 1)).otherwise("")


def name_aliases(syllables: Column, url: Column) -> Column:
    """Western spellings of a transliterated name, family name first in ``syllables``.

    Given names joined and apart, before and after the family name; and what is left of the
    family name in the last part of the person's URL.  Fewer than two syllables give none.
    """
    family = F.get(syllables, F.lit(0))
    given = F.slice(syllables, F.lit(2), F.greatest(F.size(syllables) - 1, F.lit(0)))
    stem = F.regexp_extract(F.regexp_extract(norm_text(url), r"^(?:[^:/?#]+://[^/?#]*)?([^?#;]*)", 1), r"([^/]*?)(?:\.[^./]+)?/*$", 1)
    slug = F.regexp_replace(F.lower(stem), r"\d+$", "")
    longer = F.rlike(slug, F.lit("^[a-z]+$")) & (F.length(slug) > F.length(family))
    rest = (
        F.when(longer & F.startswith(slug, family), F.call_function("substring", slug, F.length(family) + 1, F.length(slug)))
        .when(longer & F.endswith(slug, family), F.call_function("substring", slug, F.lit(1), F.length(slug) - F.length(family)))
    )

    def join(*parts: Column) -> Column:
        return F.when(F.forall(F.array(*parts), lambda p: p.isNotNull()), F.concat_ws(" ", *parts))

    joined, apart = F.array_join(given, ""), F.array_join(given, " ")
    found = F.array(join(joined, family), join(apart, family), join(family, joined), join(family, apart), join(rest, family), join(family, rest))
    return F.when(F.size(syllables) >= 2, F.array_distinct(F.array_compact(found))).otherwise(F.array().cast("array<string>"))


def author_strings(publications: Column, aliases: Column) -> Column:
    """Author names at the head of publication entries (220 characters) that equal an alias."""
    known = F.transform(aliases, normalized_name)
    heads = F.transform(split_entries(publications), lambda e: F.left(e, F.lit(220)))
    names = F.flatten(F.transform(heads, lambda e: F.transform(_all(e, AUTHOR, 1), lambda a: norm_text(F.replace(a, F.lit(","), F.lit(" "))))))
    return F.array_distinct(F.filter(names, lambda n: F.array_contains(known, normalized_name(n))))
