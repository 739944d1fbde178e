"""Selector-driven extraction: lists of people from directory pages, and their detail pages joined by address."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.names import unused
from dossier.operators.dedup import keep
from dossier.operators.graph import ship

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "svg"))
#: Tags that a next one of their kind closes.
SIBLINGS = frozenset(("li", "p", "tr", "td", "th", "dt", "dd", "option"))


@dataclass(frozen=True)
class Extractor:
    """What to take from a page.

    ``items``: the selector of the elements that are a person each; empty for the whole page.
    ``fields``: for each column a selector, with ``@name`` at its end for an attribute's value
    (``href`` is made absolute); ``labels``: for each column the label that a paragraph begins
    with; what follows ends at one of ``stops``.

    A selector is one or several steps between blanks, each a tag, ``.class``, ``#id`` or a
    tag with either, at any depth below the one before; an empty one is the item itself.
    """

    items: str = ""
    fields: Mapping[str, str] = field(default_factory=dict)
    labels: Mapping[str, str] = field(default_factory=dict)
    stops: Sequence[str] = ()
    blocks: Sequence[str] = ("p", "li", "td", "dd")

    @property
    def columns(self) -> list[str]:
        return [*self.fields, *self.labels]


class _Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list = []

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.parts) if isinstance(c, _Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in HIDDEN:
                stack.extend(reversed(node.parts))
        return " ".join(" ".join(out).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SIBLINGS and self.now.tag == tag:
            self.now = self.now.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.parts.append(node)
        if tag not in VOID:
            self.now = node

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.now = node.parent

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.now.parts.append(data)


def parse(html: str) -> _Node:
    """The tree of a page; markup that is wrong is read as far as it goes."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _fits(node: _Node, step: str) -> bool:
    tag, dot, cls = step.partition(".")
    if not dot:
        tag, hash_, name = step.partition("#")
        return (not tag or node.tag == tag) and (not hash_ or node.attrs.get("id") == name)
    return (not tag or node.tag == tag) and cls in node.attrs.get("class", "").split()


def select(node: _Node, selector: str) -> list[_Node]:
    """The elements below a node that a selector names, in the order of the page."""
    found = [node]
    for step in selector.split():
        seen: dict[int, _Node] = {}
        for above in found:
            for below in above.walk():
                if below is not above and _fits(below, step):
                    seen.setdefault(id(below), below)
        found = list(seen.values())
    return found


def _value(item: _Node, selector: str, base: str) -> str:
    path, _, attribute = selector.partition("@")
    for node in select(item, path):
        value = node.attrs.get(attribute, "") if attribute else node.text()
        if value := " ".join(value.split()):
            return urljoin(base, value) if attribute in ("href", "src") else value
    return ""


def _labelled(item: _Node, label: str, stops: Sequence[str], blocks: Sequence[str]) -> str:
    for node in item.walk():
        if node.tag in blocks and (text := node.text()).startswith(label):
            value = text[len(label) :].lstrip("：: ")
            ends = [at for s in stops if (at := value.find(s)) >= 0]
            return value[: min(ends)].strip() if ends else value.strip()
    return ""


def extract(html: str, base: str, rules: Extractor) -> list[list[str]]:
    """The values of each item of a page in the order of ``rules.columns``."""
    root = parse(html)
    items = select(root, rules.items) if rules.items else [root]
    return [
        [_value(i, s, base) for s in rules.fields.values()] + [_labelled(i, s, rules.stops, rules.blocks) for s in rules.labels.values()]
        for i in items
    ]


def people(pages: DataFrame, url: str, html: str, rules: Extractor) -> DataFrame:
    """``(page, place, columns...)``: a row for each item of each page, ``place`` from 0; a null page has none."""
    ship(pages.sparkSession)
    names = rules.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for base, text in zip(batch["u"], batch["h"], strict=True):
                if isinstance(text, str):
                    rows += [(base, place, *values) for place, values in enumerate(extract(text, base or "", rules))]
            yield pd.DataFrame(rows, columns=["page", "place", *names])

    schema = "page string, place long, " + ", ".join(f"`{n}` string" for n in names)
    return pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, schema)


def with_details(
    listed: DataFrame, link: str, pages: DataFrame, url: str, html: str, rules: Extractor
) -> DataFrame:
    """Listed people with what their detail pages say, joined by address; the list's values stay where a page says nothing.

    The first of several rows of one address counts, in the order of ``page`` and ``place``.
    ``state`` is ``parsed``, ``empty`` (the page has none of the fields) or ``missing``.
    """
    p = unused(listed, pages)
    first = keep(listed, [link], [F.col("page"), F.col("place")])
    own = people(pages, url, html, rules).filter("place = 0").drop("place")
    own = keep(own, ["page"], [F.col(c) for c in rules.columns]).withColumnRenamed("page", link)
    said = F.lit(False)
    for c in rules.columns:
        said = said | (F.col(c) != "")
    detail = own.select(link, said.alias(f"{p}said"), F.struct(*rules.columns).alias(f"{p}d"))
    out = first.join(detail, link, "left")
    values = {c: F.coalesce(F.nullif(F.col(f"{p}d.{c}"), F.lit("")), F.col(c) if c in first.columns else F.lit("")) for c in rules.columns}
    state = F.when(F.col(f"{p}d").isNull(), "missing").when(F.col(f"{p}said"), "parsed").otherwise("empty")
    return out.withColumns({**values, "state": state}).drop(f"{p}said", f"{p}d")
