"""Paged interfaces, link-following scans, XML catalogues, caches and private materials."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import count
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dossier.functions.text import author_key, norm_text
from dossier.operators.graph import cut, ship

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MATERIALS = (".docx", ".txt", ".md", ".json")
#: So many tables of a crawl's steps become one, so that its plan stays small at any depth.
PIECES = 16


def paged_source(name: str, schema: str, fetch: Callable[[int], list[tuple]], pages: Sequence[int]) -> type[DataSource]:
    """A data source that reads one page a task: ``spark.dataSource.register`` it, then ``spark.read.format(name)``.

    ``fetch`` gives the rows of a page and must be able to run on an executor, again if it was lost.
    """

    # Local classes travel by value, so executors need not have this module.
    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(n) for n in pages]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetch(partition.value)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader()

    return Paged


def truncated(rows: DataFrame, by: str, page_size: int, most_pages: int) -> DataFrame:
    """``(by, n, truncated)``: whether the pages read were all full, so that more may exist."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("truncated", F.col("n") >= page_size * most_pages)


def follow_links(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(node, depth)`` of all that links lead to from the seeds, each at its least depth.

    ``edges`` holds ``src`` and ``dst``, ``seeds`` holds ``node``.  One round a step, until a
    round finds nothing new; only whether it did comes to the driver.
    """
    frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    pieces = [(0, frontier)]  # levels fall; PIECES tables of a level become one of the next
    for depth in count(1):
        found = edges.join(frontier, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, [piece for _, piece in pieces])
        frontier = cut(found.filter("node IS NOT NULL").join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        pieces.append((0, frontier))
        while len(pieces) >= PIECES and pieces[-PIECES][0] == pieces[-1][0]:
            merged = cut(reduce(DataFrame.unionByName, [piece for _, piece in pieces[-PIECES:]]))
            pieces[-PIECES:] = [(pieces[-1][0] + 1, merged)]


def cached(rows: DataFrame, cache: DataFrame, key: str, now: Column, days: int, valid: Column | None = None) -> DataFrame:
    """Rows with what the cache holds for their key: ``hit`` and the cache's columns, null without one.

    ``cache`` holds ``key``, ``fetched_at`` and more; entries older than ``days`` or not
    ``valid`` don't count, the latest of several does; zero days turn the cache off.
    """
    fresh = cache.filter(F.col("fetched_at") >= now - F.make_dt_interval(F.lit(days)))
    if valid is not None:
        fresh = fresh.filter(valid)
    if days == 0:
        fresh = fresh.filter(F.lit(False))
    rest = [c for c in cache.columns if c not in (key, "fetched_at")]
    last = fresh.groupBy(key).agg(F.max(F.struct("fetched_at", *rest)).alias("__last"))
    out = rows.join(last, key, "left")
    return out.select(*rows.columns, F.col("__last").isNotNull().alias("hit"), *[F.col(f"__last.{c}") for c in ("fetched_at", *rest)])


PERSON_RECORD = "struct<_key:string,author:array<string>,title:string,year:int,journal:string,booktitle:string,ee:array<string>>"
RECORD_KINDS = ("article", "inproceedings", "proceedings", "book", "incollection", "phdthesis", "mastersthesis", "data")


def catalogue_records(pages: DataFrame, id_col: str, xml: Column, first_year: int, last_year: int) -> DataFrame:
    """Records of person pages ``<r><kind>...</kind></r>`` within the years, one row each.

    Ordered within a person by year, venue and title, each descending, as ``place`` from 0.
    """
    fields = ",".join(f"{k}:{PERSON_RECORD}" for k in RECORD_KINDS)
    parsed = pages.select(id_col, F.from_xml(xml, f"struct<r:array<struct<{fields}>>>").alias("x")).select(id_col, F.explode("x.r").alias("r"))
    kinds = [F.when(F.col(f"r.{k}").isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(f"r.{k}").alias("e"))) for k in RECORD_KINDS]
    rows = parsed.withColumn("k", F.coalesce(*kinds)).select(id_col, "k.kind", "k.e.*").filter(F.col("year").between(first_year, last_year))
    flat = rows.select(
        id_col, F.col("_key").alias("key"), "kind", "author", norm_text("title").alias("title"), "year",
        F.coalesce("journal", "booktitle", F.lit("")).alias("venue"), F.get("ee", F.lit(0)).alias("link"),
    )
    every = F.struct("year", "venue", "title", "key", "kind", "author", "link")
    gathered = flat.groupBy(id_col).agg(F.sort_array(F.collect_list(every), False).alias("l"))
    return gathered.select(id_col, F.posexplode("l").alias("place", "e")).select(id_col, "place", "e.*")


def feed_entries(pages: DataFrame, id_col: str, xml: Column, name: Column, first_year: int, last_year: int) -> DataFrame:
    """Entries of Atom feeds by an author whose key equals that of ``name``, latest first as ``place``."""
    entry = "struct<id:string,title:string,published:string,summary:string,author:array<struct<name:string>>,category:array<struct<_term:string>>>"
    parsed = pages.select(id_col, name.alias("__n"), F.from_xml(xml, f"struct<entry:array<{entry}>>").alias("x"))
    rows = parsed.select(id_col, "__n", F.explode("x.entry").alias("e"))
    own = F.exists("e.author", lambda a: author_key(a["name"]) == author_key(F.col("__n")))
    year = F.left("e.published", F.lit(4)).try_cast("int")
    kept = rows.filter(own & year.between(first_year, last_year)).select(
        id_col, F.struct(
            F.col("e.published").alias("published"), norm_text("e.title").alias("title"), norm_text("e.id").alias("link"),
            F.transform("e.author", lambda a: a["name"]).alias("authors"), F.transform("e.category", lambda c: c["_term"]).alias("categories"),
        ).alias("s"),
    )
    gathered = kept.groupBy(id_col).agg(F.sort_array(F.collect_list("s"), False).alias("l"))
    return gathered.select(id_col, F.posexplode("l").alias("place", "e")).select(id_col, "place", "e.*")


def _material(name: str, content: bytes) -> str:
    if name.lower().endswith(".docx"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
        paragraphs = ("".join(t.text or "" for t in p.iter(f"{WORD_NS}t")).strip() for p in root.iter(f"{WORD_NS}p"))
        text = "\n".join(p for p in paragraphs if p)
    else:
        text = content.decode("utf-8", errors="replace")
    return re.sub(r"[ \t]+", " ", text).strip()


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256, text)`` of Word, text, Markdown and JSON files; other kinds are an error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    known = F.lower("path").rlike("(" + "|".join(re.escape(m) for m in MATERIALS) + ")$")
    checked = files.withColumn("content", F.when(known, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("unsupported material: "), "path")).cast("binary")))

    @F.pandas_udf("string")
    def text(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([_material(n, bytes(c)) for n, c in zip(names, contents, strict=True)], dtype=object)

    return checked.select("path", F.sha2("content", 256).alias("sha256"), text("path", "content").alias("text"))
