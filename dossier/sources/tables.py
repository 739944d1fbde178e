"""Reading and writing the engine's tables and document stores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from dossier.operators.graph import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels")

#: Pages that are parsed before their results leave a Python worker; Spark hands it batches of 10,000.
PAGES = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt evenly over several tasks a core.

    For rows that are small to read and long to work on: a file of some MB is read by one task,
    however many rows it holds.  A number of partitions that is named isn't lowered at run time.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def first_table(spark: SparkSession, root: str, names: Sequence[str], schema: StructType) -> DataFrame:
    """The first of several names under which a table exists; an empty one if none does."""
    for name in names:
        try:
            return spark.read.parquet(f"{root}/{name}")
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def target_tables(spark: SparkSession, root: str, name: str, excluded: Sequence[str] = ("archive", "_shadow", "shadow_runs")) -> DataFrame:
    """A table over all ``school=/college=`` folders, but for paths with an excluded part."""
    df = spark.read.option("basePath", root).parquet(f"{root}/school=*/college=*/{name}")
    path = F.col("_metadata.file_path")
    for part in excluded:
        df = df.filter(~F.contains(path, F.lit(f"/{part}/")))
    return df


def write_tables(root: str, tables: dict[str, DataFrame]) -> None:
    """Overwrite each named table under a root."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: StructType, key: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """An append log of JSON lines: the last line of each key, and the lines that don't parse."""
    bad = "_corrupt_record"
    wide = StructType(list(schema.fields)).add(bad, "string")
    raw = spark.read.text(path).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    lines = raw.select(F.from_json("value", wide, options).alias("r")).select("r.*")
    good = lines.filter(F.col(bad).isNull() & F.col(key).isNotNull()).drop(bad)
    rest = [c for c in good.columns if c not in (key, seq)]
    last = good.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("t")).select(key, *[f"t.{c}" for c in (seq, *rest)])
    return last, lines.filter(F.col(bad).isNotNull()).select(bad)


def read_store(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """A JSON document ``{version, statuses: {key: entry}}`` as rows ``row_key`` and the entry's fields.

    ``entry`` is the DDL of an entry.  A document that doesn't parse is an error, never an
    empty store.
    """
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(
        F.from_json("value", f"struct<version:int,statuses:map<string,struct<{entry}>>>", {"mode": "FAILFAST"}).alias("s")
    )
    return parsed.select(F.explode("s.statuses").alias("row_key", "e")).select("row_key", "e.*")


class _Page(HTMLParser):
    """Collects visible text and anchors; stdlib, so it accepts any markup."""

    hidden = ("script", "style", "noscript", "svg")
    described = ("description", "keywords", "author", "og:description", "og:title")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.text, self.links, self.metas = 0, [], [], []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in self.hidden:
            self.skip += 1
        elif tag == "a" and given.get("href"):
            self.links.append((given["href"], []))
            self.inside = True
        elif tag == "meta" and (given.get("name") or given.get("property") or "").lower() in self.described:
            self.metas.append(given.get("content") or "")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden and self.skip:
            self.skip -= 1
        elif tag == "a":
            self.inside = False

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)
            if self.inside:
                self.links[-1][1].append(data)


def parse_html(html: Column) -> Column:
    """``struct<text, links array<struct<href, text>>>`` of a page; broken markup is read as far as it goes."""

    ship(SparkSession.active())

    @F.pandas_udf("text string, links array<struct<href string, text string>>")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            for at in range(0, len(batch), PAGES):
                texts, links = [], []
                for page in batch.iloc[at : at + PAGES]:
                    parser = _Page()
                    parser.feed(page or "")
                    texts.append(" ".join(" ".join([*parser.metas, *parser.text]).split()))
                    links.append([{"href": h, "text": " ".join("".join(t).split())} for h, t in parser.links])
                yield pd.DataFrame({"text": texts, "links": links})

    return run(html)
