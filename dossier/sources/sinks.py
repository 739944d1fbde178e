"""Writing results: one table of a set, single JSON documents, audit artefacts, answers as JSON."""

from __future__ import annotations

import datetime
import json
import math
import os
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, NumericType, TimestampNTZType, TimestampType

from dossier.operators import sheets
from dossier.operators.graph import forget_at_exit, scratch_path

# The columns of a web search, the first of them a number.
SEARCH_COUNT = "web_search_count"
SEARCH_TEXTS = ("web_search_status", "web_search_confidence", "web_search_keywords", "web_search_evidence", "web_search_urls", "web_search_advice")
ARTEFACTS = ("query_plan", "source_report", "candidates", "review_queue", "merged_publications")


def read_tables(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All tables of a root by name: its folders or files, or those named; one that can't be read is left out."""
    if names is None:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        names = sorted(f.getPath().getName() for f in files)
    out = {}
    for name in names:
        if name.startswith(("_", ".")):
            continue
        try:
            out[name.removesuffix(".parquet")] = spark.read.parquet(f"{root.rstrip('/')}/{name}")
        except AnalysisException:
            continue
    return out


def replace_table(df: DataFrame, root: str, name: str) -> None:
    """Overwrite one table of a root and leave the others alone; ``df`` may read the table it replaces.

    What replaces it is written elsewhere in full before anything is taken away.
    """
    kept = scratch_path(df.sparkSession, "replace")
    forget_at_exit(df.sparkSession, kept)  # unless it is deleted below, as after a failure
    df.write.parquet(kept)
    df.sparkSession.read.schema(df.schema).parquet(kept).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(kept)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def sync_statuses(spark: SparkSession, root: str, store: DataFrame, key: Callable[[DataFrame], Column], fallback: Callable[[DataFrame], Column], authoritative: bool = False) -> list[str]:
    """Bring the status columns of all tables of a root in line with ``store``; the names of those that have a name column, which were replaced."""
    done = []
    for name, rows in read_tables(spark, root).items():
        if sheets.NAME in rows.columns:
            replace_table(sheets.synced(rows, store, key, fallback, authoritative), root, name)
            done.append(name)
    return done


def clean_columns(df: DataFrame) -> DataFrame:
    """Every column fit for display: missing and not-a-number empty, dates and times in ISO form."""

    def clean(name: str, kind: object) -> Column:
        value = F.col(f"`{name}`")
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(kind, DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(kind, (DoubleType, FloatType)):
            value = F.when(~F.isnan(value), value)
        elif not isinstance(kind, NumericType):
            return F.coalesce(value, F.lit("")).alias(name) if kind.simpleString() == "string" else value
        return F.coalesce(value.cast("string"), F.lit("")).alias(name)

    return df.select(*[clean(f.name, f.dataType) for f in df.schema.fields])


def restored_search(df: DataFrame) -> DataFrame:
    """The columns of a web search, made where they are absent: the count a number or 0, texts or empty."""
    have = set(df.columns)
    count = F.coalesce(F.col(SEARCH_COUNT).try_cast("int"), F.lit(0)) if SEARCH_COUNT in have else F.lit(0)
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in SEARCH_TEXTS}
    return df.withColumns({SEARCH_COUNT: count, **texts})


def safe(value: object) -> object:
    """A value that JSON can hold: not-a-number and missing as null, dates as text, keys as strings."""
    if isinstance(value, Mapping):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [safe(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else str(value)


def write_document(path: str, value: object, lines: bool = False) -> None:
    """A small JSON document, or JSON lines with sorted keys, on the driver: whole or not at all."""
    folder = os.path.dirname(path)
    os.makedirs(folder or ".", exist_ok=True)
    passing = os.path.join(folder, f".{os.path.basename(path)}.tmp")
    with open(passing, "w", encoding="utf-8") as file:
        if lines:
            file.writelines(json.dumps(safe(v), ensure_ascii=False, sort_keys=True, allow_nan=False) + "\n" for v in value)
        else:
            file.write(json.dumps(safe(value), ensure_ascii=False, indent=2, allow_nan=False) + "\n")
        file.flush()
        os.fsync(file.fileno())
    os.replace(passing, path)


def write_artefacts(root: str, tables: Mapping[str, DataFrame]) -> None:
    """The audit artefacts as JSON lines, each a folder under ``root``; one that is missing is an error before any is written."""
    if missing := [n for n in ARTEFACTS if n not in tables]:
        raise ValueError(f"missing artefacts: {missing}")
    for name in ARTEFACTS:
        tables[name].write.mode("overwrite").json(f"{root.rstrip('/')}/{name}")


def as_json(df: DataFrame) -> DataFrame:
    """One column ``json``: each row as an object, missing values as null, not-a-number too."""
    clean = [F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def api(tables: Mapping[str, DataFrame], people: str = "people", key: str = "person_id") -> dict:
    """The viewer's questions as functions that return DataFrames: health, data and a person's detail."""

    def health() -> DataFrame:
        counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in sorted(tables.items())]
        out = counts[0]
        for more in counts[1:]:
            out = out.unionByName(more)
        return out

    def data() -> DataFrame:
        return clean_columns(tables[people])

    def detail(person: object) -> dict[str, DataFrame]:
        return {name: df.filter(F.col(key) == person) for name, df in tables.items() if name != people and key in df.columns}

    return {"health": health, "data": data, "detail": detail}
