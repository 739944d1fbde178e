"""Connected components without gathering the graph."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


REPO_ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the repository when the driver does."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in (REPO_ROOT, *paths) if p])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset a local session gets a temporary folder; a cluster an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="dossier-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have a written scratch path deleted when the driver ends; results may read it until then."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there.

    A written table survives the loss of any executor and can be read by all of them.  It is
    deleted when the driver ends.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (edges hold a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an undirected graph: ``(node, root)``, root the smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014), which need a
    number of rounds in the logarithm of the graph's size.  Every step is a map-side
    combined minimum and an equi-join that adaptive execution can split, so a hub with
    a third of all edges does not meet in one task.  The joins are merged by hint: a side
    grows with the graph, and broadcast it would fill the driver.  Each round ends in a
    table in the shared folder.  Roots appear as nodes; loops and repeated edges are ignored; an
    edge with a null end is dropped; an empty input gives an empty result.
    """
    a, b = F.col(left), F.col(right)
    now = cut(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    before = None
    seen = _digest(now)
    while seen != before:
        before = seen
        now = cut(_small_star(_large_star(now)))
        seen = _digest(now)
    rooted = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
