"""Incremental runs: work lists by fingerprint, and the same as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dossier.operators.contact import upsert


def split_work(rows: DataFrame, saved: DataFrame, key: str, mark: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose result is saved under the same key and fingerprint, and the rest."""
    known = saved.select(key, mark).distinct()
    return rows.join(known, [key, mark], "left_semi"), rows.join(known, [key, mark], "left_anti")


def read_appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines as they are appended to a folder."""
    return spark.readStream.schema(schema).json(path)


def maintain_store(changes: DataFrame, store_path: str, checkpoint: str, key: str, seq: str) -> StreamingQuery:
    """Keep a store of last entries from a stream of changes.

    Each batch writes a new generation beside the last and then names it, so a batch that is
    run again after a failure gives the same store.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        names = spark.read.parquet(f"{store_path}/names") if number else None
        last = names.filter(F.col("batch") < number).agg(F.max("batch")).first()[0] if names is not None else None
        old = spark.read.parquet(f"{store_path}/batch={last}") if last is not None else batch.limit(0).drop("deleted")
        upsert(old, batch, key, seq).write.mode("overwrite").parquet(f"{store_path}/batch={number}")
        spark.createDataFrame([(number,)], "batch long").write.mode("append").parquet(f"{store_path}/names")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, store_path: str) -> DataFrame:
    last = spark.read.parquet(f"{store_path}/names").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{store_path}/batch={last}")
