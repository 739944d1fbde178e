"""Cached entries as state of a stream: replayed in several runs they give what a batch gives."""

import datetime
import random

from pyspark.sql import functions as F

from dossier.streaming import expiring

ENTRY = "key string, fetched_at timestamp, seq long, body string"


def test_cache_replayed_in_runs(spark, tmp_path):
    rng = random.Random(1)
    start = datetime.datetime(2026, 1, 1)
    entries = [(f"old{i}", start + datetime.timedelta(minutes=i), 1, "o") for i in range(6)]
    entries += [(f"k{rng.randrange(25)}", start + datetime.timedelta(hours=i // 3), i % 5, f"b{i}") for i in range(240)]
    entries += [("same", start + datetime.timedelta(hours=70), s, f"s{s}") for s in (2, 9, 4)] + [(None, start, 1, "x"), ("none", None, 1, "x")]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part in (entries[:100], entries[100:170], entries[170:]):
        spark.createDataFrame(part, ENTRY).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ENTRY).parquet(source)
        expiring.keep_cache(stream, "30 HOURS", out, checkpoint, "1 day").awaitTermination()
    happened = spark.read.parquet(out)
    assert happened.filter("state = 'expired' AND key LIKE 'old%'").count() == 6
    got = sorted(map(tuple, expiring.cache_now(spark, out).collect()))
    want = sorted(map(tuple, expiring.cache_of(spark.createDataFrame(entries, ENTRY), "30 HOURS").collect()))
    # What is exactly as old as the newest entry allows, or ends with the watermark behind it, may still be stored.
    assert set(want) <= set(got) and ("same", start + datetime.timedelta(hours=70), 9, "s9") in got
    late = {r[0] for r in set(got) - set(want)}
    newest = max(e[1] for e in entries if e[1])
    assert all(r[1] > newest - datetime.timedelta(hours=30 + 24) for r in got) and len(late) < 15
    ended = happened.filter("state = 'expired'").select("key", "fetched_at").distinct().count()
    assert ended == happened.filter("state = 'expired'").count()


def test_cache_of_nothing(spark):
    assert expiring.cache_of(spark.createDataFrame([], ENTRY), "1 DAY").count() == 0
    one = spark.createDataFrame([("a", datetime.datetime(2026, 1, 1), 1, None)], ENTRY)
    assert [tuple(r)[0] for r in expiring.cache_of(one.unionAll(one), "1 DAY").collect()] == ["a"]
    assert one.filter(F.lit(False)).count() == 0
