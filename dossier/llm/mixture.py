"""Mixing sources to target weights by hash-threshold histograms.

Every document has a size (its words) and a 60-bit key, a hash of its id and text.  A source
takes each document ``floor(target / size of the source)`` times, and fills the rest of its
target in the order of the keys: a document is taken once more if it fits into what is left.

Nothing is sorted to find these documents.  They are those below a threshold: the words of
each source are summed by bucket of the key's leading bits, running sums over a source's
buckets show the one in which the budget runs out, and this boundary bucket alone is summed
again by the next bits, until it holds one key.  That key's documents do not fit.  What is left
of the budget is the next, nested budget: the same search goes on behind the threshold among
documents that are no larger than it, until ``NEAR`` of the target or less is left, ``ROUNDS`` times at most.  A source then
has a few thresholds, and one filter over the documents reads off who is taken.

Sources are numbered, and their targets found, without meeting in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import cut, fresh, ordinals, small

#: Weights of the sources in their order, repeating; the share of all words that they get; how often a document is taken at most.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Nested budgets of a source at most; another one follows only if more than this share of the target is left.
ROUNDS, NEAR = 6, 0.001
#: Leading bits of the key that one histogram tells apart, and bits of a key.
STEP, BITS = 12, 60


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null text has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")).cast("long")


def document_key(*columns: Column) -> Column:
    """60 bits of a hash of the columns; a null counts as `-`."""
    joined = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("-")) for c in columns))
    return F.conv(F.substring(F.md5(joined), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, source_size)``, one row a source, with the column ``target``.

    The sources, ordered by code point with null last, weigh ``weights``, repeating.  They share
    ``share`` of all sizes by weight; who would get more than ``cap`` times its size gets that, and
    the excess is shared again among the others, until none is above.  Each such step is one sum
    over the sources.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double")
    most = F.col("source_size") * float(cap)
    own = cut(ordinals(sources, [F.col("source").asc_nulls_last()], "at").select("source", "source_size", w.alias("w"), most.alias("most")))
    whole = own.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = F.col("most") <= F.lit(level) * F.col("w")
        got = own.agg(F.sum(F.when(capped, F.col("most"))).alias("most"), F.sum(F.when(~capped, F.col("w"))).alias("w"), F.sum(capped.cast("long")).alias("n")).first()
        if not got.w or got.n == full:
            break
        full, level = got.n, (float(share) * whole - (got.most or 0.0)) / got.w
    return own.select("source", "source_size", F.least("most", F.lit(level) * F.col("w")).alias("target"))


Hint = Callable[[DataFrame], DataFrame]


def _boundaries(documents: DataFrame, budgets: DataFrame, hint: Hint) -> DataFrame:
    """For each row of ``budgets`` (source, left, after): the first key behind ``after`` whose documents no longer fit, and what is left then.

    ``documents`` has source, size, key.  Documents larger than ``left`` are passed over.  ``stop`` is null where all fit.
    """
    path, base, done = F.lit(0).cast("long"), F.col("left"), None
    now = budgets.select("source", "left", "after", path.alias("path"), base.alias("rest"))
    for depth in range(1, BITS // STEP + 1):
        drop = BITS - STEP * depth
        inside = F.shiftright("key", drop + STEP) == F.col("path")
        heap = (
            documents.join(hint(now.withColumnRenamed("source", "source_")), F.col("source").eqNullSafe(F.col("source_")))
            .filter((F.col("key") > F.col("after")) & (F.col("size") <= F.col("left")) & inside)
            .groupBy("source", F.shiftright("key", drop).alias("bucket"))
            .agg(F.sum("size").alias("s"), F.min("key").alias("low"), F.max("key").alias("high"))
        )
        sums = F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        joined = heap.withColumn("upto", sums).join(hint(now.withColumnRenamed("source", "source_")), F.col("source").eqNullSafe(F.col("source_")))
        # The first bucket beyond the budget; where there is none, all that was summed is taken.
        over = F.struct("bucket", "low", "high", (F.col("rest") - F.col("upto") + F.col("s")).alias("rest"))
        hit = joined.groupBy("source", "left", "after").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), over)).alias("hit"), (F.first("rest") - F.max("upto")).alias("spare")
        )
        found = cut(hit)
        ended = F.col("hit").isNull() | (F.col("hit.low") == F.col("hit.high"))
        part = found.filter(ended).select(
            "source", "left", F.col("hit.low").alias("stop"), F.when(F.col("hit").isNull(), F.col("spare")).otherwise(F.col("hit.rest")).alias("rest")
        )
        done = part if done is None else done.unionByName(part)
        now = found.filter(~ended).select("source", "left", "after", F.col("hit.bucket").alias("path"), F.col("hit.rest").alias("rest"))
        if now.isEmpty():
            break
    return cut(done)


def thresholds(documents: DataFrame, wanted: DataFrame, hint: Hint = lambda df: df) -> DataFrame:
    """``wanted`` (source, source_size, target) with ``times``, how often every document is taken, and ``steps``.

    ``steps`` lists the nested budgets as (after, stop, most): documents with a key between the two (a null
    stop: any behind ``after``) and of ``most`` words or fewer are taken once more.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = wanted.withColumn("times", times)
    left = F.floor(F.col("target") + 1e-6 - F.col("times") * F.col("source_size")).cast("long")
    now = cut(plan.select("source", F.greatest(left, F.lit(0)).alias("left"), F.lit(-1).cast("long").alias("after"), (F.col("target") * NEAR).alias("near")).filter("left > 0"))
    steps = None
    for _ in range(ROUNDS):
        if now.isEmpty():
            break
        met = _boundaries(documents, now, hint)
        step = now.join(met.select(F.col("source").alias("source_"), "stop", "rest"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
        part = step.select("source", F.struct("after", "stop", F.col("left").alias("most")).alias("step"))
        steps = part if steps is None else steps.unionByName(part)
        now = cut(step.filter("stop IS NOT NULL AND rest > near").select("source", F.col("rest").alias("left"), F.col("stop").alias("after"), "near"))
    if steps is None:
        return plan.withColumn("steps", F.array().cast("array<struct<after:bigint,stop:bigint,most:bigint>>"))
    listed = steps.groupBy(F.col("source").alias("source_")).agg(F.collect_list("step").alias("steps"))
    return plan.join(listed, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


def mix(documents: DataFrame, source: str = "source", size: str = "size", key: str = "key", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``documents`` with ``source_size``, ``target`` (its source's) and ``taken``, the words that the mix takes of it, repeats counted.

    ``size`` is a document's size and ``key`` its 60-bit key; other columns stay, but for those with one of the three names.
    A null source is a source, the last one; a null size counts as 0 and a null key as 0.  A document is taken whole, up to ``cap``
    times rounded up.  Rows of a source with one key share their fate: they are taken together if they all fit.  No rows give no rows.
    The rows are read several times, so ``documents`` should be a written table, which may hold but the columns named.
    """
    names = ["source_size", "target", "taken"]
    kept = documents.drop(*[c for c in documents.columns if c.lower() in names])
    narrow = documents.select(
        F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.coalesce(F.col(key), F.lit(0)).cast("long").alias("key")
    )
    sums = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    # Each table over the sources has some ten numbers a source beside its name.
    hint: Hint = F.broadcast if small(sums, 8 << 20) else lambda df: df
    plan = cut(thresholds(narrow, targets(sums, weights, share, cap), hint))
    at = {c: fresh(kept, f"__{c}") for c in ("source", "times", "steps", "source_size", "target")}
    told = hint(plan.select(*(F.col(c).alias(n) for c, n in at.items())))
    k, n = F.coalesce(F.col(key), F.lit(0)), F.coalesce(F.col(size), F.lit(0))
    fits = lambda s: (k > s["after"]) & (s["stop"].isNull() | (k < s["stop"])) & (n <= s["most"])
    once = F.coalesce(F.exists(F.col(at["steps"]), fits), F.lit(False)).cast("long")
    return kept.join(told, F.col(source).eqNullSafe(F.col(at["source"]))).select(
        *kept.columns,
        F.col(at["source_size"]).alias("source_size"),
        F.col(at["target"]).alias("target"),
        (n.cast("long") * (F.col(at["times"]) + once)).alias("taken"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows: one a document with doc_id, size, source_size, target, taken."""
    key = document_key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("-"))))
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")
