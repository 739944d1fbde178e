"""Order-dependent merging without a fold: who comes first under a key decides, and pointers to those are followed.

A row joins what was there before by the first of its keys that an earlier row has.  The earliest row of that key
set where the key leads, and later ones don't change it.  So each row has one pointer, to a row before it, that can be
read off its keys alone: all that depends on the order is following the pointers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators.graph import cut


def first_known(rows: DataFrame, order: str, keys: str) -> DataFrame:
    """``(order, parent)``: for rows with a key that an earlier row has, the earliest row of the first such key in their list.

    ``order`` tells rows apart.  Null keys are none.  Earliest rows are combined minima, so a key
    of a third of all rows doesn't meet in one task.
    """
    pairs = rows.select(order, F.posexplode(keys).alias("pos", "key")).filter(F.col("key").isNotNull())
    heads = pairs.groupBy(F.col("key").alias("key_")).agg(F.min(order).alias("head"))
    known = pairs.join(heads, F.col("key") == F.col("key_")).filter(F.col("head") < F.col(order))
    return known.groupBy(order).agg(F.min(F.struct("pos", "head")).alias("first")).select(order, F.col("first.head").alias("parent"))


def roots_of(pointers: DataFrame, order: str) -> DataFrame:
    """``(order, root)`` of rows with a ``parent``: where their pointers end, found by doubling steps."""
    now = cut(pointers.select(order, F.col("parent").alias("root")))
    while True:
        via = now.select(F.col(order).alias("via"), F.col("root").alias("next"))
        step = cut(now.join(via, F.col("root") == F.col("via"), "left").select(order, F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def owners_of(rows: DataFrame, pointers: DataFrame, order: str, group: str) -> DataFrame:
    """``(order, owner)`` of all ``rows``: themselves without a ``parent``, and where they and their parent's owner are of one ``group``, else that owner.

    An empty or null ``group`` is none.  Whether a row stays depends on its parent's owner, so pointers
    are followed a level a step, but only those of rows that others point to; the rest follow at once.
    """
    own = rows.select(order, F.coalesce(group, F.lit("")).alias("group"))
    led = cut(own.join(pointers, order, "left"))
    heads = cut(led.join(pointers.select(F.col("parent").alias(order)).distinct(), order, "left_semi"))
    stays = (F.col("group") != "") & (F.col("group") == F.col("owner_group"))

    def settle(waiting: DataFrame, known: DataFrame) -> DataFrame:
        told = known.select(F.col(order).alias("at"), F.col("owner").alias("above"), "owner_group")
        met = waiting.join(told, F.col("parent") == F.col("at"))
        return met.select(order, "group", F.when(stays, F.col(order)).otherwise(F.col("above")).alias("owner"), F.when(stays, F.col("group")).otherwise(F.col("owner_group")).alias("owner_group"))

    start = F.col("parent").isNull()
    level = cut(heads.filter(start).select(order, "group", F.col(order).alias("owner"), F.col("group").alias("owner_group")))
    known = level
    while not level.isEmpty():
        level = cut(settle(heads.filter(~start), level))
        known = known.unionAll(level)
    known = cut(known)
    free = led.filter(start).select(order, F.col(order).alias("owner"))
    return free.unionAll(settle(led.filter(~start), known).select(order, "owner"))
