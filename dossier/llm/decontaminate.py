"""Benchmark decontamination: SimHash of item-sized windows, verified by weighted shingles.

1. Benchmark items and documents become lower-cased words; five consecutive words make a
   shingle (an item of fewer words is one shingle).
2. Every window as long as an item gets a 64-bit SimHash of its shingles, repeats included,
   from counts that are carried along: a shingle enters and another leaves from one window
   to the next.  Only windows that can't reach the similarity are left out, by this rule.
   A window of similarity t shares at least t * m of the m shingles of its item.  So of any
   items' shingles whose counts sum to more than (1 - t) * m it holds one.  Such a choice of
   each item's shingles, rarest in the benchmark first, is looked for in the documents, and
   all windows of the item's length over each place where one occurs are fingerprinted.
3. The fingerprints are cut into four blocks of 16 bits with allowances of RADIUS - 3 bits in
   all.  Two that differ by more than its allowance in each block differ in more than RADIUS bits.
   So within the radius some block differs by its allowance or less, and a join on (length, block,
   value), each item filed under all values that its allowances reach, meets a window with
   every item of its length within the radius, whichever item's shingle led to the window.  Of
   items that have nothing to do with a window it meets 7 in 100.
4. Pairs within the radius are verified by the weighted Jaccard similarity of their
   shingles: the sum of the smaller counts over the sum of the larger ones.

A pair with similarity 0.8 differs in 64 * acos(0.89) / pi = 9.7 bits on average with a
deviation of 2.9, so the radius of 16 lies 2.3 deviations above: at 0.8 one pair in a hundred is
missed, at 0.85 one in a thousand.  All steps are built-in
expressions; the shingles of the documents stream through one stage without a shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import bounded_broadcast, cut, normal_words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 16
BLOCKS, WIDTH = 4, 16
#: Most sought shingles that are broadcast at once, of 16 bytes; larger benchmarks go in slices, one pass over the corpus each.
MAX_ROWS = 500_000


def shingles_of(words: Column) -> Column:
    """Shingles in order, repeats included; a short text gives its one whole sequence."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.slice(words, i + 1, SHINGLE)))


def simhash(shingles: Column) -> Column:
    """64-bit SimHash: bits set in more than half of the shingles' XXH64 values."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def fold(h: Column) -> Column:
        def bit(i: Column) -> Column:
            ones = F.aggregate(
                h, F.lit(0), lambda acc, x: acc + F.call_function("shiftrightunsigned", x, i).bitwiseAND(F.lit(1).cast("long")).cast("int")
            )
            return F.when(ones * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(
                F.lit(0).cast("long")
            )

        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))

    return F.get(F.transform(F.array(hashes), fold), F.lit(0))


def block(fp: Column, b: int) -> Column:
    """Block ``b`` of the fingerprint, from its lowest bits on."""
    return F.shiftrightunsigned(fp, WIDTH * b).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def allowances(radius: int) -> list[int]:
    """Bits by which each block may differ, as even as can be; one more in each would be more than the radius."""
    spare = radius - BLOCKS + 1
    return [spare // BLOCKS + (b < spare % BLOCKS) for b in range(BLOCKS)]


@functools.cache
def _flips(bits: int) -> Column:
    """All values of a block with ``bits`` bits set or fewer."""
    values = [v for v in range(1 << WIDTH) if v.bit_count() <= bits]
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def filed_items(items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(item, n, fp, b, v)``: each item under all values of each block that lie within the block's allowance."""
    out = None
    for b, bits in enumerate(allowances(radius)):
        value = block(F.col("fp"), b)
        near = F.transform(_flips(bits), value.bitwiseXOR)
        own = items.select("item", "n", "fp", F.lit(b).alias("b"), F.explode(near).alias("v"))
        out = own if out is None else out.unionAll(own)
    return out


def meetings(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Windows with the items of their length that are within the allowance of some block, once a block; ``b`` is the block."""
    values = F.array(*(F.struct(F.lit(b).alias("b"), block(F.col("wfp"), b).alias("v")) for b in range(BLOCKS)))
    cells = windows.withColumn("c", F.explode(values)).select("key", "n", "first", "start", "wfp", "c.b", "c.v")
    return cells.join(filed_items(items, radius), ["n", "b", "v"])


def near_items(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(key, n, first, start, item, bits)``: the pairs within the radius, each once."""
    apart = F.col("wfp").bitwiseXOR(F.col("fp"))
    # A pair may meet in several blocks; the first one reports it.
    first = F.coalesce(*(F.when(F.bit_count(block(apart, b)) <= bits, F.lit(b)) for b, bits in enumerate(allowances(radius))))
    met = meetings(windows, items, radius).filter((F.bit_count(apart) <= radius) & (first == F.col("b")))
    return met.select("key", "n", "first", "start", "item", F.bit_count(apart).alias("bits"))


def numbered(hashes: Column) -> Column:
    """A bag as a set of 64-bit values: each element hashed with the number of equal ones before it."""
    plain = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(0)))

    def number(ordered: Column) -> Column:
        return F.transform(ordered, lambda h, i: F.xxhash64(h, (i + 1 - F.array_position(ordered, h)).cast("int")))

    counted = F.get(F.transform(F.array(F.sort_array(hashes)), number), F.lit(0))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), plain).otherwise(counted)


def weighted_jaccard(left: Column, right: Column) -> Column:
    """Sum of smaller counts over sum of larger counts of two bags given by ``numbered``."""
    shared = F.size(F.array_intersect(left, right))
    return shared / (F.size(left) + F.size(right) - shared)


def items_of(benchmark: DataFrame) -> DataFrame:
    """One row per distinct word sequence: ``item`` (its hash), ``words``, ``n``, ``shingles``."""
    words = benchmark.select("item_id", normal_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return (
        words.select("words").distinct().withColumn("item", F.xxhash64("words"))
        .withColumn("n", F.size("words")).withColumn("shingles", shingles_of(F.col("words")))
    )


def sought(items: DataFrame, similarity: float) -> DataFrame:
    """``(h, n)``: of each item shingles of which a window of that similarity holds at least one.

    They are taken from the one in fewest items on, until their counts sum to more than
    ``(1 - similarity) * m``: a window without any lacks more than it may.
    """
    own = items.select("item", "n", F.size("shingles").alias("m"), F.explode("shingles").alias("s")).withColumn("h", F.xxhash64("s"))
    own = own.groupBy("item", "n", "m", "h").agg(F.count(F.lit(1)).alias("c"))
    own = own.join(own.groupBy("h").agg(F.count(F.lit(1)).alias("items")), "h")
    order = Window.partitionBy("item").orderBy("items", "h")
    before = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # The small amount keeps a product such as 0.2 * 5 from falling below its true value.
    own = own.withColumn("before", F.coalesce(before, F.lit(0)))
    return own.filter(F.col("before") <= (1 - similarity) * F.col("m") + 1e-6).select("h", "n").distinct()


def _chunks(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Windows over places of sought shingles: ``(doc_id, key, n, first, last, m, hs)``.

    ``first`` to ``last`` are the words at which windows begin, each in one chunk of a
    document and length, ``m`` the shingles of a window, ``hs`` those from ``first`` on.
    """
    sizes = [r["size"] for r in places.select(F.least("n", F.lit(SHINGLE)).alias("size")).distinct().collect()]  # 1 to SHINGLE
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), normal_words(F.col("text")).alias("ws"))
    n, total = F.col("n"), F.size("ws")
    span = F.greatest(F.least(n, total) - SHINGLE + 1, F.lit(1))
    found = None
    for size in sorted(sizes):
        at = words.select("doc_id", "key", "ws", F.posexplode("ws").alias("pos", "w0")).filter(F.col("pos") + size <= F.size("ws"))
        text = F.concat_ws(" ", "w0", *[F.get("ws", F.col("pos") + k) for k in range(1, size)])
        own = places.filter(F.least("n", F.lit(SHINGLE)) == size)
        first = F.greatest(F.lit(0), F.col("pos") - span + 1)
        at = at.withColumn("h", F.xxhash64(text)).join(F.broadcast(own), "h").select(
            "doc_id", "key", "n", "pos", F.lit(size).alias("size"), span.alias("m"), first.alias("from"),
            F.greatest(F.lit(0), F.least("pos", total - n)).alias("last"),
            F.slice("ws", first + 1, F.col("pos") + n - first).alias("own"),
        )
        found = at if found is None else found.unionAll(at)
    # Places that repeat, as in repeated rows, are dropped before the shuffle by key.
    order = Window.partitionBy("key", "n").orderBy("pos")
    first = F.greatest("from", F.coalesce(F.lag("pos").over(order) + 1, F.lit(0)))
    found = cut(found.distinct()).withColumn("first", first).filter("first <= last")
    hs = F.transform(
        F.sequence(F.lit(0), F.col("last") - F.col("first") + F.col("m") - 1),
        lambda i: F.xxhash64(F.concat_ws(" ", F.slice("own", F.col("first") - F.col("from") + i + 1, F.col("size")))),
    )
    return found.select("doc_id", "key", "n", "first", "last", "m", hs.alias("hs"))


def window_fingerprints(chunks: DataFrame) -> DataFrame:
    """``(key, n, first, start, wfp)``: the SimHash of every window of the chunks.

    A shingle enters at one window and leaves at a later one, so a running sum of what
    enters and leaves holds the counts of the 64 bits, two of them in one long value.
    """
    i, t = F.col("i"), F.col("t")
    moves = F.array(
        F.struct(F.greatest(F.lit(0), i - F.col("m") + 1).alias("t"), F.lit(1).cast("long").alias("sign")),
        F.struct((i + 1).alias("t"), F.lit(-1).cast("long").alias("sign")),
    )
    steps = chunks.select("key", "n", "first", "last", "m", F.posexplode("hs").alias("i", "h"))
    steps = steps.select("key", "n", "first", "last", "m", "i", "h", F.inline(moves)).filter(t <= F.col("last") - F.col("first"))
    order = Window.partitionBy("key", "n", "first").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    pair = F.lit(1 << 32 | 1)
    lanes = [F.sum(F.col("sign") * F.shiftrightunsigned("h", k).bitwiseAND(pair)).over(order).alias(f"c{k}") for k in range(32)]
    counted = steps.select("key", "n", "first", "m", "t", "i", "sign", *lanes)
    # The window's last shingle enters only there, so it stands for the window.
    counted = counted.filter((F.col("sign") == 1) & (i == t + F.col("m") - 1))
    half = F.floor(F.col("m") / 2)
    bits = [F.when(F.col(f"c{k}").bitwiseAND(F.lit(0xFFFFFFFF)) > half, F.lit(1 << k)).otherwise(F.lit(0).cast("long")) for k in range(32)]
    top = [1 << (k + 32) if k < 31 else -(1 << 63) for k in range(32)]
    bits += [F.when(F.shiftrightunsigned(f"c{k}", 32) > half, F.lit(top[k]).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(32)]
    return counted.select("key", "n", "first", (F.col("first") + t).alias("start"), functools.reduce(Column.bitwiseOR, bits).alias("wfp"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document and benchmark item that it holds.

    Columns: ``doc_id``, ``item_id``, ``similarity`` of the best window, ``start_word`` (the
    first such window, in words from 0), ``bits`` (its Hamming distance).  Items of equal
    words each get a row.  Null and wordless texts match nothing; repeated rows add nothing;
    rows with a null doc_id come out under null; extra columns are ignored; either table may
    be empty.  A document shorter than the item is compared as a whole.
    """
    spark = docs.sparkSession
    ids = benchmark.select("item_id", normal_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = cut(items_of(benchmark).withColumns({"fp": simhash(F.col("shingles")), "bag": numbered(F.transform("shingles", lambda s: F.xxhash64(s)))}))
    # No more shingles are sought than there are.
    rows = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    slices = -(-rows // MAX_ROWS) or 1
    kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for k in range(slices if rows else 0):
        part = items.filter(F.pmod(F.xxhash64("words"), F.lit(slices)) == k) if slices > 1 else items
        # The few chunks are written before they are fingerprinted, so that the shingles stream
        # through the search once and nothing that follows moves into it.
        chunks = cut(_chunks(docs, cut(sought(part, similarity))))
        # Written, too, so that the expression of a fingerprint is compiled once and not again in each block.
        windows = cut(window_fingerprints(chunks))
        near = cut(near_items(windows, part, radius))
        bag = numbered(F.slice("hs", F.col("start") - F.col("first") + 1, F.col("m")))
        near = near.join(chunks.select("doc_id", "key", "n", "first", "m", "hs"), ["key", "n", "first"]).withColumn("own", bag)
        near = near.select("doc_id", "item", "start", "bits", "own").join(part.select("item", "bag"), "item")
        near = near.withColumn("similarity", weighted_jaccard(F.col("own"), F.col("bag"))).filter(F.col("similarity") >= similarity)
        near = near.select("doc_id", "item", "start", "similarity", "bits")
        out = near if out is None else out.unionAll(near)
    if out is None:
        return spark.createDataFrame([], f"doc_id {kind[0]}, item_id {kind[1]}, similarity double, start_word int, bits int")
    best = out.groupBy("doc_id", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("bits")).alias("bits"))).alias("top")
    )
    same = ids.join(items.select("words", "item"), "words").select("item_id", "item").distinct()
    return best.join(same, "item").select(
        "doc_id", "item_id", F.col("top.similarity").alias("similarity"),
        (-F.col("top.back")).alias("start_word"), (-F.col("top.bits")).alias("bits"),
    )


def drop_leaky(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item, all columns kept; null ids and repeated rows stay, no rows or items give what there is."""
    leaky = cut(leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(bounded_broadcast(leaky), "doc_id", "left_anti")
