"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints.  A text is lower-cased in A-Z, cut into words at ASCII white space, and
every three consecutive words, repeats included, vote with their XXH64 (seed 42) on the
64 bits of the fingerprint; a bit is set if more than half the shingles set it.

Covering.  Two fingerprints at 3 or fewer differing bits agree, in one of their two
32-bit halves, in all but one bit.  Within a half the anchors are the words of the
perfect [31, 26] Hamming code on the low 31 bits (covering radius 1) next to the top
bit taken as it is: 2**27 anchors.  Each fingerprint has one home anchor per half, at
distance 1 or less.  A partner one bit away lies within covering radius plus threshold,
1 + 1, of that anchor, so replicating each fingerprint to the anchors at distance 2 or
less (17 at most) brings every linked pair together at some anchor, where it is compared.

Dense places.  Near copies by the thousand fill an anchor with fingerprints that all
link to each other.  Where an anchor is home to several fingerprints, those are first
joined through the points at distance 1 or less of them: all that share such a point
lie within 2 bits of each other, at most 65 share one, and a star replaces their pairs.
At the anchors only links between different groups of that first step are then emitted,
so the output never holds all pairs of a group and yet no connection is lost.  The bound
from which a place counts as dense changes no result: a star's edges are links, as its ends
differ in 2 bits at most, and every pair of an anchor is still compared, but for pairs of one
group, which are connected already.  So the components are those of all links, with any bound.

Joins.  All are merged by hint: both sides grow with the corpus, and Spark takes the size of exploded
rows for that of the table they come from, so it would broadcast the 35 rows of each fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import components, cut, ship

SEED = 42
SHINGLE = 3
THRESHOLD = 3
#: Shingles whose bits are summed at once; longer texts take several rounds.
CHUNK = 1 << 16
#: Fingerprints at home in one anchor from which it counts as a dense place; any number gives the same result.
DENSE = 4


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text; no words or null give zero, fewer words than ``size`` one shingle."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    digest = xxhash.xxh64_digest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), CHUNK):
        raw = b"".join([digest(s, SEED) for s in shingles[at : at + CHUNK]])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(shingles)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        prints = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*batch.schema.names[:-1], "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row, ``fp`` a signed long; a null id stays a row."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp long")


def _halves(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))]


def _syndrome(half: Column) -> Column:
    """XOR of the positions 1 to 31 whose bits are set, from five masked parities."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        out = out + F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))) % 2 * (1 << k)
    return out


def _flip(half: Column, position: Column) -> Column:
    """Flip the bit of a position 1 to 31; position 0 flips nothing."""
    mask = F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("long"), position - 1)).otherwise(F.lit(0).cast("long"))
    return half.bitwiseXOR(mask)


def _anchor_rows(prints: DataFrame, replicas: bool) -> DataFrame:
    """Home anchors ``(table, anchor, ...)``, or all anchors within radius 2."""
    halves = F.array(*[F.struct(F.lit(t).alias("t"), h.alias("half")) for t, h in enumerate(_halves(F.col("fp")))])
    rows = prints.withColumn("h", F.explode(halves)).select("*", "h.t", "h.half").drop("h")
    rows = rows.withColumn("s", _syndrome(F.col("half")))
    home = _flip(F.col("half"), F.col("s"))
    if not replicas:
        return rows.withColumn("anchor", home).drop("half", "s")
    top = F.lit(1 << 31).cast("long")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(31))))
    other = F.col("i").bitwiseXOR(F.col("s"))
    rows = rows.filter((F.col("i") <= 0) | ((other > F.col("i")) & (F.col("s") > 0)))
    anchor = (
        F.when(F.col("i") == -1, home.bitwiseXOR(top))
        .when(F.col("i") == 0, home)
        .otherwise(_flip(_flip(F.col("half"), F.col("i")), other))
    )
    return rows.withColumn("anchor", anchor).drop("half", "s", "i")


def _dense_stars(prints: DataFrame) -> DataFrame:
    """Star edges between fingerprints of dense places that share a point at distance 1 or less."""
    homes = _anchor_rows(prints.select("fp"), replicas=False)
    crowded = homes.groupBy("t", "anchor").count().filter(F.col("count") >= DENSE)
    dense = homes.join(crowded.hint("merge"), ["t", "anchor"], "left_semi").select("fp").distinct()
    point = F.explode(
        F.concat(
            F.array(F.col("fp")),
            F.transform(
                F.sequence(F.lit(0), F.lit(63)),
                lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
            ),
        )
    )
    near = dense.select("fp", point.alias("z")).groupBy("z").agg(F.collect_set("fp").alias("near"))
    near = near.filter(F.size("near") > 1).withColumn("b", F.array_min("near"))
    return near.select(F.explode("near").alias("a"), "b").filter("a <> b").distinct()


def links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect all within ``THRESHOLD`` bits.

    ``prints`` holds each fingerprint once, as ``fp``.
    """
    stars = cut(_dense_stars(prints))
    grouped = components(stars)
    known = cut(
        prints.select("fp").join(grouped.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("grp"))
    )
    home = _anchor_rows(known, replicas=False).select("t", "anchor", F.col("fp").alias("a"), F.col("grp").alias("ga"))
    all_near = _anchor_rows(known, replicas=True).select("t", "anchor", F.col("fp").alias("b"), F.col("grp").alias("gb"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = home.alias("h").join(
        all_near.alias("n").hint("merge"),
        (F.col("h.t") == F.col("n.t"))
        & (F.col("h.anchor") == F.col("n.anchor"))
        & (F.col("ga") != F.col("gb"))
        & (apart <= THRESHOLD),
    )
    across = met.select(F.greatest("ga", "gb").alias("a"), F.least("ga", "gb").alias("b")).distinct()
    return stars.unionAll(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest doc_id reachable over links of 3 or fewer bits.
    Null, empty and wordless texts have fingerprint zero and link like any other;
    repeated rows stay rows of their own; a null id keeps its row, joins the group of its
    fingerprint, and names it only if no other id is there; other columns are ignored;
    an empty table gives an empty result.  Text is read once and never shuffled.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    firsts = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"))).withColumnRenamed("node", "fp")
    placed = cut(firsts.join(roots.hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(names.hint("merge"), "root").select("fp", "component_id")
    return rows.join(named.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The document with the smallest ``doc_id`` of each near-duplicate group, all columns kept.

    Of rows that repeat that id all stay; rows with a null id are kept as they can't be named.
    """
    marked = near_duplicates(docs)
    gone = marked.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")
