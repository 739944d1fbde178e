"""A Merkle manifest of a table: leaves, one tree a group, a root over the groups, and proofs.

A node is known by its group, level and index.  Each digest is an event for its parent: the parent keeps
its children's digests by index until it has as many as the size of its tree says (two, at the right edge perhaps
one), then becomes a digest itself and an event one level up.  This is a combine by key:

1. Each task feeds the leaves it holds, in any order, and emits those ancestors it can finish that
   stand at the level of a block or above, and its frontier: nodes whose parents wait for children elsewhere.
2. Frontiers are reshuffled by spans of leaves and fed again.  A span is finished but for its own root,
   so each round, with spans 64 times as long, leaves one node a span, until each group has one.
3. The nodes emitted link back from parents to children: each block of leaves looks up the siblings on its
   way to the root by key.  With them, the task that holds a block, 4,096 leaves or fewer, makes the proofs of its leaves.

The groups' roots, in order, are the leaves of one more tree, built by the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bounded_broadcast, cut, ordinals, ship

#: Levels below a block's root; how many more levels a span has in each round.
BLOCK, FAN = 12, 6
#: Where this divides the checksum of its id, a document of the query is tampered with.
TAMPER = 7

_NODES = pa.schema([("g", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string()), ("open", pa.bool_())])
#: A sibling on the way up: its digest (null in a run of one node) and whether it stands on the right.
PROOF = "array<struct<right:boolean,digest:string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Lower-case hexadecimal SHA-256 of the columns' values one after the other: byte count, `:`, value, or `-` for a null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def parent(children: Sequence[str]) -> str:
    """Digest of a run of digests, as hexadecimal text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Absorber:
    """Partial parents of the trees a task sees; ``feed`` takes a node and yields it and the ancestors it finishes."""

    def __init__(self) -> None:
        self.waiting: dict[tuple, dict[int, str]] = {}

    def feed(self, group: str | None, size: int, level: int, at: int, digest: str) -> Iterator[tuple]:
        width = -(-size >> level)
        while True:
            yield group, size, level, at, digest
            if width == 1:
                return
            key = group, size, level + 1, at >> 1
            held = self.waiting.setdefault(key, {})
            held[at] = digest
            if len(held) < min(2, width - (at & ~1)):
                return
            del self.waiting[key]
            level, at, width = level + 1, at >> 1, (width + 1) >> 1
            digest = parent([held[i] for i in sorted(held)])

    def frontier(self) -> Iterator[tuple]:
        for (group, size, level, _), held in self.waiting.items():
            for at, digest in held.items():
                yield group, size, level - 1, at, digest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NODES.types, strict=True)], schema=_NODES)


def _absorb(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the nodes at ``block`` or above and the roots that a task's events finish, and its frontier (``open``)."""

    def absorb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = Absorber(), []
        for batch in batches:
            for event in zip(*(batch.column(c).to_pylist() for c in ("g", "size", "level", "at", "digest")), strict=True):
                out += [(*node, False) for node in held.feed(*event) if node[2] >= block or node[1] <= 1 << node[2]]
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        out += [(*node, True) for node in held.frontier()]
        if out:
            yield _batch(out)

    return absorb


def nodes(leaves: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``(g, size, level, at, digest)``: the nodes at level ``block`` or above, and the root, of each group's tree, each once.

    ``leaves`` has the group g, size (the group's leaves), at (a leaf's place from 0, none missing) and digest.
    """
    ship(leaves.sparkSession)
    schema = "g string, size long, level int, at long, digest string, open boolean"
    met = cut(leaves.select("g", "size", F.lit(0).alias("level"), "at", "digest").mapInArrow(_absorb(block), schema))
    every, span = met.filter("NOT open"), block
    while not (frontier := met.filter("open").drop("open")).isEmpty():
        span += fan
        dealt = frontier.repartition(F.col("g"), F.expr(f"shiftright(shiftleft(at, level), {span})"))
        met = cut(dealt.mapInArrow(_absorb(block), schema))
        every = every.unionAll(met.filter("NOT open"))
    return cut(every.drop("open").distinct())


def roots(tree: DataFrame) -> DataFrame:
    """``(g, digest)``: the root of each group's tree."""
    return tree.filter("size <= shiftleft(1L, level)").select("g", "digest")


def block_paths(sizes: DataFrame, tree: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(g, block, path)``: the siblings, bottom first, on the way from the root of each block of leaves to its group's root.

    ``sizes`` has g and size, a row a group.
    """
    last = F.expr(f"shiftright(size - 1, {block})")
    blocks = sizes.select("g", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    ups = F.when(F.col("last") > 0, F.sequence(F.lit(0), F.length(F.bin("last")) - 1))  # as many levels as the last block's number has bits
    steps = blocks.select("g", "block", F.explode_outer(ups).alias("up"))
    asked = steps.select(
        "g", "block", (F.col("up") + block).alias("level"), F.expr("shiftright(block, up) ^ 1L").alias("at"), F.expr("shiftright(block, up) % 2 = 0").alias("right")
    )
    told = tree.select(F.col("g").alias("g_"), F.col("level").alias("level_"), F.col("at").alias("at_"), "digest")
    met = asked.join(told, F.col("g").eqNullSafe(F.col("g_")) & (F.col("level") == F.col("level_")) & (F.col("at") == F.col("at_")), "left")
    step = F.when(F.col("level").isNotNull(), F.struct("level", "right", "digest"))
    listed = met.groupBy("g", "block").agg(F.sort_array(F.collect_list(step)).alias("path"))
    return listed.withColumn("path", F.transform("path", lambda s: F.struct(s["right"].alias("right"), s["digest"].alias("digest"))))


def block_proofs(digests: dict[int, str], size: int, block: int) -> Iterator[tuple[int, list[tuple]]]:
    """(place, siblings up to the block's root, bottom first) of the leaves of one block, given by place."""
    now, width, levels = digests, size, []
    for _ in range(block):
        if width == 1:
            break
        levels.append(now)
        now = {at >> 1: parent([now[i] for i in (at & ~1, at | 1) if i in now]) for at in now if at % 2 == 0}
        width = (width + 1) >> 1
    for at in digests:
        yield at, [(at >> up & 1 == 0, level.get(at >> up ^ 1)) for up, level in enumerate(levels)]


def fold(digest: str, proof: Sequence[tuple]) -> str:
    """The root to which a leaf and its siblings lead."""
    for right, beside in proof:
        digest = parent([digest] if beside is None else [digest, beside] if right else [beside, digest])
    return digest


def prove(leaves: DataFrame, paths: DataFrame, keep: Sequence[str], finish: Callable, made: str, block: int = BLOCK) -> DataFrame:
    """For each of ``leaves`` its columns ``keep`` and what ``finish`` makes of (row, proof), columns ``made``.

    ``paths`` has g, block and path; a task holds one block of leaves at a time.
    """
    ship(leaves.sparkSession)
    kinds = ", ".join(f"{c} {leaves.schema[c].dataType.simpleString()}" for c in keep)
    names = [c.split()[0] for c in made.split(", ")]

    def work(own: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        above = [(s["right"], s["digest"]) for s in way["path"].iloc[0]]
        found = dict(block_proofs(dict(zip(own["at"], own["digest"], strict=True)), int(own["size"].iloc[0]), block))
        rows = [finish(row, [*found[row.at], *above]) for row in own.itertuples()]
        return pd.concat([own[list(keep)].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    blocks = leaves.withColumn("block", F.shiftright("at", block))
    return blocks.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInPandas(work, f"{kinds}, {made}")


def _listed(row, proof: list[tuple]) -> tuple:
    return ([{"right": right, "digest": beside} for right, beside in proof],)


def _checked(row, proof: list[tuple]) -> tuple:
    beside = "".join(d for _, d in proof if d is not None)
    return hashlib.sha256(beside.encode()).hexdigest(), fold(row.other or row.digest, proof)


def placed(leaves: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with ``at``, the place in its group ``g`` by ``order`` (nulls first), and ``size``; and ``(g, size)`` of the groups."""
    numbered = ordinals(leaves, [F.col(c).asc_nulls_first() for c in order], "at", ["g"])
    sizes = cut(leaves.groupBy("g").agg(F.count(F.lit(1)).alias("size")))
    told = bounded_broadcast(sizes.withColumnRenamed("g", "g_"))
    return cut(numbered.join(told, F.col("g").eqNullSafe(F.col("g_"))).drop("g_")), sizes


def manifest(leaves: DataFrame, keep: Sequence[str], finish: Callable = _listed, made: str = f"proof {PROOF}", block: int = BLOCK) -> DataFrame:
    """``keep``, g, leaf, subroot, root and a proof of each row of ``leaves``, a written table with g, id and digest among its columns.

    Leaves are ordered by id (nulls first), then digest, in their group g; groups by g (null first).  While more than one node
    remains, every two consecutive ones become one, a last one alone too.  ``proof`` lists the siblings up to the root;
    ``finish`` and ``made`` can make other columns of it.  Rows that repeat wholly get any order among themselves, which changes
    no digest but decides who has which proof.  No rows give no rows.
    """
    own, sizes = placed(leaves, ["id", "digest"])
    tree = nodes(own, block)
    tops = cut(roots(tree).select(F.lit("").alias("g"), F.col("g").alias("id"), "digest"))
    top, top_size = placed(tops, ["id"])
    crown = nodes(top, block)
    ways = prove(top, cut(block_paths(top_size, crown, block)), ["id", "digest"], _listed, f"proof {PROOF}", block)
    root = next((row["digest"] for row in roots(crown).take(1)), None)
    over = ways.select(F.col("id").alias("g_"), F.col("digest").alias("subroot"), F.col("proof").alias("over"), F.lit(root).cast("string").alias("root"))
    over = bounded_broadcast(cut(over))
    paths = cut(block_paths(sizes, tree, block).join(over, F.col("g").eqNullSafe(F.col("g_"))).select("g", "block", F.concat("path", "over").alias("path")))
    proved = prove(own, paths, [*keep, "g", "digest"], finish, made, block)
    return proved.join(over.drop("over"), F.col("g").eqNullSafe(F.col("g_"))).drop("g_").withColumnRenamed("digest", "leaf")


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows: a leaf for each document, by language, with its proof against a copy in which some documents are tampered with.

    A document with a null id, or a null or largest n_chars, can't be tampered with.
    """
    columns = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    more = F.try_add(F.col("n_chars"), F.lit(1))
    hit = more.isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0)
    leaves = cut(
        docs.select(
            F.col("doc_id").alias("id"), F.col("lang").alias("g"), leaf_digest(columns(F.col("n_chars"))).alias("digest"), F.when(hit, leaf_digest(columns(more))).alias("other")
        )
    )
    rows = manifest(leaves, ["id"], _checked, "proof_sha256 string, folded_root string")
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
