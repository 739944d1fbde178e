"""Lempel-Ziv phrase fingerprints: documents that compress alike have like fingerprints.

A text is parsed into LZ78 phrases: each phrase is the longest one already known followed
by one more character.  The XXH64 values of the phrase set are cut into BINS bins by their
top bits, and the least value of each bin makes the signature (one-permutation minimum
hashing; an empty bin takes the value of the next one that is not).  The likeness of two
fingerprints is the share of equal bins, which estimates the overlap of the phrase sets.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import ship

BINS = 128
#: Bits kept of each bin's least value.
BITS = 16
ROWS_OUT = 2_000
EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)).astype(np.uint64)
SHIFT = np.uint64(64 - BINS.bit_length() + 1)


@dataclass
class Parsed:
    """A text with the ends of its phrases and the phrases' hashes, in order."""

    text: str
    ends: list[int]
    hashes: np.ndarray
    signature: np.ndarray | None


def phrases(text: str, at: int = 0, known: set[str] | None = None) -> tuple[list[str], list[int]]:
    """Phrases from position ``at`` on, and their ends; ``known`` holds the phrases before it.

    The dictionary holds every prefix of what it holds, so the longest known phrase is
    looked for upwards or downwards from the length of the one before.  A last phrase that
    the text's end cuts short is known already and adds nothing.
    """
    known = set() if known is None else known
    out, ends = [], []
    n, length = len(text), 0
    while at < n:
        if text[at : at + length] in known or not length:
            while at + length < n and text[at : at + length + 1] in known:
                length += 1
        else:
            length -= 1
            while length and text[at : at + length] not in known:
                length -= 1
        end = at + length + 1
        if end > n:
            break
        phrase = text[at:end]
        known.add(phrase)
        out.append(phrase)
        ends.append(end)
        at = end
    return out, ends


def _hashes(parts: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p) for p in parts], dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray | None:
    """The least value of each bin as 16 bits; None for an empty set."""
    if not len(hashes):
        return None
    ordered = np.sort(hashes)
    first = np.searchsorted(ordered, EDGES)
    inside = np.minimum(first, len(ordered) - 1)
    values = ordered[inside]
    full = (first < len(ordered)) & (values >> SHIFT == np.arange(BINS, dtype=np.uint64))
    out = (values >> np.uint64(BITS + 8) & np.uint64((1 << BITS) - 1)).astype(">u2")
    if not full.all():
        filled = np.flatnonzero(full)
        after = filled[np.searchsorted(filled, np.arange(BINS)) % len(filled)]
        out = out[after]
    return out


def text_of(sig: np.ndarray | None) -> str:
    """Lowercase hex of a signature; that of an empty text is all zeros."""
    return "0" * (BINS * BITS // 4) if sig is None else sig.tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal bins; two empty signatures are alike, an empty and a full one are not."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.count_nonzero(a == b)) / BINS


def parse(text: str) -> Parsed:
    parts, ends = phrases(text)
    hashes = _hashes(parts)
    return Parsed(text, ends, hashes, signature(hashes))


def edited(own: Parsed, other: str) -> tuple[str, np.ndarray | None]:
    """The text with its last third replaced by the start of ``other``, and its signature.

    The parse goes on from the last phrase that lies wholly in what is kept.
    """
    n = len(own.text)
    tail = n // 3
    text = own.text[: n - tail] + other[:tail]
    k = bisect.bisect_right(own.ends, n - tail)
    at = own.ends[k - 1] if k else 0
    starts = [0, *own.ends[: max(k - 1, 0)]]
    known = {own.text[s:e] for s, e in zip(starts, own.ends[:k], strict=False)}
    fresh, _ = phrases(text, at, known)
    return text, signature(np.concatenate([own.hashes[:k], _hashes(fresh)]))


def _finish(doc_id: object, own: Parsed, after: Parsed) -> tuple:
    text, sig = edited(own, after.text)
    return (
        doc_id,
        len(own.text),
        hashlib.sha256(text.encode()).hexdigest(),
        text_of(own.signature),
        text_of(sig),
        likeness(own.signature, sig),
        likeness(own.signature, after.signature),
    )


FIELDS = [
    ("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.string(), "string"),
    ("edited_fingerprint", pa.string(), "string"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"),
]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket in order, a copy of the next bucket's first row last."""
    rows: list[tuple] = []
    held: tuple | None = None
    schema = None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, t) for c, t in zip(columns, [schema, *(t for _, t, _ in FIELDS)], strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(n for n, _, _ in FIELDS)])

    for batch in batches:
        schema = batch.schema.field("doc_id").type
        for doc_id, text, copy in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "copy")), strict=True):
            if held is None and copy.as_py():
                continue  # further copies, of rows that repeat an id
            now = parse(text.as_py())
            if held is not None:
                rows.append(_finish(held[0], held[1], now))
                if len(rows) >= ROWS_OUT:
                    yield flush()
            held = None if copy.as_py() else (doc_id.as_py(), now)
    if rows:
        yield flush()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, length, fingerprint, the edited text's hash and fingerprint, two likenesses.

    The edited text has its last third replaced by as much of the start of the next
    document in descending order of id (after the last comes the first); null ids come last
    and rows with the same id are in the order of their text's hash, then text.  Null counts as
    the empty text, whose fingerprint is all zeros.  A single document is its own next.  Other
    columns are ignored; an empty table gives an empty result.

    Ids are cut into ranges at their percentiles; an id that fills several of them is cut
    further by the hash.  The first row of each range is found beforehand, in a pass that
    keeps ids and hashes only, and a copy of it travels with the range before.  So texts are
    shuffled once, and nothing is collected but bounds and first rows, two for each shuffle
    partition at most.  Only rows alike in id and text can't be told apart and stay together.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    least = F.lit(-(1 << 63)).cast("long")
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), least).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit((k + 1) / parts) for k in range(parts)])
    bounds = keyed.agg(F.percentile_approx("key", shares, F.lit(max(10_000, 20 * parts))).alias("b")).first()["b"]
    if not bounds:
        return spark.createDataFrame([], f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, _, t in FIELDS))
    # Ranges from the highest on, each with its highest id and how many percentiles that id fills.
    tops, filled = np.unique(np.array(bounds, dtype=np.int64), return_counts=True)
    widths = np.where(filled > 1, filled + 1, 1)
    starts = widths[::-1].cumsum()[::-1] - widths

    def place(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(tops, key), len(tops) - 1)
        order = mark.view(np.uint64) ^ np.uint64(1 << 63)  # as signed numbers are ordered
        piece = ((order >> np.uint64(32)) * filled[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        inner = np.where(key == tops[at], piece, filled[at])
        return starts[at] + np.where(filled[at] > 1, inner, 0)

    @F.pandas_udf("long")
    def bucket_of(key: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series(place(key.to_numpy(dtype=np.int64), mark.to_numpy(dtype=np.int64)))

    marked = keyed.select("key", "hash").withColumn("bucket", bucket_of("key", "hash"))
    first = F.min(F.struct(F.bitwise_not("key").alias("rank"), "hash")).alias("f")
    heads = {r["bucket"]: (~r["f"]["rank"], r["f"]["hash"]) for r in marked.groupBy("bucket").agg(first).collect()}
    present = sorted(heads)
    before = dict(zip(present, [present[-1], *present[:-1]], strict=True))

    @F.pandas_udf("bucket long, to long")
    def dealt_to(key: pd.Series, mark: pd.Series) -> pd.DataFrame:
        keys, marks = key.to_numpy(dtype=np.int64), mark.to_numpy(dtype=np.int64)
        at = place(keys, marks)
        to = np.full(len(at), -1, dtype=np.int64)
        for b in np.unique(at):
            top, least_mark = heads[int(b)]
            to[(at == b) & (keys == top) & (marks == least_mark)] = before[int(b)]
        return pd.DataFrame({"bucket": at, "to": to})

    own = F.struct(F.col("p.bucket").alias("bucket"), F.lit(0).alias("copy"))
    copied = F.struct(F.col("p.to").alias("bucket"), F.lit(1).alias("copy"))
    dealt = (
        keyed.withColumn("p", dealt_to("key", "hash"))
        .withColumn("at", F.explode(F.when(F.col("p.to") >= 0, F.array(own, copied)).otherwise(F.array(own))))
        .select("doc_id", "key", "hash", "text", "at.bucket", "at.copy")
    )
    ordered = dealt.repartitionById(int(widths.sum()), F.col("bucket").cast("int")).sortWithinPartitions(
        "bucket", "copy", F.desc("key"), "hash", "text"
    )
    return ordered.select("doc_id", "text", "copy").mapInArrow(
        _walk, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, _, t in FIELDS)
    )
