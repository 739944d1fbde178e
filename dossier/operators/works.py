"""Publication works: exact and fuzzy canonicalisation, title overlap."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.names import unused
from dossier.functions.text import first_year, is_publication, normalize_doi, normalized_title, split_entries
from dossier.operators.graph import components, cut, ship

# Which source's record stands for a work, and how alike titles must be.
PRIORITY = {"official": 4, "openalex": 3, "zbmath": 2, "arxiv": 1}
RATIO = 0.94
LEAST_TITLE = 12
HUNDREDTHS = round(100 * RATIO)
#: Letters of a run.  Of a window, some runs in a row, the run of the least hash is a mark.
RUN = 14
#: By the least length of a title: the letters of a window.  A title whose matches must hold windows is looked for by its marks.
LEVELS = ((200, 15), (300, 17), (400, 20), (600, 23), (1_200, 28), (2_400, 35), (4_000, 40), (8_000, 44))
#: From which length of the second key ``SequenceMatcher`` leaves out frequent letters.
AUTOJUNK = 200
#: Lengths of letter runs by which titles that can't be alike are told apart, and counters of letters.
RUNS = (2, 4, 6)
LETTERS = 40
#: About how many titles that others are compared with by letters meet in a task.
SHARE = 20_000
COUNTS = [f"c{i}" for i in range(LETTERS)]
#: Titles of which marks or lengths leave a Python worker at once, and the most of which ids are broadcast.
PIECE = 1_000
MOST_NAMED = 1_000_000
_BASE = 0xD1342543DE82EF95
_WHOLE = (1 << 64) - 1
#: Words of a title under which it is looked for.
RUN_WORDS = 3


def official_works(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each entry of a list that reads like a publication, with year and DOI."""
    entries = rows.select(id_col, F.posexplode(split_entries(F.col(text_col))).alias("entry_no", "title"))
    kept = entries.filter(is_publication(F.col("title")))
    return kept.withColumns({"year": first_year(F.col("title")), "doi": normalize_doi(F.col("title"))})


def exact_works(rows: DataFrame, key: Column, order: Column, measures: dict[str, Column]) -> DataFrame:
    """Works by an exact key: the first record by ``order`` and roll-ups over all."""
    return rows.groupBy(key.alias("work_key")).agg(F.min(order).alias("first_record"), *[m.alias(n) for n, m in measures.items()])


def _same(a: str, b: str, i: int, j: int, most: int, step: int) -> int:
    """How many letters, ``most`` at the utmost, are equal from places i and j on, or before them if ``step`` is -1."""
    done, size = 0, 16
    while done < most:
        size = min(size, most - done)
        x, y = (i + done, j + done) if step > 0 else (i - done - size, j - done - size)
        if a[x : x + size] == b[y : y + size]:
            done += size
            size *= 2
        elif size == 1:
            break
        else:
            size //= 2
    return done


def _finder(a: str, b: str) -> Callable[[int, int, int, int], tuple[int, int, int]]:
    """``find_longest_match`` of ``SequenceMatcher``.  For a second key with frequent letters only the others are visited.

    That is the first place of the longest run of rare letters in both keys, continued by equal letters on both sides.
    """
    if len(b) < AUTOJUNK:
        return SequenceMatcher(None, a, b).find_longest_match
    one, two = _codes(a), _codes(b)
    rare = np.zeros(max(int(one.max(initial=0)), int(two.max())) + 1, dtype=bool)
    at = _rare(two)
    rare[two[at]] = True
    starts, others = np.flatnonzero(rare[one]).tolist(), at.tolist()
    runs: list[tuple[list[int], dict[str, list[int]]]] = []  # by length: places in a, and those in b of each run
    while starts and others:
        places: dict[str, list[int]] = {}
        n = len(runs) + 1
        for j in others:
            places.setdefault(b[j : j + n], []).append(j)
        starts = [i for i in starts if a[i : i + n] in places]
        runs.append((starts, places))
        starts, others = ([i for i, k in zip(found, found[1:], strict=False) if k == i + 1] for found in (starts, others))

    def find(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        i, j, k = alo, blo, 0
        for n in range(len(runs), 0, -1):
            starts, places = runs[n - 1]
            for at in range(bisect_left(starts, alo), bisect_right(starts, ahi - n)):
                found = places[a[starts[at] : starts[at] + n]]
                first = bisect_left(found, blo)
                if first < len(found) and found[first] <= bhi - n:
                    i, j, k = starts[at], found[first], n
                    break
            if k:
                back = _same(a, b, i, j, min(i - alo, j - blo), -1)
                i, j, k = i - back, j - back, k + back
                break
        return i, j, k + _same(a, b, i + k, j + k, min(ahi - i, bhi - j) - k, 1)

    return find


def alike_titles(a: str, b: str) -> bool:
    """Whether ``SequenceMatcher`` gives two titles a ratio of ``RATIO``: its blocks, the largest places first, until that is settled."""
    find, least = _finder(a, b), _least(len(a) + len(b))
    matched, left = 0, min(len(a), len(b))
    places = [(-left, 0, len(a), 0, len(b))]
    while places and matched < least <= matched + left:
        size, alo, ahi, blo, bhi = heappop(places)
        left += size
        i, j, k = find(alo, ahi, blo, bhi)
        matched += k
        for place in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if k else ():
            if (size := min(place[1] - place[0], place[3] - place[2])) > 0:
                heappush(places, (-size, *place))
                left += size
    return matched >= least


def same_work(a: dict, b: dict) -> bool:
    """Whether two records are one work; the first test that applies decides.

    DOIs, then arXiv ids, then ids of one source; else titles of 12 letters or more, years
    at most one apart, and equal titles (authors shared, or missing on a side) or alike
    ones with a shared author.
    """
    for key in ("doi", "arxiv_id"):
        if a[key] and b[key]:
            return a[key] == b[key]
    if a["source"] == b["source"] and a["source_id"] and b["source_id"]:
        return a["source_id"] == b["source_id"]
    if min(len(a["title_key"]), len(b["title_key"])) < LEAST_TITLE:
        return False
    if pd.notna(a["year"]) and pd.notna(b["year"]) and abs(a["year"] - b["year"]) > 1:
        return False
    one, two = set(a["author_keys"]), set(b["author_keys"])
    shared = bool(one & two)
    if a["title_key"] == b["title_key"]:
        return shared or not one or not two
    return shared and alike_titles(a["title_key"], b["title_key"])


def _least(total: np.ndarray | int) -> np.ndarray | int:
    """The letters that must match for keys of so many letters in all to reach the ratio."""
    return -(-total * HUNDREDTHS // 200)


def _range(n: int) -> tuple[int, int]:
    """The least and the greatest length of keys that can be alike with one of ``n`` letters."""
    return -(-n * HUNDREDTHS // (200 - HUNDREDTHS)), n * (200 - HUNDREDTHS) // HUNDREDTHS


def _level(n: int) -> int:
    """The place in ``LEVELS`` of a key of ``n`` letters, -1 for a short one."""
    return sum(n >= least for least, _ in LEVELS) - 1


def _covered(between: list[int], most: int) -> int:
    """The most letters that matching blocks of at most ``most`` letters cover, by the letters before, between and after the rare ones.

    Each block holds a rare letter but one, that at the beginning of both keys.
    """
    covered = min(between[0], most)
    bare = between[0] - covered
    for after in between[1:]:
        left = min(bare, most - 1)
        right = min(after, most - 1 - left)
        covered += 1 + left + right
        bare = after - right
    return covered


def _rare(codes: np.ndarray) -> np.ndarray:
    """Where the letters are that start a block if the key comes second and has 200 letters or more."""
    return np.flatnonzero(np.bincount(codes)[codes] <= len(codes) // 100 + 1)


def _shared(codes: np.ndarray) -> int:
    """How many windows of its level a key, which comes second, has in common with the shortest key alike; none if not above 0.

    In a second key of 200 letters or more ``SequenceMatcher`` starts blocks only at letters that make up no
    more than a hundredth of it and one.  What blocks a letter shorter than a window can't cover, of the
    letters that must match, longer blocks do, and each letter more is a window more.  So a longer key shares as many windows
    more as more letters must match.
    """
    n = len(codes)
    if _level(n) < 0:
        return -n
    between = np.diff(np.concatenate([[-1], _rare(codes), [n]])) - 1
    return int(_least(n + _range(n)[0])) - _covered(between.tolist(), LEVELS[_level(n)][1] - 1)


def _codes(key: str) -> np.ndarray:
    return np.frombuffer(key.encode("utf-32-le"), dtype=np.uint32)


def _letters(codes: np.ndarray) -> np.ndarray:
    """How often letters occur: a to z, digits, and all others in four counters."""
    times = np.bincount(codes)
    found = np.flatnonzero(times)
    at = np.where(found >= 128, 36 + found % 4, np.where(found >= 97, found - 97, found - 22)) % LETTERS
    return np.bincount(at, weights=times[found], minlength=LETTERS).astype(np.int64)


def _runs(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of ``q`` letters, put together from those of runs of powers of two."""
    n = len(codes)
    if n < q:
        return np.zeros(0, dtype=np.uint64)
    part = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    runs, have, size = np.zeros(n + 1, dtype=np.uint64), 0, 1
    part ^= part >> np.uint64(29)
    while True:
        if q & size:
            runs = runs[: n - have - size + 1] * np.uint64(pow(_BASE, size, 1 << 64)) + part[have:]
            have += size
        if have == q:
            break
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return runs ^ (runs >> np.uint64(29))


def _marks(runs: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each window of ``w`` runs in a row, and of how many windows it is the least."""
    least, have = runs, 1
    while have < w and len(least):
        step = min(have, w - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    if not len(least):
        return least, np.zeros(0, dtype=np.int32)
    at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    marks, which = np.unique(least[at], return_inverse=True)
    return marks, np.bincount(which, weights=np.diff(np.append(at, len(least)))).astype(np.int32)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), PIECE):
            yield pdf.iloc[at : at + PIECE].copy()


def _sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kinds with the length and letters of their title, and the windows that alike ones share with it."""
    for pdf in _pieces(batches):
        codes = [_codes(key) for key in pdf["title_key"]]
        pdf["n"] = [len(c) for c in codes]
        pdf["need"] = [_shared(c) for c in codes]
        yield pd.concat([pdf, pd.DataFrame([_letters(c) for c in codes], columns=COUNTS, index=pdf.index)], axis=1)


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks by which kinds are found, for each author, and of how many windows that they look for others by; 0 if they don't by that mark.

    The shorter a window, the more runs are marks, those of longer windows among them.  So a title is found by the marks of the
    level of the shortest title that may be alike, and looks by those of its own.
    """
    for pdf in _pieces(batches):
        hashes, nodes, windows = [], [], []
        for row in pdf.itertuples():
            low, high = _range(row.n)
            if _level(high) < 0:
                continue
            runs = _runs(_codes(row.title_key).astype(np.uint64), RUN)
            first, own = (LEVELS[max(0, _level(n))][1] - RUN + 1 for n in (low, row.n))
            marks, asked = _marks(runs, first)
            if row.need + _least(row.n + high) - _least(row.n + low) <= 0:
                asked = np.zeros(len(marks), dtype=np.int32)
            elif own != first:
                some, counts = _marks(runs, own)
                asked = np.zeros(len(marks), dtype=np.int32)
                asked[np.searchsorted(marks, some)] = counts
            for by, node in zip(row.bys, row.nodes, strict=True):
                # 40 bits tell marks apart well enough: those that are taken for one another only add to what is shared.
                hashes.append(((marks ^ np.uint64(int(by) & _WHOLE)) * np.uint64(_BASE)) >> np.uint64(24))
                nodes.append(np.full(len(marks), node, dtype=np.int64))
                windows.append(asked)
        if hashes:
            yield pd.DataFrame({"h": np.concatenate(hashes).view(np.int64), "node": np.concatenate(nodes), "windows": np.concatenate(windows)})


def _common(one: np.ndarray, two: np.ndarray) -> int:
    """How many of the values two keys have in common, repeats counted."""
    x, m = np.unique(one, return_counts=True)
    y, n = np.unique(two, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


def _may_be_alike(a: str, b: str) -> bool:
    """Whether common runs allow the ratio; runs are counted by hashes, which can only overstate them.

    All runs of q letters in K blocks of M letters are common, but for q - 1 at the end of each block.  Blocks
    of a second key of 200 letters or more hold a rare letter each but the first.  Of any keys they are a common
    subsequence, broken at each letter left over, so G common runs allow M <= (G + (q - 1) (1 + total)) / (2 q - 1).
    """
    one, two, total = _codes(a).astype(np.uint64), _codes(b).astype(np.uint64), len(a) + len(b)
    least = _least(total)
    if len(b) >= AUTOJUNK:
        blocks = 1 + _common(one, two[_rare(two)])
        q = max(2, min(64, least // (2 * blocks)))
        return _common(_runs(one, q), _runs(two, q)) >= least - (q - 1) * blocks
    return all((_common(_runs(one, q), _runs(two, q)) + (q - 1) * (1 + total)) // (2 * q - 1) >= least for q in RUNS)


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ordered pairs of kinds that ``same_work`` links, of rows with both kinds' columns."""
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            x, y = row["x"], row["y"]
            if x["title_key"] != y["title_key"]:
                for a, b in ((x, y), (y, x)):
                    if (len(b["title_key"]) >= AUTOJUNK or _may_be_alike(a["title_key"], b["title_key"])) and same_work(a, b):
                        out.append((a["kind"], b["kind"]))
        yield pd.DataFrame(out, columns=["a", "b"])


def _beside(rest: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a title that need not share windows with one of its author's whose length and letters allow the ratio."""
    others = others.sort_values(["author", "n"])
    author, n, year, kind = (others[c].to_numpy() for c in ("author", "n", "year", "kind"))
    counts = others[COUNTS].to_numpy(np.int32)
    one, two = [], []
    for row, own in zip(rest[["author", "kind", "n", "year", "need"]].itertuples(index=False), rest[COUNTS].to_numpy(np.int32), strict=True):
        start, end = np.searchsorted(author, [row.author, row.author + 1]) if row.author < _WHOLE >> 1 else (np.searchsorted(author, row.author), len(author))
        low, high = _range(row.n)
        # The greatest length with which no window need be shared.
        high = min(high, 200 * (int(_least(row.n + low)) - row.need) // HUNDREDTHS - row.n)
        first, last = start + np.searchsorted(n[start:end], low), start + np.searchsorted(n[start:end], high, side="right")
        if first < last:
            common = np.minimum(counts[first:last], own).sum(axis=1)
            near = (common * 200 >= (row.n + n[first:last]) * HUNDREDTHS) & ~(np.abs(year[first:last] - row.year) > 1) & (kind[first:last] != row.kind)
            two.append(kind[first:last][near])
            one += [row.kind] * len(two[-1])
    return pd.DataFrame({"kind": one, "kind_2": np.concatenate(two) if two else []})


def _equal(brief: DataFrame) -> DataFrame:
    """Ordered pairs of kinds that ``same_work`` links within the blocks ``key``, where titles, given by digests, are equal or don't count."""
    own = [c for c in brief.columns if c != "key"]
    two = brief.toDF(*[c if c == "key" else f"{c}_2" for c in brief.columns])

    def both(c: str) -> Column:
        return (F.col(c) != "") & (F.col(f"{c}_2") != "")

    def same(c: str) -> Column:
        return F.col(c) == F.col(f"{c}_2")

    authors = F.arrays_overlap("author_keys", "author_keys_2") | (F.size("author_keys") == 0) | (F.size("author_keys_2") == 0)
    close = F.coalesce(F.abs(F.col("year") - F.col("year_2")) <= 1, F.lit(True))
    linked = F.when(both("doi"), same("doi")).when(both("arxiv_id"), same("arxiv_id"))
    linked = linked.when(same("source") & both("source_id"), same("source_id")).otherwise(F.startswith("key", F.lit("t:")) & same("title_key") & close & authors)
    pairs = brief.select("key", *own).join(two.hint("merge"), "key").filter((F.col("kind") < F.col("kind_2")) & linked)
    return pairs.select(F.explode(F.array(F.struct(F.col("kind").alias("a"), F.col("kind_2").alias("b")), F.struct(F.col("kind_2").alias("a"), F.col("kind").alias("b")))).alias("p")).select("p.*")


def _candidates(kinds: DataFrame) -> DataFrame:
    """Pairs ``(x, y)`` of kinds that share an author and whose titles may be alike; all that are alike are among them.

    A title looks for others by the marks of its level, which must stand for as many windows as are shared with a title of the
    other's length (``_shared``); where none need be, as by a short one or one with many rare letters, it is compared with all of its
    authors' titles of such lengths.
    """
    sizes = kinds.select("kind", "author_keys", "n", "year", "need", *COUNTS)

    def other(df: DataFrame) -> DataFrame:
        return df.toDF(*[f"{c}_2" for c in df.columns])

    def must(total: Column) -> Column:
        return F.floor((total * HUNDREDTHS + 199) / 200).cast("int")

    near = F.greatest("n", "n_2") * HUNDREDTHS <= F.least("n", "n_2") * (200 - HUNDREDTHS)
    # In place of a sum of so many columns, which would be a method too long to be compiled.
    least = F.zip_with(F.array(*COUNTS), F.array(*[f"{c}_2" for c in COUNTS]), lambda x, y: F.least(x, y))
    common = F.aggregate(least, F.lit(0), lambda x, y: x + y)
    alike = near & (common * 200 >= (F.col("n") + F.col("n_2")) * HUNDREDTHS) & F.coalesce(F.abs(F.col("year") - F.col("year_2")) <= 1, F.lit(True))
    shortest = F.ceil(F.col("n") * HUNDREDTHS / (200 - HUNDREDTHS)).cast("int")
    # Windows that the first title, which comes second in the matcher, shares with the other if they are alike.
    needed = F.col("need") + must(F.col("n") + F.col("n_2")) - must(F.col("n") + shortest)
    pair = [F.least("kind", "kind_2").alias("x"), F.greatest("kind", "kind_2").alias("y")]

    by = F.transform("author_keys", lambda v: F.xxhash64(v))
    node = F.transform("author_keys", lambda v: F.xxhash64("kind", v))
    marks = kinds.select("n", "need", "title_key", by.alias("bys"), node.alias("nodes")).mapInPandas(_marked, "h long, node long, windows int")
    every = Window.partitionBy("h")
    shared = marks.withColumns({"met": F.count(F.lit(1)).over(every), "asked": F.max("windows").over(every)}).filter("met > 1 AND asked > 0")
    nodes = kinds.select(F.explode(node).alias("node"), "kind", "n", "need")
    # A title that shares more windows than the most frequent marks stand for shares one of another mark, so by those it looks
    # only for titles with which it shares no more.  What they stand for may be shared as well.
    frequent = Window.partitionBy("node", "kind").orderBy(F.col("met").desc(), "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = cut(shared.drop("asked").join(nodes.hint("merge"), "node").withColumn("above", F.sum("windows").over(frequent)).drop("met"))
    looking = known.filter("windows > 0 AND above >= greatest(need, 1)")
    found = other(known.select("h", "kind", "n")).hint("merge")
    meeting = looking.join(found, (F.col("h") == F.col("h_2")) & (F.col("kind") != F.col("kind_2")) & near & (needed > 0) & (needed <= F.col("above")))
    counted = meeting.groupBy("node", "kind", "kind_2").agg(
        F.sum("windows").alias("windows"), F.max(needed).alias("need"), F.min(F.col("above") - F.col("windows")).alias("left")
    )
    met = cut(counted.filter("windows + left >= need").select(*pair).distinct())
    first, second = sizes.withColumnRenamed("kind", "x"), other(sizes).withColumnRenamed("kind_2", "y")
    by_mark = met.join(first.hint("merge"), "x").join(second.hint("merge"), "y").filter(alike).select("x", "y")

    # The titles of an author are dealt over tasks, and those that look for them go to each.
    tasks = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes.withColumn("author", F.explode(by)).withColumn("year", F.col("year").cast("double"))
    shares = dealt.groupBy("author").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    dealt = dealt.join(shares.hint("merge"), "author").drop("author_keys")
    bucket = F.pmod(F.xxhash64("author", "share"), F.lit(max(tasks, dealt.count() // SHARE)))
    looking = dealt.filter("need <= 0").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("bucket", bucket)
    others = dealt.withColumn("share", F.pmod(F.xxhash64("kind"), F.col("shares")).cast("int")).withColumn("bucket", bucket)
    kind = kinds.schema["kind"].dataType.simpleString()
    beside = looking.toDF(*looking.columns).groupBy("bucket").cogroup(others.groupBy("bucket")).applyInPandas(_beside, f"kind {kind}, kind_2 {kind}")
    return cut(by_mark.unionByName(beside.select(*pair)).distinct())


def fuzzy_works(records: DataFrame) -> DataFrame:
    """``(record_id, work_id)``: each record joins the first group that has a record of the same work.

    ``records``: record_id (its order), source, source_id, doi, arxiv_id, title, year, authors.
    Records alike in all that ``same_work`` reads are one kind.  Kinds are compared within blocks of
    a shared DOI, arXiv id, source id or title key, and in the pairs of ``_candidates``, outside which no two
    records can be the same work; the ordered fold runs over the links found, one task a component.
    """
    spark = records.sparkSession
    ship(spark)
    read = ["source", "source_id", "doi", "arxiv_id", "title_key", "year", "author_keys"]
    own = records.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_id", "doi", "arxiv_id")}).withColumns(
        {
            "title_key": F.coalesce(normalized_title(F.col("title")), F.lit("")),
            "author_keys": F.array_sort(F.array_distinct(F.filter(
                F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda v: F.regexp_replace(F.lower(v), r"[^a-z0-9一-鿿]", "")),
                lambda v: v != "",
            ))),
        }
    )
    own = cut(own.select("record_id", *read, F.sha2(F.to_json(F.struct(*read)), 256).alias("digest")))
    heads = cut(own.groupBy("digest").agg(F.min("record_id").alias("kind")))
    # Copies are few as a rule, so titles need not be shuffled to leave them out.
    copies = cut(own.select("record_id", "digest").join(heads.hint("merge"), "digest").filter("record_id <> kind").select(F.col("record_id").alias("kind")))
    few = "broadcast" if copies.count() <= MOST_NAMED else "merge"
    firsts = own.withColumnRenamed("record_id", "kind").join(copies.hint(few), "kind", "left_anti").select("kind", *read)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in firsts.schema)
    kinds = cut(firsts.mapInPandas(_sized, f"{columns}, n int, need int, {', '.join(f'{c} int' for c in COUNTS)}"))
    # Whether records of the kind are one work with each other.
    itself = (F.greatest("doi", "arxiv_id", "source_id") != "") | (F.length("title_key") >= LEAST_TITLE)
    members = cut(own.select("record_id", "digest", itself.alias("itself")).join(heads, "digest").drop("digest"))

    long = F.col("n") >= LEAST_TITLE
    blocks = F.array_compact(
        F.array(
            F.when(F.col("doi") != "", F.concat(F.lit("d:"), "doi")),
            F.when(F.col("arxiv_id") != "", F.concat(F.lit("x:"), "arxiv_id")),
            F.when(F.col("source_id") != "", F.concat_ws(":", F.lit("s"), "source", "source_id")),
            F.when(long, F.concat(F.lit("t:"), F.md5("title_key"))),
        )
    )
    # Within these blocks no title is compared but with an equal one, so its digest does.
    brief = kinds.withColumn("title_key", F.md5("title_key")).select("kind", *read, F.explode(blocks).alias("key"))
    kind = records.schema["record_id"].dataType.simpleString()
    equal = _equal(brief)
    pairs = _candidates(kinds.filter(long & (F.size("author_keys") > 0)))
    # Few titles are compared, so only theirs are shuffled.
    named = pairs.select(F.explode(F.array(F.xxhash64("x"), F.xxhash64("y"))).alias("name")).distinct()
    named = cut(named)
    whole = kinds.withColumn("name", F.xxhash64("kind")).join(named.hint("broadcast" if named.count() <= MOST_NAMED else "merge"), "name", "left_semi")
    whole = cut(whole.select("kind", F.struct("kind", *read).alias("row")))
    # The pairs of a title are compared in one task, dealt by number, so that all cores have some.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = pairs.join(whole.toDF("y_kind", "two").hint("merge"), F.col("y") == F.col("y_kind")).select("x", "two").repartition(tasks, "x")
    dealt = one.join(whole.toDF("x_kind", "one").hint("merge"), F.col("x") == F.col("x_kind")).select(F.col("one").alias("x"), F.col("two").alias("y"))
    alike = dealt.mapInPandas(_alike, f"a {kind}, b {kind}")
    links = cut(equal.unionByName(alike).distinct())
    roots = cut(components(links).withColumnRenamed("node", "kind"))
    alone = members.join(roots, "kind", "left_anti").select("record_id", F.when(F.col("itself"), F.col("kind")).otherwise(F.col("record_id")).alias("work_id"))

    def fold(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        beside: dict = {}
        for a, b in zip(near["a"], near["b"], strict=True):
            beside.setdefault(a, []).append(b)
        first: dict = {}  # the first group that has a record of a kind
        out = []
        for row in rows.sort_values("record_id").itertuples():
            others = [*beside.get(row.kind, ()), *([row.kind] if row.itself else ())]
            home = min((first[k] for k in others if k in first), default=row.record_id)
            first[row.kind] = min(home, first.get(row.kind, home))
            out.append((row.record_id, home))
        return pd.DataFrame(out, columns=["record_id", "work_id"])

    rooted = links.join(roots.toDF("a", "top"), "a")
    linked = members.join(roots, "kind").groupBy("root").cogroup(rooted.groupBy("top")).applyInPandas(fold, f"record_id {kind}, work_id {kind}")
    return alone.unionByName(linked)


def roll_up(records: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a work: its main record's title and id, the latest year, its sources, whether only a preprint."""
    rank = F.lit(0)
    for name, value in PRIORITY.items():
        rank = F.when(F.col("source") == name, value).otherwise(rank)
    main = F.max(
        F.struct(
            (F.col("doi") != "").alias("a"), (~F.col("is_preprint")).alias("b"), rank.alias("c"),
            F.length("title").alias("d"), (-F.col("record_id")).alias("e"), "title", "doi", "arxiv_id", "source", "source_id",
        )
    )
    works = records.join(groups, "record_id").groupBy("work_id").agg(
        main.alias("m"), F.max("year").alias("year"), F.bool_and("is_preprint").alias("is_preprint"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("n_records"),
    )
    name = (
        F.when(F.col("m.doi") != "", F.concat(F.lit("doi:"), "m.doi"))
        .when(F.col("m.arxiv_id") != "", F.concat(F.lit("arxiv:"), "m.arxiv_id"))
        .when(F.col("m.source_id") != "", F.concat_ws(":", "m.source", "m.source_id"))
        .otherwise(F.concat(F.lit("title:"), "m.title"))
    )
    return works.select("work_id", name.alias("canonical_id"), F.col("m.title").alias("title"), "year", "is_preprint", "sources", "n_records")


def _word_runs(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words."""
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, F.lit(n))))
    )


def contained_titles(texts: DataFrame, titles: DataFrame, text_col: str, title_col: str, most_bytes: int = 32 << 20) -> DataFrame:
    """Pairs of a text and a title that it contains, as characters.

    All words of a title but the first and last are whole words of any text that contains
    it.  So a title is filed under the run of up to ``RUN_WORDS`` such words that is rarest in
    the texts, and the runs of a text fetch the few titles that are then searched in it.
    Titles of two words or fewer have no such run and are searched in every text.  Both kinds
    are broadcast in slices of about ``most_bytes``, with one pass over the texts each.
    """
    p = unused(texts, titles)
    words = F.split(F.col(title_col), r"\s+")
    own = titles.withColumn(f"{p}in", F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).filter(F.col(title_col).isNotNull())
    own = cut(own.withColumn(f"{p}n", F.least(F.size(f"{p}in"), F.lit(RUN_WORDS))))
    # Rows are told apart by their hash: equal ones fare alike, and what collides is searched all the same.
    keyed = texts.filter(F.col(text_col).isNotNull()).withColumn(f"{p}k", F.xxhash64(*texts.columns))
    pieces = keyed.select(f"{p}k", F.split(F.col(text_col), r"\s+").alias(f"{p}ws"))
    sizes = {r[f"{p}n"]: r["b"] for r in own.groupBy(f"{p}n").agg(F.sum(F.octet_length(title_col) + 64).alias("b")).collect()}  # at most RUN_WORDS + 1
    found = [texts.join(titles.limit(0), F.lit(True), "inner").limit(0)]
    for n, size in sorted(sizes.items()):
        group = own.filter(F.col(f"{p}n") == n)
        slices = max(1, math.ceil(size / most_bytes))
        for k in range(slices):
            part = group.filter(F.pmod(F.xxhash64(title_col), F.lit(slices)) == k) if slices > 1 else group
            if n == 0:
                short = F.broadcast(part.drop(f"{p}in", f"{p}n"))
                found.append(texts.join(short, F.contains(F.col(text_col), F.col(title_col))))
                continue
            runs = part.withColumn(f"{p}h", F.explode(F.array_distinct(_word_runs(F.col(f"{p}in"), n))))
            sought = F.broadcast(runs.select(f"{p}h").distinct())
            at = pieces.select(f"{p}k", f"{p}ws", F.posexplode(f"{p}ws").alias("i", "w")).filter(F.col("i") + n <= F.size(f"{p}ws"))
            run = F.xxhash64(F.concat_ws(" ", "w", *[F.get(f"{p}ws", F.col("i") + j) for j in range(1, n)]))
            hits = cut(at.select(f"{p}k", run.alias(f"{p}h")).join(sought, f"{p}h").distinct())
            counts = hits.groupBy(f"{p}h").agg(F.count(F.lit(1)).alias(f"{p}c"))
            # A run that no text has proves that no text holds the title.
            rarest = runs.join(counts, f"{p}h").groupBy(*titles.columns).agg(F.min(F.struct(f"{p}c", f"{p}h")).alias(f"{p}r"))
            times = part.groupBy(*titles.columns).agg(F.count(F.lit(1)).alias(f"{p}t"))
            named = rarest.select(*titles.columns, F.col(f"{p}r.{p}h").alias(f"{p}h")).join(times.withColumnsRenamed({c: f"{p}{c}" for c in titles.columns}), reduce(
                Column.__and__, [F.col(c).eqNullSafe(F.col(f"{p}{c}")) for c in titles.columns]
            ))
            pairs = cut(hits.join(named.select(*titles.columns, f"{p}h", F.explode(F.array_repeat(f"{p}h", F.col(f"{p}t").cast("int"))).alias(f"{p}again")), f"{p}h").drop(f"{p}h", f"{p}again"))
            found.append(keyed.join(pairs, f"{p}k").filter(F.contains(F.col(text_col), F.col(title_col))).drop(f"{p}k"))
    return reduce(DataFrame.unionByName, found)


def title_overlap(official: Column, candidate: Column, least: int = 16) -> Column:
    """How many official titles contain, or lie in, one of a candidate's; short ones don't count."""
    long_own = F.filter(official, lambda t: F.length(t) >= least)
    long_other = F.filter(candidate, lambda t: F.length(t) >= least)
    return F.size(F.filter(long_own, lambda o: F.exists(long_other, lambda c: F.contains(c, o) | F.contains(o, c))))
