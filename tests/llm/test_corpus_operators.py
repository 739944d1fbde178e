"""Source mixing, Merkle manifests and spelling variants: brute force and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from dossier.llm import common, merkle, mixture, spelling

DOCS = "doc_id long, source string, text string, lang string, n_chars long"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def slow_targets(sizes, weights=mixture.WEIGHTS, share=mixture.SHARE, cap=mixture.CAP):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while len(full) < len(names):
        level = (share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)) / sum(weigh[s] for s in names if s not in full)
        if (more := {s for s in names if cap * sizes[s] <= level * weigh[s]}) == full:
            break
        full = more
    return {s: min(cap * sizes[s], level * weigh[s]) for s in names}


def slow_mix(rows):
    """rows: (source, size, key); words taken of each."""
    sizes = collections.Counter()
    for source, size, _ in rows:
        sizes[source] += size
    wanted, taken = slow_targets(sizes), [0] * len(rows)
    for source, target in wanted.items():
        own = collections.defaultdict(list)
        for i, (s, _, key) in enumerate(rows):
            if s == source:
                own[key].append(i)
        times = int(target // sizes[source]) if sizes[source] else 0
        rest = limit = int(target + 1e-6 - times * sizes[source])
        rounds, out = 1, limit <= 0
        for key in sorted(own):
            fit = [i for i in own[key] if rows[i][1] <= limit]
            need = sum(rows[i][1] for i in fit)
            for i in own[key]:
                taken[i] = rows[i][1] * times
            if out or not fit:
                continue
            if need <= rest:
                rest -= need
                for i in fit:
                    taken[i] += rows[i][1]
            else:
                rounds, limit = rounds + 1, rest
                out = rest <= target * mixture.NEAR or rounds > mixture.ROUNDS
    return taken, wanted, sizes


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_like_first_fit(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 4 + ["b", "é", None, ""]), int(rng.paretovariate(0.7)) % 20_000, rng.getrandbits(60)) for _ in range(700)]
    rows += [("tiny", 3, 5), ("empty", 0, 7), ("one", 900, 1)]
    rows += [("ties", 10, 42)] * 5 + [("ties", 7, 43)] * 2 + [(None, 5, k << 47) for k in range(30)]
    df = spark.createDataFrame([(*r, "t", "s") for r in rows], "source string, size long, key long, Taken string, __times string")
    got = mixture.mix(df)
    assert got.columns == ["source", "size", "key", "__times", "source_size", "target", "taken"]
    taken, wanted, sizes = slow_mix(rows)
    want = sorted(((s, n, k, "s", sizes[s], t) for (s, n, k), t in zip(rows, taken, strict=True)), key=repr)
    found = got.collect()
    assert sorted(((r.source, r.size, r.key, r["__times"], r.source_size, r.taken) for r in found), key=repr) == want
    assert all(abs(r.target - wanted[r.source]) < 1e-6 and r.taken <= 2 * r.size for r in found)
    for source in ("hot", "b"):  # off by less than each document left out, or by a thousandth
        own = [r for r in found if r.source == source]
        least = min(r.size for r in own if r.taken <= wanted[source] // sizes[source] * r.size and r.size)
        assert -1 < wanted[source] - sum(r.taken for r in own) < max(least, mixture.NEAR * wanted[source])


def test_mix_of_odd_documents(spark):
    rows = [(1, "a", None, None, None), (2, None, "", None, None), (3, "a", " \t\x0b\r\n", None, None), (None, "a", "x y\x0cz w", None, None), (None, "a", "x y\x0cz w", None, None)]
    rows += [(5, "b", "word " * 100_000, "en", 1)]
    got = mixture.digest(spark.createDataFrame(rows, DOCS))
    sizes = sorted((r.doc_id or 0, r.size, r.source_size) for r in got.collect())
    assert sizes == [(0, 3, 6), (0, 3, 6), (1, 0, 6), (2, 0, 0), (3, 0, 6), (5, 100_000, 100_000)]
    assert {r.taken for r in got.collect() if r.doc_id is None} <= {3, 6}
    assert mixture.digest(spark.createDataFrame([], DOCS)).count() == 0
    only = mixture.digest(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0.0, 0)]


def test_mix_agrees_with_itself(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    one, two = (sorted(map(tuple, mixture.digest(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == two


def test_sources_too_many_to_broadcast(spark, monkeypatch):
    """The same rows where the tables over sources, and the counts of numbered ranges, are joined by shuffles."""
    rng = random.Random(4)
    rows = [(rng.choice([*"abcdefghij", None]), rng.randrange(60), rng.getrandbits(60)) for _ in range(500)]
    df = spark.createDataFrame(rows, "source string, size long, key long")
    want = sorted(map(tuple, mixture.mix(df).collect()), key=repr)
    monkeypatch.setattr(mixture, "small", lambda df, most=0: False)
    monkeypatch.setattr(common, "small", lambda df, most=0: False)
    got = mixture.mix(df)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    placed = common.ordinals(df.repartition(6), [F.col("size")], "at", ["source"]).collect()
    for source in {r.source for r in placed}:
        own = sorted((r.at, r.size) for r in placed if r.source == source)
        assert [at for at, _ in own] == list(range(len(own))) and [n for _, n in own] == sorted(n for _, n in own)


def slow_root(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([merkle.parent(levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def slow_way(levels, at):
    for level in levels[:-1]:
        yield at % 2 == 0, level[at ^ 1] if at ^ 1 < len(level) else None
        at //= 2


def slow_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: hashlib.sha256("".join(map(part, (r[0], r[1], r[3], n, r[2]))).encode()).hexdigest()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for g in names}
    trees = {g: slow_root([leaf(r, r[4]) for r in own[g]]) for g in names}
    top = slow_root([trees[g][-1][0] for g in names])
    for i, g in enumerate(names):
        for at, r in enumerate(own[g]):
            proof = [*slow_way(trees[g], at), *slow_way(top, i)]
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % merkle.TAMPER == 0
            folded = merkle.fold(leaf(r, r[4] + 1) if hit else leaf(r, r[4]), proof)
            beside = hashlib.sha256("".join(d for _, d in proof if d).encode()).hexdigest()
            yield r[0], leaf(r, r[4]), trees[g][-1][0], top[-1][0], beside, folded, folded == top[-1][0]


@pytest.mark.parametrize(("block", "fan"), [(12, 6), (2, 1), (0, 2)])
def test_manifest_like_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(merkle.nodes, "__defaults__", (block, fan))
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:2], block))
    rng = random.Random(block)
    langs = ["en"] * 6 + [None, "", "fr", "é", "zz"]
    rows = [(i, rng.choice(["a", None]), rng.choice(["x" * rng.randrange(50), None, "ü"]), rng.choice(langs), rng.choice([None, i])) for i in range(213)]
    rows += [(None, "a", "t", "en", 3), (None, "b", "t", "en", 3), (7, "a", "other", "en", 2), (7, "a", "other", "only", 2)]
    rows += [(9, "a", "again", "rep", 1)] * 5
    rng.shuffle(rows)
    got = merkle.digest(spark.createDataFrame(rows, DOCS).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == sorted(slow_manifest(rows), key=repr)
    assert 10 < sum(not r[-1] for r in found) < 60


def test_manifest_of_few_rows(spark):
    assert merkle.digest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, None, None, None)]
    (got,) = merkle.digest(spark.createDataFrame(rows, DOCS)).collect()
    assert tuple(got) == next(slow_manifest(rows)) and got.leaf == got.subroot == got.root and got.verified
    rows = [(1, "s", "t" * 1_000_000, "a", 2**63 - 1), (2, "s", "t", "b", 1)]
    got = merkle.digest(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r.leaf, r.root) for r in sorted(got)] == [(w[1], w[3]) for w in slow_manifest(rows)]


def test_manifest_lists_proofs(spark):
    leaves = spark.createDataFrame([(i, "g", merkle.parent([str(i)]), "x") for i in range(11)], "id long, g string, digest string, at_ string")
    rows = merkle.manifest(leaves, ["id", "at_"]).collect()
    assert len(rows) == 11 and all(merkle.fold(r.leaf, [(s.right, s.digest) for s in r.proof]) == r.root == r.subroot for r in rows)
    assert {len([s for s in r.proof if s.digest]) for r in rows} == {2, 3, 4}


def slow_words(rows):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % spelling.SLIP == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= spelling.MIN_LENGTH and n >= spelling.MIN_COUNT}


def slow_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(words):
    near = {w: [x for x in words if slow_near(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= spelling.TIMES * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None


@pytest.mark.parametrize("letters", ["ab", "abcdé"])
def test_variants_like_brute_force(spark, letters):
    """Few letters make runs of one letter, repeated bigrams and words that meet at several."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randrange(5, 9))): rng.randrange(3, 200) for _ in range(350)}
    words |= {w[:i] + c + w[i:]: rng.randrange(3, 40) for w in list(words)[:60] for i in (0, 3, len(w)) for c in letters[:1]}
    words |= {"a" * k: 3 * 2**k for k in range(4, 14)} | {"aaaaz" + "y" * 3_000: 5, "aaaz" + "y" * 3_000: 10}
    got = spelling.variants(spark.createDataFrame(sorted(words.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == sorted(slow_variants(words))


def test_words_and_slips_of_documents(spark):
    rng = random.Random(5)
    vocabulary = ["Straße", "Überzug", "naïveté", "letter", "Letters", "lÄtter", "x×y÷zz", "word's", "größer", "abcd"]
    rows = [(i if i % 9 else None, " ".join(rng.choices(vocabulary, k=60)) + "_1") for i in range(150)]
    rows += [(1, None), (2, ""), (3, "1 2 ퟿"), (4, "q" * 50_000 + " " + "longer " * 20_000)] + [(5, "repeat repeat repeat")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Word", F.lit(1)).withColumn("id", F.lit(2)).withColumn("run", F.lit(3))
    want = slow_words(rows)
    assert {tuple(r) for r in spelling.vocabulary(docs).collect()} == set(want.items()) and "lÄtter" in want
    assert sorted(map(tuple, spelling.digest(docs).collect())) == sorted(slow_variants(want))
    assert any(len(w) == len("letter") - 1 for w in want)


def test_variants_of_few_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none).count() == 0
    assert spelling.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    some = spark.createDataFrame([("abcde", 5), (None, 3), ("abcdf", 5), ("vwxyz", 1)], "word string, n int")
    assert sorted(map(tuple, spelling.variants(some).collect())) == [("abcde", None, "abcde", 5, 1, None), ("abcdf", None, "abcdf", 5, 1, None), ("vwxyz", None, "vwxyz", 1, 0, None)]
    with pytest.raises(ValueError, match="min_length"):
        spelling.vocabulary(none, min_length=3)
