"""BPE, SimHash, LZ fingerprints, language mixtures: against brute force, libraries, and odd inputs."""

import hashlib
import itertools
import random
import struct

import numpy as np
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.llm import byte_bpe, language_id, lz_fingerprint, simhash_dedup
from dossier.llm.common import cut

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, fp string, key string, bucket int"
ODD = [None, "", " ", "\n\n", "a", "zwei Wörter", "Ünïcödé 中文字 😀", "x" * 5000, "the cat sat on the mat " * 400]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(PATH, PATTERN, max_words=500, max_states=400)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.machine.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aetinoshré -=!0", max_size=120))
def test_bpe_like_the_library(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text


def test_bpe_long_words_and_bytes(codec, library):
    rng = random.Random(3)
    for n in (1, 70, 400, 5000):
        data = bytes(rng.choice(b"aeth*-") for _ in range(n))
        assert codec.machine.encode(data) == library._encode_single_piece(data)
        assert codec.machine.encode(b"a" * n) == library._encode_single_piece(b"a" * n)


def test_stream_holds_back_split_characters(codec):
    ids = np.array(codec.encode("aß中😀é"), dtype="<u4")
    stream = byte_bpe.StreamDecoder(codec)
    parts = [stream.feed_bytes(ids[i : i + 1]) for i in range(len(ids))]
    for part in parts:
        part.decode()
    assert b"".join(parts).decode() == "aß中😀é" and stream.finish() == b""
    with pytest.raises(UnicodeDecodeError):
        list(codec.decode_stream(struct.pack("<I", codec.machine.ranks[b"\xff"])))


def test_tokenize_rows(spark, library):
    rows = [(i, t, None, "x", "y", 1) for i, t in enumerate(ODD)] + [(None, "a", None, "", "", 0), (4, "a", None, "", "", 0)]
    out = byte_bpe.tokenize(spark.createDataFrame(rows, DOCS), PATH, PATTERN, keep_ids=True)
    got = sorted(map(tuple, out.collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        sha = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.append((doc_id, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert got == sorted(want, key=repr)
    back = byte_bpe.detokenize(out, PATH, PATTERN)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, *_ in rows)
    assert byte_bpe.tokenize(spark.createDataFrame([], DOCS), PATH, PATTERN).count() == 0


def slow_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(prints))]


def test_near_duplicates_like_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((40, 120, 300)))] for _ in range(12)]
    texts = list(ODD)
    for words in base:
        for _ in range(14):
            own = list(words)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(d, t, None, "x", "y", 1) for d, t in zip(order, texts, strict=True)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    want = groups_of(prints, order)
    assert got == {d: (f"{p:016x}", c) for d, p, c in zip(order, prints, want, strict=True)}
    assert len({c for _, c in got.values()}) < len(texts) - 30


def test_links_connect_every_pair_within_three_bits(spark):
    rng = random.Random(9)
    values = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 3, 4))):
                y ^= 1 << b
            values.add(y)
    dense = rng.getrandbits(64)
    bits = rng.sample(range(64), 9)
    for k in range(200):
        values.add(dense ^ sum(1 << b for i, b in enumerate(bits) if (k * 2654435761) >> (i + 7) & 1))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from dossier.llm.common import components

    edges = simhash_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    roots = {r.node: r.root for r in components(edges).collect()}
    got = [roots.get(v, v) for v in signed]
    want = groups_of(values, signed)
    same = {}
    for g, w in zip(got, want, strict=True):
        assert same.setdefault(g, w) == w
    assert len(set(got)) == len(set(want))


def test_no_join_of_fingerprints_is_broadcast(spark):
    """Exploded rows count as small as the table they come from, and filled the driver (F1, F2)."""
    prints = cut(spark.range(200).select((F.col("id") * 7).alias("fp")))
    found = simhash_dedup.links(prints)
    named = simhash_dedup.near_duplicates(spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string"))
    for df in (found, named):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_keep_rows(spark):
    rows = [(7, "a b c d", "en", "", "", 0), (3, "A  b\tc d", "en", "", "", 0), (3, "A  b\tc d", "en", "", "", 0), (None, "a b c d", "en", "", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = simhash_dedup.near_duplicates(df).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {3}
    assert sorted(map(repr, (r.doc_id for r in simhash_dedup.keep_first(df).collect()))) == ["3", "3", "None"]
    empty = spark.createDataFrame([], DOCS)
    assert simhash_dedup.near_duplicates(empty).count() == 0 and simhash_dedup.keep_first(empty).columns == df.columns


def slow_phrases(text):
    known, out, word = set(), [], ""
    for c in text:
        word += c
        if word not in known:
            known.add(word)
            out.append(word)
            word = ""
    return out


def slow_print(text):
    return lz_fingerprint.signature(np.array([xxhash.xxh64_intdigest(p) for p in slow_phrases(text)], dtype=np.uint64))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abß中 ", max_size=200), st.text(alphabet="abc ", max_size=60))
def test_lz_parse(text, other):
    assert lz_fingerprint.phrases(text)[0] == slow_phrases(text)
    changed, sig = lz_fingerprint.edited(lz_fingerprint.parse(text), other)
    assert lz_fingerprint.text_of(sig) == lz_fingerprint.text_of(slow_print(changed))


def test_lz_rows(spark):
    texts = [*ODD, "the cat sat on the mat " * 400]
    rows = [(3 * i, t, None, "x", "y", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in lz_fingerprint.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    down = sorted(got, reverse=True)
    plain = {i: t or "" for i, t, *_ in rows}
    for i, nxt in zip(down, [*down[1:], down[0]], strict=True):
        n = len(plain[i])
        edited = plain[i][: n - n // 3] + plain[nxt][: n // 3]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == lz_fingerprint.text_of(slow_print(plain[i]))
        assert r.edited_fingerprint == lz_fingerprint.text_of(slow_print(edited))
        assert r.near_next == lz_fingerprint.likeness(slow_print(plain[i]), slow_print(plain[nxt]))
        assert r.near_edited == lz_fingerprint.likeness(slow_print(plain[i]), slow_print(edited))
    one = lz_fingerprint.fingerprints(spark.createDataFrame([(1, "abcabc", None, "", "", 0)], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    repeated = [(5, "b", None, "", "", 0), (5, "b", None, "", "", 0), (None, "n", None, "", "", 0), (9, "q", None, "", "", 0)]
    assert lz_fingerprint.fingerprints(spark.createDataFrame(repeated, DOCS)).count() == 4
    assert lz_fingerprint.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def slow_neighbours(rows):
    """Each row's edited text, rows from the highest id, null last, equal ids by the text's hash."""
    mark = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), seed=42))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), mark(r[1]), r[1]))
    out = []
    for (i, own), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        n = len(own)
        out.append((i, n, hashlib.sha256((own[: n - n // 3] + nxt[: n // 3]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lz_hot_ids_are_split(spark):
    rng = random.Random(14)
    text = lambda: " ".join(rng.choices(("ab", "ba", "c", "ddd"), k=rng.randrange(12)))
    for rows in (
        [(None, text()) for _ in range(150)] + [(7, text()) for _ in range(100)] + [(i, text()) for i in range(-20, 40)],
        [(None, text()) for _ in range(60)], [(5, "same")] * 40 + [(9, "x"), (None, None)], [(i % 3, text()) for i in range(90)],
        [(-(1 << 63), "low"), ((1 << 63) - 1, "high"), (None, "none"), (0, "zero")],
    ):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        out = lz_fingerprint.fingerprints(df)
        got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out.collect()), key=repr)
        if any(i == -(1 << 63) for i, _ in rows):
            assert len(got) == 4
        else:
            assert got == slow_neighbours(rows)


def test_lz_likeness_is_close_to_the_exact_overlap():
    rng = random.Random(15)
    vocabulary = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "stone", "river", "light", "seven", "house"]
    off = []
    for _ in range(120):
        own = rng.choices(vocabulary, k=rng.choice((60, 200, 600)))
        other = own[: rng.randrange(len(own))] + rng.choices(vocabulary, k=rng.randrange(1, len(own)))
        a, b = (slow_phrases(" ".join(w)) for w in (own, other))
        exact = len(set(a) & set(b)) / len(set(a) | set(b))
        off.append(lz_fingerprint.likeness(slow_print(" ".join(own)), slow_print(" ".join(other))) - exact)
    off = np.array(off)
    assert abs(off.mean()) < 0.02 and np.abs(off).mean() < 0.04 and np.abs(off).max() < 0.15


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 100 < len(held) < 300
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    train = [(i, t, lang, "", "", 0) for i in range(40) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    model = language_id.train(spark.createDataFrame(train, DOCS))
    assert model.languages == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "123 !"), (4, "the dog"), (5, "die katze " * 30000), (None, "the"), (6, "the dog and the cat " * 30 + "der hund und die katze " * 30)]
    out = language_id.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    got = {r.doc_id: r for r in out}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert got[1].score == 0 and got[6].languages.count(":") == 2 and len(out) == 7
    none = language_id.train(spark.createDataFrame([], DOCS))
    assert language_id.predict(spark.createDataFrame(odd, "doc_id long, text string"), none).filter("lang_pred = 'und'").count() == 7
    kept = language_id.keep_known(spark.createDataFrame(train[:4] + [(99, "!!", "en", "", "", 0), (98, None, None, "", "", 0)], DOCS))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") and kept.count() == 4
    empty = spark.createDataFrame([], DOCS)
    assert language_id.digest(empty).count() == language_id.keep_known(empty).count() == 0
    tie = language_id.Model(["en", "fr"], np.full((language_id.FEATURES, 2), -3.0, dtype=np.float32))
    assert {(r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame([(1, "same words")] * 2, "doc_id long, text string"), tie).collect()} == {("en", 1.0)}
    clash = spark.createDataFrame([("the dog", "a", "b", "c", "d", "en")], "text string, score string, known string, own_text string, text_ string, lang string")
    assert [tuple(r) for r in language_id.keep_known(clash.withColumn("doc_id", F.lit(1))).collect()] == [("the dog", "a", "b", "c", "d", "en", 1)]


def slow_mixture(model, text):
    """Best of all language sets, each fitted by many plain EM steps: shares, and the worth of each set."""
    words, now = [], []
    for c in (text or "").lower() + " ":
        if c.isalpha():
            now.append(ord(c))
        elif now:
            codes = [0, *now, 0]
            total = np.zeros(len(model.languages))
            for x, y, z in zip(codes, codes[1:], codes[2:]):
                h = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                total += model.table[h >> 16]
            words.append((total, len(now)))
            now = []
    if not words:
        return None
    known = sum(n for w, n in words if w.max() > -np.log(language_id.FEATURES) * n) / sum(n for _, n in words)
    words = np.array([w for w, _ in words])
    worths = {}
    for size in range(1, len(model.languages) + 1):
        for chosen in itertools.combinations(range(len(model.languages)), size):
            own = words[:, chosen]
            top = own.max(axis=1, keepdims=True)
            p, share = np.exp(own - top), np.full(size, 1 / size)
            for _ in range(400):
                joint = p * share
                share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
            score = float((np.log((p * share).sum(axis=1)) + top[:, 0]).sum())
            worths[chosen] = (score - (size - 1) * (language_id.PENALTY + 0.5 * np.log(len(words))), share)
    best = max(worths, key=lambda c: worths[c][0])
    return {model.languages[i]: s for i, s in zip(best, worths[best][1], strict=True)}, known, {c: w for c, (w, _) in worths.items()}


def test_language_mixtures_like_brute_force(spark):
    rng = random.Random(11)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    by_lang = {}
    for r in docs.select("lang", "text").collect():
        by_lang.setdefault(r.lang, []).append(r.text.split())
    langs = sorted(by_lang)
    texts = [" ".join(rng.choice(by_lang[rng.choice(langs)])[: rng.choice((3, 20, 80))]) for _ in range(40)]
    for _ in range(60):
        parts = [rng.choice(by_lang[lang])[: rng.choice((10, 30, 60))] for lang in rng.sample(langs, rng.choice((2, 2, 3, 4)))]
        texts.append(" ".join(w for part in parts for w in part))
    texts += ["x", "Ελληνικά", "qzx vvkj wqx", "a1b2c3d4", None, "-"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    mixed = 0
    for i, text in enumerate(texts):
        want, r = slow_mixture(model, text), rows[i]
        if want is None:
            assert (r.lang_pred, r.score, r.languages, r.known) == ("und", 0.0, "", 0.0)
            continue
        shares, known, worths = want
        got = {p.split(":")[0]: float(p.split(":")[1]) for p in r.languages.split(",")}
        assert abs(r.known - known) < 1e-9 and abs(sum(got.values()) - 1) < 1e-3
        mine = tuple(sorted(langs.index(n) for n in got))
        assert worths[mine] >= max(worths.values()) - 0.01, (text, got, shares)
        assert got.keys() == shares.keys() and all(abs(got[n] - shares[n]) < 0.02 for n in got)
        assert r.lang_pred == max(sorted(got), key=lambda n: shares[n]) or len({round(s, 2) for s in shares.values()}) < len(shares)
        mixed += len(got) > 1
    assert mixed > 40


def test_texts_of_no_known_language_go(spark):
    rng = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = ["".join(rng.choices("qzxjkwvy", k=8)) + " " + "".join(rng.choices("QXZJVK", k=30)) for _ in range(5)] + ["Καλημέρα σε όλους", "доброе утро всем"]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*noise, None, "12 34", "Ünïcödé"])], "doc_id long, text string")
    both = docs.unionByName(extra, allowMissingColumns=True)
    kept = language_id.keep_known(both)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and ids == {r.doc_id for r in docs.select("doc_id").collect()}


def test_letters_stay_when_no_language_was_learned(spark):
    rows = [(1, "some words here"), (2, "1234 --"), (3, None), (4, "слова")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(null AS string) AS lang")
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]
