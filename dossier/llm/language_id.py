"""Language identification as a mixture: which languages a document holds, and how much of each.

A model keeps, for each language, smoothed log-likelihoods of character trigrams hashed to
2**16 features.  A word's likelihood in a language is that of its trigrams.  Expectation-
maximisation estimates a document's language proportions from its words; the set of
languages is the one with the best likelihood less a penalty for each further language.

Of one language is every text for which no larger set can win, whatever its proportions:
for any proportions t, the likelihood of any others is at most that of t plus
n * log(max over languages of the mean of p(word) / mixture(word)), as the logarithm is
concave.  Other texts try the best single language and the sets that take languages in
order of their share in the fit of all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.llm.common import release, ship

FEATURES = 1 << 16
SMOOTHING = 0.25
ROUNDS = 6
#: Rounds for the few texts of which sets are compared.
FINE_ROUNDS = 40
#: Nats that a further language costs beside half the logarithm of the number of words.
PENALTY = 4.0
#: Labelled documents of each language, about, from which the model is fitted: the sample
#: is those whose hashed id falls below a threshold, all of a language that has fewer.
SAMPLE = 3_000
MAX_LANGUAGES = 256
#: Characters that are looked at together, which bounds a worker's memory.
CHARS = 400_000
UNKNOWN = "und"
#: The stage keeps a text if at least this share of its letters stands in words that are likelier
#: in some language of the model than letters at random, whose hashed trigrams are all alike.
LEAST_KNOWN = 0.4


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def word_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the lower-cased words, and where each word's begin.

    Anything but a letter separates words and stands as a blank in their first and last trigrams.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    padded = np.zeros(len(codes) + 2, dtype=np.uint32)
    padded[1:-1] = np.where(letter, codes, 0)
    at = np.flatnonzero(letter)
    h = padded[at] * np.uint32(0x9E3779B1) ^ padded[at + 1] * np.uint32(0x85EBCA77) ^ padded[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64), np.flatnonzero(padded[at] == 0)


@dataclass
class Model:
    """``table``: log-likelihoods, a row for each feature, a column for each of ``languages``."""

    languages: list[str]
    table: np.ndarray

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word in each language, and its number of trigrams, piece by piece for long texts."""
        out, sizes, at = [], [], 0
        while at < len(text):
            end = min(len(text), at + CHARS)
            while end < len(text) and end - at < 2 * CHARS and text[end - 1].isalpha():
                end += 1
            features, starts = word_features(text[at:end])
            if len(starts):
                out.append(np.add.reduceat(self.table[features], starts, axis=0))
                sizes.append(np.diff(starts, append=len(features)))
            at = end
        if not out:
            return np.zeros((0, len(self.languages)), dtype=np.float32), np.zeros(0, dtype=np.int64)
        return np.concatenate(out), np.concatenate(sizes)


def _em(
    words: np.ndarray, starts: np.ndarray, counts: np.ndarray, theta: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of each document, its log-likelihood, and a bound that no proportions exceed.

    The rows of ``words`` lie document by document.
    """
    top = words.max(axis=1, keepdims=True)
    odds = np.exp(words - top)
    total = np.add.reduceat(top[:, 0].astype(np.float64), starts)
    for _ in range(rounds):
        joint = odds * np.repeat(theta, counts, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        theta = np.add.reduceat(joint, starts, axis=0) / counts[:, None]
    mixed = np.maximum((odds * np.repeat(theta, counts, axis=0)).sum(axis=1), 1e-30)
    score = total + np.add.reduceat(np.log(mixed.astype(np.float64)), starts)
    gain = np.add.reduceat(odds / mixed[:, None], starts, axis=0).max(axis=1) / counts
    return theta, score, score + counts * np.log(np.maximum(gain.astype(np.float64), 1.0))


def _select(words: np.ndarray, theta: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Proportions over the best of the sets: the best single language, and those in order of share."""
    order = np.argsort(-theta, kind="stable")
    n = len(words)
    full = np.zeros(len(theta), dtype=np.float64)
    full[single.argmax()] = 1.0
    best = (single.max(), full)
    for size in range(2, len(order) + 1):
        if theta[order[size - 1]] * n < 0.5:
            break
        chosen = np.sort(order[:size])
        start = np.full((1, size), 1 / size, dtype=np.float32)
        share, score, _ = _em(words[:, chosen], np.array([0]), np.array([n]), start, FINE_ROUNDS)
        worth = score[0] - (size - 1) * (PENALTY + 0.5 * np.log(n))
        if worth > best[0]:
            full = np.zeros(len(theta), dtype=np.float64)
            full[chosen] = share[0]
            best = (worth, full)
    return best[1]


def mixtures(model: Model, texts: list[str]) -> list[tuple[np.ndarray, float] | None]:
    """Language proportions of each text and the share of its letters in words that some language explains; None without words."""
    out: list[tuple[np.ndarray, float] | None] = [None] * len(texts)
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if not waiting:
            return
        words = np.concatenate([w for _, w, _ in waiting])
        sizes = np.concatenate([t for _, _, t in waiting])
        counts = np.array([len(w) for _, w, _ in waiting])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        k = len(model.languages)
        theta, _, bound = _em(words, starts, counts, np.full((len(counts), k), 1 / k, dtype=np.float32), ROUNDS)
        single = np.add.reduceat(words.astype(np.float64), starts, axis=0)
        fits = words.max(axis=1) > -np.log(FEATURES) * sizes
        known = np.add.reduceat(fits * sizes, starts) / np.add.reduceat(sizes, starts)
        alone = single.max(axis=1) >= bound - PENALTY - 0.5 * np.log(counts)
        for j, (i, own, _) in enumerate(waiting):
            if alone[j]:
                share = np.zeros(k)
                share[single[j].argmax()] = 1.0
            else:
                share = _select(own, theta[j], single[j])
            out[i] = (share, float(known[j]))
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        own, sizes = model.words(text)
        if len(own):
            waiting.append((i, own, sizes))
            held += len(text)
        if held >= CHARS:
            settle()
            held = 0
    settle()
    return out


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id's text leaves no remainder at 5; a null id isn't held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = sums.setdefault(lang, np.zeros(FEATURES, dtype=np.int64))
            value = text.as_py()
            for at in range(0, len(value), CHARS):
                own += np.bincount(word_features(value[at : at + CHARS])[0], minlength=FEATURES)
    for lang, own in sums.items():
        feature = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(feature), pa.string()), pa.array(feature, pa.int32()), pa.array(own[feature], pa.int64())],
            names=["lang", "feature", "n"],
        )


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents that aren't held out, about ``sample`` of each language.

    Rows come back summed: 2**16 for each of at most MAX_LANGUAGES languages.
    """
    ship(docs.sparkSession)
    labelled = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((FEATURES, 0), dtype=np.float32))
    whole = 1 << 30
    limit = F.lit(0)
    for lang in languages:
        limit = F.when(F.col("lang") == lang, min(whole, whole * sample // sizes[lang])).otherwise(limit)
    chosen = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(whole)) < limit)
    sums = chosen.select("lang", "text").mapInArrow(_counts, "lang string, feature int, n long")
    rows = sums.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((FEATURES, len(languages)), SMOOTHING)
    column = {lang: i for i, lang in enumerate(languages)}
    at = np.array([column[lang] for lang in rows["lang"].to_pylist()], dtype=np.int64)
    counts[rows["feature"].to_numpy(), at] += rows["n"].to_numpy()
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


ADDED = ("lang_pred", "score", "languages", "known")


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``, ``languages``, ``known``; only such names are replaced.

    ``languages`` lists the selected set as ``name:share``, largest share first, of equal ones
    the first by name; ``lang_pred`` is the first of them and ``score`` its share, 1 if it
    stands alone.  ``known`` is the share of letters in words that are likelier in some language
    than at random.  Null texts, those without a letter, and all texts of a model without languages
    get ``und``, 0, an empty list and 0.  Only the text is looked at.  Rows map one to one,
    repeated ones too, no rows give no rows, and nothing is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # 256 KB for each language
    carried = [c for c in docs.columns if c not in ADDED]
    marked = docs.select(*[F.col(f"`{c}`") for c in carried])
    schema = StructType(list(marked.schema.fields))
    for name, kind in zip(ADDED, ("string", "double", "string", "double"), strict=True):
        schema = schema.add(name, kind)
    place = carried.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(place)] if own.languages else [""] * batch.num_rows
            rows = []
            for found in mixtures(own, texts):
                if found is None:
                    rows.append((UNKNOWN, 0.0, "", 0.0))
                    continue
                share, known = found
                order = [i for i in np.argsort(-share, kind="stable") if share[i] > 0]
                sets = ",".join(f"{own.languages[i]}:{share[i]:.4f}" for i in order)
                rows.append((own.languages[order[0]], float(min(1.0, share[order[0]])), sets, known))
            names, scores, sets, known = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string()), pa.array(known, pa.float64())],
                names=[*carried, *ADDED],
            )
        release()

    return marked.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: id, whether it is held out, prediction, score, language set, known share.

    Null ids are not held out; repeated rows stay rows; no documents give no rows.
    """
    own = docs.select("doc_id", "text", "lang")
    return predict(own.select("doc_id", "text"), train(own)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), *ADDED
    )


def keep_known(docs: DataFrame, least: float = LEAST_KNOWN) -> DataFrame:
    """Documents of a language that the model knows, all columns kept.

    Rejected are those judged ``und``, and those with less than ``least`` of their letters
    in words that are likelier in some language than at random: noise, codes, languages that
    no labelled document is in.  Where no language could be learned, all texts with a letter
    stay.  Null ids and repeated rows are judged like others; no documents give no rows.
    """
    model = train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    judged = predict(docs.toDF(*own), model, own[docs.columns.index("text")])
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= least)).select(*own).toDF(*docs.columns)
