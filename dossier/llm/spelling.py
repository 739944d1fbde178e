"""Grouping of spelling variants by the three rarest positional bigrams of each word.

Words.  Maximal runs of letters are lower-cased in A-Z; where a checksum of document and run
says so, one letter is dropped, as a slip of the pen.  Words of enough letters and occurrences stay.

Near words.  One inserted, deleted or replaced letter breaks two bigrams of a word at most.
With bigrams ordered by the number of words that hold them, rarest first, then by
themselves and their place, take the three first of each of two near words.  Of the word
whose third comes first, one of the three is unbroken; its counterpart in the other word
comes no later in the order, so it is among the other's three.  Hence near words meet at
one of their three rarest bigrams.  There the edit lies behind the bigram, and
then both words agree up to and with it, at the same place; or before it, and then they agree from it to
their ends, at places one apart at most.  Of the rest, in which the edit is, either the first or the last half
agrees too.  So near words meet at a rare bigram with all that precedes or follows it and half of what is
left, and at lengths one apart at most: these are the keys.  Words that meet are verified by their distance.

The words are joined by keys only, so no task holds all pairs of a frequent bigram, and a key is
shared by as many words as have all but a stretch of one side in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import cut

RUN = "[A-Za-zÀ-ÿ]+"
#: A run loses a letter if this divides its checksum.
SLIP = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Rare bigrams a word is filed under: a bigram more than one edit can break.
RAREST = 3
#: A word is a form of a near one that occurs this many times as often or more.
TIMES = 2

_UPPER = "".join(map(chr, range(65, 91)))


def runs(docs: DataFrame) -> DataFrame:
    """``run``: the words of all documents with their slips, a row an occurrence."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(RUN.replace("A-Z", "")), F.lit(0))
    each = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring("run", 1, at), F.substring(F.col("run"), at + 2, F.length("run")))
    return each.select(F.when(h % SLIP == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: the words of at least ``min_length`` letters that occur ``min_count`` times or more.

    ``docs`` has doc_id and text.  A null text has no words, a null doc_id counts as empty text.  Words of fewer than four
    letters have fewer than three bigrams, so their near words could be missed.
    """
    if min_length < RAREST + 1:
        raise ValueError(f"min_length must be {RAREST + 1} or more")
    return runs(docs).filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def rare_places(words: DataFrame) -> DataFrame:
    """``(word, n, p)``: the places, from 0, of the ``RAREST`` bigrams of each word that the fewest words hold.

    The table of bigrams has at most the square of the letters' number of rows, which are some 90, so it is broadcast.
    """
    letters = F.split("word", "")
    grams = F.transform(F.sequence(F.lit(0), F.length("word") - 2), lambda i: F.concat(F.get("c", i), F.get("c", i + 1)))
    each = words.filter(F.length("word") > RAREST).withColumn("c", letters).select("word", "n", F.posexplode(grams).alias("p", "gram"))
    held = cut(each.groupBy("gram").agg(F.count(F.lit(1)).alias("f")))
    order = Window.partitionBy("word").orderBy("f", "gram", "p")
    return each.join(F.broadcast(held), "gram").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= RAREST).select("word", "n", "p")


def _keys(least: Column, kind: int) -> Column:
    """Keys of a word under its bigram at ``p``, for pairs whose shorter word has ``least`` letters: hashes of a head and a tail of the word."""
    p, size = F.col("p"), F.length("word")
    half = lambda free: F.floor(free / 2).cast("int")
    behind, before = least - p - 2, least - size + p  # letters, of the shorter word, in which the edit is
    cuts = [(behind, p + 2 + half(behind), F.lit(0)), (behind, p + 2, behind - half(behind)), (before, half(before), size - p), (before, F.lit(0), least - half(before))]
    made = [
        F.when(free >= 0, F.xxhash64(F.lit(kind), least, head, tail, F.substring(F.col("word"), F.lit(1), head), F.substring(F.col("word"), size - tail + 1, tail)))
        for free, head, tail in cuts
    ]
    return F.explode(F.array_compact(F.array(*made))).alias("k")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, b, n_a, n_b)``: all pairs of words (``word``, ``n``; a word once) one inserted, deleted or replaced letter apart; each once."""
    places = cut(rare_places(words))
    size = F.length("word")
    kinds = {"alike": (size, 0), "shorter": (size, 1), "longer": (size - 1, 1)}
    keyed = {name: places.select("word", "n", _keys(least, kind)) for name, (least, kind) in kinds.items()}
    near = None
    for left, right in (("alike", "alike"), ("shorter", "longer")):
        a = keyed[left].select("k", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = keyed[right].select(F.col("k").alias("k_"), F.col("word").alias("b"), F.col("n").alias("n_b"))
        met = a.join(b, (F.col("k") == F.col("k_")) & ((F.col("a") < F.col("b")) if left == right else F.lit(True)))
        met = met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b")
        near = met if near is None else near.unionAll(met)
    return near.distinct()


def _last(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for the words that have a form: the end of the way from form to form, by doubling steps."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("via"), F.col("root").alias("next"))
        now = cut(now.join(step, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, times: float = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for the rows of ``words`` (``word``, ``n``).

    ``form`` is the near word of largest count, the first in code-point order among equals, if it occurs ``times`` times
    as often as the word or more; ``root`` where forms lead at last.  Words without near ones are their own roots.
    Null words are passed over, and words of fewer than four letters have no near ones here; a word should stand once, with its count.  No rows give no rows.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")).filter("word IS NOT NULL"))
    pairs = cut(near_pairs(words))
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("x"), F.col("n_b").alias("m")).unionAll(
        pairs.select(F.col("b").alias("w"), F.col("a").alias("x"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "x")).alias("best"))
    form = F.when(-F.col("best.m") >= F.col("n") * times, F.col("best.x"))
    shaped = cut(
        words.join(best, F.col("word") == F.col("w"), "left").select(
            "word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n")
        )
    )
    ends = _last(shaped.filter("form IS NOT NULL"))
    own: Column = F.coalesce("root", "word").alias("root")
    return shaped.join(ends, "word", "left").select("word", "form", own, "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows: one a word of the vocabulary of ``docs``."""
    return variants(vocabulary(docs))
