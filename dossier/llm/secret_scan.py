"""Secret scan: pattern spans, and high-entropy strings found by a sliding window.

Everything is one projection of built-in expressions over the scanned row: no Python on
the executors and no shuffle, so a hot source or group of copies can't skew it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import fresh

# The patterns of the base kinds, in the order of their names, each with the
# least length of the part that must be long enough and the group that holds that part.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))


@dataclass(frozen=True)
class CharClass:
    """An alphabet that secrets are written in.

    ``pattern`` finds maximal candidate strings, ``must`` is what a candidate has to hold,
    ``window`` how many characters are looked at together, ``bits`` the Shannon entropy a
    window must reach.
    """

    kind: str
    pattern: str
    must: str
    alphabet: str
    window: int
    bits: float


DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("entropy_hex", r"[0-9A-F]{24,}", r"[A-F][0-9A-F]*[0-9]|[0-9][0-9A-F]*[A-F]", DIGITS + "ABCDEF", 24, 3.1),
    CharClass(
        "entropy_base64",
        r"[A-Za-z0-9+/_=-]{20,}",
        r"[0-9][A-Za-z0-9+/_=-]*[A-Za-z]|[A-Za-z][A-Za-z0-9+/_=-]*[0-9]",
        DIGITS + UPPER + UPPER.lower() + "+/_=-",
        20,
        3.85,
    ),
)
#: Strings that look random but are known to be harmless: identifiers, placeholders, examples.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]",
    r"(?i)0123456789|abcdefghij",
    r"^sha(1|256|512)-",
)


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """Matches with their places: ``array<struct<s, e, m>>``, code points, end exclusive.

    The text between matches and the matches alternate, so running sums of lengths are places.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w"), part.alias("m"))
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["b"]
        e = s + F.length(x["w"])
        return F.struct(
            e.alias("at"),
            F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"),
        )

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


NO_SPANS = "array<struct<s:int,k:int,e:int,kind:string,m:string>>"


def _spans(text: Column, pattern: str, group: int, least: int, k: int, kind: str, gate: str) -> Column:
    found = F.filter(_pieces(text, pattern, group), lambda x: F.length(x["m"]) >= least)
    named = F.transform(
        found,
        lambda x: F.struct(
            x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")
        ),
    )
    return F.when(F.rlike(text, F.lit(gate)), named).otherwise(F.array().cast(NO_SPANS))


def _f(count: Column) -> Column:
    """c * log2(c), zero for zero."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def top_entropy(value: Column, alphabet: str, window: int) -> Column:
    """The largest Shannon entropy, in bits, of any ``window`` consecutive characters.

    One pass keeps a count for each letter of the alphabet, written as one character of a
    string, and the sum of c * log2(c).  When the window moves by one place, the leaving and
    the entering character change two counts and four terms of that sum; the entropy is
    log2(window) - sum / window.  Strings shorter than the window give the entropy of the
    whole.  ``value`` must hold letters of the alphabet only.
    """
    n = F.least(F.length(value), F.lit(window))
    empty = "0" * len(alphabet)

    def run(chars: Column) -> Column:
        def count(counts: Column, at: Column) -> Column:
            return F.ascii(F.substring(counts, at, 1)) - 48

        def put(counts: Column, at: Column, number: Column) -> Column:
            return F.overlay(counts, F.char(number + 48), at, F.lit(1))

        def step(acc: Column, i: Column) -> Column:
            leaving = F.when(i > window, F.instr(F.lit(alphabet), F.get(chars, i - window - 1))).otherwise(F.lit(0))
            entering = F.instr(F.lit(alphabet), F.get(chars, i - 1))

            def less(out: Column) -> Column:
                c = count(acc["c"], out)
                return F.when(
                    out > 0,
                    F.struct(put(acc["c"], out, c - 1).alias("c"), (acc["s"] - _f(c) + _f(c - 1)).alias("s")),
                ).otherwise(F.struct(acc["c"].alias("c"), acc["s"].alias("s")))

            def more(x: Column) -> Column:
                c = count(x["c"], entering)
                s = x["s"] - _f(c) + _f(c + 1)
                return F.struct(
                    put(x["c"], entering, c + 1).alias("c"),
                    s.alias("s"),
                    F.when(i >= n, F.least(acc["best"], s)).otherwise(acc["best"]).alias("best"),
                )

            return F.get(F.transform(F.transform(F.array(leaving), less), more), F.lit(0))

        start = F.struct(F.lit(empty).alias("c"), F.lit(0.0).alias("s"), F.lit(1e18).alias("best"))
        return F.aggregate(
            F.sequence(F.lit(1), F.size(chars)),
            start,
            step,
            lambda acc: F.log2(n.cast("double")) - acc["best"] / n,
        )

    # The array is bound once by a lambda, so it isn't split again at every step.
    return F.get(F.transform(F.array(F.split(value, "")), run), F.lit(0))


def _entropy_spans(text: Column, cls: CharClass, k: int, allow: Sequence[str]) -> Column:
    def suspicious(x: Column) -> Column:
        keep = F.rlike(x["m"], F.lit(cls.must))
        for pattern in allow:
            keep = keep & ~F.rlike(x["m"], F.lit(pattern))
        return F.when(keep, F.round(top_entropy(x["m"], cls.alphabet, cls.window), 9) >= cls.bits).otherwise(False)

    spans = _spans(text, cls.pattern, 0, 0, k, cls.kind, cls.pattern)
    return F.filter(spans, suspicious)


def scan(
    docs: DataFrame,
    text_col: str = "text",
    out: str = "secrets",
    classes: Sequence[CharClass] = CLASSES,
    allow: Sequence[str] = ALLOW,
) -> DataFrame:
    """All columns of ``docs`` and the array ``out`` of spans ``(s, k, e, kind, m)``.

    ``s`` and ``e`` count code points from 0, end exclusive; ``m`` is the part found (for an
    assignment the value).  Spans are in the order of start, then kind as listed: assign,
    access, hex, then the entropy classes.  Kinds are found apart from each other and may
    overlap.  The allow-list silences entropy spans only.  A null or empty text has no
    spans; rows are kept one to one whatever they repeat; a column named ``out`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Runs are maximal, so for whole matches the least length can stand inside the pattern.
    searched = (ASSIGN, r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}")
    parts = [
        _spans(text, pattern, group, least, k, kind, pattern)
        for k, ((kind, _, group, least), pattern) in enumerate(zip(BASE, searched, strict=True))
    ]
    parts += [_entropy_spans(text, cls, len(BASE) + i, allow) for i, cls in enumerate(classes)]
    return docs.withColumn(out, F.array_sort(F.concat(*parts)))


def spans_text(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kept = F.filter(spans, lambda x: x["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(
        F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of base kinds, hash of base spans, all spans as text."""
    rows = scan(docs.select("doc_id", F.col("text").alias("text")), out="found").select("doc_id", "found")
    base = [kind for kind, *_ in BASE]

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id",
        *[number(kind) for kind in base],
        F.sha2(spans_text(F.col("found"), base), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span, overlapping ones together, replaced by ``mark``.

    Texts without spans, null included, stay as they are; repeated rows stay, no rows give no
    rows, and other columns are kept whatever their names.
    """
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        gap = F.when(
            fresh, F.concat(F.call_function("substring", text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))
        ).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.call_function("substring", text, acc["at"] + 1, F.length(text)))
    name = fresh(docs, "secrets_")
    cleaned = F.when(F.size(name) > 0, F.aggregate(name, start, step, rest)).otherwise(text)
    return scan(docs, text_col, name).withColumn(text_col, cleaned).drop(name)
