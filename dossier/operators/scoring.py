"""Weighted-keyword scoring of text against a profile.

A profile is a query parameter of bounded size, so its keywords stand in the plan as
literals: matching is a chain of built-in predicates over one column, with no join.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import CJK, let, norm_text

#: Most keywords of a profile.
MAX_KEYWORDS = 2_000
# Keywords that match by a pattern of their own.
SPECIAL = {
    "robot": r"\brobots?\b|\brobotics?\b",
    "robotic": r"\brobotic(s)?\b",
    "agent": r"\bagents?\b",
    "llm": r"\bllms?\b",
    "rl": r"\brl\b",
    "nlp": r"\bnlp\b",
    "3d": r"\b3d\b",
    "video": r"\bvideos?\b",
    "control": r"\bcontrol(s|led|ling)?\b",
    "policy": r"\bpolic(y|ies)\b",
}


@dataclass(frozen=True)
class Profile:
    """What a text is scored against; see ``validate`` for the rules it keeps."""

    weights: Sequence[tuple[str, int]]
    core: Sequence[str] = ()
    alias_groups: Sequence[Sequence[str]] = ()
    direction_groups: Mapping[str, Sequence[str]] = field(default_factory=dict)
    bonus: Sequence[tuple[str, int]] = ()
    excluded: Sequence[str] = ()


def validate(profile: Profile) -> Profile:
    """Raise ValueError on a profile that can't be scored with; else return it.

    Weights are whole numbers of 0 or more; core terms have a positive weight; terms of alias
    and direction groups are keywords, and no keyword is in two groups of a kind.
    """
    if not profile.weights or len(profile.weights) > MAX_KEYWORDS:
        raise ValueError(f"a profile has 1 to {MAX_KEYWORDS} keywords")
    names = [kw.lower() for kw, _ in profile.weights]
    if any(not kw.strip() for kw in names) or len(set(names)) < len(names):
        raise ValueError("keywords must be given, each once")
    for kw, weight in [*profile.weights, *profile.bonus]:
        if isinstance(weight, bool) or not isinstance(weight, int) or weight < 0:
            raise ValueError(f"weight of {kw!r} is not a whole number of 0 or more")
    positive = {kw.lower() for kw, weight in profile.weights if weight > 0}
    if unknown := [t for t in profile.core if t.lower() not in positive]:
        raise ValueError(f"core terms without a positive weight: {unknown}")
    for kind, groups in (("alias", profile.alias_groups), ("direction", profile.direction_groups.values())):
        terms = [t.lower() for group in groups for t in group]
        if unknown := sorted(set(terms) - set(names)):
            raise ValueError(f"{kind} terms that are no keywords: {unknown}")
        if kind == "alias" and len(set(terms)) < len(terms):
            raise ValueError("a keyword is in two alias groups")
    return profile


def is_cjk(keyword: str) -> bool:
    return bool(re.search(CJK, keyword))


def keyword_pattern(keyword: str) -> str:
    """The pattern by which a keyword of other than CJK letters is found in lower-case text."""
    own = keyword.lower().strip()
    if own in SPECIAL:
        return "(?U)" + SPECIAL[own]
    parts = [re.sub(r"([^\w\s])", r"\\\1", part) for part in own.split(" ")]
    return rf"(?<![a-z0-9]){'(?U:\\s)+'.join(parts)}(?![a-z0-9])"


def keyword_in(keyword: str, lowered: Column) -> Column:
    """Whether a keyword occurs in normalised lower-case text; a blank one never does."""
    own = keyword.lower().strip()
    if not own:
        return F.lit(False)
    if is_cjk(own):
        return F.contains(lowered, F.lit(own))
    matches = F.rlike(lowered, F.lit(keyword_pattern(own)))
    if own in SPECIAL:
        return matches
    # A plain search goes before the pattern; of a phrase it looks for the longest word.
    return F.contains(lowered, F.lit(max(own.split(), key=len))) & matches


def matched_terms(lowered: Column, terms: Sequence[str]) -> Column:
    """The terms found, in the order given."""
    if not terms:
        return F.array().cast("array<string>")
    return let(lowered, lambda x: F.array_compact(F.array(*[F.when(keyword_in(t, x), F.lit(t)) for t in terms])))


def _entries(lowered: Column, profile: Profile) -> Column:
    """Matched keywords as structs; the order of fields is that of suppression."""
    group = {t.lower(): i for i, g in enumerate(profile.alias_groups) for t in g}
    place = {t.lower(): i for g in profile.alias_groups for i, t in enumerate(g)}
    found = []
    for order, (kw, weight) in enumerate(profile.weights):
        if weight > 0:
            own = kw.lower()
            entry = F.struct(
                F.lit(-len(kw)).alias("len"),
                F.lit(-weight).alias("neg"),
                # Picks of alias groups come first, in the order of the groups.
                F.lit(group.get(own, len(profile.alias_groups) + order)).alias("ord"),
                F.lit(place.get(own, 0)).alias("place"),
                F.lit(kw).alias("kw"),
                F.lit(is_cjk(kw)).alias("cjk"),
            )
            found.append(F.when(keyword_in(kw, lowered), entry))
    return F.array_compact(F.array(*found))


def _suppress(entries: Column) -> Column:
    """Longest first; an entry goes if one that was kept, of the same kind of letters, contains it."""
    ordered = F.array_sort(entries)

    def step(kept: Column, x: Column) -> Column:
        covered = F.exists(kept, lambda k: (k["cjk"] == x["cjk"]) & F.contains(F.lower(k["kw"]), F.lower(x["kw"])))
        return F.when(covered, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def score(text: Column, profile: Profile, max_terms: int = 4) -> Column:
    """``struct<score int, keywords array<string>>`` of a text.

    Of the aliases of a group only the heaviest counts (then the longest, then the first);
    a keyword within a longer one doesn't count; at most ``max_terms`` count, longest first.
    """
    lowered = F.lower(norm_text(text))
    entries = let(lowered, lambda x: _entries(x, profile))
    n = len(profile.alias_groups)
    if n:

        def pick(found: Column, g: int) -> Column:
            own = F.filter(found, lambda x: x["ord"] == g)
            keyed = F.transform(
                own, lambda x: F.struct(x["neg"].alias("neg"), x["len"].alias("len"), x["place"].alias("place"), x.alias("x"))
            )
            return F.array_min(keyed)["x"]

        def picks(found: Column) -> Column:
            best = F.array_compact(F.array(*[pick(found, g) for g in range(n)]))
            return F.concat(best, F.filter(found, lambda x: x["ord"] >= n))

        entries = F.get(F.transform(F.array(entries), picks), F.lit(0))

    def total(kept: Column) -> Column:
        return F.struct(
            F.aggregate(kept, F.lit(0), lambda acc, x: acc - x["neg"]).alias("score"),
            F.transform(kept, lambda x: x["kw"]).alias("keywords"),
        )

    return F.get(F.transform(F.array(F.slice(_suppress(entries), 1, max_terms)), total), F.lit(0))


def direction_groups(keywords: Column, profile: Profile) -> Column:
    """Names of the direction groups that a keyword array touches, in the profile's order."""
    lowered = F.transform(keywords, lambda k: F.lower(norm_text(k)))
    hits = [
        F.when(F.arrays_overlap(lowered, F.array(*[F.lit(t.lower()) for t in terms])), F.lit(name))
        for name, terms in profile.direction_groups.items()
    ]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def institute_bonus(text: Column, profile: Profile, cap: int = 10) -> Column:
    """``struct<bonus int, keywords>``: plain substrings, overlaps suppressed, the sum capped."""
    lowered = F.lower(norm_text(text))
    found = [
        F.when(
            F.contains(lowered, F.lit(kw.lower())),
            F.struct(
                F.lit(-len(kw)).alias("len"), F.lit(-bonus).alias("neg"), F.lit(i).alias("ord"),
                F.lit(0).alias("place"), F.lit(kw).alias("kw"), F.lit(is_cjk(kw)).alias("cjk"),
            ),
        )
        for i, (kw, bonus) in enumerate(profile.bonus)
        if bonus > 0
    ]
    if not found:
        return F.struct(F.lit(0).alias("bonus"), F.array().cast("array<string>").alias("keywords"))
    kept = _suppress(F.array_compact(F.array(*found)))
    return F.struct(
        F.least(F.aggregate(kept, F.lit(0), lambda acc, x: acc - x["neg"]), F.lit(cap)).alias("bonus"),
        F.transform(kept, lambda x: x["kw"]).alias("keywords"),
    )


def relevance_labels(text: Column, rules: Mapping[str, Sequence[str]], title: Column | None = None, keywords: Sequence[str] = ()) -> Column:
    """Labels whose terms a text holds, in the order of the rules.

    With ``title`` and ``keywords``, ``uncertain`` is added where the title holds no keyword.
    """
    lowered = F.lower(norm_text(text))

    def holds(of: Column, terms: Sequence[str]) -> Column:
        out = F.lit(False)
        for term in terms:
            out = out | keyword_in(term, of)
        return out

    def found(own: Column) -> Column:
        return F.array(*[F.when(holds(own, terms), F.lit(name)) for name, terms in rules.items()])

    labels = let(lowered, found)
    if title is not None:
        sure = let(F.lower(norm_text(title)), lambda own: holds(own, keywords))
        labels = F.concat(labels, F.array(F.when(~sure, F.lit("uncertain"))))
    return F.array_compact(labels)
