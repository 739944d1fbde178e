"""URL filter: host rules, and pattern rules found through their rarest literal token.

The literal tokens that every URL a pattern matches must hold as whole tokens are read off
the pattern itself.  The rule is filed under whichever of them is rarest among all URLs of
the table, so the tokens of a URL fetch the few rules that could match, and only those run
their regular expression.  A pattern without such a token is a candidate of every URL.

A few rules are carried in the plan; many are a table that meets the tokens of the distinct URLs in a join.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bounded_broadcast, cut, fresh

# Host rules in the order given, (action, host, path).
HOST_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def _closing(pattern: str, at: int) -> int:
    """Place after the group, class, or single character that begins at ``at``; -1 if it isn't understood."""
    c = pattern[at]
    if c == "\\":
        return at + 2 if at + 1 < len(pattern) else -1
    if c == "[":
        found = re.compile(r"\[\^?\]?(?:\\.|[^\]\[\\])*\]").match(pattern, at)
        return found.end() if found else -1
    if c == "(":
        depth, here = 0, at
        while 0 <= here < len(pattern):
            if pattern[here] in "()":
                depth += 1 if pattern[here] == "(" else -1
                here += 1
                if not depth:
                    return here
            else:
                here = _closing(pattern, here)
        return -1
    return at + 1


#: A character class of single characters, none a letter or digit; a dash stands first or last.
_MARKS = re.compile(r"\[-?(?:\\[^\w\s]|[^\w\\\]\[^&-])+(?:(?:&(?!&)))?-?\]|\[(?:[?&]){1,2}\]", re.ASCII)


def _marks_only(piece: str) -> bool:
    """Whether a class holds only ASCII characters that aren't letters or digits."""
    return piece.isascii() and bool(_MARKS.fullmatch(piece))


@functools.cache
def whole_tokens(pattern: str) -> tuple[str, ...]:
    """Lower-case letter-digit runs that stand as whole tokens in every text ``pattern`` matches.

    Only what stands at the pattern's top level counts.  A run is whole if on both sides
    stands the pattern's anchor, or a piece that must match and can match nothing but a mark.
    An optional piece between is passed over if it is a mark or ends (begins) in one.
    Whatever isn't understood, such as alternatives at the top level, ends a run and may hold
    letters, so it takes tokens away and never adds one.
    """
    flag = re.match(r"\(\?i\)", pattern)
    pieces, at = [], flag.end() if flag else 0
    if re.search(r"\(\?[a-zA-Z-]|\\[^\W_dDwWsSbBnrt]", pattern[at:], re.ASCII):  # flags, quotes, named parts
        return ()
    while at < len(pattern):
        end = _closing(pattern, at)
        if end < 0:
            return ()
        piece = pattern[at:end]
        times = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?").match(pattern, end)
        if piece == "|":
            return ()
        pieces.append((piece, times.group() if times else ""))
        at = times.end() if times else end

    def side(piece: str, last: bool) -> str:
        """What a piece shows at its end (or beginning): a mark, a word character, or anything."""
        if piece in ("^", "$"):
            return "mark"
        if piece.startswith("["):
            return "mark" if _marks_only(piece) else "any"
        if piece.startswith("("):
            inner = piece[3:-1] if piece.startswith("(?:") else piece[1:-1]
            if inner.startswith("?") or not inner:
                return "any"
            parts, here = [], 0
            while here < len(inner):
                end = _closing(inner, here)
                if end < 0 or inner[here] == "|":
                    return "any"
                parts.append(inner[here:end])
                here = end
            edge = parts[-1] if last else parts[0]
            follows = parts[1] if len(parts) > 1 else ""
            return "any" if edge in ("*", "+", "?", "}") or (not last and follows[:1] in ("*", "?", "{")) else side(edge, last)
        if piece.startswith("\\"):
            return "mark" if piece[1].isascii() and not piece[1].isalnum() else "any"
        if piece.isascii() and piece.isalnum():
            return "word"
        return "mark" if piece.isascii() and piece not in (".", "*", "+", "?", "{", "}", ")") else "any"

    def bounded(place: int, step: int) -> bool:
        place += step
        while 0 <= place < len(pieces):
            piece, times = pieces[place]
            if side(piece, step < 0) != "mark":
                return False
            if not times.startswith(("*", "?", "{0")):
                return True
            place += step
        return False

    found, start = [], None
    for place, (piece, times) in enumerate([*pieces, ("", "")]):
        word = len(piece) == 1 and side(piece, True) == "word" and not times
        if word and start is None:
            start = place
        elif not word and start is not None:
            if bounded(start, -1) and bounded(place - 1, 1):
                found.append("".join(p for p, _ in pieces[start:place]).lower())
            start = None
    return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class PatternRule:
    """A rule of an action (block or allow) and the regular expression that it is for."""

    action: str
    pattern: str

    @property
    def tokens(self) -> tuple[str, ...]:
        return whole_tokens(self.pattern)


PATTERN_RULES = (
    PatternRule("block", r"(?i)^https?://([^/?#]*[.-])?ads-track\."),
    PatternRule("block", r"(?i)^https?://([^/?#]*\.)?cheap-pills\."),
    PatternRule("block", r"(?i)^https?://([^/?#]*\.)?free-bets\."),
    PatternRule("block", r"(?i)^https?://([^/?#]*\.)?spam-farm\."),
    PatternRule("block", r"(?i)[/.-]casino[/.-]"),
    PatternRule("block", r"(?i)[/.-]xxx[/.-]"),
    PatternRule("block", r"(?i)[?&]affiliate=[^&#]*"),
    PatternRule("block", r"(?i)/wp-login\.php([?#]|$)"),
    PatternRule("block", r"(?i)/redirect\?.*url=https?%3a"),
    PatternRule("allow", r"(?i)^https?://([^/?#]*\.)?spam-farm\.[^/?#]+/(about|privacy)([/?#]|$)"),
)
#: Most rules that are carried inside the plan as literals; more are a table.
MAX_RULES = 2_000

TOKEN = r"[^a-z0-9]+"


def tokens(url: Column) -> Column:
    """Distinct lower-case letter-digit runs of a URL (A-Z lower-cased with the rest)."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(url, F.lit(""))), TOKEN), ""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = HOST_RULES) -> Column:
    """``struct(rule, action)`` of the longest rule that fits, null if none does.

    Of rules of one length the first listed wins.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    hits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action")),
        )
        for action, h, p in ordered
    ]
    return F.coalesce(*hits) if hits else F.lit(None).cast("struct<rule:string,action:string>")


def rare_tokens(pages: DataFrame, rules: Sequence[PatternRule], url_col: str = "url") -> dict[str, list[int]]:
    """Rule numbers by the rarest of their tokens, counted over all URLs; under ``""`` those without any.

    The counts are of the rules' own tokens, combined before the shuffle, so as many rows
    as the rules have tokens come back.  Ties go to the longer token, then by its letters.
    """
    named = sorted({t for rule in rules for t in rule.tokens})
    found = pages.select(F.explode(F.array_intersect(tokens(F.col(url_col)), F.lit(named).cast("array<string>"))).alias("t"))
    seen = {row["t"]: row["n"] for row in found.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()} if named else {}
    index: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        least = min(rule.tokens, key=lambda t: (seen.get(t, 0), -len(t), t), default="")
        index.setdefault(least, []).append(number)
    return index


def candidates(url: Column, rules: Sequence[PatternRule], index: dict[str, list[int]]) -> Column:
    """The rules that the URL's tokens fetch from the index, and those of no token: ``array<struct<action, pattern>>``."""

    def filed(numbers: Sequence[int]) -> Column:
        return F.array(*[F.struct(F.lit(rules[n].action).alias("action"), F.lit(rules[n].pattern).alias("pattern")) for n in numbers])

    always = filed(index.get("", ())).cast("array<struct<action:string,pattern:string>>")
    named = {token: numbers for token, numbers in index.items() if token}
    if not named:
        return always
    files = F.map_from_arrays(F.array(*[F.lit(token) for token in named]), F.array(*[filed(numbers) for numbers in named.values()]))
    present = F.array_intersect(tokens(url), F.array(*[F.lit(token) for token in named]))
    return F.concat(F.flatten(F.transform(present, lambda t: F.element_at(files, t))), always)


def _fires(action: str, text: Column) -> Callable[[Column], Column]:
    return lambda rule: (rule["action"] == action) & F.rlike(text, rule["pattern"])


def hits_by_table(pages: DataFrame, rules: Sequence[PatternRule], url_col: str = "url") -> DataFrame:
    """``(hit_url, block, allow)``: the distinct URLs for which some rule with a token fires, and of which actions.

    Tokens of URLs meet a table of all rules' tokens to be counted, then each rule under its rarest one, and only what
    meets runs a regular expression.  Ties go to the longer token, then by its letters, as in ``rare_tokens``.
    """
    spark = pages.sparkSession
    named = [(i, r.action, r.pattern, t) for i, r in enumerate(rules) for t in r.tokens]
    filed = cut(spark.createDataFrame(named, "rule long, action string, pattern string, token string"))
    urls = pages.select(F.coalesce(F.col(url_col), F.lit("")).alias("hit_url")).distinct()
    held = cut(urls.select("hit_url", F.explode(tokens(F.col("hit_url"))).alias("token")).join(bounded_broadcast(cut(filed.select("token").distinct())), "token"))
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token")
    rarest = filed.join(counts, "token", "left").groupBy("rule", "action", "pattern").agg(F.min(rank).alias("r"))
    index = bounded_broadcast(cut(rarest.select("action", "pattern", F.col("r.token").alias("token"))))
    fired = held.join(index, "token").filter(F.rlike("hit_url", F.col("pattern")))
    return fired.groupBy("hit_url").agg(F.max(F.col("action") == "block").alias("block"), F.max(F.col("action") == "allow").alias("allow"))


def judge(
    pages: DataFrame,
    url_col: str = "url",
    host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
) -> DataFrame:
    """All columns and ``host``, ``path``, ``rule``, ``verdict``; only columns of those names are replaced.

    The verdict is the host rule's, else that of the pattern rules.  A null URL, or one
    without ``://``, has an empty host and path, no rule, and is judged by its tokens
    alone.  Rows map one to one, repeated ones too; no pages give no rows.  More than ``MAX_RULES``
    pattern rules with a token are looked up by a join (``hits_by_table``); those without one must run on every URL
    and are carried in slices of that size.
    """
    url = F.col(url_col)
    host, path, rule = (fresh(pages, name) for name in ("host_", "path_", "rule_"))
    out = pages.withColumns({host: host_of(url), path: path_of(url)})
    out = out.withColumn(rule, host_rule(F.col(host), F.col(path), host_rules))
    text = F.coalesce(url, F.lit(""))
    hit = {"block": F.lit(False), "allow": F.lit(False)}
    own = []
    carried = list(pattern_rules)
    if len(pattern_rules) > MAX_RULES:
        filed = [r for r in pattern_rules if r.tokens]
        carried = [r for r in pattern_rules if not r.tokens]
        names = {c: fresh(out, f"{c}_hit_") for c in ("hit_url", *hit)}
        found = hits_by_table(pages, filed, url_col).withColumnsRenamed(names)
        out = out.join(found, text == F.col(names["hit_url"]), "left")
        hit = {action: F.coalesce(F.col(names[action]), F.lit(False)) for action in hit}
    for at in range(0, len(carried), MAX_RULES):
        part = carried[at : at + MAX_RULES]
        own.append(fresh(out, f"rules_{at}_"))
        out = out.withColumn(own[-1], candidates(url, part, rare_tokens(pages, part, url_col)))
        for action in hit:
            hit[action] = hit[action] | F.exists(own[-1], _fires(action, text))
    method = F.when(hit["block"] & ~hit["allow"], "block").otherwise("allow")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(
        *[F.col(f"`{c}`") for c in kept], F.col(host).alias("host"), F.col(path).alias("path"),
        F.col(f"{rule}.rule").alias("rule"), F.coalesce(F.col(f"{rule}.action"), method).alias("verdict"),
    )
