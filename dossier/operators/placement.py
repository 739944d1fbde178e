"""Where people of a joint directory belong: kinds of evidence in order, decisions by hand over them, several places a person."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.identity import normalize_url
from dossier.functions.text import let, norm_text
from dossier.operators.graph import cut

# Words of recruiting, of a post, what breaks off the way to one, what joins colleges in a list, and how statuses are called.
RECRUITS, RECRUITED = "招收", "招收|招生|报考"
POSTS = "教授|副教授|讲师|导师|院长|任职|就职|工作至今"
BREAKS = "取得|毕业|学位|学院"
JOINS = r"、，,/与和\s"
CONFIRMED, BY_HAND, PENDING = "官方确认", "人工确认", "待复核"
METHODS = {"department": "官方组织机构内设系别", "profile": "导师主页明确表述", "hand": "本地人工复核", "directory": "联合导师名录待复核"}
SHOWN = 100


@dataclass(frozen=True)
class Joint:
    """Colleges by target that share a directory, the one to which ``departments`` belong, and a name that stands for several of them."""

    school: str
    colleges: Mapping[str, str]
    home: str
    departments: Sequence[str] = ()
    short: Sequence[str] = ()
    merged: str = ""
    merged_targets: Sequence[str] = field(default=())


def snippet(text: Column, needle: str, around: int = SHOWN) -> Column:
    """What stands up to ``around`` characters before and behind the first ``needle``; empty without one."""
    at = F.locate(needle, text)
    first = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, norm_text(F.substring(text, first, at - first + len(needle) + around))).otherwise("")


def _holds(text: Column, words: str) -> Column:
    """Whether a text has one of the words of a pattern that only lists them."""
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words.split("|")])


def profile_evidence(text: Column, joint: Joint, target: str) -> Column:
    """``struct<step, evidence>`` for one target, null without any; the first step that applies decides.

    1 recruits for the college, 2 has a post there, 3 has one in a list of colleges that names it, 4 the name that stands for several.
    """
    name = joint.colleges[target]
    q = re.escape(name)
    # Plain searches for what the first three steps need go before their patterns.
    named, recruits, post = F.contains(text, F.lit(name)), _holds(text, RECRUITED), _holds(text, POSTS)
    listed = "|".join(map(re.escape, [*joint.colleges.values(), *joint.short]))
    lists = F.regexp_extract_all(text, F.lit(f"{re.escape(joint.school)}(?:{listed}|[{JOINS}]){{2,100}}(?:{POSTS})"), F.lit(0))
    steps = [
        (named & recruits & F.rlike(text, F.lit(f"{RECRUITS}.{{0,100}}{q}|{q}.{{0,100}}(?:{RECRUITED})")), name),
        (named & post & F.rlike(text, F.lit(f"{q}(?:(?!{BREAKS}).){{0,40}}(?:{POSTS})")), name),
        (named & post & F.exists(lists, lambda found: F.contains(found, F.lit(name))), name),
        (F.contains(text, F.lit(joint.merged)) if joint.merged and target in joint.merged_targets else F.lit(False), joint.merged),
    ]
    return F.coalesce(*[F.when(holds, F.struct(F.lit(i).alias("step"), snippet(text, needle).alias("evidence"))) for i, (holds, needle) in enumerate(steps, 1)])


def placed(people: DataFrame, by: str, joint: Joint, overrides: DataFrame | None = None) -> DataFrame:
    """``by``, ``target``, ``status``, ``method``, ``step``, ``evidence``, ``source``: a row for each place of each person.

    ``people``: ``by`` (each once), ``name``, ``url``, ``department``, ``profile``.  A department of the home college confirms it (step 0);
    profile evidence (steps 1 to 4) replaces that; what was decided by hand (step 5) replaces either; who has nothing
    awaits review under the home college (step 6).  ``overrides``: ``seq``, ``name``, ``url`` (one may be missing, which then fits anyone),
    ``targets``, ``status``, ``evidence``, ``sources``; of several for one place the last by ``seq`` counts, targets that aren't known and
    overrides that name no one go.  They are met by address or name, never all with all.
    """
    who = people.select(by, norm_text("name").alias("name"), normalize_url(F.col("url")).alias("url"), norm_text("url").alias("page"), norm_text("department").alias("department"), norm_text("profile").alias("profile"))
    stated = F.when(F.col("department").isin(*joint.departments), F.struct(F.lit(joint.home).alias("target"), F.lit("department").alias("kind"), F.lit(0).alias("step"), F.col("department").alias("evidence")))
    found = [profile_evidence(F.col("profile"), joint, t) for t in joint.colleges]

    def said(target: str) -> Callable[[Column], Column]:
        return lambda e: F.when(e.isNotNull(), F.struct(F.lit(target).alias("target"), F.lit("profile").alias("kind"), e["step"].alias("step"), e["evidence"].alias("evidence")))

    told = [let(e, said(t)) for t, e in zip(joint.colleges, found, strict=True)]
    rows = who.select(by, "page", F.inline(F.array_compact(F.array(stated, *told))))
    rows = rows.select(by, "target", F.lit(CONFIRMED).alias("status"), "kind", "step", "evidence", F.col("page").alias("source"), F.lit(0).cast("long").alias("seq"))
    if overrides is not None:
        text = lambda c: norm_text(F.col(c))
        given = overrides.select("seq", text("name").alias("n_"), normalize_url(F.col("url")).alias("u_"), "targets", text("status").alias("s_"), text("evidence").alias("e_"), F.array_join("sources", "; ").alias("f_"))
        given = given.withColumn("target", F.explode("targets")).drop("targets").filter(F.col("target").isin(*joint.colleges))
        # Of overrides that fit the same people only the last counts, so people meet one for each target.
        given = given.groupBy("n_", "u_", "target").agg(F.max_by(F.struct("s_", "e_", "f_"), "seq").alias("g"), F.max("seq").alias("seq")).select("n_", "u_", "target", "g.*", "seq")
        by_page = who.filter("url <> ''").join(given.filter("u_ <> ''"), (F.col("url") == F.col("u_")) & ((F.col("n_") == "") | (F.col("n_") == F.col("name"))))
        by_name = who.join(given.filter("u_ = '' AND n_ <> ''"), F.col("name") == F.col("n_"))
        hand = by_page.unionByName(by_name).select(
            by, "target", F.coalesce(F.nullif("s_", F.lit("")), F.lit(BY_HAND)).alias("status"), F.lit("hand").alias("kind"), F.lit(5).alias("step"), F.col("e_").alias("evidence"), F.coalesce("f_", F.lit("")).alias("source"),
            F.col("seq").cast("long").alias("seq"),
        )
        rows = rows.unionByName(hand)
    # Written, as it is read twice: for what it says and for who is left.
    last = cut(rows.groupBy(by, "target").agg(F.max_by(F.struct("status", "kind", "step", "evidence", "source"), F.struct("step", "seq")).alias("a")).select(by, "target", "a.*"))
    settled = last.select(F.col(by).alias("by_")).distinct()
    left = who.join(settled, F.col(by).eqNullSafe(F.col("by_")), "left_anti")
    waiting = left.select(by, F.lit(joint.home).alias("target"), F.lit(PENDING).alias("status"), F.lit("directory").alias("kind"), F.lit(6).alias("step"), F.lit("").alias("evidence"), F.col("page").alias("source"))
    methods = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])
    return last.unionByName(waiting).select(by, "target", "status", methods[F.col("kind")].alias("method"), "step", "evidence", "source")
