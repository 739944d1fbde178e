"""Evidence-gated ranking: six sources to one score, a level, reasons and warnings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import norm_text
from dossier.operators.scoring import Profile, direction_groups, institute_bonus, matched_terms, score

# Fixed values of the ranking policy: thresholds, levels, and for each source the coefficient
# and cap of its score.
CONSIDER, STRONG = 24, 44
OFFICIAL_CAP = 80
LEVELS = ("强烈建议", "可以考虑", "暂不优先")
SOURCES = {"dblp": (0.45, 24), "publication": (0.35, 18), "arxiv": (0.2, 10), "web": (0.18, 8), "web_search": (0.15, 6)}
CUE = (
    r"(?i)研究方向|研究兴趣|研究领域|主要从事|主要聚焦|当前主要|research interests?|research focuses?|focus(?:ed|es)? on"
)
# What is said when a source counts, and when it was held back.
SAID = {
    "dblp": ("高置信DBLP近三年论文增强了已确认的核心方向", "DBLP存在相关词，但身份置信度或官方核心锚点不足，未计入排名"),
    "publication": ("经身份消歧确认的近年数学论文增强了官网核心方向", "数学论文存在相关词，但作者身份或官方核心锚点不足，未计入排名"),
    "arxiv": ("经身份交叉确认的arXiv论文提供补充证据", "arXiv仅按姓名或方向命中，未作为作者身份确认或排名依据"),
    "web": ("已知教师或个人主页补充了核心方向证据", None),
    "web_search": ("人工确认的WebSearch来源提供补充证据", "自动WebSearch仅用于发现来源，未直接影响排名"),
}
EXCLUDED = "教师当前方向命中画像明确排除的方向，且缺少更高优先级核心锚点"
NO_ANCHOR = "官方名录、教师主页或官方PDF中缺少当前画像的显式核心方向锚点"
TOO_WEAK = "虽有核心方向词，但当前证据强度尚未达到优先名单门槛"
ONE_GROUP = "当前命中集中在单一画像方向组且缺少可信辅助证据，暂不提升为强烈建议"


def half_even(value: Column) -> Column:
    """Rounding to a whole number, halves to the even one."""
    return F.bround(value, 0).cast("int")


def source_score(raw: Column, source: str, trusted: Column) -> Column:
    """A source's part of the score: its share of the raw score up to its cap, zero unless trusted."""
    share, cap = SOURCES[source]
    return F.when(trusted, F.least(half_even(raw * F.lit(share)), F.lit(cap))).otherwise(F.lit(0))


def source_states(value: Column) -> Column:
    """States named in ``official:success/high; zbmath:no_record``, lower-cased."""

    def state(part: Column) -> Column:
        after = F.when(F.instr(part, ":") > 0, F.call_function("substring", part, F.instr(part, ":") + 1, F.length(part))).otherwise(part)
        return F.lower(F.trim(F.substring_index(after, "/", 1)))

    parts = F.filter(F.transform(F.split(norm_text(value), ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, state))


def decide(total: Column, anchored: Column, excluded: Column, grouped: Column) -> Column:
    """``struct<score, level, can_contact>`` by the decision table.

    Without an anchor the score stays below the first threshold; the highest level asks for
    evidence from two direction groups or a trusted second source (``grouped``).
    """
    held = F.when(anchored, total).otherwise(F.least(total, F.lit(CONSIDER - 1)))
    level = (
        F.when(~anchored, LEVELS[2])
        .when((held >= STRONG) & grouped, LEVELS[0])
        .when(held >= CONSIDER, LEVELS[1])
        .otherwise(LEVELS[2])
    )
    return F.struct(held.alias("score"), level.alias("level"), F.when(level == LEVELS[2], "否").otherwise("是").alias("can_contact"))


def level_rank(level: Column) -> Column:
    out = F.lit(9)
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, i).otherwise(out)
    return out


def cue_excerpts(bio: Column, most: int = 600) -> Column:
    """Each sentence of a biography that speaks of directions, with the one after it."""
    sentences = F.split(norm_text(bio), r"(?<=[。！？.!?；;])\s*")
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(sentences) - 1),
        lambda i: F.when(
            F.rlike(F.get(sentences, i), F.lit(CUE)), F.left(F.array_join(F.slice(sentences, i + 1, 2), " "), F.lit(most))
        ),
    )
    return F.array_join(F.array_compact(pairs), " ")


@dataclass(frozen=True)
class Columns:
    """Names of the columns of evidence; those that a table lacks count as empty."""

    explicit: tuple[str, ...] = ("direction", "registry_direction", "team_evidence")
    bio: str = "bio"
    institutes: tuple[str, ...] = ("directory_institute", "homepage_institute", "department")
    texts: Mapping[str, tuple[str, ...]] = None

    def text_of(self, source: str) -> tuple[str, ...]:
        given = self.texts or {
            "dblp": ("dblp_keywords", "dblp_titles"),
            "publication": ("publication_keywords", "publication_titles", "publication_classes"),
            "arxiv": ("arxiv_keywords", "arxiv_titles"),
            "web": ("web_keywords", "web_evidence"),
            "web_search": ("web_search_keywords", "web_search_evidence"),
        }
        return given[source]


def rank(people: DataFrame, profile: Profile, columns: Columns = Columns()) -> DataFrame:
    """All columns and the decision for each row.

    Adds ``score``, ``level``, ``can_contact``, ``explicit_anchor``, ``matched_keywords``,
    ``matched_direction_groups``, ``reasons``, ``warnings`` and a sub-score for each source.
    Besides texts it reads ``dblp_confidence``, ``publication_confidence``,
    ``publication_status``, ``arxiv_confidence``, ``web_status``, ``web_search_confidence``
    and ``web_search_status``.  Projections only, without a join or shuffle; what is read
    several times is worked out once, as a column of its own.
    """

    def col(name: str) -> Column:
        return norm_text(F.col(name).cast("string")) if name in people.columns else F.lit("")

    def joined(names: tuple[str, ...]) -> Column:
        return F.concat_ws(" ", *[col(n) for n in names])

    low = lambda name: F.lower(col(name))
    trust = {
        "dblp": low("dblp_confidence") == "高",
        "publication": low("publication_confidence").isin("high", "medium", "高", "中")
        & F.array_contains(source_states(low("publication_status")), "success"),
        "arxiv": low("arxiv_confidence").isin("高", "中-dblp交叉确认"),
        "web": col("web_status") == "已抓取",
        "web_search": F.startswith(col("web_search_status"), F.lit("人工确认")) & col("web_search_confidence").isin("高", "中"),
    }
    given = people.withColumns({"__bio": col(columns.bio), "__explicit": joined(columns.explicit), "__institutes": joined(columns.institutes)})
    explicit = F.concat_ws(" ", "__explicit", cue_excerpts(F.col("__bio")))
    official = F.concat_ws(" ", "__explicit", "__bio", "__institutes")
    out = given.withColumns(
        {
            "__core": F.array_sort(matched_terms(F.lower(explicit), profile.core)),
            "__excluded": F.array_sort(matched_terms(F.lower(official), profile.excluded)),
            "__official": score(official, profile),
            "__bonus": institute_bonus(F.col("__institutes"), profile),
            **{f"__{s}": score(joined(columns.text_of(s)), profile, 8 if s == "publication" else 4) for s in SOURCES},
            **{f"__trust_{s}": trust[s] for s in SOURCES},
        }
    )
    anchored = F.size("__core") > 0
    trust = {s: F.col(f"__trust_{s}") for s in SOURCES}
    bonus = F.when(anchored, F.col("__bonus.bonus")).otherwise(0)
    out = out.withColumn("score_official", F.least(F.col("__official.score") + bonus, F.lit(OFFICIAL_CAP)))
    out = out.withColumns({f"score_{s}": source_score(F.col(f"__{s}.score"), s, anchored & trust[s]) for s in SOURCES})
    matched = F.array_distinct(
        F.concat(
            F.col("__official.keywords"),
            F.col("__bonus.keywords"),
            *[F.when(anchored & trust[s], F.col(f"__{s}.keywords")).otherwise(F.array().cast("array<string>")) for s in SOURCES],
        )
    )
    out = out.withColumn("matched_keywords", matched)
    out = out.withColumn("matched_direction_groups", direction_groups(F.col("matched_keywords"), profile))
    second = sum((F.col(f"score_{s}") for s in SOURCES), F.lit(0))
    grouped = F.lit(not profile.direction_groups) | (F.size("matched_direction_groups") >= 2) | (second > 0)
    excluded = F.size("__excluded") > 0
    total = F.col("score_official") + second
    out = out.withColumn("__d", decide(total, anchored, excluded, grouped))
    held = F.col("__d.score")
    terms = F.array_join(F.slice("__core", 1, 4), "; ")
    strong = anchored & (held >= STRONG) & grouped
    first = F.when(strong, F.concat(F.lit("官方方向明确命中核心方向："), terms)).when(
        anchored & (held >= CONSIDER), F.concat(F.lit("官方方向命中核心方向："), terms)
    )
    counted = [F.when(F.col(f"score_{s}") > 0, F.lit(SAID[s][0])) for s in SOURCES]
    last = (
        F.when(~anchored & excluded, EXCLUDED)
        .when(~anchored, NO_ANCHOR)
        .when(held < CONSIDER, TOO_WEAK)
        .when((held >= STRONG) & ~grouped, ONE_GROUP)
    )
    held_back = [
        F.when(~(anchored & trust[s]) & (F.col(f"__{s}.score") > 0), F.lit(SAID[s][1])) for s in SOURCES if SAID[s][1]
    ]
    warned = F.when(excluded, F.concat(F.lit("当前画像排除方向命中："), F.array_join(F.slice("__excluded", 1, 4), "; ")))
    return out.withColumns(
        {
            "score": held,
            "level": F.col("__d.level"),
            "can_contact": F.col("__d.can_contact"),
            "explicit_anchor": anchored,
            "reasons": F.array_distinct(F.array_compact(F.array(first, *counted, last))),
            "warnings": F.array_distinct(F.array_compact(F.array(warned, *held_back))),
        }
    ).drop("__core", "__excluded", "__official", "__bonus", "__d", "__bio", "__explicit", "__institutes", *[f"__{s}" for s in SOURCES], *[f"__trust_{s}" for s in SOURCES])


def in_order(ranked: DataFrame, tie: str) -> DataFrame:
    """Rows by level, score from the highest, and a column that breaks ties."""
    return ranked.orderBy(level_rank(F.col("level")), F.col("score").desc_nulls_last(), F.col(tie).asc_nulls_last())


def priority_list(ranked: DataFrame) -> DataFrame:
    return ranked.filter(F.col("can_contact") == "是")
