"""Rows of an earlier output: their columns under the names of today, evidence laid back over new rows, and what of them must be ranked again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.names import unused
from dossier.functions.text import norm_text
from dossier.operators.graph import cut
from dossier.operators.ranking import Columns, rank
from dossier.operators.scoring import Profile

# The columns of an output's sheet and what ranking calls them.
SHEET = {
    "研究方向": "direction", "导师信息库研究方向": "registry_direction", "团队PDF证据": "team_evidence", "个人简介摘要": "bio",
    "名录研究所": "directory_institute", "主页研究所": "homepage_institute", "官方系别": "department",
    "DBLP匹配置信度": "dblp_confidence", "DBLP近三年关键词": "dblp_keywords", "DBLP近三年代表论文": "dblp_titles",
    "学术作者匹配状态": "publication_status", "学术作者匹配置信度": "publication_confidence", "近五年关键词": "publication_keywords", "近五年代表论文": "publication_titles",
    "主要数学分类": "publication_classes", "arXiv置信度": "arxiv_confidence", "arXiv关键词": "arxiv_keywords", "网页状态": "web_status", "网页关键词": "web_keywords",
    "网页近三年/发表证据": "web_evidence", "WebSearch状态": "web_search_status", "WebSearch置信度": "web_search_confidence", "WebSearch关键词": "web_search_keywords",
    "WebSearch代表证据": "web_search_evidence",
}
WEB_SEARCH = ("web_search_status", "web_search_confidence", "web_search_keywords", "web_search_evidence")
RESULTS = ("score", "level", "can_contact", "explicit_anchor", "matched_keywords", "matched_direction_groups", "reasons", "warnings")


def from_sheet(rows: DataFrame) -> DataFrame:
    """Rows of a sheet under the names of ranking; a column that is there under both names keeps its sheet's values where they say something."""
    renamed = {}
    for old, new in SHEET.items():
        if old in rows.columns:
            own = F.when(norm_text(F.col(f"`{old}`").cast("string")) != "", F.col(f"`{old}`"))
            renamed[new] = F.coalesce(own, F.col(new)) if new in rows.columns else F.col(f"`{old}`")
    return rows.withColumns(renamed).drop(*SHEET)


def to_sheet(rows: DataFrame) -> DataFrame:
    """The other way round."""
    return rows.withColumnsRenamed({new: old for old, new in SHEET.items() if new in rows.columns})


def rank_sheet(rows: DataFrame, profile: Profile) -> DataFrame:
    """A sheet's rows ranked anew from its own columns, still under the sheet's names; the titles of preprints are not among them."""
    return to_sheet(rank(from_sheet(rows).drop("arxiv_titles"), profile))


def restored(rows: DataFrame, previous: DataFrame, key: str, columns: Sequence[str] = WEB_SEARCH) -> DataFrame:
    """``rows`` with ``columns`` as the ``previous`` output has them under the same key (each once), and ``found`` and ``changed``.

    All ``columns`` of a row that is found are the earlier ones, empty where those are null; other rows
    keep their own, empty ones if ``rows`` lacks a column.  ``changed`` says that one differs from before.
    """
    p = unused(rows, previous)
    old = F.struct(*[(F.col(c) if c in previous.columns else F.lit(None)).cast("string").alias(c) for c in columns])
    told = previous.filter(F.col(key).isNotNull()).select(F.col(key).alias(f"{p}key"), old.alias(f"{p}old"))
    out = rows.join(told, F.col(key) == F.col(f"{p}key"), "left")
    found = F.col(f"{p}old").isNotNull()
    own = {c: F.col(c).cast("string") if c in rows.columns else F.lit("") for c in columns}
    new = {c: F.when(found, F.coalesce(F.col(f"{p}old.{c}"), F.lit(""))).otherwise(own[c]) for c in columns}
    differs = F.lit(False)
    for c in columns:
        differs |= F.coalesce(new[c], F.lit("")) != F.coalesce(own[c], F.lit(""))
    return out.withColumns({"found": found, "changed": differs}).withColumns(new).drop(f"{p}key", f"{p}old")


def rank_restored(ranked: DataFrame, previous: DataFrame, key: str, profile: Profile, columns: Columns = Columns()) -> DataFrame:
    """``ranked`` rows with the earlier output's search evidence, and ranked again where that changed anything.

    Rows whose evidence stays keep their results as they are, so only changed rows pay for ranking;
    ``level_before`` keeps the level that a row came with.  One join on the key, and no other shuffle; its rows
    are written, as both kinds are read from them and would else be ranked twice.
    """
    rows = cut(restored(ranked.withColumn("level_before", F.col("level")), previous, key))
    scores = [c for c in rows.columns if c.startswith("score_")]
    again = rank(rows.filter("changed").drop(*RESULTS, *scores), profile, columns)
    return rows.filter("NOT changed").unionByName(again.select(*rows.columns))


def first_wins(rows: DataFrame, key: str, value: str, order: Sequence[Column]) -> DataFrame:
    """``(key, value)``: of each key the value with the smallest ``order``, then the smallest value; null keys and values go.

    A combined minimum, so a key that many rows share doesn't meet in one task.
    """
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))
    said = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    return said.groupBy(key).agg(F.min_by(value, at).alias(value))


def person_details(people: DataFrame, rows: DataFrame, id_col: str, name_col: str, url_col: str) -> DataFrame:
    """Detail ``rows`` of each of ``people``: those of the same id; where there are none, rows without an id under the person's name.

    By name a row counts if one of both has no address, or both have the same.  Ids, names and addresses are compared in normal
    form, null as empty; two empty names are one name.  Columns of ``rows`` get the prefix ``detail_``.
    """
    p = unused(people, rows)
    clean = lambda c: F.coalesce(norm_text(F.col(c).cast("string")), F.lit(""))
    who = people.withColumns({f"{p}i": clean(id_col), f"{p}n": clean(name_col), f"{p}u": clean(url_col)})
    own = rows.select(clean(id_col).alias(f"{p}di"), clean(name_col).alias(f"{p}dn"), clean(url_col).alias(f"{p}du"), *[F.col(c).alias(f"detail_{c}") for c in rows.columns])
    known = own.filter(F.col(f"{p}di") != "")
    by_id = who.filter(F.col(f"{p}i") != "").join(known, F.col(f"{p}i") == F.col(f"{p}di"))
    without = who.join(known.select(F.col(f"{p}di").alias(f"{p}k")).distinct(), (F.col(f"{p}i") != "") & (F.col(f"{p}i") == F.col(f"{p}k")), "left_anti")
    same_page = (F.col(f"{p}u") == "") | (F.col(f"{p}du") == "") | (F.col(f"{p}u") == F.col(f"{p}du"))
    by_name = without.join(own.filter(F.col(f"{p}di") == ""), (F.col(f"{p}n") == F.col(f"{p}dn")) & same_page)
    return by_id.unionByName(by_name).drop(f"{p}i", f"{p}n", f"{p}u", f"{p}di", f"{p}dn", f"{p}du")
