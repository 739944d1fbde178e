"""Runs and their stages: fingerprints, what a checkpoint still says, caches, gates."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from hashlib import sha256
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.names import unused
from dossier.functions.text import norm_text

# The columns whose content decides whether a saved result still holds.
MARKED = (
    "name", "profile_url", "personal_url", "email", "direction", "registry_direction", "team_evidence", "bio", "dblp_confidence", "dblp_url",
    "dblp_keywords", "dblp_titles", "publication_status", "publication_confidence", "author_id", "openalex_id", "zbmath_author_id", "seed_hash",
    "decision_hash", "source_report_hash", "works_hash", "publication_classes", "publication_keywords", "publication_titles",
)
OPTIONAL = "relevance_labels"
# Results that a cache may keep, and what stands in rows that weren't processed.
CACHEABLE = (
    "success", "no_record", "no_recent_record", "no_candidate", "identity_uncertain", "identity_confirmed", "identity_probable", "identity_rejected",
)
UNPROCESSED = "未深检索-时间/同名风险"
FIRST_PROFILE = "legacy-default"


@dataclass(frozen=True)
class Run:
    """What a stage ran with."""

    stage: str
    target: str
    profile_id: str = FIRST_PROFILE
    profile_hash: str = ""
    schema_version: int = 1
    policy_version: str = ""
    years: Sequence[str] = ()
    inputs: Mapping[str, str] = field(default_factory=dict)
    metadata: Mapping[str, object] = field(default_factory=dict)

    def settings(self) -> dict:
        """What a row's result depends on besides the row."""
        own = {
            "schema_version": self.schema_version, "policy_version": self.policy_version, "profile_hash": self.profile_hash,
            "profile_id": self.profile_id, "recent_years": list(self.years), "input_hashes": dict(self.inputs),
        }
        return own | ({"stage_metadata": dict(self.metadata)} if self.metadata else {})

    def fingerprint(self) -> str:
        return sha256(canonical(asdict(self)).encode()).hexdigest()


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def row_json(columns: Mapping[str, Column]) -> Column:
    """A row as canonical JSON: values normalised to strings, keys sorted."""
    return F.to_json(F.struct(*[norm_text(columns[c].cast("string")).alias(c) for c in sorted(columns)]))


def row_mark(rows: DataFrame, person: Column, run: Run) -> Column:
    """A hash of a person's row and of what the run's results depend on; absent columns are empty."""
    columns = {c: F.col(c) if c in rows.columns else F.lit("") for c in MARKED}
    if OPTIONAL in rows.columns:
        columns[OPTIONAL] = F.col(OPTIONAL)
    return F.sha2(F.concat_ws("\u001f", person, row_json(columns), F.lit(canonical(run.settings()))), 256)


def latest_checkpoints(saved: DataFrame, key: str, seq: str) -> DataFrame:
    """The last saved item of each key that names someone, as a combined maximum."""
    rest = [c for c in saved.columns if c not in (key, seq)]
    named = saved.filter(~norm_text(F.col(key)).isin("", "::"))
    last = named.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("t"))
    return last.select(key, *[F.col(f"t.{c}").alias(c) for c in (seq, *rest)])


def from_checkpoint(rows: DataFrame, saved: DataFrame, key: str, evidence: Mapping[str, Column]) -> DataFrame:
    """The latest rows with the evidence that checkpoints hold; those without any are marked as not processed.

    ``saved`` holds ``key`` once.  ``evidence``: for each column what stands in it where
    nothing is saved.
    """
    p = unused(rows, saved)
    held = saved.select(key, F.struct(*[F.col(c) for c in evidence]).alias(f"{p}e"))
    out = rows.drop(*evidence).join(held, key, "left")
    found = F.col(f"{p}e").isNotNull()
    return out.withColumns({c: F.when(found, F.col(f"{p}e.{c}")).otherwise(empty) for c, empty in evidence.items()}).drop(f"{p}e")


def saved_evidence(entries: Column, keywords: Column, texts: Column, snippets: Column, packed: Column) -> Column:
    """``struct<n_papers, years, keywords, snippets>`` rebuilt from a checkpoint's detail rows.

    Snippets of the detail rows go before those packed into one text; keywords as saved.
    """
    clean = F.filter(F.transform(F.coalesce(snippets, F.array().cast("array<string>")), norm_text), lambda s: s != "")
    unpacked = F.filter(F.transform(F.split(norm_text(packed), "；"), norm_text), lambda s: s != "")
    return F.struct(
        F.coalesce(F.size(entries), F.lit(0)).alias("n_papers"),
        F.coalesce(F.transform(entries, lambda e: F.left(norm_text(e), F.lit(4))), F.array().cast("array<string>")).alias("years"),
        F.coalesce(F.nullif(norm_text(keywords), F.lit("")), norm_text(texts)).alias("keywords"),
        F.when(F.size(clean) > 0, clean).otherwise(unpacked).alias("snippets"),
    )


def check_stage(stages: Mapping[str, Mapping[str, str]], stage: str, run: Run) -> None:
    """Raise RuntimeError if an earlier stage ran for another profile, or never for one other than the first."""
    before = stages.get(stage)
    if before is None:
        if run.profile_id != FIRST_PROFILE:
            raise RuntimeError(f"{stage} has not run for profile {run.profile_id}")
        return
    was = (before.get("profile_id") or FIRST_PROFILE, before.get("profile_hash") or "")
    if was != (run.profile_id, run.profile_hash):
        raise RuntimeError(f"the profile changed after {stage}: {was[0]} then, {run.profile_id} now")


def stage_states(stages: DataFrame, run: Run) -> DataFrame:
    """``(stage, state)`` of saved stages against a run: same, profile_changed or content_changed."""
    other = F.coalesce(F.nullif("profile_id", F.lit("")), F.lit(FIRST_PROFILE)) != run.profile_id
    changed = F.coalesce("profile_hash", F.lit("")) != run.profile_hash
    return stages.select("stage", F.when(other, "profile_changed").when(changed, "content_changed").otherwise("same").alias("state"))


def semantic_cache(rows: DataFrame, cache: DataFrame, keys: Sequence[str], status: str, values: Sequence[str], through: DataFrame | None = None) -> DataFrame:
    """Rows with what a cache holds for all of their ``keys`` (source, input hash, adapter version, window).

    Only entries of a cacheable status count, and one that is asked again, from a read-only
    second cache ``through``, only where the first has none.  ``origin`` tells which it was.
    """
    p = unused(rows, cache)
    layers = [("cache", cache)] + ([("through", through)] if through is not None else [])
    out = rows
    for name, layer in layers:
        own = layer.filter(F.col(status).isin(*CACHEABLE)).groupBy(*keys).agg(F.max(F.struct(status, *values)).alias(f"{p}{name}"))
        out = out.join(own, list(keys), "left")
    held = F.coalesce(*[F.col(f"{p}{name}") for name, _ in layers])
    origin = F.coalesce(*[F.when(F.col(f"{p}{name}").isNotNull(), F.lit(name)) for name, _ in layers], F.lit("miss"))
    return out.withColumn(f"{p}h", held).select(*rows.columns, origin.alias("origin"), *[F.col(f"{p}h.{c}").alias(c) for c in (status, *values)])


def input_hash(mode: str, version: str, columns: Mapping[str, Column]) -> Column:
    """The hash by which a result is looked up: mode, adapter version and the row's relevant fields."""
    return F.sha2(F.concat_ws("\u001f", F.lit(mode), F.lit(version), row_json(columns)), 256)


def stale_files(now: DataFrame, seen: DataFrame) -> DataFrame:
    """``(path, state)`` by signature of path, time and size: fresh, changed, new or gone."""
    before = seen.select("path", F.struct("modified", "size").alias("b"))
    both = now.select("path", F.struct("modified", "size").alias("n")).join(before, "path", "full")
    state = F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.col("n") == F.col("b"), "fresh").otherwise("changed")
    return both.select("path", state.alias("state"))


def check_shadow(path: str) -> str:
    """The path, if one of its folders is ``_shadow``; else ValueError."""
    if "_shadow" not in (part.lower() for part in PurePosixPath(path).parts):
        raise ValueError(f"not inside a folder named _shadow: {path}")
    return path


def provenance(spark, run: Run) -> DataFrame:  # noqa: ANN001
    """``(item, content)`` rows that tell what a result was made with."""
    items = {"stage": run.stage, "target": run.target, "fingerprint": run.fingerprint()} | run.settings()
    rows = [(k, v if isinstance(v, str) else canonical(v)) for k, v in sorted(items.items())]
    return spark.createDataFrame(rows, "item string, content string")
