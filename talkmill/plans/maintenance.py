"""The whole maintenance run: bring every derived table up to date, in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from talkmill.functions.embedding import EmbeddingProvider
from talkmill.operators.analytics import update_session_analytics
from talkmill.operators.chunks import reindex_stale
from talkmill.operators.dashboards import project_activity, theme_recurrence
from talkmill.operators.embeddings import backfill_embeddings, with_embeddings
from talkmill.operators.enrichment import enrich_projects, enrich_themes
from talkmill.operators.extraction import ExtractionProvider, assign_themes, extract_missing, extract_projects
from talkmill.operators.merging import candidate_list, recompute_candidates
from talkmill.operators.recommendations import (
    consolidation_candidates, generate_recommendations, revisit_candidates, rising_candidates, seed_recommendation,
    stalled_candidates,
)
from talkmill.schema import TABLES, empty_table
from talkmill.sources.store import TableStore

# The stages in order. "candidates" is a scan of its own and runs only when asked for.
STAGES = [
    "index", "embeddings", "projects", "themes", "analytics", "project_enrichment", "theme_enrichment", "candidates",
    "seed", "recommendations",
]


def apply_stage(
    stage: str, t: dict[str, DataFrame], as_of: Column, embedding: EmbeddingProvider | None, extraction: ExtractionProvider,
) -> dict[str, DataFrame]:
    """The tables that a stage changes, from all tables."""
    if stage == "index":
        chunks, batches = reindex_stale(
            t["import_batches"], t["sessions"], t["messages"], t["artifacts"], t["chunks"],
            embed=lambda c: with_embeddings(c, embedding),
        )
        return {"chunks": chunks, "import_batches": batches}
    if stage == "embeddings":
        return {"chunks": backfill_embeddings(t["chunks"], embedding)}
    if stage == "projects":
        found = extract_missing(t["sessions"], t["messages"], t["artifacts"], t["evidence_links"], as_of, extraction)
        return {"projects": t["projects"].unionByName(found.projects), "evidence_links": t["evidence_links"].unionByName(found.evidence)}
    if stage == "themes":
        themes, links = assign_themes(t["sessions"], t["messages"], t["themes"], t["evidence_links"], as_of)
        return {"themes": t["themes"].unionByName(themes), "evidence_links": t["evidence_links"].unionByName(links)}
    if stage == "analytics":
        return {"session_analytics": update_session_analytics(t["session_analytics"], t["sessions"], t["messages"], as_of)}
    if stage == "project_enrichment":
        return {"projects": enrich_projects(t["projects"], t["evidence_links"], t["sessions"], as_of)}
    if stage == "theme_enrichment":
        return {"themes": enrich_themes(t["themes"], t["evidence_links"], t["sessions"], as_of)}
    if stage == "candidates":
        return {"project_merge_candidates": recompute_candidates(t["projects"], as_of)}
    if stage == "seed":
        made = seed_recommendation(t["recommendations"], t["projects"], t["evidence_links"], t["sessions"], t["messages"], as_of)
    elif stage == "recommendations":
        candidates = t.get("project_merge_candidates", empty_table(t["sessions"].sparkSession, "project_merge_candidates"))
        made = generate_recommendations(
            [
                stalled_candidates(project_activity(t["projects"], t["evidence_links"], as_of)),
                consolidation_candidates(candidate_list(candidates, t["projects"])),
                rising_candidates(theme_recurrence(t["themes"], t["evidence_links"], as_of)),
                revisit_candidates(t["session_analytics"], t["sessions"], as_of),
            ],
            t["evidence_links"], t["recommendations"], as_of,
        )
    else:
        raise ValueError(f"unknown stage: {stage}")
    return {
        "recommendations": t["recommendations"].unionByName(made.recommendations),
        "evidence_links": t["evidence_links"].unionByName(made.evidence),
    }


def run_maintenance(
    tables: dict[str, DataFrame],
    as_of: Column,
    keep: Callable[[str, str, DataFrame], DataFrame],
    embedding: EmbeddingProvider | None = None,
    extraction: ExtractionProvider = extract_projects,
    recompute_merges: bool = False,
    stages: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Apply the stages to ``tables`` and return the new tables.

    ``keep(stage, table, df)`` stores a snapshot and returns it as read back, so each stage starts from stored rows.
    ``resume_maintenance`` goes on from the last finished stage.
    """
    t = dict(tables)
    for stage in STAGES:
        if stage in (stages or STAGES) and (recompute_merges or stage != "candidates"):
            for name, df in apply_stage(stage, t, as_of, embedding, extraction).items():
                t[name] = keep(stage, name, df)
    return t


def resume_maintenance(
    store: TableStore,
    run: str,
    as_of: Column,
    embedding: EmbeddingProvider | None = None,
    extraction: ExtractionProvider = extract_projects,
    recompute_merges: bool = False,
    stop_after: str | None = None,
) -> tuple[dict[str, DataFrame], list[str]]:
    """Run maintenance ``run`` over a store's tables, or the rest of it; the new tables, and the stages that this call ran.

    The journal is the store's log. The first entry fixes the version whose tables the run works on; each stage commits its
    tables in one entry, under names of their own. A call after a failure reads what finished stages wrote and runs the others
    from there, on the same tables, whatever was imported since. ``as_of`` must be that of the first call.
    """
    first = store.begin(f"{run}.start")
    if not store.committed(first.run):
        first.note = {"version": store.state()["version"]}
        first.commit()
    pinned = store.at(store.state()["runs"][first.run]["version"])
    t = {name: pinned.read(name) for name in TABLES}
    done = []
    for stage in STAGES:
        if stage == "candidates" and not recompute_merges:
            continue
        staged = store.begin(f"{run}.{stage}")
        if not store.committed(staged.run):
            changed = apply_stage(stage, t, as_of, embedding, extraction)
            for name, df in changed.items():
                staged.write(f"maintained_{name}", df)
            staged.note = {"tables": sorted(changed)}
            staged.commit()
            done.append(stage)
        for name in store.state()["runs"][staged.run]["tables"]:
            t[name] = store.read(f"maintained_{name}", run=staged.run)
        if stage == stop_after:
            break
    return t, done
