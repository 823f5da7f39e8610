"""Corporate-action events grouped from titles, and the timelines of event chains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketry import vocab
from docketry.functions import text as tx
from docketry.functions.actions import ActionVocabulary, action_facts, effect_states, unresolved
from docketry.operators.classify import literal_rows


def action_events(findings: DataFrame, words: ActionVocabulary = ActionVocabulary(), keep_ids: int = 20) -> DataFrame:
    """Events per company by (subject, family): stages, effects, document count, the first ids, effect states.

    Input: code, id, title. Sets are bounded by the vocabulary; the first ids come from a rank limit that is
    applied before the shuffle, so a group of any size stays cheap.
    """
    facts = findings.withColumn("f", action_facts("title", words)).select(
        "code", "id", "f.subject", "f.family", "f.stage", "f.effects", "f.needs_document"
    )
    keys = ["code", "subject", "family"]
    # One row per combination first: stages and effect lists repeat across almost all rows.
    combos = facts.groupBy(*keys, "stage", "effects").agg(
        F.count("id").alias("documents"), F.max("needs_document").alias("needs_document")
    )
    groups = combos.groupBy(*keys).agg(
        F.array_sort(F.collect_set("stage")).alias("stages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("effects")))).alias("effects"),
        F.sum("documents").alias("document_count"),
        F.max("needs_document").alias("needs_document"),
    )
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("id"))
    first = (
        facts.where("id IS NOT NULL").select(*keys, "id").withColumn("rank", rank).where(F.col("rank") <= keep_ids)
        .groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    g = groups.alias("g")
    i = first.alias("i")
    same = (
        (F.col("g.code") == F.col("i.code"))
        & (F.col("g.subject") == F.col("i.subject"))
        & F.col("g.family").eqNullSafe(F.col("i.family"))
    )
    joined = g.join(i, same, "left").select("g.*", F.coalesce("i.ids", F.array().cast("array<string>")).alias("ids"))
    states = effect_states(F.col("stages"), F.col("effects"))
    return (
        joined.withColumn("effect_states", states)
        .withColumn("company_completed", F.array_contains("stages", "COMPLETION"))
        .withColumn("unresolved_effects", unresolved(F.col("effect_states")))
        .withColumn("open", (F.col("subject") == "SELF") & (F.size("unresolved_effects") > 0))
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Roll-up per company over its events."""
    own = F.col("subject") == "SELF"
    done = F.col("effect_states")["CORPORATE_EVENT"] == "RESOLVED_CONFIRMED"
    return events.groupBy("code").agg(
        F.count_if("open").alias("open_self"),
        F.count_if(~own).alias("subsidiary"),
        F.count_if(own & done & F.col("open")).alias("company_done_awaiting_exchange"),
        F.count_if(own & (F.size("unresolved_effects") == 0)).alias("fully_resolved"),
        F.count("*").alias("events"),
    )


def documents_needed(findings: DataFrame, words: ActionVocabulary = ActionVocabulary()) -> DataFrame:
    """Rows per company whose title alone does not settle the matter."""
    return findings.groupBy("code").agg(F.count_if(action_facts("title", words)["needs_document"]).alias("needs_document"))


@dataclass(frozen=True)
class Stage:
    stage: str
    label: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class Chain:
    key: str
    label: str
    stages: tuple[Stage, ...]
    note: str = ""


def match_stages(filings: DataFrame, chains: tuple[Chain, ...]) -> DataFrame:
    """One row per filing and chain it belongs to: the first stage whose pattern is in the bare title."""
    rows = [
        {"chain": c.key, "chain_ord": i, "stage": s.stage, "stage_label": s.label, "stage_ord": j, "word": p.replace(" ", "")}
        for i, c in enumerate(chains)
        for j, s in enumerate(c.stages)
        for p in s.patterns
    ]
    table = literal_rows(
        rows, "chain string, chain_ord int, stage string, stage_label string, stage_ord int, word string"
    )
    hits = tx.let(tx.bare("title"), lambda text: F.filter(table, lambda p: F.contains(text, p["word"])))
    first = tx.let(
        hits, lambda h: F.filter(h, lambda p, i: ~F.exists(F.slice(h, F.lit(1), i), lambda o: o["chain"] == p["chain"]))
    )
    return (
        filings.withColumn("m", F.explode(first))
        .select(*filings.columns, "m.chain", "m.chain_ord", "m.stage", "m.stage_label", "m.stage_ord")
    )


def stage_grid(chains: tuple[Chain, ...]) -> Column:
    """All stages of all chains in order, as a constant array."""
    return literal_rows(
        [
            {"chain": c.key, "stage_ord": j, "stage": s.stage, "stage_label": s.label}
            for c in chains
            for j, s in enumerate(c.stages)
        ],
        "chain string, stage_ord int, stage string, stage_label string",
    )


def timelines(items: DataFrame, chains: tuple[Chain, ...]) -> DataFrame:
    """Per (code, chain): item count, stages seen and not found in chain order, and the latest item.

    The items themselves stay rows (``match_stages``); only vocabulary-sized sets are nested here.
    """
    grid = F.filter(stage_grid(chains), lambda s: s["chain"] == F.col("chain"))
    grouped = items.groupBy("code", "chain").agg(
        F.count("*").alias("items"),
        F.collect_set("stage").alias("seen"),
        F.max(F.struct("received_on", "rcept_no", "stage", "stage_label")).alias("latest"),
    )

    def names(keep):
        return F.transform(F.filter(grid, keep), lambda s: s["stage"])

    return grouped.select(
        "code",
        "chain",
        "items",
        F.array_distinct(names(lambda s: F.array_contains(F.col("seen"), s["stage"]))).alias("stages_seen"),
        names(lambda s: ~F.array_contains(F.col("seen"), s["stage"])).alias("stages_not_found"),
        F.col("latest.stage").alias("latest_stage"),
        F.col("latest.stage_label").alias("latest_stage_label"),
        F.col("latest.received_on").alias("latest_received_on"),
    )


def timeline_nodes(items: DataFrame, chains: tuple[Chain, ...]) -> DataFrame:
    """Timeline items plus one explicit row per stage not found. Stages outside the chain come last."""
    lines = timelines(items, chains)
    grid = F.filter(stage_grid(chains), lambda s: s["chain"] == F.col("chain"))
    absent = F.filter(grid, lambda s: F.array_contains(F.col("stages_not_found"), s["stage"]))
    missing = lines.select("code", "chain", F.explode(absent).alias("s")).select(
        "code", "chain", "s.stage_ord", "s.stage", "s.stage_label",
        F.lit(None).cast("string").alias("rcept_no"), F.lit(None).cast("date").alias("received_on"),
        F.lit(vocab.NOT_FOUND).alias("node_state"),
    )
    found = items.select(
        "code", "chain", F.coalesce("stage_ord", F.lit(1 << 30)).alias("stage_ord"), "stage", "stage_label", "rcept_no", "received_on",
        F.lit("FOUND").alias("node_state"),
    )
    return found.unionByName(missing)


def active_timelines(lines: DataFrame, count: int = 80) -> DataFrame:
    per_company = lines.groupBy("code").agg(F.count("*").alias("chains"), F.max("latest_received_on").alias("latest"))
    return per_company.orderBy(F.desc("latest"), "code").limit(count)
