"""Temperature mixing of sources, realised as budgeted block permutations.

Source shares are raised to an exponent and normalised. The exponent is bisected so that the mixture meets a
target entropy or a repetition limit. Every source then gets its weight's part of the token budget, as whole
passes over its documents and one partial pass. Each pass visits the documents in its own order: blocks in a
keyed order, documents in a keyed order inside their block.

Nothing but a few sums leaves Spark: a search step evaluates many exponents in one aggregation over sources.
Running totals are taken inside (source, pass, block) and carried over block sums, so a hot source is spread
over all its blocks.

Edge cases: a null source is a source of its own; a null or empty text has one token, its end; rows that are
equal in id and text share one place in the order and are taken or left together; an empty table gives an empty
plan; other columns are kept by ``mix_rows``, columns named like its working columns included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import SPACE_CLASS
from docketry.session import cut_lineage

#: Exponents tried in one pass over the sources; each pass narrows the interval by this factor.
GRID = 32
BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class Mixture:
    """What the mixture must meet: one of the two targets, the token budget and the key of the orders.

    Without a budget, it is the smallest one at which every source is visited once as a whole.
    """

    repeat_limit: float | None = 2.0
    target_entropy: float | None = None
    budget: int | None = None
    seed: int = 17


def token_count(text: str = "text") -> Column:
    """Words of a text and its end."""
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS + "+"), "")
    return (F.size(words) + 1).cast("bigint")


def _place(seed: int, epoch: Column, digest: str) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), F.col(digest))


def fit_exponent(sources: DataFrame, mixture: Mixture) -> tuple[float, float]:
    """The exponent in 0 to 1 that meets the target, and the normaliser of the powered shares.

    ``sources`` has one row per source with its positive ``share``. Entropy (in bits) falls and repetition falls
    as the exponent grows; a target out of reach gives the nearer end of the interval.
    """
    low, high = 0.0, 1.0
    sums = {}

    def powers(points: list[float]) -> list[tuple[float, float]]:
        row = sources.agg(
            *[F.sum(F.pow("share", F.lit(a))).alias(f"z{i}") for i, a in enumerate(points)],
            *[F.sum(F.pow("share", F.lit(a)) * F.log2("share")).alias(f"l{i}") for i, a in enumerate(points)],
            F.min("share").alias("least"),
            F.max("share").alias("most"),
        ).first()
        sums["least"], sums["most"] = row["least"], row["most"]
        return [(row[f"z{i}"], row[f"l{i}"]) for i in range(len(points))]

    def too_flat(a: float, z: float, weighted: float) -> bool:
        """Whether the exponent must grow."""
        if mixture.target_entropy is not None:
            return math.log2(z) - a * weighted / z > mixture.target_entropy
        if mixture.budget is None:
            return (sums["least"] / sums["most"]) ** (a - 1) > mixture.repeat_limit
        return sums["least"] ** (a - 1) / z * sums["scale"] > mixture.repeat_limit

    if mixture.budget is not None:
        sums["scale"] = mixture.budget / sources.agg(F.sum("tokens")).first()[0]
    while high - low > 1e-12:
        points = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        flat = [too_flat(a, *zl) for a, zl in zip(points, powers(points), strict=True)]
        if all(flat):
            low = high
        elif not flat[0]:
            high = low
        else:
            at = max(i for i, f in enumerate(flat) if f)
            low, high = points[at], points[at + 1]
    return high, powers([high])[0][0]


def plan_sources(docs: DataFrame, mixture: Mixture, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Narrow rows of the documents, and one row per source: tokens, share, weight, passes and the partial budget."""
    rows = cut_lineage(
        docs.select(
            F.col("doc_id").alias("doc_id"),
            F.col(source).alias("source"),
            token_count().alias("tokens"),
            F.xxhash64(F.col("doc_id"), F.col("text")).alias("digest"),
        ),
        "mix-rows",
    )
    sums = cut_lineage(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mix-sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    exponent, norm = fit_exponent(shares, mixture) if total else (1.0, 1.0)
    weight = F.pow("share", F.lit(exponent)) / F.lit(norm)
    budget = mixture.budget
    if budget is None and total:
        budget = total / shares.agg(F.min(weight / F.col("share"))).first()[0]
    # A budget that is a whole number of passes must not fall short by a rounding error.
    wanted = F.round(F.lit(float(budget or 0)) * weight, 0).cast("bigint")
    return rows, (
        shares.withColumn("weight", weight)
        .withColumn("wanted", wanted)
        .withColumn("passes", F.floor(F.col("wanted") / F.col("tokens")).cast("int"))
        .withColumn("rest", F.col("wanted") - F.col("passes") * F.col("tokens"))
        .withColumn("blocks", F.greatest(F.lit(16), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int"))
    )


def _visits(rows: DataFrame, sources: DataFrame, mixture: Mixture, epochs: Column) -> DataFrame:
    """Each row once per pass, with the tokens that precede it in that pass."""
    small = sources.select(
        F.col("source").alias("of_source"), "weight", "passes", "rest", "blocks"
    )
    placed = (
        rows.join(small, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("epoch", F.explode(epochs))
        .withColumn("place", _place(mixture.seed, F.col("epoch"), "digest"))
        .withColumn("block", F.pmod("place", "blocks").cast("int"))
    )
    inside = Window.partitionBy("source", "epoch", "block").orderBy("place")
    sums = placed.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "epoch").orderBy("block")) - F.col("n")
    bases = sums.select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("b"), before.alias("base")
    )
    return (
        placed.withColumn("within", F.sum("tokens").over(inside))
        .join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")))
        .withColumn("until", F.col("base") + F.col("within"))
        .where((F.col("epoch") < F.col("passes")) | (F.col("until") <= F.col("rest")))
    )


def mix_plan(docs: DataFrame, mixture: Mixture = Mixture(), source: str = "source") -> DataFrame:
    """One row per visit of a document: doc_id, source, tokens, weight, epoch, block, until.

    ``until`` counts the tokens of this source in this pass up to and with the document (and rows that share its place).
    """
    rows, sources = plan_sources(docs, mixture, source)
    epochs = F.sequence(F.lit(0), F.col("passes"))
    return _visits(rows, cut_lineage(sources, "mix-plan"), mixture, epochs).select(
        "doc_id", "source", "tokens", "weight", "epoch", "block", "until"
    )


def mix_rows(docs: DataFrame, mixture: Mixture = Mixture(), source: str = "source") -> DataFrame:
    """The documents with all their columns, each as often as the plan visits it.

    Only narrow rows are ordered: the last place that a source's partial pass reaches decides for the texts.
    """
    rows, sources = plan_sources(docs, mixture, source)
    sources = cut_lineage(sources, "mix-plan")
    last = F.array(F.col("passes"))
    reached = (
        _visits(rows, sources, mixture, last)
        .groupBy("source")
        .agg(F.max(F.struct("block", "place")).alias("end"))
        .select(F.col("source").alias("end_source"), "end")
    )
    limits = cut_lineage(
        sources.join(reached, F.col("source").eqNullSafe(F.col("end_source")), "left").select(
            F.struct("source", "passes", "blocks", "end").alias("_mix")
        ),
        "mix-limits",
    )
    mine = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.xxhash64(F.col("doc_id"), F.col("text")).alias("_mix_digest"))
    place = F.xxhash64(F.lit(mixture.seed), F.col("_mix.passes").cast("int"), F.col("_mix_digest"))
    here = F.struct(F.pmod(place, F.col("_mix.blocks")).cast("int").alias("block"), place.alias("place"))
    extra = F.when(F.col("_mix.end").isNotNull() & (here <= F.col("_mix.end")), 1).otherwise(0)
    return (
        mine.join(limits, F.col(source).eqNullSafe(F.col("_mix.source")))
        .withColumn("_mix_visits", F.col("_mix.passes") + extra)
        .where(F.col("_mix_visits") > 0)
        .withColumn("_mix_visit", F.explode(F.sequence(F.lit(1), F.col("_mix_visits"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
