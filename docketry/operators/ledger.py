"""Usage ledgers: roll-ups, three-way merges, projections and the version contract.

A ledger is a long table of (day, kind, n), so that increments from many writers simply add up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docketry import vocab


def known_kind(kind: Column, kinds=vocab.LEDGER_KINDS) -> Column:
    return F.when(kind.isin(*kinds), kind).otherwise("other")


def roll_up(increments: DataFrame, kinds=vocab.LEDGER_KINDS) -> DataFrame:
    """Requests per (day, kind) and per day (null kind); unknown kinds count as other."""
    per_kind = increments.groupBy("day", known_kind(F.col("kind"), kinds).alias("kind")).agg(F.sum("n").alias("n"))
    return per_kind.groupingSets([["day", "kind"], ["day"]], "day", "kind").agg(F.sum("n").alias("n"))


def usage_report(increments: DataFrame, hard: int = vocab.DAILY_HARD_LIMIT, soft: int = vocab.SOFT_BUDGET) -> DataFrame:
    """Per day: total, status against both limits, share used and what remains."""
    total = F.col("total")
    return (
        increments.groupBy("day").agg(F.sum("n").alias("total"))
        .withColumn(
            "status",
            F.when(total >= hard, "DART_BUDGET_EXCEEDED").when(total >= soft, "DART_BUDGET_WARNING").otherwise("BUDGET_OK"),
        )
        .withColumn("remaining", F.greatest(F.lit(0), F.lit(hard) - total))
        .withColumn("used_pct", F.round(total.cast("double") / hard * 100, 2))
    )


def merge_ledgers(base: DataFrame, ours: DataFrame, theirs: DataFrame, kinds=vocab.LEDGER_KINDS) -> DataFrame:
    """Three versions of a one-day ledger added up: the later day of the two sides wins, each side of that day
    contributes what it has over the base of the same day, never less than zero.

    If all three have ``runs`` and ``updated_at`` (of the whole version, on each of its rows), runs add up the same
    way and the latest stamp of that day is kept.
    """
    parts = []
    stamped = all({"runs", "updated_at"} <= set(df.columns) for df in (base, ours, theirs))
    extra = ["runs", "updated_at"] if stamped else []
    for side, df in (("base", base), ("ours", ours), ("theirs", theirs)):
        parts.append(df.select("day", known_kind(F.col("kind"), kinds).alias("kind"), "n", *extra, F.lit(side).alias("side")))
    rows = reduce(DataFrame.unionByName, parts)
    sums = rows.groupBy("day", "kind").agg(
        *[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("base", "ours", "theirs")],
    )
    latest = ours.select("day").unionByName(theirs.select("day")).agg(F.max("day").alias("day")).scalar()
    gain = lambda side: F.greatest(F.lit(0), F.col(side) - F.col("base"))
    total = F.col("base") + gain("ours") + gain("theirs")
    merged = sums.where(F.col("day") == latest).select("day", "kind", total.alias("n"))
    if not stamped:
        return merged
    runs = rows.groupBy("day").agg(
        *[F.coalesce(F.max(F.when(F.col("side") == s, F.col("runs"))), F.lit(0)).alias(s) for s in ("base", "ours", "theirs")],
        F.max("updated_at").alias("updated_at"),
    )
    return merged.join(runs.select("day", total.alias("runs"), "updated_at"), "day", "left")


def project_requests(plan: DataFrame, hard: int = vocab.DAILY_HARD_LIMIT) -> DataFrame:
    """Expected requests a day from measured rates."""
    expected = (
        F.col("list_per_run") * F.col("runs_per_day")
        + F.col("mapping_per_day") + F.col("financial_per_day") + F.col("detail_per_day")
    )
    return plan.withColumn("expected_daily", expected).withColumn(
        "pct_of_hard_limit", F.round(expected.cast("double") / hard * 100, 2)
    )


def ledger_problems(versions: DataFrame, head: DataFrame, kinds=vocab.LEDGER_KINDS) -> DataFrame:
    """One row per broken rule of a ledger version against the one before.

    ``versions``: day, updated_at, schema_version, counts (map), runs; ``head``: day, counts, runs.
    """
    before = head.select("day", F.col("counts").alias("old_counts"), F.col("runs").alias("old_runs"))
    zero = F.lit(0).cast("bigint")
    shrunk = F.lit(False)
    for kind in kinds:
        shrunk = shrunk | (F.coalesce(F.col("counts")[kind], zero) < F.coalesce(F.col("old_counts")[kind], zero))
    rules = F.array_compact(
        F.array(
            F.when(~F.col("schema_version").eqNullSafe("dart_budget_v1"), "SCHEMA"),
            F.when(~F.coalesce(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "DAY_FORMAT"),
            F.when(
                ~F.coalesce(
                    F.col("updated_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(\+00:00|Z)$"), F.lit(False)
                ),
                "STAMP_FORMAT",
            ),
            F.when(F.size(F.array_except(F.map_keys("counts"), F.lit(list(kinds)))) > 0, "UNKNOWN_KIND"),
            F.when(F.exists(F.map_values("counts"), lambda v: v < 0) | (F.col("runs") < 0), "NEGATIVE"),
            F.when(F.col("old_counts").isNotNull() & (shrunk | (F.col("runs") < F.col("old_runs"))), "SHRUNK"),
        )
    )
    return versions.join(before, "day", "left").select("day", F.explode(rules).alias("problem"))
