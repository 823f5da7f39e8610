"""Filing activity: comparable windows, change tables, company pages and recent lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketry import vocab
from docketry.operators.classify import Category


def comparison_windows(coverage_from: Column, as_of: Column) -> Column:
    """Struct of two comparable windows ending at ``as_of``.

    Thirty days each when at least sixty are covered, otherwise half of the covered days, never under seven.
    """
    covered = F.datediff(as_of, coverage_from) + 1
    days = F.when(covered >= 60, 30).otherwise(F.greatest(F.lit(7), F.floor(covered / 2).cast("int")))
    recent_from = F.date_sub(as_of, days - 1)
    prior_from = F.date_sub(as_of, days * 2 - 1)
    return F.struct(
        days.alias("days"),
        recent_from.alias("recent_from"),
        as_of.alias("recent_to"),
        prior_from.alias("prior_from"),
        F.date_sub(recent_from, 1).alias("prior_to"),
        (prior_from >= coverage_from).alias("fully_covered"),
        coverage_from.alias("coverage_from"),
    )


def data_windows(filings: DataFrame) -> DataFrame:
    """The windows spanned by the data itself, as one row with one struct column."""
    span = filings.agg(F.min("received_on").alias("first"), F.max("received_on").alias("last"))
    return span.select(comparison_windows(F.col("first"), F.col("last")).alias("win"))


def windows_between(coverage_from: str, as_of: str) -> Column:
    return comparison_windows(F.to_date(F.lit(coverage_from)), F.to_date(F.lit(as_of)))


def _label(categories: tuple[Category, ...]) -> Column:
    table = F.create_map(*[x for c in categories for x in (F.lit(c.key), F.lit(c.label))])
    return F.coalesce(table[F.col("category")], F.col("category"))


def category_counts(filings: DataFrame, low: Column, high: Column) -> DataFrame:
    """Filings per (code, category) received inside [low, high]."""
    return (
        filings.where(F.col("received_on").between(low, high))
        .groupBy("code", "category")
        .agg(F.count("*").alias("n"))
    )


def window_changes(filings: DataFrame, win: Column, categories: tuple[Category, ...]) -> DataFrame:
    """Change rows per company: category changes in vocabulary order, then the correction count.

    Input rows are list-sourced filings with code, category, received_on, is_correction; ``win`` is a windows
    struct, a literal or a scalar subquery. One aggregation serves both windows and the corrections. The
    prior count is null when the prior window is not covered. The windows are attached again after the
    aggregation, which keeps its buffers fixed-width and the aggregation hashed.
    """
    order = {c.key: i for i, c in enumerate(categories)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    rows = filings.withColumn("win", win)
    in_recent = F.col("received_on").between(F.col("win.recent_from"), F.col("win.recent_to"))
    in_prior = F.col("received_on").between(F.col("win.prior_from"), F.col("win.prior_to"))
    counted = (
        rows.where(in_recent | in_prior)
        .groupBy("code", "category")
        .agg(
            F.count_if(in_recent).alias("recent"),
            F.count_if(in_prior).alias("prior"),
            F.count_if(in_recent & F.col("is_correction")).alias("corrections"),
        )
        .withColumn("win", win)
    )
    n = F.col("win.days").cast("string")
    label, r, p = _label(categories), F.col("recent").cast("string"), F.col("prior").cast("string")
    covered = F.col("win.fully_covered")
    recent, prior = F.col("recent"), F.col("prior")
    kind = (
        F.when(~covered, F.when(recent > 0, "RECENT_ONLY"))
        .when(prior == 0, "NEW_CATEGORY")
        .when(recent < prior, "FEWER")
        .when(recent > prior, "MORE")
        .otherwise("SAME")
    )
    # Wording of the change lines.
    text = (
        F.when(~covered, F.concat(F.lit("최근 "), n, F.lit("일에 "), label, F.lit(" 공시 "), r, F.lit("건 (이전 창은 자료가 덮이지 않아 비교하지 않음)")))
        .when(prior == 0, F.concat(F.lit("최근 "), n, F.lit("일에 "), label, F.lit(" 공시 "), r, F.lit("건 — 그 이전 "), n, F.lit("일에는 0건")))
        .when(recent == 0, F.concat(F.lit("최근 "), n, F.lit("일에 "), label, F.lit(" 공시 0건 — 그 이전 "), n, F.lit("일에는 "), p, F.lit("건")))
        .when(recent > prior, F.concat(label, F.lit(" 공시 "), r, F.lit("건 — 이전 "), n, F.lit("일 "), p, F.lit("건보다 늘었다")))
        .when(recent < prior, F.concat(label, F.lit(" 공시 "), r, F.lit("건 — 이전 "), n, F.lit("일 "), p, F.lit("건보다 줄었다")))
        .otherwise(F.concat(label, F.lit(" 공시 "), r, F.lit("건 (이전 "), n, F.lit("일과 같음)")))
    )
    change = F.struct(
        F.coalesce(rank[F.col("category")], F.lit(len(order))).alias("position"),
        kind.alias("type"),
        F.col("category"),
        recent.alias("recent"),
        F.when(covered, prior).alias("prior"),
        text.alias("text"),
    )
    # A company has at most one row per category of the vocabulary, so the correction totals are small sums.
    by_category = counted.select("code", change.alias("c")).where("c.type IS NOT NULL").select("code", "c.*")
    corrections = (
        counted.groupBy("code")
        .agg(F.sum("corrections").alias("recent"), F.first("win.days").cast("string").alias("n"))
        .where("recent > 0")
        .select(
            "code",
            F.lit(len(order) + 1).alias("position"),
            F.lit("CORRECTIONS").alias("type"),
            F.lit(None).cast("string").alias("category"),
            "recent",
            F.lit(None).cast("bigint").alias("prior"),
            F.concat(F.lit("최근 "), "n", F.lit("일 정정 공시 "), F.col("recent").cast("string"), F.lit("건 — 정정 전후는 원문 비교로 확인")).alias("text"),
        )
    )
    return by_category.unionByName(corrections)


def company_headers(filings: DataFrame, win: Column, keep: int = vocab.FILINGS_PER_COMPANY) -> DataFrame:
    """Per company: filings, latest date, counts in both windows, and how many rows the page leaves out."""
    rows = filings.withColumn("win", win)
    listed = F.col("listed")
    recent = listed & F.col("received_on").between(F.col("win.recent_from"), F.col("win.recent_to"))
    prior = listed & F.col("received_on").between(F.col("win.prior_from"), F.col("win.prior_to"))
    return rows.groupBy("code").agg(
        F.count("*").alias("filing_count"),
        F.max("received_on").alias("latest_received_on"),
        F.count_if(recent).alias("recent_count"),
        F.when(F.first("win.fully_covered"), F.count_if(prior)).alias("prior_count"),
        F.greatest(F.lit(0), F.count("*") - keep).alias("filings_truncated"),
    )


def coverage_summary(universe: DataFrame, filings: DataFrame) -> DataFrame:
    """Tracked companies, companies with filings, filings, and the span of the data."""
    tracked = universe.agg(F.count("*").alias("n"))
    per_company = filings.groupBy("code").agg(
        F.count("*").alias("n"), F.min("received_on").alias("first"), F.max("received_on").alias("last")
    )
    return per_company.agg(
        F.count("*").alias("companies_with_filings"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("filings"),
        F.min("first").alias("from"),
        F.max("last").alias("to"),
    ).withColumn("tracked_companies", tracked.scalar())


def newest_per_company(filings: DataFrame, keep: int, *order: Column, partition: str = "code") -> DataFrame:
    """The first ``keep`` rows per company with their rank. The limit is applied before the shuffle too."""
    rank = F.row_number().over(W.partitionBy(partition).orderBy(*order))
    return filings.withColumn("rank", rank).where(F.col("rank") <= keep)


def filing_page(filings: DataFrame, keep: int = vocab.FILINGS_PER_COMPANY) -> DataFrame:
    return newest_per_company(filings, keep, F.desc("received_on"), F.desc("rcept_no"))


def recent_list(filings: DataFrame, keep: int = vocab.RECENT_PER_COMPANY, days: int = vocab.RECENT_DAYS) -> DataFrame:
    """Newest rows per company inside the days that end at the newest receipt date."""
    latest = filings.agg(F.max("received_on").alias("d")).scalar()
    window = filings.where(F.col("received_on") >= F.date_sub(latest, days - 1))
    return newest_per_company(window, keep, F.desc("received_on"), F.desc("detected_at"), F.desc("rcept_no"))


def latest_cards(items: DataFrame, cards: int = 6) -> DataFrame:
    """One row per company, its latest, with the count of that day; the first ``cards`` of all."""
    per_day = items.groupBy("code", "received_on").agg(
        F.count("*").alias("same_day"), F.max(F.struct("detected_at", "rcept_no", "title")).alias("row")
    )
    newest = per_day.groupBy("code").agg(F.max(F.struct("received_on", "row", "same_day")).alias("top"))
    return (
        newest.select("code", "top.received_on", "top.row.*", "top.same_day")
        .orderBy(F.desc("received_on"), F.desc("detected_at"), F.desc("rcept_no"))
        .limit(cards)
    )


def active_companies(filings: DataFrame, count: int = 80) -> DataFrame:
    per_company = filings.groupBy("code").agg(F.max("received_on").alias("latest"), F.count("*").alias("n"))
    return per_company.orderBy(F.desc("latest"), "code").limit(count)
