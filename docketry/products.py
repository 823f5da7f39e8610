"""The published data products as one job: gate on coverage, merge, classify, build, write, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketry.functions import text as tx
from docketry.operators import changes as ch, coverage as cv, events as ev, filings as fl, financials as fin
from docketry.operators.classify import Category, with_category_columns
from docketry.session import cut_lineage
from docketry.sources import partitions as pt, registry as src


class NoCompleteCheck(ValueError):
    """No run is known that saw its whole window, so no product may claim to be current."""


def freshness(runs: DataFrame, source: str = "list"):
    """The one row that says up to when everything was seen; raises when nothing is known."""
    row = cv.last_complete(runs.where(F.col("source") == source)).first()
    if row is None:
        raise NoCompleteCheck(f"no complete run of source {source!r}")
    return row


def build_products(
    universe: DataFrame, seen: DataFrame, evidence: DataFrame, records: DataFrame, runs: DataFrame, *,
    categories: tuple[Category, ...], chains: tuple[ev.Chain, ...], years, accounts, path: str, version: str, or_word: str = "또는",
) -> DataFrame:
    """Write all products under ``path`` and return their contract with the freshness instant.

    ``seen`` and ``evidence`` are the filing sources, ``records`` the long statement records. Merged and
    classified filings are written once and read by every product. The windows end at the day that was seen
    completely, never at the day of the build.
    """
    check = freshness(runs)
    listed = src.seen_to_filings(seen, universe).select("code", "rcept_no", "title", "received_on", "source")
    found = src.evidence_to_filings(evidence, universe)
    merged = fl.merge_filings(listed, found)
    merged = merged.withColumn("is_correction", tx.research_correction_kind("title").isNotNull())
    merged = merged.withColumn("listed", F.array_contains("sources", "list"))
    filings = cut_lineage(with_category_columns(merged, "title", categories, or_word), "filings")
    as_of = F.lit(check.window_end)
    first = F.coalesce(filings.where("listed").agg(F.min("received_on").alias("d")).scalar(), as_of)
    window = filings.sparkSession.range(1).select(ch.comparison_windows(first, as_of).alias("win")).scalar()
    items = ev.match_stages(filings.select("code", "rcept_no", "title", "received_on", "is_correction", "sources"), chains)
    values = fin.account_values(records.join(universe.select("code"), "code", "left_semi"), years, accounts)
    products = {
        "disclosure_headers": ch.company_headers(filings, window),
        "disclosure_changes": ch.window_changes(filings.where("listed"), window, categories),
        "disclosure_filings": ch.filing_page(filings).drop("listed"),
        "financial_values": values,
        "financial_changes": fin.account_changes(values),
        "event_timelines": ev.timelines(items, chains),
        "event_items": items,
    }
    table = pt.write_products(products, path, version)
    return table.withColumn("generated_at", F.lit(check.covered_until)).withColumn("as_of", as_of)
