"""Issuer evidence as one job: reconcile logged pages, group titles into events, stamp an expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketry import vocab
from docketry.functions import text as tx
from docketry.functions.actions import ActionVocabulary, in_scope
from docketry.operators import coverage as cv, events as ev, filings as fl

COUNTS = ("open_self", "subsidiary", "company_done_awaiting_exchange", "fully_resolved", "events")


def relevant_findings(rows: DataFrame, relevant=vocab.RELEVANT_TERMS) -> DataFrame:
    """Admissible rows whose title holds a relevant term, with the sorted terms."""
    terms = F.array_sort(tx.words_in("report_nm", relevant))
    kept = rows.where(F.col("row_state") == "KEPT").withColumn("terms", terms).where(F.size("terms") > 0)
    return kept.select(F.col("ticker").alias("code"), F.col("rcept_no").alias("id"), F.col("report_nm").alias("title"), "terms")


def comparison_findings(rows: DataFrame, words: ActionVocabulary = ActionVocabulary(), extra=vocab.EXTRA_SCOPE_TERMS) -> DataFrame:
    """Admissible rows kept for comparison: any classified effect or any of the extra terms."""
    kept = rows.where((F.col("row_state") == "KEPT") & in_scope("report_nm", words, extra))
    return kept.select(F.col("ticker").alias("code"), F.col("rcept_no").alias("id"), F.col("report_nm").alias("title"))


def issuer_evidence(
    pages: DataFrame, rows: DataFrame, queried_at: Column, words: ActionVocabulary = ActionVocabulary(), relevant=vocab.RELEVANT_TERMS
) -> DataFrame:
    """One evidence row per company. A failed company keeps its error and has no counts.

    ``pages`` is the response log, ``rows`` the listed rows with ticker, stock_code, rcept_no, report_nm.
    """
    checked = fl.reconcile_rows(rows)
    base = cv.reconcile_issuers(pages, checked, words, relevant)
    counts = ev.event_counts(ev.action_events(relevant_findings(checked, relevant), words))
    joined = base.join(counts.withColumnRenamed("code", "ticker"), "ticker", "left")
    filled = [F.when(F.col("ok"), F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS]
    return joined.select(
        *base.columns, *filled, queried_at.alias("queried_at"),
        (queried_at + F.make_dt_interval(hours=F.lit(vocab.EVIDENCE_TTL_HOURS))).alias("expires_at"),
    )
