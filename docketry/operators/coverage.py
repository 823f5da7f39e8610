"""Collection coverage: page completeness, states, evidence reconciliation, work queues and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketry import vocab
from docketry.functions import instants as ts, text as tx
from docketry.functions.actions import ActionVocabulary, action_facts


def collection_stats(rows: DataFrame) -> DataFrame:
    """Detected, unmatched, duplicate and matched rows and pages, per day and in total (null day)."""
    tracked, known = F.col("tracked"), F.col("acknowledged")
    per_page = rows.groupBy("day", "page").agg(
        F.count("*").alias("detected"),
        F.count_if(~tracked).alias("unmatched"),
        F.count_if(tracked & known).alias("duplicate"),
        F.count_if(tracked & ~known).alias("matched"),
    )
    return per_page.rollup("day").agg(
        *[F.sum(c).alias(c) for c in ("detected", "unmatched", "duplicate", "matched")], F.count("page").alias("pages")
    )


def page_completeness(pages: DataFrame, page_limit: int, page_size: int = 100) -> DataFrame:
    """Per query: pages reported and fetched, whether all were seen, and why not.

    Input: query, page, total_page, failed, and optionally budget_stopped and page_rows (rows on the page). A query
    that hit a failure or the budget is incomplete. So is one that lacks a page below its last one or fetched fewer
    pages than reported. Where the number of pages was never reported, a query that stopped at the page limit is
    complete only if its last page was short or empty; an unknown number of rows does not count as short.
    """
    for name, value in (("budget_stopped", F.lit(False)), ("page_rows", F.lit(None).cast("int"))):
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
    seen = ~F.col("failed")
    grouped = pages.groupBy("query").agg(
        F.max("total_page").alias("pages_reported"),
        F.count_distinct(F.when(seen, F.col("page"))).alias("pages_fetched"),
        F.max(F.when(seen, F.struct("page", "page_rows"))).alias("last"),
        F.max("failed").alias("failed"),
        F.max("budget_stopped").alias("budget_stopped"),
    )
    fetched, reported = F.col("pages_fetched"), F.col("pages_reported")
    gap = F.coalesce(fetched < F.col("last.page"), F.lit(False))
    cut = reported.isNull() & (fetched >= page_limit) & ~F.coalesce(F.col("last.page_rows") < page_size, F.lit(False))
    unread = F.coalesce(fetched < reported, F.lit(False)) | gap | cut
    reasons = F.array_compact(
        F.array(
            F.when(F.col("failed"), "API_ERROR"),
            F.when(~F.col("failed") & F.col("budget_stopped"), "BUDGET_LIMIT_REACHED"),
            F.when(~F.col("failed") & ~F.col("budget_stopped") & unread, "PAGE_LIMIT_REACHED"),
        )
    )
    return grouped.withColumn("reasons", reasons).withColumn("complete", F.size("reasons") == 0).drop("failed", "budget_stopped", "last")


def overall_completeness(per_query: DataFrame) -> DataFrame:
    """Complete only if every query is; reasons of all of them. The distinct reason lists are a handful."""
    return per_query.agg(
        F.bool_and("complete").alias("complete"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
        F.count("*").alias("queries"),
    )


def coverage_state(has_key: Column, errors: Column, complete: Column, events: Column) -> Column:
    """State in order of precedence; "no event" only when everything was seen without error."""
    return (
        F.when(~has_key, vocab.EVENT_COVERAGE_INCOMPLETE)
        .when(errors > 0, vocab.EVENT_DATA_ERROR)
        .when(~complete, vocab.EVENT_COVERAGE_INCOMPLETE)
        .when(events > 0, vocab.EVENT_DETECTED)
        .otherwise(vocab.NO_OFFICIAL_EVENT_DETECTED)
    )


def response_state(transport_ok: Column, body: Column) -> Column:
    """State of one logged page response."""
    doc = F.from_json(body, "status string, list array<string>, total_page string, total_count string")
    is_object = F.coalesce(F.trim(body).rlike(r"(?s)^\{.*\}$"), F.lit(False)) & F.try_parse_json(body).isNotNull()
    status = F.coalesce(doc["status"], F.lit(""))
    shaped = doc["list"].isNotNull() & doc["total_page"].isNotNull() & doc["total_count"].isNotNull()
    return (
        F.when(~transport_ok, "UNREACHABLE")
        .when(~is_object, vocab.EVENT_DATA_ERROR)
        .when(status == "013", "NO_DATA")
        .when((status != "") & (status != "000"), "API_ERROR")
        .when(~shaped, "RESPONSE_SHAPE_UNEXPECTED")
        .otherwise(vocab.OK)
    )


def reconcile_issuers(pages: DataFrame, rows: DataFrame, words=ActionVocabulary(), relevant=vocab.RELEVANT_TERMS) -> DataFrame:
    """Evidence per company from logged pages and their rows.

    ``pages``: ticker, page, state, total_page, total_count. ``rows``: ticker, rcept_no, report_nm, row_state
    (see ``reconcile_rows``). The first failed page decides the error; a failed company has no expected pages, no
    total and no counts. Only pages that were read count as collected, and a company is checked only if every page
    from the first to the expected last one was. An answer without data is one page with zero rows.
    """
    read = F.col("state").isin(vocab.OK, "NO_DATA")
    no_data = F.col("state") == "NO_DATA"
    per_ticker = pages.groupBy("ticker").agg(
        F.min(F.when(~read, F.struct("page", "state"))).alias("failure"),
        F.count_distinct(F.when(read, F.col("page"))).alias("pages_collected"),
        F.coalesce(F.max(F.when(read, F.col("page"))), F.lit(0)).alias("last_page"),
        F.max(F.when(no_data, F.lit(1)).when(read, F.col("total_page"))).alias("expected"),
        F.max(F.when(no_data, F.lit(0)).when(read, F.col("total_count"))).alias("total"),
    )
    kept = F.col("row_state") == "KEPT"
    finding = kept & tx.contains_any("report_nm", relevant)
    needs = finding & action_facts("report_nm", words)["needs_document"]
    counted = rows.groupBy("ticker").agg(
        F.count_if(kept).alias("collected"),
        F.count_if(finding).alias("findings"),
        (F.count_if(~kept) + F.count_if(needs)).alias("uninterpreted"),
    )
    whole = (F.col("pages_collected") == F.col("last_page")) & (F.col("last_page") >= F.greatest("expected", F.lit(1)))
    ok = F.col("failure").isNull() & whole
    unfailed = F.col("failure").isNull()
    joined = per_ticker.join(counted, "ticker", "left").withColumn("ok", ok)

    def when_ok(name):
        return F.when(F.col("ok"), F.coalesce(name, F.lit(0))).alias(name)

    return joined.select(
        "ticker", "ok", F.col("failure.state").alias("error"), F.when(unfailed, F.col("expected")).alias("pages_expected"), "pages_collected",
        F.when(unfailed, F.col("total")).alias("total_count"),
        when_ok("collected"), when_ok("findings"), when_ok("uninterpreted"),
    )


def ticker_states(universe: DataFrame, evidence: DataFrame, cycle_started: Column) -> DataFrame:
    """How each company was seen in this cycle. A record from before the cycle is still pending."""
    fresh = F.col("queried_at").isNotNull() & (F.col("queried_at") >= cycle_started)
    state = (
        F.when(~F.coalesce(fresh, F.lit(False)), "PENDING")
        .when(~F.coalesce("ok", F.lit(False)), "CHECK_FAILED")
        .when(F.coalesce("findings", F.lit(0)) > 0, "CHECKED_FOUND")
        .otherwise("CHECKED_NONE")
    )
    return universe.select("code").join(evidence, "code", "left").select("code", state.alias("state"))


def cycle_progress(states: DataFrame, started: Column, now: Column, last_completed: Column) -> DataFrame:
    """Progress of a full cycle; a completed cycle moves ``last_completed_at``, an open one carries it."""
    counts = states.agg(
        F.count("*").alias("universe"),
        F.count_if(F.col("state") != "PENDING").alias("attempted"),
        F.count_if(F.col("state").isin("CHECKED_FOUND", "CHECKED_NONE")).alias("verified"),
    )
    complete = (F.col("universe") > 0) & (F.col("attempted") == F.col("universe"))
    return (
        counts.withColumn("progress_pct", F.round(F.coalesce(F.try_divide(F.col("verified").cast("double") * 100, "universe"), F.lit(0.0))).cast("bigint"))
        .withColumn("complete", complete)
        .withColumn("started_at", F.when(~complete, started))
        .withColumn("completed_started_at", F.when(complete, started))
        .withColumn("last_completed_at", F.when(complete, now).otherwise(last_completed))
    )


def run_summary(todo: DataFrame, evidence: DataFrame) -> DataFrame:
    """Outcome counts of one run; companies never attempted are not failures."""
    ok = F.coalesce("ok", F.lit(False))
    found = F.coalesce("findings", F.lit(0)) > 0
    is_open = F.coalesce("open_self", F.lit(0)) > 0
    attempted = F.col("ok").isNotNull()
    return todo.select("code").join(evidence, "code", "left").agg(
        F.count_if(ok & found).alias("with_documents"),
        F.count_if(ok & is_open).alias("with_open_event"),
        F.count_if(ok & found & ~is_open).alias("subsidiary_only"),
        F.count_if(ok & ~found).alias("clean"),
        F.count_if(attempted & ~ok).alias("failed"),
        F.count_if(~attempted).alias("not_processed"),
    )


def fresh_evidence(evidence: DataFrame, as_of: Column, hours: int = vocab.EVIDENCE_TTL_HOURS) -> DataFrame:
    """Evidence with its expiry; an expired record is unknown, not clean."""
    expires = F.col("queried_at") + F.make_dt_interval(hours=F.lit(hours))
    return evidence.withColumn("expires_at", expires).withColumn(
        "freshness", F.when(F.col("expires_at") >= as_of, "FRESH").otherwise("UNKNOWN")
    )


# ── work queues ─────────────────────────────────────────────────────────────────────────────────


def rotation_targets(universe: DataFrame, cursor: str, cap: int) -> DataFrame:
    """Next ``cap`` companies after the cursor, wrapping round to the start."""
    turn = F.when(F.col("code") > F.lit(cursor or ""), 0).otherwise(1)
    return universe.select("code").withColumn("turn", turn).orderBy("turn", "code").limit(max(0, cap))


def listed_targets(universe: DataFrame, wanted: DataFrame, cap: int) -> DataFrame:
    """Companies of a target list in list order. An empty list means no company."""
    known = wanted.join(universe.select("code"), "code", "left_semi")
    return known.orderBy("ord").limit(max(0, cap))


def gap_days(sources: DataFrame, today: Column, limit: int = vocab.MAX_CATCHUP_DAYS) -> DataFrame:
    """Per source: days to read this run, oldest unconfirmed first, and how many days stay behind."""
    days = sources.withColumn("days", ts.catchup_days(today, "confirmed_until", limit))
    return days.withColumn("behind_days", F.datediff(today, F.element_at("days", -1)))


def trading_period(base: Column, sessions: int, holidays=vocab.KRX_HOLIDAYS) -> Column:
    """First and last of the next ``sessions`` exchange sessions after a date.

    A span of twice the sessions plus all holidays plus a week always holds enough sessions.
    """
    if sessions <= 0:
        raise ValueError("sessions must be positive")
    closed = F.lit(list(holidays)).cast("array<date>")
    span = F.sequence(F.date_add(base, 1), F.date_add(base, 2 * sessions + len(holidays) + 7))
    open_days = F.filter(span, lambda d: (F.weekday(d) < 5) & ~F.array_contains(closed, d))
    return F.struct(
        F.element_at(open_days, 1).alias("period_start"), F.element_at(open_days, sessions).alias("period_end")
    )


# ── completeness watermark ──────────────────────────────────────────────────────────────────────


def last_complete(runs: DataFrame) -> DataFrame:
    """The last run whose whole window was seen, with the instant it covers; no row when none is known.

    Input: source, finished_at (instant), status, event_state, window_start, window_end. A failed run never
    moves the result; the instant is the earlier of the finish and midnight after the window.
    """
    done = runs.where(
        (F.col("status") == vocab.OK)
        & F.col("event_state").isin(vocab.EVENT_DETECTED, vocab.NO_OFFICIAL_EVENT_DETECTED)
        & F.col("finished_at").isNotNull()
        & F.col("window_end").isNotNull()
    )
    last = done.groupBy("source").agg(F.max(F.struct("finished_at", "window_start", "window_end")).alias("r"))
    return last.select("source", "r.*").withColumn("covered_until", ts.covered_until("finished_at", "window_end"))
