"""Queries on collection coverage, evidence, work queues, calendars and usage ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import evidence as job
from docketry.operators import coverage as op, filings as fl, ledger as lg
from docketry.plans import standins as sv
from docketry.plans.registry import query
from docketry.plans.titles import EVENTS_SQL


@query(
    "ag1_collection_stats",
    "WITH " + sv.FILING + "," + sv.UNIVERSE + """, r AS (SELECT strftime(received_on, '%Y-%m-%d') AS day, seq % 9 AS page, code IN (SELECT code FROM universe) AS tracked, seq % 4 = 0 AS ack FROM filing)
SELECT day, count(*) AS detected, count(*) FILTER (NOT tracked) AS unmatched, count(*) FILTER (tracked AND ack) AS duplicate, count(*) FILTER (tracked AND NOT ack) AS matched, count(DISTINCT page) AS pages FROM r GROUP BY day
UNION ALL SELECT NULL, count(*), count(*) FILTER (NOT tracked), count(*) FILTER (tracked AND ack), count(*) FILTER (tracked AND NOT ack), count(DISTINCT (day, page)) FROM r""",
)
def _(t):
    known = sv.universe(t).select("code", F.lit(True).alias("tracked"))
    rows = sv.filing(t).join(known, "code", "left").select(
        sv.day_text("received_on").alias("day"),
        (F.col("seq") % 9).alias("page"),
        F.coalesce("tracked", F.lit(False)).alias("tracked"),
        (F.col("seq") % 4 == 0).alias("acknowledged"),
    )
    return op.collection_stats(rows)


PAGES = """pg AS (SELECT l_orderkey AS query, l_linenumber AS page, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(1 + l_orderkey % 6 AS INT) END AS total_page, l_tax = 0.08 AND l_discount > 0.07 AS failed, CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 100 ELSE 17 END AS page_rows FROM lineitem),
pc AS (SELECT query, max(total_page) AS pages_reported, count(DISTINCT page) FILTER (NOT failed) AS pages_fetched, max(page) FILTER (NOT failed) AS lp, max_by(page_rows, page) FILTER (NOT failed) AS lr, bool_or(failed) AS f FROM pg GROUP BY 1),
done AS (SELECT query, pages_reported, pages_fetched, CASE WHEN f THEN 'API_ERROR' WHEN coalesce(pages_fetched < pages_reported, false) OR coalesce(pages_fetched < lp, false) OR (pages_reported IS NULL AND pages_fetched >= 4 AND NOT coalesce(lr < 100, false)) THEN 'PAGE_LIMIT_REACHED' ELSE '' END AS reasons FROM pc)"""


def pages(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("query"),
        F.col("l_linenumber").alias("page"),
        F.when(F.col("l_orderkey") % 13 != 0, (F.lit(1) + F.col("l_orderkey") % 6).cast("int")).alias("total_page"),
        ((F.col("l_tax") == 0.08) & (F.col("l_discount") > 0.07)).alias("failed"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0, 100).otherwise(17).alias("page_rows"),
    )


@query("ag2_page_completeness", "WITH " + PAGES + " SELECT *, reasons = '' AS complete FROM done")
def _(t):
    return op.page_completeness(pages(t), 4).withColumn("reasons", sv.joined("reasons"))


@query(
    "ag2_overall_completeness",
    "WITH " + PAGES + " SELECT bool_and(reasons = '') AS complete, string_agg(DISTINCT nullif(reasons, ''), ',' ORDER BY nullif(reasons, '')) AS reasons, count(*) AS queries FROM done",
)
def _(t):
    return op.overall_completeness(op.page_completeness(pages(t), 4)).withColumn("reasons", sv.joined("reasons"))


@query(
    "ag3_coverage_state",
    """WITH g AS (SELECT o_custkey, max(o_totalprice) > 100000 AS has_key, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS errors,
  bool_and(o_totalprice < 480000) AS complete, count(*) FILTER (o_orderstatus = 'F') AS events FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN NOT has_key THEN 'EVENT_COVERAGE_INCOMPLETE' WHEN errors > 0 THEN 'EVENT_DATA_ERROR' WHEN NOT complete THEN 'EVENT_COVERAGE_INCOMPLETE'
  WHEN events > 0 THEN 'EVENT_DETECTED' ELSE 'NO_OFFICIAL_EVENT_DETECTED' END AS state FROM g""",
)
def _(t):
    g = t.orders.groupBy("o_custkey").agg(
        (F.max("o_totalprice") > 100000).alias("has_key"),
        F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("errors"),
        F.bool_and(F.col("o_totalprice") < 480000).alias("complete"),
        F.count_if(F.col("o_orderstatus") == "F").alias("events"),
    )
    state = op.coverage_state(F.col("has_key"), F.col("errors"), F.col("complete"), F.col("events"))
    return g.select("o_custkey", state.alias("state"))


@query(
    "fn18_response_state",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'UNREACHABLE' WHEN k % 6 = 0 THEN 'EVENT_DATA_ERROR' WHEN k % 6 = 1 THEN 'NO_DATA' WHEN k % 6 = 2 THEN 'API_ERROR'
  WHEN k % 6 = 3 THEN 'RESPONSE_SHAPE_UNEXPECTED' ELSE 'OK' END AS state FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("int") % 6
    body = (
        F.when(k == 0, F.substring("props", 1, 4)).when(k == 1, '{"status": "013"}').when(k == 2, '{"status": "020", "list": []}')
        .when(k == 3, F.col("props")).otherwise('{"status": "000", "list": [], "total_page": 1, "total_count": 0}')
    )
    return t.events.select("event_id", op.response_state(F.col("event_type") != "error", body).alias("state"))


ISSUER = """ip AS (SELECT l_suppkey AS ticker, l_linenumber AS page, CASE WHEN l_suppkey % 5 = 0 AND l_linenumber >= 3 THEN 'API_ERROR' WHEN l_suppkey % 7 = 0 AND l_linenumber >= 2 THEN 'RESPONSE_SHAPE_UNEXPECTED' WHEN l_suppkey % 11 = 1 THEN 'NO_DATA' ELSE 'OK' END AS state,
  CASE WHEN l_suppkey % 11 <> 1 THEN CAST(6 + l_suppkey % 3 AS INT) END AS total_page FROM lineitem WHERE (l_suppkey % 11 <> 1 OR l_linenumber = 1) AND (l_suppkey % 13 <> 0 OR l_linenumber <> 3)),
pt0 AS (SELECT ticker, min_by(state, page) FILTER (state NOT IN ('OK', 'NO_DATA')) AS error, count(DISTINCT page) FILTER (state IN ('OK', 'NO_DATA')) AS pages_collected, coalesce(max(page) FILTER (state IN ('OK', 'NO_DATA')), 0) AS lp,
  max(CASE state WHEN 'NO_DATA' THEN 1 WHEN 'OK' THEN total_page END) AS expd, max(CASE WHEN state = 'NO_DATA' THEN 0 WHEN state = 'OK' THEN tc END) AS tot FROM ip JOIN (SELECT l_suppkey AS ticker, count(*) AS tc FROM lineitem GROUP BY 1) USING (ticker) GROUP BY 1),
pt AS (SELECT ticker, error, pages_collected, CASE WHEN error IS NULL THEN expd END AS pages_expected, CASE WHEN error IS NULL THEN tot END AS total_count, error IS NULL AND pages_collected = lp AND lp >= greatest(expd, 1) AS ok FROM pt0),
ir AS (SELECT l_suppkey AS ticker, l_partkey % 11 = 0 AS bad, title FROM lineitem JOIN part_title ON id = l_partkey),
ic AS (SELECT ticker, count(*) FILTER (NOT bad) AS collected, count(*) FILTER (NOT bad AND regexp_matches(title, 'red|bolt')) AS findings,
  count(*) FILTER (bad) + count(*) FILTER (NOT bad AND regexp_matches(title, 'red|bolt') AND contains(title,'hot') AND contains(title,'plate')) AS uninterpreted FROM ir GROUP BY 1)"""


def issuer_log(t):
    """Response pages and listed rows per supplier."""
    li = t.lineitem
    bad = (
        F.when((F.col("l_suppkey") % 5 == 0) & (F.col("l_linenumber") >= 3), "API_ERROR")
        .when((F.col("l_suppkey") % 7 == 0) & (F.col("l_linenumber") >= 2), "RESPONSE_SHAPE_UNEXPECTED")
        .when(F.col("l_suppkey") % 11 == 1, "NO_DATA")
        .otherwise("OK")
    )
    size = li.groupBy("l_suppkey").agg(F.count("*").alias("total_count")).withColumnRenamed("l_suppkey", "ticker")
    # Some suppliers answer "no data" on one page, some never show page three.
    logged = ((F.col("l_suppkey") % 11 != 1) | (F.col("l_linenumber") == 1)) & ((F.col("l_suppkey") % 13 != 0) | (F.col("l_linenumber") != 3))
    log = li.where(logged).select(
        F.col("l_suppkey").alias("ticker"), F.col("l_linenumber").alias("page"), bad.alias("state"),
        F.when(F.col("l_suppkey") % 11 != 1, (F.lit(6) + F.col("l_suppkey") % 3).cast("int")).alias("total_page"),
    ).distinct().join(size, "ticker")
    title = sv.part_title(t).select(F.col("id").alias("l_partkey"), "title")
    rows = li.join(title, "l_partkey").select(
        F.col("l_suppkey").alias("ticker"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_orderkey").cast("string")).alias("rcept_no"),
        F.col("title").alias("report_nm"),
        F.lit("").alias("stock_code"),
    )
    return log, rows


@query(
    "ag9_issuer_reconciliation",
    "WITH " + sv.PART_TITLE + "," + ISSUER + """ SELECT ticker, ok, error, pages_expected, pages_collected, total_count, CASE WHEN ok THEN collected END AS collected,
  CASE WHEN ok THEN findings END AS findings, CASE WHEN ok THEN uninterpreted END AS uninterpreted
FROM pt JOIN ic USING (ticker)""",
)
def _(t):
    pages_, rows = issuer_log(t)
    return op.reconcile_issuers(pages_, fl.reconcile_rows(rows), sv.ACTIONS, ("red", "bolt"))


EVENT_ROWS = """ev_row AS (SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_suppkey AS VARCHAR) AS brand, title FROM lineitem JOIN part_title ON id = l_partkey
  WHERE l_partkey % 11 <> 0 AND regexp_matches(title, 'red|bolt'))"""
ISSUER_EVENTS = EVENTS_SQL.replace(sv.PART_TITLE + ",", sv.PART_TITLE + ", " + EVENT_ROWS + ",", 1).replace("FROM part_title p)", "FROM ev_row p)")


@query(
    "ag9_issuer_evidence",
    "WITH " + ISSUER_EVENTS + "," + ISSUER + """, cn AS (SELECT CAST(code AS BIGINT) AS ticker, count(*) FILTER (subject = 'SELF' AND unresolved <> '') AS open_self,
  count(*) FILTER (subject <> 'SELF') AS subsidiary, count(*) FILTER (subject = 'SELF' AND done AND unresolved <> '') AS company_done_awaiting_exchange,
  count(*) FILTER (subject = 'SELF' AND unresolved = '') AS fully_resolved, count(*) AS events FROM ev GROUP BY 1)
SELECT ticker, ok, error, CASE WHEN ok THEN coalesce(open_self, 0) END AS open_self, CASE WHEN ok THEN coalesce(subsidiary, 0) END AS subsidiary,
  CASE WHEN ok THEN coalesce(company_done_awaiting_exchange, 0) END AS company_done_awaiting_exchange, CASE WHEN ok THEN coalesce(fully_resolved, 0) END AS fully_resolved,
  CASE WHEN ok THEN coalesce(events, 0) END AS events, '2026-01-02 20:00:00' AS expires_at
FROM pt LEFT JOIN cn USING (ticker)""",
)
def _(t):
    pages_, rows = issuer_log(t)
    done = job.issuer_evidence(pages_, rows, F.lit("2026-01-02").cast("timestamp_ntz"), sv.ACTIONS, ("red", "bolt"))
    return done.select("ticker", "ok", "error", *job.COUNTS, F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


EVID = """evd AS (SELECT printf('%06d', o_custkey) AS code, max(o_orderdate) AS queried_at, count(*) FILTER (o_orderpriority = '2-HIGH') AS findings,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS open_self, bool_or(o_totalprice > 450000) AS ok FROM orders GROUP BY 1)"""


def evidence(t):
    return t.orders.groupBy(sv.six(F.col("o_custkey")).alias("code")).agg(
        F.max("o_orderdate").alias("queried_at"),
        F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("findings"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("open_self"),
        F.bool_or(F.col("o_totalprice") > 450000).alias("ok"),
    )


STATES = EVID + "," + sv.UNIVERSE + """, sts AS (SELECT u.code, CASE WHEN queried_at IS NULL OR queried_at < TIMESTAMP '2001-01-01' THEN 'PENDING' WHEN NOT ok THEN 'CHECK_FAILED'
  WHEN findings > 0 THEN 'CHECKED_FOUND' ELSE 'CHECKED_NONE' END AS state FROM universe u LEFT JOIN evd USING (code))"""


@query("ag10_ticker_states", "WITH " + STATES + " SELECT * FROM sts")
def _(t):
    return op.ticker_states(sv.universe(t), evidence(t), F.lit("2001-01-01").cast("timestamp_ntz"))


@query(
    "ag10_cycle_progress",
    "WITH " + STATES + """, c AS (SELECT count(*) AS universe, count(*) FILTER (state <> 'PENDING') AS attempted, count(*) FILTER (state LIKE 'CHECKED%') AS verified FROM sts)
SELECT *, CAST(round(100.0 * verified / universe) AS BIGINT) AS progress_pct, attempted = universe AS complete, CASE WHEN attempted <> universe THEN 'S' END AS started_at, CASE WHEN attempted = universe THEN 'S' END AS completed_started_at,
  CASE WHEN attempted = universe THEN 'N' ELSE 'L' END AS last_completed_at FROM c""",
)
def _(t):
    states = op.ticker_states(sv.universe(t), evidence(t), F.lit("2001-01-01").cast("timestamp_ntz"))
    return op.cycle_progress(states, F.lit("S"), F.lit("N"), F.lit("L"))


@query(
    "ag11_run_summary",
    "WITH " + EVID + "," + sv.UNIVERSE + """ SELECT count(*) FILTER (ok AND findings > 0) AS with_documents, count(*) FILTER (ok AND open_self > 0) AS with_open_event,
  count(*) FILTER (ok AND findings > 0 AND open_self = 0) AS subsidiary_only, count(*) FILTER (ok AND findings = 0) AS clean, count(*) FILTER (NOT ok) AS failed,
  count(*) FILTER (ok IS NULL) AS not_processed FROM universe LEFT JOIN evd USING (code)""",
)
def _(t):
    return op.run_summary(sv.universe(t), evidence(t))


@query(
    "str7_evidence_freshness",
    """SELECT event_id, strftime(ts + INTERVAL 20 HOUR, '%Y-%m-%d %H:%M:%S') AS expires_at, CASE WHEN ts + INTERVAL 20 HOUR >= TIMESTAMP '2024-01-15' THEN 'FRESH' ELSE 'UNKNOWN' END AS freshness FROM events""",
)
def _(t):
    rows = t.events.select("event_id", F.col("ts").alias("queried_at"))
    fresh = op.fresh_evidence(rows, F.lit("2024-01-15").cast("timestamp_ntz"))
    return fresh.select("event_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"), "freshness")


@query(
    "str4_last_complete",
    """WITH r AS (SELECT o_custkey AS source, o_orderdate + INTERVAL 10 HOUR AS fin, CAST(o_orderdate AS DATE) - 1 AS ws, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 3 AS INT) AS we,
  o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' AS good FROM orders)
SELECT source, strftime(fin, '%Y-%m-%d %H:%M:%S') AS finished_at, strftime(we, '%Y-%m-%d') AS window_end, strftime(least(fin, CAST(we + 1 AS TIMESTAMP) - INTERVAL 9 HOUR), '%Y-%m-%d %H:%M:%S') AS covered_until
FROM r WHERE good QUALIFY row_number() OVER (PARTITION BY source ORDER BY fin DESC, ws DESC, we DESC) = 1""",
)
def _(t):
    day = F.col("o_orderdate").cast("date")
    runs = t.orders.select(
        F.col("o_custkey").alias("source"),
        F.to_timestamp_ltz(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 10 HOURS"), "yyyy-MM-dd HH:mm:ss")).alias("finished_at"),
        F.when(F.col("o_orderstatus") == "P", "DATA_ERROR").otherwise("OK").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "EVENT_COVERAGE_INCOMPLETE").otherwise("EVENT_DETECTED").alias("event_state"),
        F.date_sub(day, 1).alias("window_start"),
        F.date_sub(day, (F.col("o_orderkey") % 3).cast("int")).alias("window_end"),
    )
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return op.last_complete(runs).select("source", text("finished_at"), sv.day_text("window_end").alias("window_end"), text("covered_until"))


@query("wn10_rotation_targets", "WITH " + sv.UNIVERSE + " SELECT code, CAST(CASE WHEN code > '001300' THEN 0 ELSE 1 END AS INT) AS turn FROM universe ORDER BY turn, code LIMIT 400")
def _(t):
    return op.rotation_targets(sv.universe(t), "001300", 400)


WANTED = "wanted AS (SELECT printf('%06d', o_custkey) AS code, min(o_orderkey) AS ord FROM orders GROUP BY 1)"


def wanted(t):
    return t.orders.groupBy(sv.six(F.col("o_custkey")).alias("code")).agg(F.min("o_orderkey").alias("ord"))


@query("wn10_listed_targets", "WITH " + sv.UNIVERSE + "," + WANTED + " SELECT code, ord FROM wanted WHERE code IN (SELECT code FROM universe) ORDER BY ord LIMIT 100")
def _(t):
    return op.listed_targets(sv.universe(t), wanted(t), 100)


@query(
    "wn12_gap_days",
    """WITH s AS (SELECT o_custkey AS source, CAST(max(o_orderdate) AS DATE) AS since FROM orders GROUP BY 1), x AS (SELECT *, least(since, DATE '2001-06-29') AS st FROM s),
y AS (SELECT *, least(DATE '2001-06-30', st + 13) AS en FROM x)
SELECT source, strftime(st, '%Y-%m-%d') AS first_day, strftime(en, '%Y-%m-%d') AS last_day, CAST(en - st + 1 AS INT) AS days, CAST(DATE '2001-06-30' - en AS INT) AS behind_days FROM y""",
)
def _(t):
    sources = t.orders.groupBy(F.col("o_custkey").alias("source")).agg(F.max("o_orderdate").cast("date").alias("confirmed_until"))
    rows = op.gap_days(sources, F.lit("2001-06-30").cast("date"))
    return rows.select(
        "source", sv.day_text(F.element_at("days", 1)).alias("first_day"), sv.day_text(F.element_at("days", -1)).alias("last_day"),
        F.size("days").alias("days"), "behind_days",
    )


@query(
    "wn13_trading_period",
    """WITH cal AS (SELECT CAST(unnest(generate_series(DATE '1994-12-31', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
ses AS (SELECT d FROM cal WHERE isodow(d) < 6 AND d NOT IN (DATE '1995-05-01', DATE '1997-12-25', DATE '2000-01-03', DATE '2000-01-04')),
num AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM ses),
b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS base FROM orders), n AS (SELECT base, (SELECT min(i) FROM num WHERE d > base) AS i FROM b)
SELECT o_orderkey, strftime(s.d, '%Y-%m-%d') AS period_start, strftime(e.d, '%Y-%m-%d') AS period_end FROM orders JOIN n ON CAST(o_orderdate AS DATE) = base
JOIN num s ON s.i = n.i JOIN num e ON e.i = n.i + 4""",
)
def _(t):
    holidays = ("1995-05-01", "1997-12-25", "2000-01-03", "2000-01-04")
    period = op.trading_period(F.col("o_orderdate").cast("date"), 5, holidays)
    rows = t.orders.select("o_orderkey", period.alias("p"))
    return rows.select("o_orderkey", sv.day_text("p.period_start").alias("period_start"), sv.day_text("p.period_end").alias("period_end"))


INC = """inc AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'click' THEN 'list' WHEN 'view' THEN 'mapping' WHEN 'signup' THEN 'financial' ELSE event_type END AS kind, 1 + event_id % 40 AS n, event_id FROM events)"""


def increments(t):
    kind = F.when(F.col("event_type") == "click", "list").when(F.col("event_type") == "view", "mapping").when(F.col("event_type") == "signup", "financial").otherwise(F.col("event_type"))
    return t.events.select(sv.day_text("ts").alias("day"), kind.alias("kind"), (F.lit(1) + F.col("event_id") % 40).alias("n"), "event_id")


KIND = "CASE WHEN kind IN ('list','mapping','detail','financial','other') THEN kind ELSE 'other' END"


@query("ag14_ledger_rollup", f"WITH {INC} SELECT day, {KIND} AS kind, CAST(sum(n) AS BIGINT) AS n FROM inc GROUP BY 1, 2 UNION ALL SELECT day, NULL, CAST(sum(n) AS BIGINT) FROM inc GROUP BY 1")
def _(t):
    return lg.roll_up(increments(t))


@query(
    "ag14_usage_report",
    f"""WITH {INC}, d AS (SELECT day, CAST(sum(n) AS BIGINT) AS total FROM inc GROUP BY 1) SELECT day, total, CASE WHEN total >= 7000 THEN 'DART_BUDGET_EXCEEDED' WHEN total >= 6800 THEN 'DART_BUDGET_WARNING' ELSE 'BUDGET_OK' END AS status,
  greatest(0, 7000 - total) AS remaining, round(total / 7000 * 100, 2) AS used_pct FROM d""",
)
def _(t):
    return lg.usage_report(increments(t), 7000, 6800)


@query(
    "ag15_ledger_merge",
    f"""WITH {INC}, b AS (SELECT {KIND} AS kind, sum(n) AS n FROM inc WHERE day = (SELECT max(day) FROM inc) GROUP BY 1),
o AS (SELECT {KIND} AS kind, sum(n + CASE WHEN event_id % 2 = 0 THEN 3 ELSE -1 END) AS n FROM inc WHERE day = (SELECT max(day) FROM inc) GROUP BY 1),
h AS (SELECT {KIND} AS kind, sum(CASE WHEN kind = 'list' THEN n - 5 ELSE n + 2 END) AS n FROM inc WHERE day = (SELECT max(day) FROM inc) GROUP BY 1)
SELECT (SELECT max(day) FROM inc) AS day, b.kind, CAST(b.n + greatest(0, o.n - b.n) + greatest(0, h.n - b.n) AS BIGINT) AS n,
  (SELECT count(*) + 4 FROM inc WHERE day = (SELECT max(day) FROM inc)) AS runs, (SELECT max(day) FROM inc) || ' 21:00' AS updated_at FROM b JOIN o USING (kind) JOIN h USING (kind)""",
)
def _(t):
    inc = increments(t)
    ours = inc.withColumn("n", F.col("n") + F.when(F.col("event_id") % 2 == 0, 3).otherwise(-1))
    theirs = inc.withColumn("n", F.when(F.col("kind") == "list", F.col("n") - 5).otherwise(F.col("n") + 2))
    # The base counts one run a row; our side has four more, theirs has two less and the later stamp.
    size = inc.groupBy("day").agg(F.count("*").alias("runs"))

    def version(df, more, clock):
        return df.join(size, "day").withColumn("runs", F.col("runs") + more).withColumn("updated_at", F.concat("day", F.lit(clock)))

    return lg.merge_ledgers(version(inc, 0, " 09:00"), version(ours, 4, " 20:00"), version(theirs, -2, " 21:00"))


@query(
    "ag16_request_projection",
    """SELECT o_orderkey, o_orderkey % 8 * 15 + 1 + o_custkey % 150 + o_custkey % 7 AS expected_daily, round((o_orderkey % 8 * 15 + 1 + o_custkey % 150 + o_custkey % 7) / 10000 * 100, 2) AS pct_of_hard_limit FROM orders""",
)
def _(t):
    plan = t.orders.select(
        "o_orderkey",
        (F.col("o_orderkey") % 8).alias("list_per_run"),
        F.lit(15).alias("runs_per_day"),
        F.lit(1).alias("mapping_per_day"),
        (F.col("o_custkey") % 150).alias("financial_per_day"),
        (F.col("o_custkey") % 7).alias("detail_per_day"),
    )
    return lg.project_requests(plan).select("o_orderkey", "expected_daily", "pct_of_hard_limit")


@query(
    "cor9_ledger_contract",
    """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(day(min(ts)) AS INT) AS k, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY 1),
p AS (SELECT CASE WHEN k % 10 = 1 THEN day || 'x' ELSE day END AS day, unnest([CASE WHEN k % 9 = 0 THEN 'SCHEMA' END, CASE WHEN k % 10 = 1 THEN 'DAY_FORMAT' END,
  CASE WHEN k % 8 = 0 THEN 'STAMP_FORMAT' END, CASE WHEN k % 7 = 0 THEN 'UNKNOWN_KIND' END, CASE WHEN k % 6 = 0 THEN 'NEGATIVE' END,
  CASE WHEN k % 10 <> 1 AND k % 5 = 0 THEN 'SHRUNK' END]) AS problem FROM d)
SELECT day, problem FROM p WHERE problem IS NOT NULL""",
)
def _(t):
    days = t.events.groupBy(sv.day_text("ts").alias("day")).agg(
        F.dayofmonth(F.min("ts")).alias("k"), F.count_if(F.col("event_type") == "click").alias("n")
    )
    k = F.col("k")
    counts = F.when(k % 7 == 0, F.create_map(F.lit("list"), F.col("n"), F.lit("ghost"), F.col("n"))).otherwise(F.create_map(F.lit("list"), F.col("n")))
    versions = days.select(
        F.when(k % 10 == 1, F.concat("day", F.lit("x"))).otherwise(F.col("day")).alias("day"),
        F.when(k % 8 == 0, F.col("day")).otherwise(F.concat("day", F.lit("T01:02:03Z"))).alias("updated_at"),
        F.when(k % 9 == 0, "v0").otherwise("dart_budget_v1").alias("schema_version"),
        counts.alias("counts"),
        F.when(k % 6 == 0, -1).otherwise(5).cast("bigint").alias("runs"),
    )
    head = days.select(
        "day",
        F.create_map(F.lit("list"), F.when(k % 5 == 0, F.col("n") + 1).otherwise(F.col("n"))).alias("counts"),
        F.when(k % 6 == 0, -1).otherwise(5).cast("bigint").alias("runs"),
    )
    return lg.ledger_problems(versions, head)
