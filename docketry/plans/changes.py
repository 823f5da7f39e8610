"""Queries on activity windows, change tables, company pages and recent lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import changes as op
from docketry.operators import filings as fl
from docketry.operators.classify import classify_titles
from docketry.plans import standins as sv
from docketry.plans.filings import MERGED, two_sources
from docketry.plans.registry import query
from docketry.session import cut_lineage


def classified(t):
    return classify_titles(sv.tracked_filing(t), "title", sv.CATEGORIES)


CLASSED = sv.TRACKED + ", cls AS (SELECT *, " + sv.CATEGORY_SQL + " AS category FROM tracked)"
WIN = """, span AS (SELECT min(received_on) AS lo, max(received_on) AS hi, date_diff('day', min(received_on), max(received_on)) + 1 AS cov FROM {src}),
w0 AS (SELECT lo, hi, cov, CAST(CASE WHEN cov >= 60 THEN 30 ELSE greatest(7, cov // 2) END AS INT) AS days FROM span),
win AS (SELECT lo, hi, days, hi - (days - 1) AS rf, hi - (2 * days - 1) AS pf, hi - days AS pt, hi - (2 * days - 1) >= lo AS covered FROM w0)"""


@query(
    "ag4_category_counts",
    "WITH " + CLASSED + " SELECT code, category, count(*) AS n FROM cls WHERE received_on BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1, 2",
)
def _(t):
    return op.category_counts(classified(t), F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"))


def changes_sql(filter_sql, win_sql):
    return (
        "WITH " + CLASSED + win_sql + """,
cnt AS (SELECT code, category, count(*) FILTER (received_on BETWEEN rf AND hi) AS r, count(*) FILTER (received_on BETWEEN pf AND pt) AS p,
  count(*) FILTER (received_on BETWEEN rf AND hi AND is_correction) AS cor, any_value(covered) AS covered, any_value(CAST(days AS VARCHAR)) AS n,
  any_value(CASE category WHEN 'purchase' THEN 'Purchase' WHEN 'signup' THEN 'Sign-up' WHEN 'traffic' THEN 'Traffic' ELSE category END) AS lb
  FROM cls, win WHERE received_on BETWEEN pf AND hi GROUP BY 1, 2)
SELECT code, CASE category WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'traffic' THEN 2 ELSE 3 END AS position,
  CASE WHEN NOT covered THEN 'RECENT_ONLY' WHEN p = 0 THEN 'NEW_CATEGORY' WHEN r < p THEN 'FEWER' WHEN r > p THEN 'MORE' ELSE 'SAME' END AS type,
  category, r AS recent, CASE WHEN covered THEN p END AS prior,
  CASE WHEN NOT covered THEN '최근 '||n||'일에 '||lb||' 공시 '||r||'건 (이전 창은 자료가 덮이지 않아 비교하지 않음)'
       WHEN p = 0 THEN '최근 '||n||'일에 '||lb||' 공시 '||r||'건 — 그 이전 '||n||'일에는 0건'
       WHEN r = 0 THEN '최근 '||n||'일에 '||lb||' 공시 0건 — 그 이전 '||n||'일에는 '||p||'건'
       WHEN r > p THEN lb||' 공시 '||r||'건 — 이전 '||n||'일 '||p||'건보다 늘었다'
       WHEN r < p THEN lb||' 공시 '||r||'건 — 이전 '||n||'일 '||p||'건보다 줄었다'
       ELSE lb||' 공시 '||r||'건 (이전 '||n||'일과 같음)' END AS text
FROM cnt WHERE covered OR r > 0
UNION ALL
SELECT code, 4, 'CORRECTIONS', NULL, CAST(sum(cor) AS BIGINT), NULL, '최근 '||any_value(n)||'일 정정 공시 '||CAST(sum(cor) AS BIGINT)||'건 — 정정 전후는 원문 비교로 확인'
FROM cnt GROUP BY code HAVING sum(cor) > 0"""
    )


@query("ag5_window_changes", changes_sql("", WIN.format(src="tracked")))
def _(t):
    rows = classified(t)
    return op.window_changes(rows, op.data_windows(sv.tracked_filing(t)).scalar(), sv.CATEGORIES)


@query(
    "ag5_uncovered_prior",
    changes_sql("", """, win AS (SELECT DATE '2024-01-20' AS lo, DATE '2024-01-30' AS hi, 7 AS days, DATE '2024-01-24' AS rf,
  DATE '2024-01-17' AS pf, DATE '2024-01-23' AS pt, false AS covered)"""),
)
def _(t):
    return op.window_changes(classified(t), op.windows_between("2024-01-20", "2024-01-30"), sv.CATEGORIES)


@query(
    "ag6_company_headers",
    "WITH " + MERGED + WIN.format(src="merged") + """ SELECT code, count(*) AS filing_count, strftime(max(received_on), '%Y-%m-%d') AS latest_received_on,
  count(*) FILTER (contains(sources, 'list') AND received_on BETWEEN rf AND hi) AS recent_count,
  CASE WHEN any_value(covered) THEN count(*) FILTER (contains(sources, 'list') AND received_on BETWEEN pf AND pt) END AS prior_count,
  greatest(0, count(*) - 40) AS filings_truncated FROM merged, win GROUP BY code""",
)
def _(t):
    first, second = two_sources(t)
    # The merged rows are written once: the span and the headers both read them.
    merged = cut_lineage(fl.merge_filings(first, second).withColumn("listed", F.array_contains("sources", "list")).drop("title"), "merged")
    return op.company_headers(merged, op.data_windows(merged).scalar()).withColumn("latest_received_on", sv.day_text("latest_received_on"))


@query(
    "ag6_coverage_summary",
    "WITH " + sv.TRACKED + """ SELECT count(DISTINCT code) AS companies_with_filings, count(*) AS filings,
  strftime(min(received_on), '%Y-%m-%d') AS "from", strftime(max(received_on), '%Y-%m-%d') AS "to",
  (SELECT count(*) FROM universe) AS tracked_companies FROM tracked""",
)
def _(t):
    out = op.coverage_summary(sv.universe(t), sv.tracked_filing(t))
    return out.withColumn("from", sv.day_text("from")).withColumn("to", sv.day_text("to"))


def windows_out(win):
    days = ("recent_from", "recent_to", "prior_from", "prior_to", "coverage_from")
    return win.select(
        F.col("win.days").alias("days"),
        F.col("win.fully_covered").alias("fully_covered"),
        *[sv.day_text(f"win.{d}").alias(d) for d in days],
    )


WIN_OUT = """ SELECT days, covered AS fully_covered, strftime(rf, '%Y-%m-%d') AS recent_from, strftime(hi, '%Y-%m-%d') AS recent_to,
  strftime(pf, '%Y-%m-%d') AS prior_from, strftime(pt, '%Y-%m-%d') AS prior_to, strftime(lo, '%Y-%m-%d') AS coverage_from FROM win"""


@query("wn1_windows_short_span", "WITH " + sv.FILING + WIN.format(src="filing") + WIN_OUT)
def _(t):
    return windows_out(op.data_windows(sv.filing(t)))


@query(
    "wn1_windows_long_span",
    "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS received_on FROM orders)" + WIN.format(src="o") + WIN_OUT,
)
def _(t):
    return windows_out(op.data_windows(t.orders.select(F.col("o_orderdate").cast("date").alias("received_on"))))


@query(
    "wn2_recent_list",
    "WITH " + sv.TRACKED + """ SELECT code, rcept_no, title, strftime(received_on, '%Y-%m-%d') AS received_on FROM tracked
WHERE received_on >= (SELECT max(received_on) FROM tracked) - 6
QUALIFY row_number() OVER (PARTITION BY code ORDER BY received_on DESC, detected_at DESC, rcept_no DESC) <= 3""",
)
def _(t):
    return op.recent_list(sv.tracked_filing(t)).select("code", "rcept_no", "title", sv.day_text("received_on").alias("received_on"))


@query(
    "wn3_latest_cards",
    "WITH " + sv.TRACKED + """ SELECT code, rcept_no, title, strftime(received_on, '%Y-%m-%d') AS received_on, same_day FROM (
  SELECT *, count(*) OVER (PARTITION BY code, received_on) AS same_day FROM tracked)
QUALIFY row_number() OVER (PARTITION BY code ORDER BY received_on DESC, detected_at DESC, rcept_no DESC) = 1
ORDER BY received_on DESC, detected_at DESC, rcept_no DESC LIMIT 6""",
)
def _(t):
    cards = op.latest_cards(sv.tracked_filing(t))
    return cards.select("code", "rcept_no", "title", sv.day_text("received_on").alias("received_on"), "same_day")


@query(
    "wn4_filing_page",
    "WITH " + sv.TRACKED + """ SELECT code, rcept_no, rn AS rank FROM (SELECT code, rcept_no, CAST(row_number() OVER (PARTITION BY code ORDER BY received_on DESC, rcept_no DESC) AS INT) AS rn FROM tracked) WHERE rn <= 40""",
)
def _(t):
    return op.filing_page(sv.tracked_filing(t)).select("code", "rcept_no", "rank")


@query(
    "wn5_active_companies",
    "WITH " + sv.TRACKED + " SELECT code, strftime(max(received_on), '%Y-%m-%d') AS latest, count(*) AS n FROM tracked GROUP BY code ORDER BY max(received_on) DESC, code LIMIT 80",
)
def _(t):
    return op.active_companies(sv.tracked_filing(t)).withColumn("latest", sv.day_text("latest"))
