"""Queries on annual statements and financial products."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import amounts as am
from docketry.operators import financials as op
from docketry.plans import standins as sv
from docketry.plans.registry import query

YEARS = sv.YEARS

TARGETS = {
    "revenue": (("IS", "CIS"), ("R-0", "R-1"), ("A name 3",)),
    "totalAssets": (("BS",), ("N-2",), ("N name 5", "R name 6")),
    "totalEquity": (("BS",), ("Z-9",), ("A name 7",)),
    "costOfSales": (("IS",), ("Q-1",), ("none",)),
}
LINES = """
line AS (SELECT printf('%06d', l_partkey) AS code, CAST(year(l_shipdate) AS INT) AS year, l_orderkey * 8 + l_linenumber AS ord,
  CASE WHEN l_quantity < 10 THEN NULL WHEN l_linestatus = 'O' THEN 'IS' ELSE 'BS' END AS sj,
  l_returnflag || '-' || (l_suppkey % 4) AS aid, l_returnflag || 'name' || l_linenumber AS nm,
  CASE WHEN l_tax = 0.05 THEN '-' ELSE format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) END AS amt FROM lineitem),
tgt(account, kind, cand, sj, tier, so, co) AS (VALUES {rows}),
hit AS (SELECT l.code, l.year, l.ord, l.amt, t.account, t.tier, t.so, t.co FROM line l JOIN tgt t
  ON ((t.kind = 'id' AND l.aid = t.cand) OR (t.kind = 'name' AND l.nm = t.cand)) AND (t.sj IS NULL OR t.sj = l.sj)),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY code, year, account ORDER BY tier, so, co, ord, amt) = 1),
got AS (SELECT code, year, account, CASE WHEN amt <> '-' THEN CAST(replace(amt, ',', '') AS BIGINT) END AS amount,
  CASE WHEN amt <> '-' THEN CASE tier WHEN 1 THEN 'account_id' WHEN 2 THEN 'account_nm' WHEN 3 THEN 'account_id_any_sj' ELSE 'account_nm_any_sj' END END AS matched_by FROM best),
sec AS (SELECT printf('%06d', p_partkey) AS code, p_type AS sector FROM part),
grid AS (SELECT y.code, y.year, a.account, g.amount, g.matched_by, CASE WHEN g.amount IS NOT NULL THEN 'NUMBER'
    WHEN g.code IS NULL AND sector = 'PROMO' AND a.account IN ('revenue', 'costOfSales') THEN 'NOT_APPLICABLE_FINANCIAL_SECTOR' ELSE 'NOT_AVAILABLE' END AS value_state
  FROM (SELECT DISTINCT code, year FROM line) y CROSS JOIN (VALUES ('revenue'), ('totalAssets'), ('totalEquity'), ('costOfSales')) a(account)
  LEFT JOIN got g ON g.code = y.code AND g.year = y.year AND g.account = a.account LEFT JOIN sec s ON s.code = y.code)"""
LINES = LINES.replace(
    "{rows}",
    ", ".join(
        "('{account}','{kind}','{cand}',{sj},{tier},{sj_ord},{cand_ord})".format(**{**r, "sj": f"'{r['sj']}'" if r["sj"] else "NULL"})
        for r in op.target_rows(TARGETS)
    ),
)


def lines(t):
    return t.lineitem.select(
        sv.six(F.col("l_partkey")).alias("code"),
        F.year("l_shipdate").alias("year"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_quantity") >= 10, F.when(F.col("l_linestatus") == "O", "IS").otherwise("BS")).alias("sj_div"),
        F.concat("l_returnflag", F.lit("-"), (F.col("l_suppkey") % 4).cast("string")).alias("account_id"),
        F.concat("l_returnflag", F.lit(" name "), F.col("l_linenumber").cast("string")).alias("account_nm"),
        F.when(F.col("l_tax") == 0.05, "-").otherwise(F.format_number(F.floor("l_extendedprice"), 0)).alias("thstrm_amount"),
    )


def grid(t):
    sectors = t.part.select(sv.six(F.col("p_partkey")).alias("code"), F.col("p_type").alias("sector"))
    return op.account_grid(lines(t), sectors, TARGETS, ("PROMO",), ("revenue", "costOfSales"))


@query("fin1_account_extraction", "WITH " + LINES + " SELECT code, year, account, amount, matched_by FROM got")
def _(t):
    rows = op.extract_accounts(lines(t), TARGETS)
    return rows.withColumn("amount", F.col("amount").cast("bigint"))


@query("fin2_missing_or_not_applicable", "WITH " + LINES + " SELECT code, year, account, amount, matched_by, value_state FROM grid")
def _(t):
    return grid(t).withColumn("amount", F.col("amount").cast("bigint"))


@query(
    "ag13_statement_coverage",
    "WITH " + LINES + """ SELECT code, year, count(*) FILTER (value_state = 'NUMBER') AS found, count(*) FILTER (value_state <> 'NOT_APPLICABLE_FINANCIAL_SECTOR') AS applicable,
  round(coalesce(count(*) FILTER (value_state = 'NUMBER') / nullif(count(*) FILTER (value_state <> 'NOT_APPLICABLE_FINANCIAL_SECTOR'), 0), 0), 4) AS coverage FROM grid GROUP BY 1, 2""",
)
def _(t):
    return op.statement_coverage(grid(t))


@query(
    "fin3_basis_fallback",
    "WITH " + sv.UNIVERSE + """, av AS (SELECT printf('%06d', o_custkey) AS code, CAST(year(o_orderdate) AS INT) AS year, max(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END) AS cfs
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT u.code, y.year, CASE cfs WHEN 1 THEN 'CFS' WHEN 0 THEN 'OFS' END AS fs_div, CASE WHEN cfs IS NULL THEN 'NO_DATA' ELSE 'OK' END AS status
FROM universe u CROSS JOIN (VALUES (1997), (1998), (1999)) y(year) LEFT JOIN av ON av.code = u.code AND av.year = y.year""",
)
def _(t):
    status = F.col("o_orderstatus")
    available = t.orders.where(status != "P").select(
        sv.six(F.col("o_custkey")).alias("code"), F.year("o_orderdate").alias("year"), F.when(status == "F", "CFS").otherwise("OFS").alias("fs_div")
    )
    return op.choose_basis(sv.universe(t), available, YEARS)


@query(
    "fin4_point_in_time_record",
    """SELECT printf('%06d', o_custkey) AS code, CAST(year(o_orderdate) AS INT) - 1 AS year, '11011' AS reprt_code, 'LIVE_DART_PIT' AS source_mode,
  CASE WHEN o_orderstatus = 'P' THEN 'NOT_AVAILABLE' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS disclosed_at, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS detected_at,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS usable_from, 'DETECTED_AT' AS usable_from_basis, 'CONSENSUS_DATA_UNAVAILABLE' AS consensus, 'NOT_COMPUTABLE_WITHOUT_CONSENSUS' AS surprise FROM orders""",
)
def _(t):
    records = t.orders.select(
        sv.six(F.col("o_custkey")).alias("code"),
        (F.year("o_orderdate") - 1).alias("year"),
        F.lit("11011").alias("reprt_code"),
        F.when(F.col("o_orderstatus") != "P", sv.day_text("o_orderdate")).alias("disclosed_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("detected_at"),
    )
    return op.point_in_time_record(records)


def wide(t):
    return sv.finance(t).join(sv.universe(t).select("code", "sector"), "code")


def long_form(records):
    rows = records.unpivot(["code", "year", "status", "fs_div", "sector"], list(sv.ACCOUNTS), "account", "amount")
    applicable = ~((F.col("sector") == "FURNITURE") & (F.col("account") == "currentAssets"))
    return rows.withColumn("applicable", applicable)


def long(t):
    return long_form(wide(t))


YEAR_LIST = "(1997, 1998, 1999)"
WIDE = sv.FINANCE + "," + sv.UNIVERSE + """,
wide AS (SELECT f.*, sector FROM finance f JOIN universe USING (code)),
ok AS (SELECT * FROM wide WHERE status = 'OK' AND year IN (1997, 1998, 1999)),
long AS (""" + " UNION ALL ".join(
    f"SELECT code, year, status, fs_div, sector, '{a}' AS account, \"{a}\" AS amount FROM wide" for a in sv.ACCOUNTS
) + """),
vals AS (SELECT c.code, a.account, y.year, CASE WHEN l.status = 'OK' THEN l.fs_div END AS fs_div,
    CASE WHEN l.status = 'OK' AND NOT (c.sector = 'FURNITURE' AND a.account = 'currentAssets') THEN l.amount END AS amount,
    CASE WHEN l.status IS NULL OR l.status <> 'OK' THEN 'NOT_COLLECTED' WHEN c.sector = 'FURNITURE' AND a.account = 'currentAssets' THEN 'NOT_APPLICABLE'
         WHEN l.amount IS NULL THEN 'NOT_AVAILABLE' ELSE 'NUMBER' END AS value_state
  FROM (SELECT DISTINCT code, sector FROM ok) c CROSS JOIN (SELECT DISTINCT account FROM long) a CROSS JOIN (VALUES (1997), (1998), (1999)) y(year)
  LEFT JOIN long l ON l.code = c.code AND l.account = a.account AND l.year = y.year),
chg AS (SELECT b.code, b.account, a.year AS from_year, b.year AS to_year, a.amount AS prior, b.amount AS current, b.amount - a.amount AS change_abs,
    CASE WHEN a.amount > 0 THEN round((CAST(b.amount AS DOUBLE) - CAST(a.amount AS DOUBLE)) / CAST(a.amount AS DOUBLE) * 100, 1) + 0.0 END AS change_pct,
    CASE WHEN a.amount <= 0 THEN 'prior_zero_or_negative' END AS pct_reason
  FROM vals a JOIN vals b ON a.code = b.code AND a.account = b.account AND b.year = a.year + 1 AND a.fs_div = b.fs_div
  WHERE a.amount IS NOT NULL AND b.amount IS NOT NULL)"""


@query(
    "jn8_comparable_pairs",
    "WITH " + WIDE + " SELECT a.code, a.year AS from_year, b.year AS to_year, a.fs_div FROM ok a JOIN ok b ON a.code = b.code AND b.year = a.year + 1 AND a.fs_div = b.fs_div",
)
def _(t):
    return op.comparable_pairs(wide(t), YEARS)


@query(
    "wn8_year_over_year",
    "WITH " + WIDE + " SELECT * FROM chg",
)
def _(t):
    return op.account_changes(op.account_values(long(t), YEARS, sv.ACCOUNTS))


@query(
    "wn9_bar_widths",
    "WITH " + WIDE + """ SELECT code, account, year, amount, CAST(CASE WHEN amount = 0 THEN 0 ELSE greatest(2, CAST(round(CAST(abs(amount) AS DOUBLE)
  / max(CAST(abs(amount) AS DOUBLE)) OVER (PARTITION BY code, account) * 100) AS INT)) END AS INT) AS width FROM vals WHERE amount IS NOT NULL""",
)
def _(t):
    return op.bar_widths(op.account_values(long(t), YEARS, sv.ACCOUNTS)).drop("fs_div", "value_state")


@query(
    "wn11_most_needed",
    "WITH " + WIDE + """ SELECT code, count(*) AS missing, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM (
  SELECT u.code, y.year FROM universe u CROSS JOIN (VALUES (1997), (1998), (1999)) y(year)
  WHERE NOT EXISTS (SELECT 1 FROM finance f WHERE f.code = u.code AND f.year = y.year)) GROUP BY code ORDER BY missing DESC, code LIMIT 50""",
)
def _(t):
    top = op.most_needed(sv.universe(t), sv.finance(t).select("code", "year"), YEARS, 50)
    return top.withColumn("years", sv.joined(F.col("years").cast("array<string>")))


@query(
    "fin5_financial_values",
    "WITH " + WIDE + " SELECT * FROM vals",
)
def _(t):
    return op.account_values(long(t), YEARS, sv.ACCOUNTS)


@query(
    "fin5_company_periods",
    "WITH " + WIDE + """ SELECT u.code, y.year, coalesce(w.status, 'NOT_COLLECTED') AS status, w.fs_div, CASE w.fs_div WHEN 'CFS' THEN '연결' WHEN 'OFS' THEN '별도' END AS fs_div_label
FROM universe u CROSS JOIN (VALUES (1997), (1998), (1999)) y(year) LEFT JOIN wide w ON w.code = u.code AND w.year = y.year""",
)
def _(t):
    return op.periods(sv.universe(t), sv.finance(t), YEARS)


@query(
    "fin5_company_header",
    "WITH " + WIDE + " SELECT code, max_by(fs_div, year) AS fs_div, min(fs_div) <> max(fs_div) AS mixed_basis, count(*) AS ok_years FROM ok GROUP BY code",
)
def _(t):
    return op.companies_with_data(wide(t), YEARS)


RATIO = "CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100, 1) + 0.0 END"


@query(
    "fin6_derived_ratios",
    "WITH " + WIDE + " SELECT code, year, " + RATIO.format(a='"operatingIncome"', b="revenue") + " AS operating_margin_pct, "
    + RATIO.format(a='"totalLiabilities"', b='"totalEquity"') + " AS debt_to_equity_pct FROM ok",
)
def _(t):
    return op.derived_ratios(wide(t), YEARS)


FACTS = WIDE + """,
okall AS (SELECT * FROM wide WHERE status = 'OK'),
ask AS (SELECT DISTINCT printf('%06d', c_custkey) AS code, 1999 + CAST(c_custkey % 3 AS INT) AS analyzed_year FROM customer),
fr AS (SELECT a.code, a.analyzed_year, c.year, c.fs_div, CASE c.fs_div WHEN 'CFS' THEN '연결' ELSE '별도' END AS lb, c.revenue AS rev, p.revenue AS prev,
  CASE WHEN p.revenue > 0 THEN round((CAST(c.revenue AS DOUBLE) - CAST(p.revenue AS DOUBLE)) / CAST(p.revenue AS DOUBLE) * 100, 1) + 0.0 END AS g,
  """ + RATIO.format(a='c."operatingIncome"', b="c.revenue") + " AS m, " + RATIO.format(a='c."netIncome"', b='c."totalEquity"') + """ AS r
  FROM ask a JOIN okall c ON c.code = a.code AND c.year = a.analyzed_year - 1
  LEFT JOIN okall p ON p.code = a.code AND p.year = a.analyzed_year - 2 AND p.fs_div = c.fs_div),
facts AS (
  SELECT code, analyzed_year, year, fs_div, 'REVENUE_YOY' AS kind, g AS value,
    year || '년 매출액은 ' || (year - 1) || '년보다 ' || printf('%.1f', g) || '% ' || CASE WHEN rev >= prev THEN '늘었다' ELSE '줄었다' END || '(' || lb || ' 기준).' AS text FROM fr WHERE g IS NOT NULL
  UNION ALL SELECT code, analyzed_year, year, fs_div, 'OPERATING_MARGIN', m, year || '년 영업이익률(영업이익 ÷ 매출액)은 ' || printf('%.1f', m) || '%였다(' || lb || ' · 자체 계산).' FROM fr WHERE m IS NOT NULL
  UNION ALL SELECT code, analyzed_year, year, fs_div, 'ROE_YEAR_END_EQUITY', r, year || '년 ROE(당기순이익 ÷ 기말 자본총계)는 ' || printf('%.1f', r) || '%였다(' || lb || ' · 자체 계산 · 평균자본이 아닌 기말 기준).' FROM fr WHERE r IS NOT NULL)"""


def facts(t):
    asks = t.customer.select(
        sv.six(F.col("c_custkey")).alias("code"), (F.lit(1999) + (F.col("c_custkey") % 3).cast("int")).alias("analyzed_year")
    )
    return op.fact_lines(asks, wide(t))


@query("fin7_fact_lines", "WITH " + FACTS + " SELECT * FROM facts")
def _(t):
    return facts(t)


@query(
    "fin8_fact_audit",
    "WITH " + FACTS + """ SELECT code, analyzed_year, kind, CASE WHEN analyzed_year = 2000 THEN NULL WHEN kind = 'OPERATING_MARGIN' THEN value + 1 ELSE value END AS stored_value,
  value AS expected_value, CASE WHEN analyzed_year = 2000 THEN 'NOT_STORED' ELSE 'VALUE_DIFFERS' END AS problem
FROM facts WHERE analyzed_year = 2000 OR kind = 'OPERATING_MARGIN'""",
)
def _(t):
    good = facts(t)
    stored = good.where("analyzed_year <> 2000").withColumn(
        "value", F.when(F.col("kind") == "OPERATING_MARGIN", F.col("value") + 1).otherwise(F.col("value"))
    )
    return op.audit_facts(stored, good)


@query(
    "fin9_notable_changes",
    "WITH " + WIDE + """ SELECT * FROM (SELECT *, CASE WHEN prior > 0 AND current < 0 THEN 'PROFIT_TO_LOSS' WHEN prior < 0 AND current > 0 THEN 'LOSS_TO_PROFIT'
  WHEN abs(change_pct) >= 20 THEN CASE WHEN change_pct > 0 THEN 'UP' ELSE 'DOWN' END END AS flag FROM chg) WHERE flag IS NOT NULL""",
)
def _(t):
    return op.notable_changes(op.account_changes(op.account_values(long(t), YEARS, sv.ACCOUNTS)))


@query(
    "ag12_readiness",
    "WITH " + WIDE + """, h AS (SELECT u.code, count(DISTINCT o.year) AS have FROM universe u LEFT JOIN ok o USING (code) GROUP BY 1)
SELECT count(*) AS companies, count(*) FILTER (have >= 3) AS ready, count(*) FILTER (have BETWEEN 1 AND 2) AS partial, count(*) FILTER (have = 0) AS no_data,
  round(100.0 * count(*) FILTER (have >= 3) / count(*), 1) AS ready_pct FROM h""",
)
def _(t):
    return op.readiness(sv.universe(t), sv.finance(t), YEARS)


@query(
    "st2_missing_cells",
    "WITH " + WIDE + " SELECT u.code, y.year FROM universe u CROSS JOIN (VALUES (1997), (1998), (1999)) y(year) WHERE NOT EXISTS (SELECT 1 FROM finance f WHERE f.code = u.code AND f.year = y.year)",
)
def _(t):
    return op.missing_cells(sv.universe(t), sv.finance(t).select("code", "year"), YEARS)


@query("st3_not_collected", "WITH " + WIDE + " SELECT code FROM universe WHERE code NOT IN (SELECT code FROM ok)")
def _(t):
    return op.not_collected(sv.universe(t), op.companies_with_data(sv.finance(t), YEARS))


@query("st3_outside_universe", "WITH " + WIDE + " SELECT DISTINCT code FROM finance WHERE code NOT IN (SELECT code FROM universe)")
def _(t):
    return op.outside_universe(sv.finance(t), sv.universe(t))


@query(
    "fn14_parse_amount",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0.05 OR l_tax = 0.03 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS amount FROM lineitem""",
)
def _(t):
    text = F.when(F.col("l_tax") == 0.05, "-").when(F.col("l_tax") == 0.03, "").otherwise(F.format_number(F.floor("l_extendedprice"), 0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", am.parse_amount(text).cast("bigint").alias("amount"))


@query(
    "fn15_amount_text",
    """WITH a AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN -CAST(floor(o_totalprice) AS BIGINT) * 10000 WHEN 2 THEN CAST(floor(o_totalprice) AS BIGINT) * 100000000
  WHEN 3 THEN CAST(floor(o_totalprice) AS BIGINT) % 9000 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS v, CASE o_orderkey % 2 WHEN 0 THEN 'NOT_COLLECTED' ELSE 'NOT_APPLICABLE' END AS st FROM orders)
SELECT o_orderkey, CASE WHEN v IS NULL THEN CASE st WHEN 'NOT_COLLECTED' THEN '아직 못 받음' ELSE '해당 없음' END
  ELSE CASE WHEN v < 0 THEN '−' ELSE '' END || CASE WHEN abs(v) >= 1000000000000 THEN regexp_replace(format('{:,.1f}', abs(v) / 1e12), '\\.0$', '') || '조'
   WHEN abs(v) >= 100000000 THEN format('{:,}', CAST(round(abs(v) / 1e8) AS BIGINT)) || '억' WHEN abs(v) >= 10000 THEN format('{:,}', CAST(round(abs(v) / 1e4) AS BIGINT)) || '만'
   ELSE format('{:,}', abs(v)) || '원' END END AS text FROM a""".replace("\\\\", "\\"),
)
def _(t):
    k, price = F.col("o_orderkey") % 7, F.floor("o_totalprice")
    v = (
        F.when(k == 0, F.lit(None).cast("bigint")).when(k == 1, -price * 10000).when(k == 2, price * 100000000)
        .when(k == 3, price % 9000).otherwise(price)
    )
    state = F.when(F.col("o_orderkey") % 2 == 0, "NOT_COLLECTED").otherwise("NOT_APPLICABLE")
    return t.orders.select("o_orderkey", am.won_text(v, state).alias("text"))


@query(
    "fn16_percent_text",
    "WITH " + WIDE + """ SELECT code, account, to_year, CASE WHEN change_pct IS NULL THEN '전년이 0 이하라 증감률 안 셈'
  ELSE CASE WHEN change_pct > 0 THEN '+' WHEN change_pct < 0 THEN '−' ELSE '' END || printf('%g', abs(change_pct)) || '%' END AS text FROM chg""".replace("\\\\", "\\"),
)
def _(t):
    changes = op.account_changes(op.account_values(long(t), YEARS, sv.ACCOUNTS))
    return changes.select("code", "account", "to_year", am.pct_text(F.col("change_pct"), F.col("pct_reason")).alias("text"))
