"""Queries over filing rows: scans, predicates, joins and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions import actions, instants as ts, text as tx
from docketry.operators import filings as op
from docketry.plans import standins as sv
from docketry.plans.registry import query


@query(
    "prj1_normalize_filings",
    "WITH " + sv.FILING + """, reg AS (SELECT printf('%06d', s_suppkey) AS code FROM supplier)
SELECT 'OPENDART' AS source, 'LIVE_DART_PIT' AS source_mode, f.code AS corp_code,
  coalesce(r.code, 'NOT_AVAILABLE') AS stock_code, coalesce(r.code, 'UNKNOWN_MAPPING') AS ticker, rcept_no,
  title AS report_name, 'NOT_AVAILABLE' AS corp_cls, strftime(received_on, '%Y%m%d') AS rcept_dt, is_correction,
  'NOT_AVAILABLE' AS corrects_rcept_no, 'https://dart.fss.or.kr/dsaf001/main.do?rcpNo=' || rcept_no AS raw_source_reference
FROM filing f LEFT JOIN reg r ON f.code = r.code""",
)
def _(t):
    issuers = t.supplier.select(sv.six(F.col("s_suppkey")).alias("ticker"))
    rows = sv.filing(t).join(issuers, F.col("code") == F.col("ticker"), "left").select(
        "rcept_no",
        F.concat(F.lit(" "), "title", F.lit("  ")).alias("report_nm"),
        F.col("code").alias("corp_code"),
        F.lit("").alias("corp_cls"),
        F.date_format("received_on", "yyyyMMdd").alias("rcept_dt"),
        F.col("ticker").alias("stock_code"),
        "ticker",
        "detected_at",
    )
    return op.normalize_filings(rows).drop("detected_at")


@query(
    "prj2_point_in_time",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+09:00'
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS detected_text
FROM events WHERE event_id % 3 <> 2 AND
  (CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 9 HOUR ELSE date_trunc('second', ts) END) <= TIMESTAMP '2024-01-16 00:00:00'""",
)
def _(t):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    offset = F.when(F.col("event_id") % 3 == 0, "+09:00").when(F.col("event_id") % 3 == 1, "Z").otherwise("")
    events = t.events.select("event_id", F.concat(text, offset).alias("detected_text"))
    return op.visible_at(events, "detected_text", F.lit("2024-01-16T09:00:00+09:00"))


@query(
    "prj3_relevant_titles",
    "WITH " + sv.ACTIONS_SQL + " SELECT id, title FROM fact WHERE effects IS NOT NULL OR contains(title,'PROMO') OR contains(title,'cold')",
)
def _(t):
    return sv.part_title(t).where(actions.in_scope("title", sv.ACTIONS, ("PROMO", "cold"))).select("id", "title")


@query(
    "prj4_finding_terms",
    "WITH " + sv.PART_TITLE + """, w(word) AS (VALUES ('widget'),('red'),('PROMO'),('old'),('gear'))
SELECT id, string_agg(word, ',' ORDER BY word) AS terms FROM part_title JOIN w ON contains(title, word) GROUP BY id""",
)
def _(t):
    terms = F.array_sort(tx.words_in("title", ("widget", "red", "PROMO", "old", "gear")))
    return sv.part_title(t).select("id", sv.joined(terms).alias("terms")).where("terms <> ''")


@query(
    "prj5_financial_sector",
    "SELECT c_custkey AS id, c_mktsegment AS sector, regexp_matches(c_mktsegment, 'HOUSE|AUTO') AS is_financial FROM customer",
)
def _(t):
    flag = tx.contains_any("c_mktsegment", ("HOUSE", "AUTO"))
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("sector"), flag.alias("is_financial"))


@query(
    "prj6_row_admissibility",
    """SELECT printf('%06d', l_partkey % 50) AS ticker, count(*) FILTER (bad) AS uninterpreted, count(*) FILTER (NOT bad) AS kept FROM (
  SELECT l_partkey, (l_linenumber = 7 OR (l_suppkey % 5 <> 0 AND l_suppkey % 50 <> l_partkey % 50)) AS bad FROM lineitem) GROUP BY 1""",
)
def _(t):
    rows = t.lineitem.select(
        sv.six(F.col("l_partkey") % 50).alias("ticker"),
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey").cast("string")).alias("rcept_no"),
        F.col("l_returnflag").alias("report_nm"),
        F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(sv.six(F.col("l_suppkey") % 50)).alias("stock_code"),
    )
    state = op.reconcile_rows(rows)
    return state.groupBy("ticker").agg(
        F.count_if(F.col("row_state") == "UNINTERPRETED").alias("uninterpreted"),
        F.count_if(F.col("row_state") == "KEPT").alias("kept"),
    )


@query(
    "prj7_correction_kinds",
    """WITH d AS (SELECT doc_id, (CASE doc_id % 6 WHEN 0 THEN '[기재정정]' WHEN 1 THEN '[첨부추가]' WHEN 2 THEN '정정신고 '
  WHEN 3 THEN '[첨부정정]' WHEN 4 THEN '[정정]' ELSE '' END) || text AS title FROM documents)
SELECT doc_id, regexp_matches(title, '\\[기재정정\\]|\\[첨부정정\\]|\\[정정\\]|정정신고') AS ingest,
  CASE WHEN contains(title,'[기재정정]') THEN '기재정정' WHEN contains(title,'[첨부정정]') THEN '첨부정정'
       WHEN contains(title,'[첨부추가]') THEN '첨부추가' WHEN contains(title,'[정정]') THEN '정정'
       WHEN contains(title,'정정신고') THEN '정정' END AS research_kind,
  regexp_matches(title, '\\[(기재정정|정정|첨부정정|첨부추가)\\]') AS site FROM d""",
)
def _(t):
    at = F.col("doc_id") % 6
    mark = (
        F.when(at == 0, "[기재정정]").when(at == 1, "[첨부추가]").when(at == 2, "정정신고 ")
        .when(at == 3, "[첨부정정]").when(at == 4, "[정정]").otherwise("")
    )
    return t.documents.select("doc_id", F.concat(mark, "text").alias("title")).select(
        "doc_id",
        tx.is_ingest_correction("title").alias("ingest"),
        tx.research_correction_kind("title").alias("research_kind"),
        tx.is_site_correction("title").alias("site"),
    )


@query(
    "prj8_coverage_words",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'EVENT_DETECTED' WHEN 'F' THEN 'PARTIAL' END AS coverage FROM orders""",
)
def _(t):
    state = F.when(F.col("o_orderstatus") == "O", "EVENT_DETECTED").when(
        F.col("o_orderstatus") == "F", "EVENT_COVERAGE_INCOMPLETE"
    ).otherwise("SOMETHING_ELSE")
    words = F.create_map(*[F.lit(x) for pair in vocab.COVERAGE_WORDS.items() for x in pair])
    return t.orders.select("o_orderkey", words[state].alias("coverage"))


REGISTRY = """reg AS (SELECT printf('%08d', s_suppkey) AS corp_code, s_name AS corp_name,
  CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE printf('%06d', s_nationkey * 10 + s_suppkey % 3) END AS stock_code FROM supplier)"""


def registry(t):
    nation = sv.six(F.col("s_nationkey") * 10 + F.col("s_suppkey") % 3)
    return t.supplier.select(
        F.format_string("%08d", "s_suppkey").alias("corp_code"),
        F.col("s_name").alias("corp_name"),
        F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(nation).alias("stock_code"),
    )


MAPPING = sv.UNIVERSE + ", " + REGISTRY + """, hit AS (SELECT stock_code, count(*) AS n, min(corp_code) AS corp_code, min(corp_name) AS corp_name
  FROM reg WHERE length(stock_code) = 6 GROUP BY 1),
mapping AS (SELECT code, name, sector, CASE WHEN n = 1 THEN 'MAPPED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS mapping,
  coalesce(n, 0) AS candidate_count, CASE WHEN n = 1 THEN corp_code END AS corp_code, CASE WHEN n = 1 THEN corp_name END AS corp_name,
  CASE WHEN n = 1 THEN 'STOCK_CODE_EXACT' END AS mapped_by FROM universe LEFT JOIN hit ON code = stock_code)"""


@query("jn1_issuer_mapping", "WITH " + MAPPING + " SELECT * FROM mapping")
def _(t):
    return op.map_issuers(sv.universe(t), registry(t))


@query(
    "jn1_issuer_candidates",
    "WITH " + MAPPING + " SELECT stock_code AS code, corp_code, corp_name FROM reg WHERE stock_code IN (SELECT code FROM mapping WHERE mapping = 'AMBIGUOUS')",
)
def _(t):
    return op.issuer_candidates(sv.universe(t), registry(t))


@query(
    "ev4_mapping_report",
    "WITH " + MAPPING + """, cur AS (SELECT count(*) AS universe_size, count(*) FILTER (mapping = 'MAPPED') AS mapped,
  count(*) FILTER (mapping = 'UNKNOWN') AS unknown, count(*) FILTER (mapping = 'AMBIGUOUS') AS ambiguous,
  round(count(*) FILTER (mapping = 'MAPPED') / count(*), 4) AS mapping_rate FROM mapping)
SELECT cur.*, (SELECT count(*) FROM universe WHERE sector <> 'MACHINERY') AS stored_size,
  universe_size <> (SELECT count(*) FROM universe WHERE sector <> 'MACHINERY') AS universe_changed FROM cur""",
)
def _(t):
    stored = sv.universe(t).where("sector <> 'MACHINERY'").agg(F.count("*").alias("n"))
    return op.mapping_report(op.map_issuers(sv.universe(t), registry(t)), stored.scalar())


@query(
    "jn2_universe_match",
    "WITH " + sv.FILING + "," + sv.UNIVERSE + """ SELECT count(*) AS detected, count(*) FILTER (u.code IS NOT NULL) AS matched,
  count(*) FILTER (u.code IS NULL) AS unmatched FROM filing f LEFT JOIN universe u ON f.code = u.code""",
)
def _(t):
    rows = sv.filing(t).withColumnRenamed("code", "corp_code")
    return op.match_counts(rows, sv.universe(t).select(F.col("code").alias("corp_code")))


@query(
    "jn2_matched_filings",
    "WITH " + sv.FILING + "," + sv.UNIVERSE + " SELECT f.code AS corp_code, rcept_no, title, name FROM filing f JOIN universe u ON f.code = u.code",
)
def _(t):
    rows = sv.filing(t).select(F.col("code").alias("corp_code"), "rcept_no", "title")
    return op.match_issuers(rows, sv.universe(t).select(F.col("code").alias("corp_code"), "name"))


@query(
    "jn3_seen_filter",
    "WITH " + sv.FILING + """, st AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'ACKNOWLEDGED' WHEN 'O' THEN 'STORED' ELSE 'PENDING' END AS state FROM orders)
SELECT rcept_no, title FROM filing LEFT JOIN st ON seq = k WHERE seq % 11 <> 0 AND (state IS NULL OR state <> 'ACKNOWLEDGED')""",
)
def _(t):
    rows = sv.filing(t).withColumn("rcept_no", F.when(F.col("seq") % 11 == 0, "").otherwise(F.col("rcept_no")))
    state = F.when(F.col("o_orderstatus") == "F", "ACKNOWLEDGED").when(F.col("o_orderstatus") == "O", "STORED").otherwise("PENDING")
    orders = t.orders.select(F.col("o_orderkey").alias("seq"), state.alias("state"))
    states = sv.filing(t).select("seq", "rcept_no").join(orders, "seq").select("rcept_no", "state")
    return op.drop_acknowledged(rows, states).select("rcept_no", "title")


@query(
    "jn4_correction_links",
    "WITH " + sv.FILING + r""", c AS (SELECT *, trim(regexp_replace(title, '\[기재정정\]|\[첨부정정\]|\[정정\]|정정신고', '', 'g')) AS base
  FROM filing WHERE is_correction),
cand AS (SELECT c.rcept_no, h.rcept_no AS other, row_number() OVER (PARTITION BY c.rcept_no ORDER BY h.rcept_no DESC) AS rn,
  count(*) OVER (PARTITION BY c.rcept_no) AS n
  FROM c JOIN filing h ON c.code = h.code AND h.seq < c.seq AND contains(h.title, c.base)),
agg AS (SELECT rcept_no, max(n) AS n, string_agg(other, ',' ORDER BY other) AS others FROM cand WHERE rn <= 5 GROUP BY 1)
SELECT c.rcept_no, CASE WHEN n = 1 THEN others ELSE 'NOT_AVAILABLE' END AS corrects_rcept_no,
  CASE WHEN n > 1 THEN others END AS candidates,
  CASE WHEN n = 1 THEN 'SAME_TICKER_SAME_REPORT_NAME' WHEN n > 1 THEN 'AMBIGUOUS_NOT_LINKED' END AS basis
FROM c LEFT JOIN agg USING (rcept_no)""",
)
def _(t):
    events = sv.filing(t).select(
        F.col("code").alias("ticker"), "rcept_no", F.col("title").alias("report_name"), "is_correction", "seq"
    )
    return op.link_corrections(events).where("is_correction").select(
        "rcept_no",
        "corrects_rcept_no",
        sv.joined("correction_candidates").alias("candidates"),
        F.col("correction_link_basis").alias("basis"),
    )


@query(
    "jn5_as_of_visibility",
    """WITH a AS (SELECT o_orderkey AS k, o_custkey % 150 AS u, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 173 % 2592000) AS t FROM orders)
SELECT k AS ask_id, count(event_id) AS visible, max_by(strftime(ts, '%Y%m%d') || printf('%06d', event_id), ts) AS latest_rcept_no
FROM a LEFT JOIN events ON user_id = u AND ts <= t GROUP BY k""",
)
def _(t):
    second = F.make_dt_interval(secs=(F.col("o_orderkey") * 173 % 2592000).cast("decimal(18,6)"))
    asks = t.orders.select(
        sv.six(F.col("o_custkey") % 150).alias("ticker"),
        F.col("o_orderkey").alias("ask_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + second).alias("at"),
    )
    events = sv.filing(t).select(F.col("code").alias("ticker"), "rcept_no", "detected_at")
    return op.visible_as_of(asks, events).select("ask_id", "visible", "latest_rcept_no")


def two_sources(t):
    base = sv.tracked_filing(t).select("code", "rcept_no", "title", "received_on", "seq")
    first = base.where("seq % 3 <> 0").drop("seq").withColumn("source", F.lit("list"))
    second = base.where("seq % 2 = 0").drop("seq").withColumn("title", F.concat("title", F.lit(" *"))).withColumn(
        "source", F.lit("evidence")
    )
    return first, second


MERGED = sv.TRACKED + """, merged AS (SELECT code, rcept_no, received_on, seq,
  CASE WHEN seq % 3 <> 0 THEN title ELSE title || ' *' END AS title,
  CASE WHEN seq % 3 <> 0 AND seq % 2 = 0 THEN 'list,evidence' WHEN seq % 3 <> 0 THEN 'list' ELSE 'evidence' END AS sources
  FROM tracked WHERE seq % 3 <> 0 OR seq % 2 = 0)"""


@query(
    "jn6_merge_sources",
    "WITH " + MERGED + " SELECT code, rcept_no, title, strftime(received_on, '%Y-%m-%d') AS received_on, sources FROM merged",
)
def _(t):
    return op.merge_filings(*two_sources(t)).select(
        "code", "rcept_no", "title", sv.day_text("received_on").alias("received_on"), sv.joined("sources").alias("sources")
    )


@query(
    "jn7_priority_merge",
    "WITH " + MERGED + """ SELECT code, rcept_no, CASE WHEN seq % 2 = 0 AND seq % 5 <> 0 THEN 'recent' ELSE 'product' END AS source
FROM tracked WHERE seq % 3 <> 0 OR (seq % 2 = 0 AND seq % 5 <> 0)""",
)
def _(t):
    base = sv.tracked_filing(t)
    recent = base.where("seq % 2 = 0").withColumn("code", F.when(F.col("seq") % 5 == 0, "x").otherwise(F.col("code")))
    first = op.recent_source(recent).select("rcept_no", "code", F.lit("recent").alias("source"))
    second = base.where("seq % 3 <> 0").select("rcept_no", "code", F.lit("product").alias("source"))
    return op.priority_merge(first, second)


@query(
    "fn1_bare_title",
    r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\[[^\]]*\]', '', 'g'), '\s+', '', 'g')) AS bare_md5 FROM documents",
)
def _(t):
    return t.documents.select("doc_id", F.md5(tx.bare("text")).alias("bare_md5"))


@query(
    "fn2_clean_title",
    r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_md5 FROM documents",
)
def _(t):
    return t.documents.select("doc_id", F.md5(tx.clean_title("text")).alias("clean_md5"))


@query(
    "fn3_bracket_depth",
    "WITH " + sv.PART_TITLE + """, b AS (SELECT id, replace(title, ' (', ')((') AS s FROM part_title),
ch AS (SELECT id, i, substr(s, i, 1) AS c FROM b, LATERAL (SELECT unnest(generate_series(1, length(s))) AS i)),
d AS (SELECT id, i, c, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run FROM ch),
m AS (SELECT id, i, c, CAST(run - least(0, min(run) OVER (PARTITION BY id ORDER BY i)) AS INT) AS after FROM d)
SELECT id, string_agg(CAST(CASE WHEN c = '(' THEN after - 1 ELSE after END AS VARCHAR), ',' ORDER BY i) AS depths FROM m GROUP BY id""",
)
def _(t):
    text = F.regexp_replace("title", r" \(", ")((")
    return sv.part_title(t).select("id", sv.joined(tx.bracket_depths(text).cast("array<string>")).alias("depths"))


@query(
    "fn10_parse_instant",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) - 32400000000
  WHEN 2 THEN epoch_us(ts) END AS micros FROM events""",
)
def _(t):
    at = F.col("event_id") % 5
    whole = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(at == 0, F.concat(whole, F.lit("Z"))).when(at == 1, F.concat(whole, F.lit("+09:00")))
        .when(at == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
        .when(at == 3, whole).otherwise("not a time")
    )
    return t.events.select("event_id", F.unix_micros(ts.parse_instant(text)).alias("micros"))


@query(
    "fn11_dates",
    "WITH " + sv.FILING + """ SELECT rcept_no, strftime(received_on, '%Y-%m-%d') AS received, strftime(received_on, '%Y-%m-%d') AS iso,
  strftime(date_trunc('week', received_on), '%Y-%m-%d') AS monday,
  month(date_trunc('week', received_on)) || '월 ' || day(date_trunc('week', received_on)) || '일~' ||
  CASE WHEN month(date_trunc('week', received_on)) <> month(date_trunc('week', received_on) + INTERVAL 6 DAY)
       THEN month(date_trunc('week', received_on) + INTERVAL 6 DAY) || '월 ' ELSE '' END ||
  day(date_trunc('week', received_on) + INTERVAL 6 DAY) || '일' AS label FROM filing""",
)
def _(t):
    day = ts.compact_to_date("rcept_no")
    return sv.filing(t).select(
        "rcept_no",
        sv.day_text(day).alias("received"),
        ts.compact_to_iso(F.substring("rcept_no", 1, 8)).alias("iso"),
        sv.day_text(ts.monday_of(day)).alias("monday"),
        ts.week_label(ts.monday_of(day)).alias("label"),
    )


@query(
    "fn12_covered_until",
    """SELECT o_orderkey, epoch_us(least(o_orderdate + INTERVAL 11 HOUR, o_orderdate + to_days(CAST(o_orderkey % 3 AS INT)) - INTERVAL 9 HOUR)) AS until FROM orders""",
)
def _(t):
    finished = F.to_timestamp_ltz(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 11 HOURS"), "yyyy-MM-dd HH:mm:ss"))
    end = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 3).cast("int") - 1)
    return t.orders.select("o_orderkey", F.unix_micros(ts.covered_until(finished, end)).alias("until"))


@query(
    "fn13_target_years",
    """SELECT o_orderkey, concat_ws(',', y, y - 1, y - 2) AS years FROM (SELECT o_orderkey,
  year(o_orderdate) - CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 2 END AS y FROM orders)""",
)
def _(t):
    years = ts.target_years(F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", sv.joined(years.cast("array<string>")).alias("years"))


@query(
    "fn17_mask_parameter",
    r"""SELECT page_id, regexp_replace(url, '(utm_source=)[^&"'' \n\t]*', '\1***REDACTED***') AS masked FROM pages""",
)
def _(t):
    return t.pages.select("page_id", tx.mask_parameter("url", "utm_source").alias("masked"))
