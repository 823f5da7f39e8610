"""Queries on scans and sinks. Inputs in file form are written by Spark from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F


from docketry import products as pr
from docketry.operators import archive as ar
from docketry.plans import standins as sv
from docketry.plans.archive import hash_sql
from docketry.plans.changes import WIN
from docketry.plans.financials import WIDE, long
from docketry.plans.registry import query
from docketry.plans.titles import CHAINS, STAGED
from docketry.session import scratch_path
from docketry.sources import partitions as pt, registry as src


@query(
    "src1_issuer_registry",
    "SELECT printf('%08d', s_suppkey) AS corp_code, s_name AS corp_name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE printf('%06d', s_nationkey) END AS stock_code FROM supplier",
)
def _(t):
    path = scratch_path(t.spark, "registry")
    rows = t.supplier.select(
        F.format_string("%08d", "s_suppkey").alias("corp_code"),
        F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("corp_name"),
        F.when(F.col("s_suppkey") % 3 != 0, F.format_string("%06d", "s_nationkey")).alias("stock_code"),
    )
    rows.write.format("xml").option("rowTag", "list").option("rootTag", "result").save(path)
    return src.read_issuer_registry(t.spark, path)


@query(
    "src2_financial_documents",
    "WITH " + sv.FINANCE + """ SELECT code, year, status, fs_div AS "fsDiv", CAST(revenue AS VARCHAR) AS revenue, coalesce(CAST("totalEquity" AS VARCHAR), 'NOT_AVAILABLE') AS equity FROM finance""",
)
def _(t):
    path = scratch_path(t.spark, "statements")
    values = F.create_map(
        F.lit("revenue"), F.col("revenue").cast("string"),
        F.lit("totalEquity"), F.coalesce(F.col("totalEquity").cast("string"), F.lit("NOT_AVAILABLE")),
    )
    cell = F.struct("status", F.col("fs_div").alias("fsDiv"), values.alias("values"))
    docs = sv.finance(t).groupBy(F.col("code").alias("ticker")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string").alias("key"), cell.alias("value")))).alias("years")
    )
    docs.write.json(path)
    rows = src.read_financial_documents(t.spark, path, multi_line=False)
    return rows.select("code", "year", "status", "fsDiv", F.col("values")["revenue"].alias("revenue"), F.col("values")["totalEquity"].alias("equity"))


def seen(t):
    return sv.filing(t).select("rcept_no", F.col("code").alias("ticker"), F.concat(F.lit("  "), F.regexp_replace("title", " ", "  ")).alias("report_name"))


SEEN = sv.TRACKED + """, sf AS (SELECT code, rcept_no, title, strftime(received_on, '%Y-%m-%d') AS received_on, 'list' AS source,
  CASE WHEN contains(title, '[기재정정]') THEN '기재정정' WHEN contains(title, '[첨부추가]') THEN '첨부추가' END AS correction_kind, 'https://dart.fss.or.kr/dsaf001/main.do?rcpNo=' || rcept_no AS url FROM tracked)"""


@query("src3_registry_filings", "WITH " + SEEN + " SELECT *, correction_kind IS NOT NULL AS is_correction FROM sf")
def _(t):
    return src.seen_to_filings(seen(t), sv.universe(t)).withColumn("received_on", sv.day_text("received_on"))


@query("src3_registry_span", "WITH " + SEEN + ' SELECT min(received_on) AS "from", max(received_on) AS "to", count(*) AS count FROM sf')
def _(t):
    span = src.span_of(src.seen_to_filings(seen(t), sv.universe(t)))
    return span.withColumn("from", sv.day_text("from")).withColumn("to", sv.day_text("to"))


@query(
    "src4_evidence_filings",
    "WITH " + sv.TRACKED + " SELECT code, rcept_no, title, strftime(received_on, '%Y-%m-%d') AS received_on, 'evidence' AS source FROM tracked WHERE seq % 9 <> 0 AND seq % 10 <> 0",
)
def _(t):
    # One evidence record per company and day, so that a record stays small.
    finding = F.struct(
        F.when(F.col("seq") % 9 != 0, F.col("rcept_no")).alias("id"),
        F.when(F.col("seq") % 10 != 0, F.concat("title", F.lit("  "))).alias("title"),
        F.date_format("received_on", "yyyyMMdd").alias("receivedOn"),
    )
    block = F.floor(F.col("seq") / 1000)
    evidence = sv.filing(t).groupBy(F.col("code").alias("ticker"), "received_on", block.alias("block")).agg(F.collect_list(finding).alias("comparisonFindings"))
    return src.evidence_to_filings(evidence, sv.universe(t)).withColumn("received_on", sv.day_text("received_on"))


def day_records(t):
    return t.events.select(
        sv.day_text("ts").alias("day"), (F.col("event_id") - F.col("event_id") % 2).alias("rcept_no"),
        F.col("event_type").alias("title"), F.col("event_id").alias("seq"),
    )


def first_day(rows):
    """The oldest day of the rows, so that every day of the table counts as open."""
    return rows.agg(F.min("day")).first()[0] or ""


@query(
    "src6_keyed_upsert",
    """WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id - event_id % 2 AS rcept_no, event_type AS title, event_id AS seq FROM events)
SELECT day, rcept_no, max_by(title, seq) AS title, max(seq) AS seq FROM r GROUP BY 1, 2""",
)
def _(t):
    path = scratch_path(t.spark, "days")
    rows = day_records(t)
    first = rows.where("seq % 3 <> 2")
    today = first_day(rows)
    pt.upsert_day(t.spark, path, first, "rcept_no", "seq", today)
    pt.upsert_day(t.spark, path, rows, "rcept_no", "seq", today)
    return t.spark.read.schema("rcept_no bigint, title string, seq bigint, day string").parquet(path)


@query(
    "src6_upsert_counts",
    """WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id - event_id % 2 AS rcept_no, bool_or(event_id % 4 <> 0 AND event_id % 4 <> 1) AS old FROM events GROUP BY 1, 2)
SELECT day, count(*) FILTER (NOT old) AS added, count(*) FILTER (old) AS replaced FROM r GROUP BY 1""",
)
def _(t):
    path = scratch_path(t.spark, "days")
    rows = day_records(t)
    today = first_day(rows)
    pt.upsert_day(t.spark, path, rows.where("seq % 4 IN (2, 3)"), "rcept_no", "seq", today)
    return pt.upsert_day(t.spark, path, rows, "rcept_no", "seq", today)


@query(
    "src7_product_contract",
    "WITH " + sv.TRACKED + ", p AS (SELECT code, '{\"code\":\"' || code || '\",\"n\":' || count(*) || ',\"title\":\"' || title || '\"}' AS text FROM tracked GROUP BY code, title), h AS (SELECT *, "
    + hash_sql(("text",)) + """ AS h FROM p), a AS (SELECT count(*) AS rows, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, count(DISTINCT code) AS companies, CAST(CAST(sum(h) AS HUGEINT) AS VARCHAR) AS h FROM h)
SELECT 'activity' AS kind, rows, bytes, companies, sha256(rows || ':' || h) AS sha256, 'v1:activity:' || substr(sha256(rows || ':' || h), 1, 16) AS record_id FROM a""",
)
def _(t):
    activity = sv.tracked_filing(t).groupBy("code", "title").agg(F.count("*").alias("n"))
    return pt.write_products({"activity": activity}, scratch_path(t.spark, "products"), "v1")


@query(
    "src8_target_list",
    "WITH x AS (SELECT printf('%06d', o_custkey) AS code FROM orders WHERE o_orderkey % 5 <> 0) SELECT DISTINCT code FROM x",
)
def _(t):
    path = scratch_path(t.spark, "targets")
    code = sv.six(F.col("o_custkey"))
    line = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("# "), code)).otherwise(F.concat(code, F.lit("  # note")))
    t.orders.select(line.alias("value")).write.text(path)
    return src.read_target_list(t.spark, path).select("code")


@query("src9_script_literal", "SELECT printf('%06d', c_custkey) AS code, c_name AS name, c_mktsegment AS sector FROM customer")
def _(t):
    # Scripts of at most ten thousand entries each, so that no file grows with the table.
    path = scratch_path(t.spark, "scripts")
    entry = F.struct(sv.six(F.col("c_custkey")).alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"))
    scripts = t.customer.groupBy(F.floor(F.col("c_custkey") / 10000).alias("block")).agg(F.to_json(F.collect_list(entry)).alias("rows"))
    text = F.concat(F.lit("// tickers\nconst TICKERS = "), "rows", F.lit(";\n"))
    scripts.select("block", text.alias("value")).write.partitionBy("block").text(path)
    return src.read_script_literal(t.spark, path, "TICKERS", "code string, name string, sector string")


@query(
    "arc4_compaction_proof",
    """WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 10 = 0 THEN '{"event_id":' || event_id || ',"ex' ELSE '{"event_id":' || event_id || ',"extra":"' || event_type || '"}' END AS value FROM events),
d AS (SELECT max(day) AS today FROM l), h AS (SELECT *, """ + hash_sql(("value",)) + """ AS h FROM l WHERE day < (SELECT today FROM d)),
p AS (SELECT day, count(*) AS record_count, CAST(sum(strlen(value) + 1) AS BIGINT) AS raw_bytes, CAST(CAST(sum(h) AS HUGEINT) AS VARCHAR) AS plain_digest FROM h GROUP BY 1)
SELECT *, CASE WHEN CAST(substr(day, 9) AS INT) % 7 = 3 THEN 'ARCHIVE_INTEGRITY_ERROR' ELSE 'OK' END AS status FROM p""",
)
def _(t):
    raw, packed = scratch_path(t.spark, "raw"), scratch_path(t.spark, "packed")
    # Every tenth line breaks off, all others carry a field no schema knows; days of rank three of a week are damaged.
    start = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"ex'))
    line = F.when(F.col("event_id") % 10 == 0, start).otherwise(F.concat(start, F.lit('tra":"'), "event_type", F.lit('"}')))
    t.events.select(sv.day_text("ts").alias("day"), line.alias("value")).write.partitionBy("day").text(raw)
    last = t.events.agg(F.max("ts").alias("ts")).select(sv.day_text("ts")).scalar()
    lines = pt.read_lines(t.spark, raw).where(F.col("day") < last)
    hurt = (F.substring("day", 9, 2).cast("int") % 7 == 3) & (F.get_json_object("value", "$.event_id").cast("bigint") % 10 == 1)
    pt.copy_days(lines.withColumn("value", F.when(hurt, F.concat("value", F.lit(" "))).otherwise(F.col("value"))), packed)
    return pt.prove_days(lines, packed).select("day", "record_count", "raw_bytes", "plain_digest", "status")


@query(
    "arc4_late_lines",
    """WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, '{"event_id":' || event_id || '}' AS value, event_id % 20 = 3 AS late FROM events),
d AS (SELECT max(day) AS today FROM l), h AS (SELECT *, """ + hash_sql(("value",)) + """ AS h FROM l WHERE day < (SELECT today FROM d))
SELECT day, count(*) FILTER (late) AS record_count, CAST(sum(strlen(value) + 1) FILTER (late) AS BIGINT) AS raw_bytes, CAST(CAST(sum(h) FILTER (late) AS HUGEINT) AS VARCHAR) AS late_digest,
  CAST(CAST(sum(h) AS HUGEINT) AS VARCHAR) AS whole_digest, 'OK' AS status FROM h GROUP BY day HAVING count(*) FILTER (late) > 0""",
)
def _(t):
    raw, packed, late, manifest, late_manifest = (scratch_path(t.spark, n) for n in ("raw", "packed", "late", "manifest", "late-manifest"))
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit("}"))
    rows = t.events.select(sv.day_text("ts").alias("day"), line.alias("value"), (F.col("event_id") % 20 == 3).alias("late"))
    today = rows.agg(F.max("day")).first()[0] or ""
    rows.where("not late").drop("late").write.partitionBy("day").text(raw)
    pt.compact_days(t.spark, raw, packed, manifest, today)
    # Lines of an outage turn up when the days are closed; the sources of odd days are still there, the others are gone.
    proofs = t.spark.read.schema(pt.MANIFEST_SCHEMA).parquet(manifest)
    pt.remove_proven(proofs.where(F.substring("day", 10, 1).cast("int") % 2 == 0), raw, packed)
    rows.where("late").drop("late").write.mode("append").partitionBy("day").text(raw)
    return pt.compact_late(t.spark, raw, packed, late, manifest, late_manifest, today).drop("run")


@query(
    "arc6_monthly_bundles",
    """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, o_orderstatus FROM orders), b AS (SELECT substr(day, 1, 7) AS month, count(*) AS record_count,
  count(DISTINCT CASE WHEN CAST(substr(day, 9) AS INT) = 13 AND CAST(substr(day, 6, 2) AS INT) % 3 = 0 THEN day END) AS problem_days FROM r GROUP BY 1)
SELECT month, record_count, problem_days, CASE WHEN problem_days = 0 THEN record_count END AS bundled, CASE WHEN problem_days = 0 THEN 'MONTHLY_ARCHIVED' ELSE 'ARCHIVE_INTEGRITY_ERROR' END AS status FROM b""",
)
def _(t):
    rows = t.orders.select(sv.day_text("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus")
    stats = ar.partition_stats(rows, "o_orderkey", "o_orderstatus", ())
    # Damage the manifests of the thirteenth day in every third month.
    hurt = (F.substring("day", 9, 2) == "13") & (F.substring("day", 6, 2).cast("int") % 3 == 0)
    manifests = stats.withColumn("record_count", F.when(hurt, F.col("record_count") + 1).otherwise(F.col("record_count")))
    months = ar.monthly_rollup(stats, ar.audit_archive(stats, manifests, ()))
    return pt.bundle_months(rows, months, scratch_path(t.spark, "months"))


BUNDLE = (
    STAGED + WIN.format(src="(SELECT received_on FROM tracked UNION ALL SELECT DATE '2024-01-30')") + "," + WIDE.replace(sv.UNIVERSE, "ignored AS (SELECT 1)")
    + ", cls AS (SELECT *, " + sv.CATEGORY_SQL + """ AS category FROM tracked),
cnt AS (SELECT code, category, count(*) FILTER (is_correction OR contains(title, '[첨부추가]')) FILTER (received_on BETWEEN rf AND hi) AS cor FROM cls, win WHERE received_on BETWEEN pf AND hi GROUP BY 1, 2),
p AS (SELECT 'disclosure_headers' AS kind, count(DISTINCT code) AS rows, count(DISTINCT code) AS companies FROM tracked
 UNION ALL SELECT 'disclosure_changes', count(*), count(DISTINCT code) FROM (SELECT code FROM cnt UNION ALL SELECT code FROM cnt GROUP BY code HAVING sum(cor) > 0)
 UNION ALL SELECT 'disclosure_filings', CAST(sum(least(n, 40)) AS BIGINT), count(*) FROM (SELECT code, count(*) AS n FROM tracked GROUP BY 1)
 UNION ALL SELECT 'financial_values', count(*), count(DISTINCT code) FROM vals UNION ALL SELECT 'financial_changes', count(*), count(DISTINCT code) FROM chg
 UNION ALL SELECT 'event_timelines', count(*), count(DISTINCT code) FROM lines UNION ALL SELECT 'event_items', count(*), count(DISTINCT code) FROM staged)
SELECT *, '2024-01-30' AS as_of, '2024-01-30 11:00:00' AS generated_at FROM p"""
).replace("count(*) FILTER (is_correction OR contains(title, '[첨부추가]')) FILTER (received_on BETWEEN rf AND hi) AS cor", "count(*) FILTER ((is_correction OR contains(title, '[첨부추가]')) AND received_on BETWEEN rf AND hi) AS cor")


@query("src7_product_bundle", "WITH " + BUNDLE)
def _(t):
    finding = F.struct(F.col("rcept_no").alias("id"), F.date_format("received_on", "yyyyMMdd").alias("receivedOn"), "title")
    evidence = sv.filing(t).select(F.col("code").alias("ticker"), F.array(finding).alias("comparisonFindings"))
    last = t.events.agg(F.max("ts").cast("date").alias("day"))
    stamp = F.to_timestamp_ltz(F.concat(sv.day_text("day"), F.lit(" 11:00:00")))
    runs = last.select(
        F.lit("list").alias("source"), stamp.alias("finished_at"), F.lit("OK").alias("status"), F.lit("EVENT_DETECTED").alias("event_state"),
        F.date_sub("day", 1).alias("window_start"), F.col("day").alias("window_end"),
    )
    done = pr.build_products(
        sv.universe(t), seen(t), evidence, long(t), runs, categories=sv.CATEGORIES, chains=CHAINS, years=sv.YEARS,
        accounts=sv.ACCOUNTS, path=scratch_path(t.spark, "bundle"), version="v1",
    )
    return done.select(
        "kind", "rows", "companies", sv.day_text("as_of").alias("as_of"), F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at")
    )

