"""Queries on daily partition archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import archive as op
from docketry.plans import standins as sv
from docketry.plans.registry import query

REQUIRED = ("source", "mode")


def records(t):
    """Archive records by day: some keys repeated, some fields empty."""
    dup = F.when(F.col("event_id") % 100 == 1, F.col("event_id") - 1).otherwise(F.col("event_id"))
    return t.events.select(
        sv.day_text("ts").alias("day"),
        dup.alias("rcept_no"),
        F.when(F.col("event_id") % 251 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("detected_at"),
        F.when(F.col("event_id") % 333 != 0, F.col("event_type")).alias("source"),
        F.lit("live").alias("mode"),
    )


def hash_sql(cols):
    text = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in cols)
    return (
        f"list_sum(list_transform(range(15), lambda i: (instr('0123456789abcdef', substr(sha256({text}), CAST(i AS INT) + 1, 1)) - 1)"
        " * CAST(1152921504606846976 >> CAST(4 * (i + 1) AS INT) AS HUGEINT)))"
    )


RECORDS = "rec AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 100 = 1 THEN event_id - 1 ELSE event_id END AS rcept_no, CASE WHEN event_id % 251 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS detected_at, CASE WHEN event_id % 333 <> 0 THEN event_type END AS source, 'live' AS mode FROM events)"
STATS = RECORDS + ", hs AS (SELECT *, " + hash_sql(("day", "rcept_no", "detected_at", "source", "mode")) + """ AS h FROM rec),
dk AS (SELECT day, count(*) AS duplicate_keys FROM (SELECT day, rcept_no FROM rec GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
st AS (SELECT day, count(*) AS record_count, coalesce(any_value(duplicate_keys), 0) AS duplicate_keys, min(detected_at) AS first_ts, max(detected_at) AS last_ts,
  count(*) FILTER (detected_at IS NULL) AS missing_stamp, count(*) FILTER (source IS NULL) AS missing_source, count(*) FILTER (mode IS NULL) AS missing_mode, CAST(CAST(sum(h) AS HUGEINT) AS VARCHAR) AS digest
  FROM hs LEFT JOIN dk USING (day) GROUP BY day)"""
MANIFEST = """, mf AS (SELECT day, CASE WHEN CAST(substr(day, 9) AS INT) % 7 = 0 THEN record_count + 1 ELSE record_count END AS record_count,
  CASE WHEN CAST(substr(day, 9) AS INT) % 5 = 0 THEN digest || '0' ELSE digest END AS digest FROM st WHERE CAST(substr(day, 9) AS INT) % 11 <> 0)"""
ERRORS = MANIFEST + """, er AS (SELECT day, unnest([CASE WHEN m.day IS NULL THEN 'NO_MANIFEST' END, CASE WHEN m.record_count <> s.record_count THEN 'COUNT ' || s.record_count || ' != ' || m.record_count END,
  CASE WHEN m.digest <> s.digest THEN 'DIGEST' END, CASE WHEN m.day IS NOT NULL AND duplicate_keys > 0 THEN 'DUPLICATE_KEYS ' || duplicate_keys END,
  CASE WHEN m.day IS NOT NULL AND missing_stamp > 0 THEN 'MISSING_STAMP ' || missing_stamp END, CASE WHEN m.day IS NOT NULL AND missing_source > 0 THEN 'MISSING source ' || missing_source END]) AS error
  FROM st s LEFT JOIN mf m USING (day)), err AS (SELECT * FROM er WHERE error IS NOT NULL)"""


def stats(t):
    return op.partition_stats(records(t), "rcept_no", "detected_at", REQUIRED)


def manifests(t):
    k = F.substring("day", 9, 2).cast("int")
    return stats(t).where(k % 11 != 0).select(
        "day",
        F.when(k % 7 == 0, F.col("record_count") + 1).otherwise(F.col("record_count")).alias("record_count"),
        F.when(k % 5 == 0, F.concat("digest", F.lit("0"))).otherwise(F.col("digest")).alias("digest"),
    )


@query("arc1_partition_stats", "WITH " + STATS + " SELECT * FROM st")
def _(t):
    return stats(t)


@query("arc2_build_manifests", "WITH " + STATS + MANIFEST + " SELECT day, record_count, digest, 'CLOSED' AS status FROM st WHERE day < '2024-01-30' AND day NOT IN (SELECT day FROM mf)")
def _(t):
    return op.build_manifests(stats(t), manifests(t), F.lit("2024-01-30")).select("day", "record_count", "digest", "status")


@query("arc3_integrity_audit", "WITH " + STATS + ERRORS + " SELECT * FROM err")
def _(t):
    return op.audit_archive(stats(t), manifests(t), REQUIRED)


@query(
    "arc5_weekly_rollup",
    "WITH " + STATS + " SELECT strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week, string_agg(day, ',' ORDER BY day) AS days, CAST(sum(record_count) AS BIGINT) AS record_count, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM st GROUP BY 1",
)
def _(t):
    return op.weekly_rollup(stats(t)).withColumn("week", sv.day_text("week")).withColumn("days", sv.joined("days"))


@query(
    "arc6_monthly_rollup",
    "WITH " + STATS + ERRORS + """ SELECT substr(day, 1, 7) AS month, count(*) AS days, CAST(sum(record_count) AS BIGINT) AS record_count, count(*) FILTER (day IN (SELECT day FROM err)) AS problem_days,
  CAST(CAST(sum(CAST(digest AS HUGEINT)) AS HUGEINT) AS VARCHAR) AS digest, CASE WHEN count(*) FILTER (day IN (SELECT day FROM err)) = 0 THEN 'MONTHLY_ARCHIVED' ELSE 'ARCHIVE_INTEGRITY_ERROR' END AS status FROM st GROUP BY 1""",
)
def _(t):
    return op.monthly_rollup(stats(t), op.audit_archive(stats(t), manifests(t), REQUIRED))


@query(
    "arc7_storage_projection",
    """WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(length(props) * 40) AS raw, CAST(day(min(ts)) AS INT) % 3 <> 0 AS compressed, 0.05 + (CAST(day(min(ts)) AS INT) % 4) / 100.0 AS r FROM events GROUP BY 1),
s AS (SELECT *, CAST(CASE WHEN compressed THEN round(raw * r) ELSE raw END AS BIGINT) AS b FROM m), q AS (SELECT round(avg(CAST(r AS DOUBLE)) FILTER (compressed), 4) AS ratio FROM s)
SELECT '2024-01-28' AS as_of, count(*) AS observed_days, coalesce(CAST(sum(n) FILTER (day = '2024-01-28') AS BIGINT), 0) AS new_records_today,
  coalesce(CAST(sum(b) FILTER (day = '2024-01-28' AND NOT compressed) AS BIGINT), 0) AS raw_bytes_today, coalesce(CAST(sum(b) FILTER (day = '2024-01-28' AND compressed) AS BIGINT), 0) AS compressed_bytes_today,
  any_value(ratio) AS compression_ratio, CAST(sum(b) AS BIGINT) AS total_bytes, CAST(round(avg(b)) AS BIGINT) AS daily_growth_bytes,
  CAST(round(avg(CASE WHEN compressed THEN b ELSE b * ratio END)) AS BIGINT) AS projected_daily_bytes, CAST(round(avg(CASE WHEN compressed THEN b ELSE b * ratio END) * 30) AS BIGINT) AS estimated_30d_bytes,
  CAST(round(avg(CASE WHEN compressed THEN b ELSE b * ratio END) * 90) AS BIGINT) AS estimated_90d_bytes, CAST(round(avg(CASE WHEN compressed THEN b ELSE b * ratio END) * 365) AS BIGINT) AS estimated_365d_bytes FROM s, q""",
)
def _(t):
    k = F.dayofmonth(F.min("ts"))
    m = t.events.groupBy(sv.day_text("ts").alias("day")).agg(F.count("*").alias("records"), F.sum(F.length("props") * 40).alias("raw"), k.alias("k"))
    ratio = F.lit(0.05) + (F.col("k") % 4) / 100
    compressed = F.col("k") % 3 != 0
    stored = F.when(compressed, F.round(F.col("raw") * ratio).cast("bigint")).otherwise(F.col("raw"))
    return op.storage_projection(m.select("day", "records", stored.alias("stored_bytes"), compressed.alias("compressed"), ratio.alias("compression_ratio")), "2024-01-28")


@query(
    "arc9_partition_states",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(day(min(ts)) AS INT) % 3 = 0 AS compacted FROM events GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d) - 1, (SELECT max(day) FROM d) + 1, INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(c.day, '%Y-%m-%d') AS day, CASE WHEN compacted THEN 'COMPRESSED' WHEN compacted IS NULL THEN 'MISSING' WHEN c.day >= DATE '2024-01-28' THEN 'ACTIVE' ELSE 'CLOSED' END AS state FROM c LEFT JOIN d ON c.day = d.day""",
)
def _(t):
    stored = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg((F.dayofmonth(F.min("ts")) % 3 == 0).alias("compacted"))
    span = stored.agg(F.date_sub(F.min("day"), 1).alias("first"), F.date_add(F.max("day"), 1).alias("last"))
    return op.partition_states(op.calendar(span), stored, F.lit("2024-01-28").cast("date")).withColumn("day", sv.day_text("day"))


@query(
    "arc8_sealed_payload",
    """SELECT event_id, props AS opened, CAST(NULL AS VARCHAR) AS moved FROM events""",
)
def _(t):
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    label = F.concat(F.lit("event|"), sv.day_text("ts"))
    other = F.concat(F.lit("event|"), sv.day_text(F.date_add(F.col("ts").cast("date"), 1)))
    sealed = t.events.select("event_id", label.alias("label"), other.alias("other"), op.seal(F.col("props"), key, label).alias("blob"))
    return sealed.select("event_id", op.unseal(F.col("blob"), key, F.col("label")).alias("opened"), op.unseal(F.col("blob"), key, F.col("other")).alias("moved"))
