"""Streaming queries: the event table is written as arriving files, streamed, and compared with the batch result."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from docketry.plans import standins as sv
from docketry.plans.registry import query
from docketry.session import scratch_path
from docketry.streaming import ingest as ing

FILING_SCHEMA = (
    "code string, rcept_no string, title string, received_on date, detected_at timestamp_ntz, is_correction boolean, seq bigint"
)


def arrivals(path, rows, again=0, held=None):
    """Write the rows in three slices, as a collector would; each slice is one generator step.

    The cuts are thirds of the span of the table, and the outer slices are open, so no row falls between them. A
    slice starts ``again`` days early, as a run that reads the last days of the run before again. Rows of the first
    slice that the condition ``held`` names arrive after all others, as after an outage.
    """
    first, last = rows.agg(F.min("received_on"), F.max("received_on")).first()
    if first is None:
        cuts = [(None, None)]
    else:
        third = (last - first) // 3 + timedelta(1)
        starts = [first + third, first + 2 * third]
        cuts = list(zip([None, *[s - timedelta(again) for s in starts]], [*starts, None]))
    late = None
    if held is not None and cuts[0][1] is not None:
        missed = F.coalesce(F.expr(held) & (F.col("received_on") < cuts[0][1]), F.lit(False))
        rows, late = rows.where(~missed), rows.where(missed)
    for low, high in cuts:
        part = rows
        if low is not None:
            part = part.where(F.col("received_on") >= low)
        if high is not None:
            early = F.col("received_on") < high
            part = part.where(early if low is not None else F.coalesce(early, F.lit(True)))
        part.write.mode("append").parquet(path)
        yield
    if late is not None:
        late.write.mode("append").parquet(path)
        yield


def ingested(t):
    base = scratch_path(t.spark, "ingest")
    store = ing.FilingStore(t.spark, base, FILING_SCHEMA)
    tracked = sv.universe(t)
    for _ in arrivals(f"{base}/arrivals", sv.filing(t), 1):
        stream = ing.read_files(t.spark, f"{base}/arrivals", FILING_SCHEMA)
        ing.run_available(stream, f"{base}/checkpoint", lambda df, n: store.ingest(df, n, tracked))
    return store


@query("str1_incremental_ingest", "WITH " + sv.TRACKED + " SELECT code, rcept_no, title, seq FROM tracked")
def _(t):
    return ingested(t).rows().select("code", "rcept_no", "title", "seq")


@query(
    "str2_acknowledged_states",
    "WITH " + sv.TRACKED + " SELECT 'ACKNOWLEDGED' AS state, count(*) AS n FROM tracked GROUP BY 1",
)
def _(t):
    return ingested(t).states().groupBy("state").agg(F.count("*").alias("n"))


#: Rows that an outage holds back until all others are there.
HELD = "seq % 5 = 0"


def events_stored(t, again):
    """The events as a stream with an outage: late rows are taken by backfill after every run, oldest days first."""
    base = scratch_path(t.spark, "events")
    schema = FILING_SCHEMA.replace("timestamp_ntz", "timestamp")
    store = ing.EventStore(t.spark, base, schema, "rcept_no", "detected_at", "substring(rcept_no, 1, 8)", "title")
    for _ in arrivals(f"{base}/arrivals", sv.filing(t), again, HELD):
        stream = ing.read_files(t.spark, f"{base}/arrivals", FILING_SCHEMA).withColumn("detected_at", F.col("detected_at").cast("timestamp"))
        ing.run_available(stream, f"{base}/checkpoint", store.ingest)
        while store.backfill():
            pass
    return store


@query("str3_overlap_dedup", "WITH " + sv.FILING + " SELECT rcept_no, code, title FROM filing")
def _(t):
    return events_stored(t, 1).rows().select("rcept_no", "code", "title")


@query(
    "str3_late_rows",
    "WITH " + sv.FILING + """, cut AS (SELECT min(received_on) + CAST((max(received_on) - min(received_on)) // 3 + 1 AS INTEGER) AS first_cut FROM filing),
held AS (SELECT filing.*, coalesce(seq % 5 = 0 AND received_on < first_cut, false) AS late FROM filing, cut)
SELECT rcept_no, code, true AS taken FROM held WHERE late AND detected_at < (SELECT max(detected_at) FILTER (NOT late) - INTERVAL 1 DAY FROM held)""",
)
def _(t):
    return events_stored(t, 1).late_rows().select("rcept_no", "code", "taken")


@query(
    "str5_weekly_stream_counts",
    "WITH " + sv.FILING + " SELECT strftime(date_trunc('week', received_on), '%Y-%m-%d') AS week, title AS kind, count(*) AS n FROM filing GROUP BY 1, 2",
)
def _(t):
    return events_stored(t, 0).weekly_counts().withColumn("week", sv.day_text("week"))


LINK_SCHEMA = "ticker string, rcept_no string, report_name string, is_correction boolean, seq bigint"


@query(
    "str6_stream_correction_links",
    "WITH " + sv.FILING + r""", c AS (SELECT *, trim(regexp_replace(title, '\[기재정정\]|\[첨부정정\]|\[정정\]|정정신고', '', 'g')) AS base FROM filing WHERE is_correction),
cand AS (SELECT c.rcept_no, h.rcept_no AS other, row_number() OVER (PARTITION BY c.rcept_no ORDER BY h.rcept_no DESC) AS rn, count(*) OVER (PARTITION BY c.rcept_no) AS n
  FROM c JOIN filing h ON c.code = h.code AND h.seq < c.seq AND contains(h.title, c.base)),
agg AS (SELECT rcept_no, max(n) AS n, string_agg(other, ',' ORDER BY other) AS others FROM cand WHERE rn <= 5 GROUP BY 1)
SELECT c.rcept_no, CASE WHEN n = 1 THEN others ELSE 'NOT_AVAILABLE' END AS corrects_rcept_no, CASE WHEN n > 1 THEN others END AS candidates FROM c LEFT JOIN agg USING (rcept_no)""",
)
def _(t):
    base = scratch_path(t.spark, "links")
    rows = sv.filing(t).select(F.col("code").alias("ticker"), "rcept_no", F.col("title").alias("report_name"), "is_correction", "seq", "received_on")
    store = ing.LinkStore(t.spark, base, LINK_SCHEMA)
    for _ in arrivals(f"{base}/arrivals", rows):
        stream = ing.read_files(t.spark, f"{base}/arrivals", LINK_SCHEMA)
        ing.run_available(stream, f"{base}/checkpoint", store.ingest)
    return store.links().where("is_correction").select("rcept_no", "corrects_rcept_no", sv.joined("correction_candidates").alias("candidates"))
