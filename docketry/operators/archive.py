"""Daily partition archives: statistics, manifests, audits, roll-ups, projections and sealed payloads.

Content digests add up: a day's digest is the sum of row hashes, so it needs no order, no single task and
no concatenation, and digests of parts combine into the digest of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def row_hash(*cols: str) -> Column:
    """Sixty bits of the SHA-256 of the canonical row, as a summable number."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def partition_stats(
    records: DataFrame, key: str, stamp: str, required: tuple[str, ...], day: str = "day", version: str | None = None
) -> DataFrame:
    """Per day: records, duplicate keys, missing fields, first and last stamp, content digest.

    Record types that carry a version also get the set of versions and the count of rows without one.

    Rows are first combined per (day, key), which also finds the duplicates; a key with very many rows
    collapses before it is shuffled.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    missing = [F.count_if(empty(c)).alias(f"missing_{c}") for c in required]
    content = [c for c in records.columns]
    extra_key = [F.collect_set(version).alias("versions"), F.count_if(empty(version)).alias("missing_version")] if version else []
    extra_day = (
        [F.array_sort(F.array_distinct(F.flatten(F.collect_set("versions")))).alias("versions"), F.sum("missing_version").alias("missing_version")]
        if version
        else []
    )
    per_key = records.withColumn("h", row_hash(*content)).groupBy(day, key).agg(
        F.count("*").alias("n"), F.min(stamp).alias("first_ts"), F.max(stamp).alias("last_ts"), F.sum("h").alias("h"),
        F.count_if(empty(stamp)).alias("missing_stamp"), *missing, *extra_key,
    )
    return per_key.groupBy(day).agg(
        F.sum("n").alias("record_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("missing_stamp").alias("missing_stamp"),
        *[F.sum(f"missing_{c}").alias(f"missing_{c}") for c in required],
        F.sum("h").cast("string").alias("digest"),
        *extra_day,
    )


def build_manifests(stats: DataFrame, manifests: DataFrame, today: Column, day: str = "day") -> DataFrame:
    """Manifests of closed days that have none yet. Today's partition is still written and is left alone."""
    closed = stats.where(F.col(day) < today)
    return closed.join(manifests.select(day), day, "left_anti").withColumn("status", F.lit("CLOSED"))


def audit_archive(stats: DataFrame, manifests: DataFrame, required: tuple[str, ...], day: str = "day") -> DataFrame:
    """Every difference between manifests and recomputed statistics, one row per error."""
    m = manifests.select(day, F.col("record_count").alias("m_count"), F.col("digest").alias("m_digest"), F.lit(True).alias("has_manifest"))
    both = stats.join(m, day, "full")
    seen = F.col("record_count").isNotNull()
    known = F.coalesce("has_manifest", F.lit(False))
    both_sides = seen & known
    count = lambda c: F.col(c).cast("string")
    errors = F.array_compact(
        F.array(
            F.when(~known, "NO_MANIFEST"),
            F.when(~seen, "NO_PARTITION"),
            F.when(both_sides & (F.col("record_count") != F.col("m_count")), F.concat(F.lit("COUNT "), count("record_count"), F.lit(" != "), count("m_count"))),
            F.when(both_sides & (F.col("digest") != F.col("m_digest")), "DIGEST"),
            F.when(both_sides & (F.col("duplicate_keys") > 0), F.concat(F.lit("DUPLICATE_KEYS "), count("duplicate_keys"))),
            F.when(both_sides & (F.col("missing_stamp") > 0), F.concat(F.lit("MISSING_STAMP "), count("missing_stamp"))),
            *[F.when(both_sides & (F.col(f"missing_{c}") > 0), F.concat(F.lit(f"MISSING {c} "), count(f"missing_{c}"))) for c in required],
        )
    )
    return both.select(day, F.explode(errors).alias("error"))


def weekly_rollup(stats: DataFrame, day: str = "day") -> DataFrame:
    """Per week: days included, records, first and last stamp."""
    return stats.groupBy(F.date_trunc("week", F.to_date(day)).cast("date").alias("week")).agg(
        F.array_sort(F.collect_set(day)).alias("days"), F.sum("record_count").alias("record_count"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


def monthly_rollup(stats: DataFrame, errors: DataFrame, day: str = "day") -> DataFrame:
    """Per month: bundled only if every day verifies, otherwise the number of days with problems."""
    bad = errors.select(day).distinct().withColumn("bad", F.lit(1))
    rows = stats.join(bad, day, "left")
    return rows.groupBy(F.substring(day, 1, 7).alias("month")).agg(
        F.count("*").alias("days"), F.sum("record_count").alias("record_count"), F.count("bad").alias("problem_days"),
        F.sum(F.col("digest").cast("decimal(38,0)")).cast("string").alias("digest"),
    ).withColumn("status", F.when(F.col("problem_days") == 0, "MONTHLY_ARCHIVED").otherwise("ARCHIVE_INTEGRITY_ERROR"))


def storage_projection(manifests: DataFrame, today: str) -> DataFrame:
    """Growth estimate from the final size of each day; a compressed day is not compressed again.

    Input: day (text), records, stored_bytes, compressed, compression_ratio. The day ``today`` is also told by itself:
    its new records, and its bytes as raw or as compressed ones.
    """
    own = lambda value, when: F.coalesce(F.sum(F.when((F.col("day") == today) & when, F.col(value))), F.lit(0)).cast("bigint")
    ratio = manifests.agg(F.round(F.avg(F.when(F.col("compressed"), F.col("compression_ratio"))), 4).alias("r")).scalar()
    size = F.col("stored_bytes").cast("double")
    final = F.when(F.col("compressed"), size).otherwise(size * F.coalesce(F.col("ratio"), F.lit(1.0)))
    sums = manifests.withColumn("ratio", ratio).agg(
        F.count("*").alias("observed_days"), F.max("ratio").alias("compression_ratio"),
        F.sum("stored_bytes").alias("total_bytes"), F.avg(size).alias("avg"), F.avg(final).alias("daily"),
        own("records", F.lit(True)).alias("new_records_today"), own("stored_bytes", ~F.col("compressed")).alias("raw_bytes_today"),
        own("stored_bytes", F.col("compressed")).alias("compressed_bytes_today"),
    )
    whole = lambda c: F.round(c).cast("bigint")
    return sums.select(
        F.lit(today).alias("as_of"), "observed_days", "new_records_today", "raw_bytes_today", "compressed_bytes_today", "compression_ratio", "total_bytes", whole(F.col("avg")).alias("daily_growth_bytes"),
        whole(F.col("daily")).alias("projected_daily_bytes"),
        *[whole(F.col("daily") * n).alias(f"estimated_{n}d_bytes") for n in (30, 90, 365)],
    )


def partition_states(days: DataFrame, stored: DataFrame, today: Column, day: str = "day") -> DataFrame:
    """State of every calendar day: COMPRESSED, ACTIVE, CLOSED or MISSING. ``stored`` has day and compacted."""
    state = (
        F.when(F.col("compacted"), "COMPRESSED")
        .when(F.col("compacted").isNull(), "MISSING")
        .when(F.col(day) >= today, "ACTIVE")
        .otherwise("CLOSED")
    )
    return days.select(day).join(stored.select(day, "compacted"), day, "left").select(day, state.alias("state"))


def calendar(span: DataFrame) -> DataFrame:
    """All days between the first and last day of a one-row span (first, last)."""
    return span.select(F.explode(F.sequence("first", "last")).alias("day"))


def seal(payload: Column, key: Column, label: Column) -> Column:
    """AES-GCM of a payload bound to a label such as ``type|day``; a missing key refuses to write."""
    checked = F.when(key.isNull(), F.raise_error(F.lit("archive key missing"))).otherwise(key)
    return F.aes_encrypt(payload, checked, F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lit("")), label)


def unseal(blob: Column, key: Column, label: Column) -> Column:
    """Plain payload, or null when the key or the label is not the one it was sealed with."""
    return F.try_aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT"), label).cast("string")
