"""Daily partitioned tables: keyed upsert, compaction with proof, and product bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry import vocab
from docketry.operators.archive import row_hash
from docketry.session import cut_lineage


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds anything yet, asked of the file system that owns the path."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def latest_rows(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of every key. An aggregation, so copies combine before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*key, "row.*")


def upsert_day(spark: SparkSession, path: str, records: DataFrame, key: str, order: str, today: str, day: str = "day") -> DataFrame:
    """Write records into their day partitions: a known key is replaced, a new one added.

    Only the partition of ``today`` and later ones may be written; earlier days are closed and raise. Returns
    one row per day with the added and replaced counts. Rows are rebalanced by day before they are written, so a
    day has few files and a large day has several writers. The merged rows are materialised in the shared folder
    before the partitions are overwritten, so a lost executor never reads what is being replaced.
    """
    incoming = cut_lineage(latest_rows(records, [day, key], order), "incoming")
    if not incoming.where(F.col(day) < F.lit(today)).isEmpty():
        raise PermissionError(f"partitions before {today} are closed")
    touched = incoming.select(day).distinct()
    if table_exists(spark, path):
        # Closed days are never written, so the scan of the archive is pruned to the open ones.
        archive = spark.read.schema(incoming.schema).parquet(path).where(F.col(day) >= F.lit(today))
        old = archive.join(touched, day, "left_semi").select(*incoming.columns)
    else:
        old = incoming.limit(0)
    tagged = old.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    rest = [c for c in incoming.columns if c not in (day, key)]
    merged = tagged.groupBy(day, key).agg(
        F.max_by(F.struct(*rest), F.struct("__new", order)).alias("row"), F.min("__new").alias("__low"), F.max("__new").alias("__high")
    )
    staged = cut_lineage(merged.select(day, key, "row.*", "__low", "__high"), "merged")
    (
        staged.drop("__low", "__high").hint("rebalance", day).sortWithinPartitions(day, key).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    )
    return staged.groupBy(day).agg(
        F.count_if(F.col("__low") == 1).alias("added"),
        F.count_if((F.col("__low") == 0) & (F.col("__high") == 1)).alias("replaced"),
    )


MANIFEST_SCHEMA = (
    "day string, record_count bigint, raw_bytes bigint, compressed_bytes bigint, compression_ratio double, plain_digest string, status string"
)


def read_lines(spark: SparkSession, path: str, day: str = "day") -> DataFrame:
    """The lines of a daily archive as they are: no field is parsed and no byte is changed. Only \\n ends a line."""
    return spark.read.schema(f"value string, {day} string").option("lineSep", "\n").text(path)


def copy_days(lines: DataFrame, target: str, day: str = "day") -> None:
    """Write lines gzip-compressed into their day partitions; other days of the target stay."""
    (
        lines.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "gzip").option("lineSep", "\n").partitionBy(day).text(target)
    )


def prove_days(lines: DataFrame, target: str, day: str = "day") -> DataFrame:
    """Manifest row of every day of ``lines``: what was copied, its size, and whether the copy holds the same lines.

    Source and copy are compared by number of lines and by an additive digest of the raw lines, so an unknown
    field, an unreadable line or a repeated line that is missing, changed or added shows. The order of lines is
    not part of the digest.
    """
    spark = lines.sparkSession

    def proof(df, tag):
        return df.groupBy(day).agg(
            F.count("*").alias(f"{tag}_count"), F.sum(row_hash("value")).alias(f"{tag}_digest"),
            F.sum(F.octet_length("value") + 1).alias(f"{tag}_bytes"),
        )

    files = spark.read.format("binaryFile").load(target)
    sizes = files.groupBy(F.col(day).cast("string").alias(day)).agg(F.sum("length").alias("compressed_bytes"))
    same = F.col("source_count").eqNullSafe(F.col("copy_count")) & F.col("source_digest").eqNullSafe(F.col("copy_digest"))
    return (
        proof(lines, "source").join(proof(read_lines(spark, target, day), "copy"), day, "left").join(sizes, day, "left")
        .select(
            F.col(day).alias("day"), F.col("source_count").alias("record_count"), F.col("source_bytes").alias("raw_bytes"), "compressed_bytes",
            F.round(F.col("compressed_bytes") / F.col("source_bytes"), 4).alias("compression_ratio"),
            F.col("source_digest").cast("string").alias("plain_digest"),
            F.when(same, vocab.OK).otherwise("ARCHIVE_INTEGRITY_ERROR").alias("status"),
        )
    )


def compact_days(spark: SparkSession, source: str, target: str, manifest: str, today: str, day: str = "day") -> DataFrame:
    """Copy the closed days (before ``today``) of a JSON-lines archive compressed, prove each, and keep the proofs.

    A day that an earlier run proved is not touched again, so lines that turn up late never replace its copy; they are
    taken by ``compact_late``.
    The manifest rows of this run are appended to ``manifest`` and returned; sources are only removed by
    ``remove_proven``.
    """
    lines = read_lines(spark, source, day).where(F.col(day) < F.lit(today))
    if table_exists(spark, manifest):
        done = spark.read.schema(MANIFEST_SCHEMA).parquet(manifest).where(F.col("status") == vocab.OK)
        lines = lines.join(done.select(F.col("day").alias(day)).distinct(), day, "left_anti")
    copy_days(lines, target, day)
    if not table_exists(spark, target):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    proved = cut_lineage(prove_days(lines, target, day), "manifest")
    proved.coalesce(1).write.mode("append").parquet(manifest)
    return proved


LATE_SCHEMA = "run int, day string, record_count bigint, raw_bytes bigint, late_digest string, whole_digest string, status string"


def read_late(spark: SparkSession, late: str, day: str = "day") -> DataFrame:
    """Late lines with the run that took them."""
    if not table_exists(spark, late):
        return spark.createDataFrame([], f"value string, run int, {day} string")
    return spark.read.schema(f"value string, run int, {day} string").option("lineSep", "\n").text(late)


def read_archive(spark: SparkSession, target: str, late: str, day: str = "day") -> DataFrame:
    """All archived lines: the copies of the days and what came late for them."""
    return read_lines(spark, target, day).unionByName(read_late(spark, late, day).drop("run"))


def compact_late(spark: SparkSession, source: str, target: str, late: str, manifest: str, late_manifest: str, today: str, day: str = "day") -> DataFrame:
    """Archive the lines that came for days already proven, and report them: one row per day with late lines.

    A source that still holds every line of the copy is the one it was made of, so only its surplus is late; of any
    other source all lines are. Late lines go to a folder of their own per run, compressed, and are read back. A day's
    digest of them is added to the digests kept so far: the sum must be that of all its archived lines. A run that
    stopped before its rows were in ``late_manifest`` has none and is repeated under the same number. Sources are
    removed by ``remove_late`` only.
    """
    proofs = spark.read.schema(MANIFEST_SCHEMA).parquet(manifest).where(F.col("status") == vocab.OK)
    kept = proofs.groupBy(F.col("day").alias(day)).agg(F.max("plain_digest").cast("decimal(38,0)").alias("kept"))
    earlier = spark.read.schema(LATE_SCHEMA).parquet(late_manifest) if table_exists(spark, late_manifest) else spark.createDataFrame([], LATE_SCHEMA)
    run = (earlier.agg(F.max("run")).first()[0] or 0) + 1
    added = earlier.where(F.col("status") == vocab.OK).groupBy(F.col("day").alias(day)).agg(F.sum(F.col("late_digest").cast("decimal(38,0)")).alias("added"))
    lines = read_lines(spark, source, day).where(F.col(day) < F.lit(today)).join(kept.select(day), day, "left_semi")
    days = lines.select(day).distinct()
    archived = read_lines(spark, target, day).unionByName(read_late(spark, late, day).where(F.col("run") < run).drop("run")).join(days, day, "left_semi")
    one, none = F.lit(1).alias("there"), F.lit(0).alias("there")
    counts = lines.select(day, "value", one).unionByName(archived.select(day, "value", none)).groupBy(day, "value").agg(
        F.sum("there").alias("here"), F.sum(1 - F.col("there")).alias("known")
    )
    counts = cut_lineage(counts, "late-counts")
    same = counts.groupBy(day).agg(F.bool_and(F.col("here") >= F.col("known")).alias("same"))
    more = F.col("here") - F.when(F.col("same"), F.col("known")).otherwise(0)
    found = cut_lineage(counts.join(same, day).select(day, "value", more.alias("n")).where("n > 0"), "late-lines")
    if found.isEmpty():
        return spark.createDataFrame([], LATE_SCHEMA)
    copies = found.select(day, "value", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("value", day)
    (
        copies.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "static")
        .option("compression", "gzip").option("lineSep", "\n").partitionBy(day).text(f"{late}/run={run}")
    )
    hashed = found.withColumn("h", row_hash("value") * F.col("n"))
    wanted = hashed.groupBy(day).agg(
        F.sum("n").cast("bigint").alias("record_count"), F.sum((F.octet_length("value") + 1) * F.col("n")).cast("bigint").alias("raw_bytes"),
        F.sum("h").cast("decimal(38,0)").alias("late_digest"),
    )
    stored = read_late(spark, late, day).where(F.col("run") == run).groupBy(day).agg(F.count("*").alias("n"), F.sum(row_hash("value")).alias("stored"))
    touched = found.select(day).distinct()
    whole = read_archive(spark, target, late, day).join(touched, day, "left_semi").groupBy(day).agg(F.sum(row_hash("value")).cast("decimal(38,0)").alias("whole"))
    right = (
        F.col("n").eqNullSafe(F.col("record_count")) & F.col("stored").eqNullSafe(F.col("late_digest"))
        & F.col("whole").eqNullSafe(F.col("kept") + F.coalesce("added", F.lit(0)) + F.col("late_digest"))
    )
    rows = wanted.join(stored, day, "left").join(whole, day, "left").join(kept, day).join(added, day, "left").select(
        F.lit(run).alias("run"), F.col(day).alias("day"), "record_count", "raw_bytes", F.col("late_digest").cast("string").alias("late_digest"),
        F.col("whole").cast("string").alias("whole_digest"), F.when(right, vocab.OK).otherwise("ARCHIVE_INTEGRITY_ERROR").alias("status"),
    )
    report = cut_lineage(rows, "late-manifest")
    report.coalesce(1).write.mode("append").parquet(late_manifest)
    return report


def _delete_days(spark: SparkSession, folders: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in folders:
        folder = jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def remove_late(report: DataFrame, source: str, late: str, day: str = "day") -> None:
    """Finish a run of ``compact_late``: the source of every proven day goes, and what was copied of every other day,
    so that the next run takes its lines again. The rows are one per calendar day."""
    rows = report.select("run", "day", "status").toLocalIterator()
    _delete_days(report.sparkSession, [f"{source}/{day}={r.day}" if r.status == vocab.OK else f"{late}/run={r.run}/{day}={r.day}" for r in rows])


def remove_proven(proved: DataFrame, source: str, target: str, day: str = "day") -> None:
    """Finish a run of ``compact_days``: the source of every proven day goes, the copy of every other day goes.

    The rows are one per calendar day, so the driver can walk them.
    """
    rows = proved.select("day", "status").toLocalIterator()
    _delete_days(proved.sparkSession, [f"{source if r.status == vocab.OK else target}/{day}={r.day}" for r in rows])


def bundle_months(records: DataFrame, months: DataFrame, path: str, day: str = "day") -> DataFrame:
    """Write the months whose days all verify, then count again what was written.

    ``months`` is the result of ``monthly_rollup``. A month with problems is not written at all; a bundle whose
    count differs from the sum of its days is reported as damaged.
    """
    spark = records.sparkSession
    rows = records.withColumn("month", F.substring(day, 1, 7))
    good = months.where("problem_days = 0").select("month")
    rows.join(good, "month", "left_semi").hint("rebalance", "month").write.mode("overwrite").option("compression", "zstd").partitionBy("month").parquet(path)
    written = spark.read.schema(rows.schema).parquet(path).groupBy("month").agg(F.count("*").alias("bundled"))
    whole = (F.col("problem_days") == 0) & F.col("bundled").eqNullSafe(F.col("record_count"))
    return months.select("month", "record_count", "problem_days").join(written, "month", "left").withColumn(
        "status", F.when(whole, "MONTHLY_ARCHIVED").otherwise("ARCHIVE_INTEGRITY_ERROR")
    )


def product_contract(products: dict[str, DataFrame], version: str, company: str = "code") -> DataFrame:
    """One row per product: rows, bytes of its canonical JSON, companies, content hash and record id.

    The hash is over the row set, not over file bytes, so it does not depend on how many files were written.
    """
    out = None
    for kind, df in products.items():
        text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        part = (
            df.select(F.col(company).alias("company"), text.alias("text"))
            .groupBy("company")
            .agg(F.count("*").alias("rows"), F.sum(F.octet_length("text") + 1).alias("bytes"), F.sum(row_hash("text")).alias("h"))
            .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("companies"), F.sum("h").cast("string").alias("h"))
            .select(
                F.lit(kind).alias("kind"), "rows", "bytes", "companies",
                F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.coalesce("h", F.lit("0"))), 256).alias("sha256"),
            )
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("record_id", F.concat_ws(":", F.lit(version), "kind", F.substring("sha256", 1, 16)))


def write_products(products: dict[str, DataFrame], path: str, version: str, company: str = "code") -> DataFrame:
    """Write every product as JSON lines, then the contract computed from what was written."""
    spark = next(iter(products.values())).sparkSession
    written = {}
    for kind, df in products.items():
        folder = f"{path}/{kind}"
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
        written[kind] = spark.read.schema(df.schema).json(folder)
    table = product_contract(written, version, company)
    table.write.mode("overwrite").parquet(f"{path}/contract")
    return spark.read.parquet(f"{path}/contract")
