"""Scans: issuer registries, seen registries, evidence, statements, target lists and script literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.functions import instants as ts, text as tx


def read_issuer_registry(spark: SparkSession, path: str) -> DataFrame:
    """Issuer registry from XML ``<list>`` records; values are trimmed and a missing tag is empty."""
    rows = (
        spark.read.format("xml").option("rowTag", "list")
        .schema("corp_code string, corp_name string, stock_code string").load(path)
    )
    return rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in rows.columns])


CELL = (
    "struct<status:string,fsDiv:string,reprtCode:string,collectedAt:string,coverage:double,"
    "values:map<string,string>,missing:array<string>,notApplicable:array<string>>"
)


def read_financial_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per (company, year) from one JSON document per company, or from JSON lines.

    A document that cannot be read or has no ``years`` object is skipped. Values stay text: a number or a
    sentinel word.
    """
    docs = (
        spark.read.schema(f"ticker string, years map<string,{CELL}>, _corrupt_record string")
        .option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    )
    cells = docs.where("_corrupt_record IS NULL AND years IS NOT NULL").select(
        F.col("ticker").alias("code"), F.explode("years").alias("year", "r")
    )
    return cells.select("code", F.col("year").cast("int").alias("year"), "r.*")


def seen_to_filings(seen: DataFrame, universe: DataFrame) -> DataFrame:
    """Registry entries as list-sourced filings: tracked code, a title, and a date in the receipt number."""
    day = ts.compact_to_date("rcept_no")
    rows = seen.where((F.coalesce("report_name", F.lit("")) != "") & day.isNotNull())
    kind = tx.research_correction_kind("title")
    return (
        rows.join(universe.select(F.col("code").alias("ticker")), "ticker", "left_semi")
        .select(
            F.col("ticker").alias("code"), "rcept_no", tx.clean_title("report_name").alias("title"), day.alias("received_on"),
            F.lit("list").alias("source"),
        )
        .withColumn("correction_kind", kind)
        .withColumn("is_correction", F.col("correction_kind").isNotNull())
        .withColumn("url", tx.viewer_url("rcept_no"))
    )


def evidence_to_filings(evidence: DataFrame, universe: DataFrame) -> DataFrame:
    """Findings nested in evidence records as filings; rows without id, date or title are skipped."""
    rows = (
        evidence.join(universe.select(F.col("code").alias("ticker")), "ticker", "left_semi")
        .select(F.col("ticker").alias("code"), F.explode("comparisonFindings").alias("f"))
        .select("code", F.col("f.id").alias("rcept_no"), "f.title", ts.compact_to_date("f.receivedOn").alias("received_on"))
    )
    present = (F.coalesce("rcept_no", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & F.col("received_on").isNotNull()
    return rows.where(present).withColumn("title", tx.clean_title("title")).withColumn("source", F.lit("evidence"))


def span_of(filings: DataFrame) -> DataFrame:
    """First day, last day and count of a source."""
    return filings.agg(F.min("received_on").alias("from"), F.max("received_on").alias("to"), F.count("*").alias("count"))


def weekly_rows(seen: DataFrame, names: DataFrame) -> DataFrame:
    """All rows with a fourteen-digit receipt, tracked or not; an unknown name is the code itself."""
    known = names.select(F.col("code").alias("ticker"), "name")
    rows = seen.where(F.col("rcept_no").rlike(r"^\d{14}$")).join(known, "ticker", "left")
    return rows.select(
        F.col("ticker").alias("code"),
        F.coalesce(F.nullif("name", F.lit("")), "ticker").alias("name"),
        F.col("report_name").alias("title"),
        ts.compact_to_date("rcept_no").alias("date"),
        "rcept_no",
        tx.viewer_url("rcept_no").alias("url"),
        F.col("name").isNotNull().alias("tracked"),
        tx.is_site_correction("report_name").alias("is_correction"),
    )


def read_target_list(spark: SparkSession, path: str) -> DataFrame:
    """Six-digit codes of a text list, comments cut, in order of first appearance."""
    lines = spark.read.text(path).select(
        F.trim(F.regexp_replace("value", "#.*$", "")).alias("code"),
        F.struct(
            F.input_file_name().alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("ord"),
    )
    return lines.where(F.col("code").rlike(r"^\d{6}$")).groupBy("code").agg(F.min("ord").alias("ord"))


def read_script_literal(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of a JSON array assigned to a constant in a script file; no match gives no row."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?m)^\s*//.*$", "").alias("text"))
    literal = F.regexp_extract("text", rf"(?s)const\s+{name}\s*=\s*(\[.*?\])\s*;", 1)
    rows = text.select(F.from_json(literal, f"array<struct<{schema}>>").alias("rows"))
    return rows.select(F.inline("rows"))
