"""Incremental ingest: at-least-once delivery, keyed storage, acknowledgement after read-back, rows of any age.

All tables are runs (see ``runs``) in the shared folder as Parquet, partitioned by day, week or bucket. A micro-batch
reads only the parts its rows belong to, and a batch that runs twice after a failure overwrites itself instead of adding
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry import vocab
from docketry.operators.filings import link_corrections, title_state
from docketry.streaming.runs import PART, RunTable, latest_of, parts_of

#: Late days that one backfill takes, oldest first, as one catch-up run does.
BACKFILL_DAYS = 14
#: Buckets of tickers that the titles known so far are spread over.
TITLE_BUCKETS = 64
#: Corrected tickers of a batch that are named in the scan of the titles.
LISTED_TICKERS = 1000


def read_files(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, handle, mode: str = "append") -> None:
    """Process everything that has arrived, then stop. Progress is kept in the checkpoint."""
    (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(handle).trigger(availableNow=True).start().awaitTermination()
    )


def _staged(rows: DataFrame, root: str, batch: int) -> DataFrame:
    """Rows of a batch, written once and read from there; the copy of the batch before goes."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop(PART).dtypes)
    return RunTable(rows.sparkSession, f"{root}/pending", schema).stage(batch, rows)


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("row")).select(key, "row.*")


class FilingStore:
    """Stored filings and their states, by receipt day: one row each per receipt, however often it arrived."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema
        self.filings = RunTable(spark, f"{root}/filings", schema, latest_of("rcept_no"))
        self.log = RunTable(spark, f"{root}/states", "rcept_no string, state string, batch bigint", latest_of("rcept_no"))

    def _store(self, rows: DataFrame, batch: int) -> None:
        self.filings.write(batch, rows)

    def rows(self) -> DataFrame:
        """Stored filings, one row per receipt: the last batch wins, which absorbs repeats."""
        return self.filings.read().drop(PART)

    def states(self, parts: list[str] | None = None, before: int | None = None) -> DataFrame:
        """State of every receipt; only of the given receipt days, only from earlier batches, if asked."""
        return self.log.read(before, parts).select("rcept_no", "state")

    def ingest(self, batch: DataFrame, batch_id: int, universe: DataFrame) -> None:
        """One micro-batch: match, skip acknowledged, store, read back, acknowledge what is really there.

        The new rows are first written to the batch folder and everything after reads that copy. The states follow
        last, so a batch that stops half-way has none and runs again as a whole: it finds the table as it was before
        it, and does not see its own acknowledgements.
        """
        usable = batch.where(F.coalesce("rcept_no", F.lit("")) != "").join(universe.select("code"), "code", "left_semi")
        arrived = _staged(_one_each(usable, "rcept_no").withColumn(PART, F.substring("rcept_no", 1, 8)), self.root, batch_id)
        states = self.states(parts_of(arrived), batch_id)
        fresh = arrived.join(states.where(F.col("state") == vocab.ACKNOWLEDGED), "rcept_no", "left_anti")
        self._store(fresh, batch_id)
        # Read back from storage: only a receipt that can be read again is stored and acknowledged.
        stored = self.filings.read_run(batch_id).select("rcept_no", F.lit(vocab.ACKNOWLEDGED).alias("stored"))
        self.log.write(
            batch_id,
            fresh.select("rcept_no", PART).join(stored, "rcept_no", "left")
            .select("rcept_no", F.coalesce("stored", F.lit(vocab.PENDING)).alias("state"), F.lit(batch_id).alias("batch"), PART),
        )

    def unconfirmed(self) -> DataFrame:
        """Receipts to retry: seen but not acknowledged."""
        return self.states().where(F.col("state") != vocab.ACKNOWLEDGED)


class EventStore:
    """Rows of a stream once each by key, and their counts per Monday week and kind, whatever their age.

    The watermark is the greatest stamp of all earlier batches less ``delay``. Rows behind it are no loss: they go to the
    table of late rows, and ``backfill`` takes them into rows and counts, oldest days first. Repeats are known by key
    among all stored rows of the same day, so a run that reads the last days again adds nothing, after any time.
    The expression ``day`` must follow from the key, as the day in a receipt number does, so that repeats meet in one part. Rows
    without a stamp are on time and counted under no week. Rows without a day are kept in a part of their own.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, stamp: str, day: str, kind: str | None = None, delay: str = "1 day"):
        self.spark, self.root, self.key, self.stamp, self.kind, self.delay = spark, root, key, stamp, kind, delay
        self.day = f"coalesce(nullif(string({day}), ''), 'unknown')"
        self.kept, self.caught_up = (RunTable(spark, f"{root}/{n}", schema) for n in ("kept", "caught_up"))
        self.late = RunTable(spark, f"{root}/late", f"{schema}, watermark timestamp, batch bigint")
        self.done = RunTable(spark, f"{root}/done", "batch bigint", lambda rows: rows.groupBy(PART).agg(F.max("batch").alias("batch")))
        self.marks = RunTable(spark, f"{root}/marks", "stamp timestamp", lambda rows: rows.groupBy(PART).agg(F.max("stamp").alias("stamp")))
        self.counts, self.late_counts = (RunTable(spark, f"{root}/{n}", "week date, kind string, n bigint", self._added) for n in ("counts", "late_counts"))

    @staticmethod
    def _added(rows: DataFrame) -> DataFrame:
        return rows.groupBy(PART, "week", "kind").agg(F.sum("n").alias("n"))

    def watermark(self, batch: int | None = None) -> Column:
        """The instant that rows of a batch must reach to be on time; null before the first one."""
        mark = F.unix_micros(F.max("stamp") - F.expr(f"INTERVAL {self.delay}"))
        return F.timestamp_micros(F.lit(self.marks.read(batch).agg(mark).first()[0]).cast("bigint"))

    def _count(self, table: RunTable, number: int, rows: DataFrame) -> None:
        if self.kind:
            week = F.to_date(F.date_trunc("week", F.col(self.stamp)))
            sums = rows.groupBy(week.alias("week"), F.col(self.kind).alias("kind")).agg(F.count("*").alias("n"))
            table.write(number, sums.withColumn(PART, F.coalesce(F.col("week").cast("string"), F.lit("unknown"))))

    def _unknown(self, rows: DataFrame, before: int, step: int) -> DataFrame:
        """Rows whose key is not stored yet; looks only into the parts the rows belong to."""
        parts = parts_of(rows)
        known = self.kept.read(before, parts).select(self.key).union(self.caught_up.read(step, parts).select(self.key))
        return rows.join(known, self.key, "left_anti")

    def ingest(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. Its mark is written last: only then do its rows count, and it is not taken again."""
        if self.marks.next_batch() > batch_id:
            return
        mark = self.watermark(batch_id)
        arrived = _staged(_one_each(batch.where(F.col(self.key).isNotNull()), self.key).withColumn(PART, F.expr(self.day)), self.root, batch_id)
        fresh = self._unknown(arrived, batch_id, self.done.next_batch())
        behind = F.coalesce(F.col(self.stamp) < mark, F.lit(False))
        self.kept.write(batch_id, fresh.where(~behind))
        self.late.write(batch_id, fresh.where(behind).withColumns({"watermark": mark, "batch": F.lit(batch_id)}))
        self._count(self.counts, batch_id, self.kept.read_run(batch_id))
        self.marks.write(batch_id, arrived.agg(F.max(self.stamp).alias("stamp")).withColumn(PART, F.lit("all")))

    def waiting(self) -> DataFrame:
        """Late rows that no backfill has taken yet."""
        done = self.done.read().withColumnRenamed("batch", "upto")
        rows = self.late.read(self.marks.next_batch()).join(done, PART, "left")
        return rows.where(F.col("batch") > F.coalesce("upto", F.lit(-1))).drop("upto")

    def backfill(self, days: int = BACKFILL_DAYS) -> int:
        """Take the late rows of the oldest ``days`` days into rows and counts; returns how many days are left.

        A step that stops half-way has no ``done`` run and is taken again as a whole.
        """
        waiting = parts_of(self.waiting())
        if waiting[:days]:
            step, upto = self.done.next_batch(), self.marks.next_batch() - 1
            rows = self.waiting().where(F.col(PART).isin(waiting[:days])).drop("watermark", "batch")
            self.caught_up.write(step, self._unknown(_one_each(rows, self.key), upto + 1, step))
            self._count(self.late_counts, step, self.caught_up.read_run(step))
            taken = self.spark.createDataFrame([(d, upto) for d in waiting[:days]], f"{PART} string, batch bigint")
            self.done.write(step, taken)
        return len(waiting[days:])

    def rows(self) -> DataFrame:
        """All rows taken so far, once each: keys are told apart before they are stored, so nothing is merged here."""
        return self.kept.read(self.marks.next_batch()).unionByName(self.caught_up.read(self.done.next_batch())).drop(PART)

    def weekly_counts(self) -> DataFrame:
        """Rows by Monday week and kind."""
        both = self.counts.read(self.marks.next_batch()).unionByName(self.late_counts.read(self.done.next_batch()))
        return self._added(both).drop(PART)

    def late_rows(self) -> DataFrame:
        """Every row that came behind the watermark, with the watermark it missed and whether it has been taken since."""
        open_rows = self.waiting().select(self.key, F.lit(True).alias("open")).distinct()
        return self.late.read(self.marks.next_batch()).join(open_rows, self.key, "left").withColumn("taken", F.col("open").isNull()).drop("open", PART)


class LinkStore:
    """Corrections of a stream linked against everything before them.

    The history is kept as the greatest receipts per ticker and title, in buckets of tickers. A batch reads the titles of
    the tickers that it corrects, and nothing of others; a ticker's titles grow with its different titles, not with
    its filings.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keep: int = 5):
        self.root, self.keep = root, keep
        self.titles = RunTable(
            spark, f"{root}/titles", "ticker string, report_name string, receipts array<string>", self._greatest, order="ticker"
        )
        self.linked = RunTable(
            spark, f"{root}/linked", f"{schema}, corrects_rcept_no string, correction_candidates array<string>, correction_link_basis string"
        )

    def _greatest(self, rows: DataFrame) -> DataFrame:
        """Titles of several runs as one: the greatest receipts per ticker and title."""
        every = F.array_distinct(F.sort_array(F.flatten(F.collect_list("receipts")), asc=False))
        return rows.groupBy(PART, "ticker", "report_name").agg(F.slice(every, 1, self.keep + 1).alias("receipts"))

    @staticmethod
    def bucket(ticker: str = "ticker") -> Column:
        return F.pmod(F.xxhash64(ticker), F.lit(TITLE_BUCKETS)).cast("string")

    def history(self, corrections: DataFrame, batch: int) -> DataFrame:
        """What is known of the corrected tickers before a batch. A short list of them reaches the scan, whose files
        are in order of tickers; a long one is joined."""
        tickers = corrections.select("ticker", self.bucket().alias(PART)).distinct()
        some = [r["ticker"] for r in tickers.limit(LISTED_TICKERS + 1).collect()]
        if len(some) <= LISTED_TICKERS:
            return self.titles.read(batch, parts_of(tickers), F.col("ticker").isin(some)).drop(PART)
        return self.titles.read(batch, parts_of(tickers)).drop(PART).join(tickers.select("ticker"), "ticker", "left_semi")

    def ingest(self, batch: DataFrame, batch_id: int) -> None:
        day = F.coalesce(F.nullif(F.substring("rcept_no", 1, 8), F.lit("")), F.lit("unknown"))
        arrived = _staged(batch.withColumn(PART, day), self.root, batch_id)
        events = arrived.drop(PART)
        links = link_corrections(events, self.history(events.where("is_correction"), batch_id), self.keep)
        self.linked.write(batch_id, links.withColumn(PART, day))
        self.titles.write(batch_id, title_state(events, self.keep).withColumn(PART, self.bucket()))

    def links(self) -> DataFrame:
        return self.linked.read().drop(PART)
