"""Tables that grow by micro-batches and stay small in files: numbered runs, merged as the digits of a number carry.

Every batch writes one run. When ``fan`` runs of a size are there, they are merged into one, so after n batches at most
``fan`` runs of each of log(n) sizes are read, a part of the table that batches stop touching soon lies in one file, and
a row is rewritten log(n) times in all. A batch that runs again overwrites its own run, and a run counts only once Spark
has marked it as complete, so a stop at any point loses and repeats nothing.

Rows carry a text column ``part`` (a day, a week, a bucket); runs are partitioned by it, and readers name the parts they
need. Parts are few (days of a calendar, buckets), so lists of them may pass the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

PART = "part"


def latest_of(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Merge: the row of the newest run per key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, PART, "run")]
        return rows.groupBy(PART, *keys).agg(F.max_by(F.struct(*rest), "run").alias("row")).select(PART, *keys, "row.*")

    return merge


def parts_of(rows: DataFrame) -> list[str]:
    return sorted(r[0] for r in rows.select(PART).distinct().collect() if r[0] is not None)


class RunTable:
    """One table of runs. ``schema`` lists the columns besides ``part``; ``merge`` joins rows of several runs (which
    have a text column ``run``, in order of age) into what one run would hold, and may be left out where rows of
    different batches never belong together."""

    def __init__(self, spark: SparkSession, root: str, schema: str, merge: Callable[[DataFrame], DataFrame] | None = None, fan: int = 8, order: str | None = None):
        self.spark, self.root, self.schema, self.fan, self.order = spark, root.rstrip("/"), schema, fan, order
        self.merge = merge or (lambda rows: rows.drop("run"))
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _runs(self) -> list[tuple[int, int]]:
        """First and last batch of every complete run."""
        found = []
        if self._files.exists(self._path(self.root)):
            for status in self._files.listStatus(self._path(self.root)):
                name = status.getPath().getName()
                if name.startswith("run=") and self._files.exists(self._path(f"{self.root}/{name}/_SUCCESS")):
                    first, last = name.removeprefix("run=").split("-")
                    found.append((int(first), int(last)))
        return sorted(found)

    def _folder(self, first: int, last: int) -> str:
        return f"{self.root}/run={first:09d}-{last:09d}"

    def cover(self, before: int | None = None, since: int = 0) -> list[tuple[int, int]]:
        """The fewest runs that hold the batches from ``since`` up to, not including, ``before``."""
        usable = [r for r in self._runs() if r[0] >= since and (before is None or r[1] < before)]
        chosen, at = [], since
        while ahead := [r for r in usable if r[0] >= at]:
            first = min(r[0] for r in ahead)
            chosen.append(max(r for r in ahead if r[0] == first))
            at = chosen[-1][1] + 1
        return chosen

    def next_batch(self) -> int:
        """The number after the newest run."""
        return max((last for _, last in self._runs()), default=-1) + 1

    def _load(self, runs: list[tuple[int, int]]) -> DataFrame:
        schema = f"{self.schema}, run string, {PART} string"
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*[self._folder(*r) for r in runs])

    def read(self, before: int | None = None, parts: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """The merged rows of all runs, or of those before the newest batch; only of the given parts or where a condition on
        merged keys holds, if asked. Both reach the scan."""
        rows = self._load(self.cover(before))
        if parts is not None:
            rows = rows.where(F.col(PART).isin(parts))
        return self.merge(rows if where is None else rows.where(where))

    def read_run(self, batch: int) -> DataFrame:
        """What the run of one batch holds, read back from storage."""
        return self._load([(batch, batch)]).drop("run")

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        placed = rows.select(*StructType.fromDDL(self.schema).names, PART).hint("rebalance", PART)
        if self.order:
            placed = placed.sortWithinPartitions(PART, self.order)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(PART).parquet(self._folder(first, last))

    def write(self, batch: int, rows: DataFrame) -> None:
        """Write the run of a batch, then merge the runs that became ``fan``. Merged runs go with the next batch, as a
        batch that runs again must find the table as it was before it."""
        self._prune(batch)
        self._write(rows, batch, batch)
        size = self.fan
        while (batch + 1) % (size * self.fan) == 0:
            size *= self.fan
        if (batch + 1) % size == 0:
            first = batch + 1 - size
            self._write(self.merge(self._load(self.cover(batch + 1, first))), first, batch)

    def stage(self, batch: int, rows: DataFrame) -> DataFrame:
        """Keep rows only for their own batch: write its run, drop those of earlier ones, and read it back."""
        self._write(rows, batch, batch)
        for first, last in self._runs():
            if last < batch:
                self._files.delete(self._path(self._folder(first, last)), True)
        return self.read_run(batch)

    def _prune(self, batch: int) -> None:
        runs = self._runs()
        for first, last in runs:
            if any(a <= first and last <= b < batch and (a, b) != (first, last) for a, b in runs):
                self._files.delete(self._path(self._folder(first, last)), True)
