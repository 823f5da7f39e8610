"""Minimax contiguous partition of ordered atomic groups into shards, in native expressions only.

Rows with equal texts are one atomic group. Groups are ordered by the digest of their text, which spreads sizes
evenly over the order. A group larger than an even share of what is left gets a shard of its own first (no
partition can do better for it); the others are cut contiguously at the smallest capacity for which filling
shards greedily needs no more shards than there are.

The capacity is found by binary search over a coarse list of running totals on the driver, at most
``COARSE`` rows whatever the input. The search keeps a lower and an upper bound of every greedy run, and asks
Spark for finer totals only inside the gaps where the two differ, until both agree: the capacity is exact.
The cuts become digests, so a row finds its shard by comparing its own digest: no join.

Edge cases: a null text counts as empty (size 16) and is one group with empty texts; null and repeated ids are
numbered like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import cut_lineage

#: Running totals that one refinement brings to the driver.
COARSE = 1 << 14
#: Rows that one numbering task is meant to hold.
CELL_ROWS = 1_000_000


class Totals:
    """Known group ends (running totals) and, for each gap between them, whether more ends may lie inside."""

    def __init__(self, total: int):
        self.ends, self.open, self.total = [0, total], [True, False], total

    def refine(self, gaps: list[tuple[int, int]], buckets: list[tuple[int, int, int]]) -> None:
        """Replace what is known inside each gap by the buckets (first end, last end, count) found there."""
        state = dict(zip(self.ends, self.open, strict=True))
        for a, b in gaps:
            for end in self.ends[bisect_right(self.ends, a) : bisect_left(self.ends, b)]:
                del state[end]
            state[a] = False
        for first, last, count in buckets:
            state.setdefault(last, False)
            if first != last:
                state[first] = count > 2
        self.ends = sorted(state)
        self.open = [state[e] for e in self.ends]

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the largest group end that is at most ``x``."""
        at = bisect_right(self.ends, x) - 1
        return self.ends[at], (x if self.open[at] else self.ends[at])

    def runs(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Ends of greedily filled shards: a run through known ends, and a bound that no run exceeds."""
        low, high, lows, highs = 0, 0, [], []
        for _ in range(shards):
            low, high = self.floor(low + capacity)[0], self.floor(min(self.total, high + capacity))[1]
            lows.append(low)
            highs.append(high)
        return lows, highs

    def smallest(self, shards: int, least: int, most: int, which: int) -> int:
        """The smallest capacity whose run (0: known ends, 1: bound) reaches the total."""
        while least < most:
            middle = (least + most) // 2
            if self.runs(middle, shards)[which][-1] >= self.total:
                most = middle
            else:
                least = middle + 1
        return least

    def gaps(self, lows: list[int], highs: list[int]) -> list[tuple[int, int]]:
        """Intervals between known ends, one for each shard at most, that hold all open gaps the true run may fall into."""
        merged: list[tuple[int, int]] = []
        for a, b in zip(lows, highs, strict=True):
            at, to = bisect_right(self.ends, a) - 1, bisect_right(self.ends, b)
            if not any(self.open[at:to]):
                continue
            a, b = self.ends[at], self.ends[min(to, len(self.ends) - 1)]
            if merged and merged[-1][1] >= a:
                a = merged.pop()[0]
            merged.append((a, b))
        return merged


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the running totals at which shards end.

    ``ends`` has one row per group with its running total in the bigint column ``end``.
    """
    known, gaps, width = Totals(total), [(0, total)], total
    while True:
        width = max(1, min(width // 2, sum(b - a for a, b in gaps) // COARSE))
        inside, gap = F.lit(False), F.lit(0)
        for a, b in gaps:
            inside = inside | ((F.col("end") > a) & (F.col("end") <= b))
            gap = gap + (F.col("end") > a).cast("int")
        found = (
            ends.where(inside)
            .groupBy(gap.alias("gap"), F.floor((F.col("end") - 1) / width).alias("bucket"))
            .agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        known.refine(gaps, [(r["first"], r["last"], r["n"]) for r in found])
        least = max(largest, -(-total // shards))
        low, high = known.smallest(shards, least, total, 1), known.smallest(shards, least, total, 0)
        if low == high:
            return high, known.runs(high, shards)[0]
        gaps = known.gaps(known.runs(low, shards)[0], known.runs(high, shards)[1])


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, text_digest, shard (from 0) and slot (gapless in its shard)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = cut_lineage(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 16).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.md5(body).alias("text_digest"),
        ),
        "shard-rows",
    )
    groups = cut_lineage(
        rows.groupBy("text_digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups"
    )
    total, count = groups.agg(F.sum("bytes"), F.sum("n")).first()
    if not total:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")})
    top = groups.orderBy(F.desc("bytes"), "text_digest").limit(shards).collect()
    giants: list[str] = []
    for row in top:
        left = shards - len(giants)
        if left == 1 or row["bytes"] * left <= total:
            break
        giants.append(row["text_digest"])
        total -= row["bytes"]
    others = groups.where(~F.col("text_digest").isin(giants)) if giants else groups
    place = F.lit(len(giants))
    if total:
        bucket = F.substring("text_digest", 1, 3)
        sums = others.groupBy(bucket.alias("part")).agg(F.sum("bytes").alias("bytes"))  # 4,096 rows at most
        bases = sums.select(
            "part", (F.sum("bytes").over(Window.orderBy("part")) - F.col("bytes")).alias("base")
        )
        within = F.sum("bytes").over(Window.partitionBy("part").orderBy("text_digest").rowsBetween(Window.unboundedPreceding, 0))
        ends = cut_lineage(
            others.withColumn("part", bucket)
            .withColumn("within", within)
            .join(F.broadcast(bases), "part")
            .select("text_digest", (F.col("base") + F.col("within")).alias("end")),
            "shard-ends",
        )
        largest = max((r["bytes"] for r in top if r["text_digest"] not in giants), default=total)
        _, cuts = minimax_cuts(ends, total, largest, shards - len(giants))
        inner = [c for c in dict.fromkeys(cuts) if 0 < c < total]
        borders = ends.where(F.col("end").isin(inner)).select("text_digest").collect() if inner else []
        for border in sorted(r["text_digest"] for r in borders):
            place = place + (F.col("text_digest") > border).cast("int")
    for at, digest in enumerate(giants):
        place = F.when(F.col("text_digest") == digest, F.lit(at)).otherwise(place)
    cells = max(16, -(-count // CELL_ROWS))
    placed = rows.withColumn("shard", place.cast("int")).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "text_digest"), F.lit(cells))
    )
    sizes = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(
        F.col("shard").alias("of_shard"),
        F.col("cell").alias("of_cell"),
        (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("start"),
    )
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_digest"))
    return (
        placed.withColumn("number", number)
        .join(starts, (F.col("shard") == F.col("of_shard")) & (F.col("cell") == F.col("of_cell")))
        .select(
            "doc_id", "size", "text_crc32", "text_digest", "shard", (F.col("start") + F.col("number") - 1).cast("bigint").alias("slot")
        )
    )
