"""Hard negatives by slots: the upper limits of an anchor's positives cut the scores into disjoint slots.

An anchor's positives are its best rows of the same label, and each allows negatives in a window of scores below its
own. The windows of one anchor overlap, so their upper limits are sorted: the scores up to a limit and above the next
lower one are a slot. Every task keeps the best few rows of each slot (the combiner), Spark keeps the best of all tasks,
and the slots are merged from the lowest one upwards: what has been merged at a limit answers its window.

Rows and anchors meet in a grid of cells of bounded size (``CELL_VALUES`` components of rows, ``ANCHOR_VALUES`` of
anchors): a row goes to one group and every block, an anchor to one block and every group, and a cell multiplies the two
in tiles. The anchors are a stated query set; nothing is broadcast or sent to the driver.

Components become ``floor(scale * x)``. Scores are exact integers: 64-bit floats where no sum can pass 2^53, Python
integers elsewhere; a score beyond 64 bits counts as the end of their range.

Edge cases: rows with a null label or vector or any null or non-finite component take no part; shorter vectors count as
filled up with zeros; rows with the anchor's own key are no positives of it; a null key is no anchor, and sorts last
among ties; a repeated anchor gives its rows as often; a positive whose window is empty gives none; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import bound_batches
from docketry.session import cut_lineage

#: Components of the rows and of the anchors of one cell, and scores of one tile.
CELL_VALUES = 1 << 22
ANCHOR_VALUES = 1 << 20
TILE = 1 << 21
#: A group holds at least this many rows where the session has cores to spare.
LEAST_ROWS = 2048
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Mining:
    """``floor`` and ``ceiling``: per cent of the positive's score that a negative's score may have."""

    positives: int = 5
    negatives: int = 3
    floor: int = 50
    ceiling: int = 95
    scale: float = 256.0


def whole_vectors(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """A matrix of whole numbers (as doubles) from lists of numbers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors) as 64-bit integers."""
    width = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :width], anchors[:, :width]
    limit = (2.0**53 / max(1, width)) ** 0.5 - 1
    small_rows, small = np.abs(rows).max(axis=1, initial=0) <= limit, np.abs(anchors).max(axis=1, initial=0) <= limit
    if small_rows.all() and small.all():
        return (rows @ anchors.T).astype(np.int64)
    out = np.empty((len(rows), len(anchors)), dtype=np.int64)
    out[np.ix_(small_rows, small)] = (rows[small_rows] @ anchors[small].T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    every = np.ones(len(small), bool)
    for some, others in ((~small_rows, every), (small_rows, ~small)):
        if some.any() and others.any():
            product = exact(rows[some]).dot(exact(anchors[others]).T)
            out[np.ix_(some, others)] = np.minimum(np.maximum(product, int(LOW)), int(HIGH)).astype(np.int64)
    return out


class Best:
    """The best rows of every (anchor, slot) so far: by score, then by key. Works as a combiner inside a task."""

    def __init__(self, anchors: int, slots: int, most: int, keys: np.ndarray, none: np.ndarray):
        self.most, self.slots, self.keys, self.none = most, slots, keys, none
        self.least = np.full(anchors * slots, LOW, dtype=np.int64)
        self.held = [np.zeros(0, np.int64)] * 3
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, place: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Candidates by place (anchor * slots + slot), score and index of the row."""
        good = score >= self.least[place]
        self.new.append((place[good], score[good], row[good]))
        self.waiting += int(good.sum())
        if self.waiting > TILE // 4:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, score, row = (np.concatenate([h, *parts]) for h, parts in zip(self.held, zip(*self.new) if self.new else ((), (), ())))
        order = np.lexsort((self.keys[row], self.none[row], ~score, place))
        place, score, row = place[order], score[order], row[order]
        start = np.searchsorted(place, place, side="left")
        nth = np.arange(len(place)) - start
        full = nth == self.most - 1
        self.least[place[full]] = score[full]
        kept = nth < self.most
        self.held, self.new, self.waiting = [place[kept], score[kept], row[kept]], [], 0
        return tuple(self.held)


def _labels(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    names = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
    codes = pc.dictionary_encode(names).indices.to_numpy(zero_copy_only=False)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _keys(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, int(HIGH)).to_numpy(zero_copy_only=False), pc.is_null(column).to_numpy(zero_copy_only=False)


def windows(positive: np.ndarray, mining: Mining) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest scores allowed by positives' scores, without leaving 64 bits."""
    whole, rest = positive // 100, positive % 100
    return mining.floor * whole - ((-mining.floor * rest) // 100), mining.ceiling * whole + (mining.ceiling * rest) // 100


def _cells(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int, work, schema: str) -> DataFrame:
    """``work`` on every pair of a group of rows and a block of anchors, whose tables it gets."""
    spread = lambda n: F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("group", spread(groups)).withColumn("block", every(blocks))
    # Both sides come from one table: new columns keep them apart.
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    right = anchors.withColumn("block", spread(blocks)).withColumn("group", every(groups))
    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(work, schema)


def _found(best: Best, anchors: pa.Table, slots: int) -> pa.Table:
    place, score, row = best.settle()
    none = pa.array(best.none[row]) if len(row) else pa.array([], pa.bool_())
    return pa.table({
        "anchor": pa.array(anchors.column("row_id").to_numpy()[place // slots], pa.int64()),
        "slot": pa.array(place % slots, pa.int32()),
        "score": pa.array(score, pa.int64()),
        "key": pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(best.keys[row], pa.int64())),
    })


FOUND = "anchor bigint, slot int, score bigint, key bigint"


def _top(found: DataFrame, most: int) -> DataFrame:
    """The best rows of every anchor and slot over all tasks, numbered from 0."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < most)


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", mining: Mining = Mining()) -> DataFrame:
    """Negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the columns of ``vectors``.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    usable = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    rows = cut_lineage(
        vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & usable).select(
            F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("bigint").alias("key"),
            F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"), F.coalesce(is_anchor & F.col(key).isNotNull(), F.lit(False)).alias("anchor"),
        ),
        "vectors",
    )
    size = F.size("vector").cast("bigint")
    n, values, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("anchor"), size)), F.lit(0))).first()
    groups = max(1, -(-values // CELL_VALUES), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-asked // ANCHOR_VALUES))
    anchors, rows = rows.where("anchor").drop("anchor"), rows.drop("anchor")

    def positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        (keys, none), (own, _) = _keys(rows.column("key")), _keys(anchors.column("key"))
        of_row, of_anchor = _labels(rows.column("label"), anchors.column("label"))
        left, right = whole_vectors(rows.column("vector"), mining.scale), whole_vectors(anchors.column("vector"), mining.scale)
        best = Best(len(own), 1, mining.positives, keys, none)
        for code in np.unique(of_anchor):
            some, asked = np.flatnonzero(of_row == code), np.flatnonzero(of_anchor == code)
            step = max(1, TILE // len(asked))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                score = scores(left[part], right[asked])
                r, a = np.nonzero((score >= best.least[asked]) & ((keys[part][:, None] != own[asked]) | none[part][:, None]))
                best.add(asked[a], score[r, a], part[r])
        return _found(best, anchors, 1)

    liked = cut_lineage(_top(_cells(rows, anchors, groups, blocks, positives, FOUND), mining.positives), "positives")
    limits = liked.groupBy(F.col("anchor").alias("of")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("liked")
    )

    def negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        keys, none = _keys(rows.column("key"))
        of_row, of_anchor = _labels(rows.column("label"), anchors.column("label"))
        left, right = whole_vectors(rows.column("vector"), mining.scale), whole_vectors(anchors.column("vector"), mining.scale)
        slots = mining.positives
        # Limits in descending order, as positives are; an empty place allows nothing.
        lowest, highest = np.full((len(of_anchor), slots), HIGH), np.full((len(of_anchor), slots), LOW)
        for i, liked in enumerate(anchors.column("liked").to_pylist()):
            lowest[i, : len(liked)], highest[i, : len(liked)] = windows(np.array(liked, dtype=np.int64), mining)
        lowest = np.where(lowest > highest, HIGH, lowest)
        best = Best(len(of_anchor), slots, mining.negatives, keys, none)
        step = max(1, TILE // max(1, len(of_anchor)))
        for at in range(0, len(left), step):
            score = scores(left[at : at + step], right)
            good = (score <= highest[:, 0]) & (score >= lowest.min(axis=1)) & (of_row[at : at + step, None] != of_anchor)
            r, a = np.nonzero(good)
            value = score[r, a]
            slot = (value[:, None] <= highest[a]).sum(axis=1) - 1
            best.add(a * slots + slot, value, r + at)
        return _found(best, anchors, slots)

    asking = anchors.join(limits, F.col("row_id") == F.col("of")).drop("of")
    slotted = _top(_cells(rows, asking, groups, blocks, negatives, FOUND), mining.negatives)
    return _answers(anchors, liked, slotted, mining)


def _answers(anchors: DataFrame, liked: DataFrame, slotted: DataFrame, mining: Mining) -> DataFrame:
    """Merge the slots of every anchor upwards; the best so far, down to the window's lower end, answer its positive."""
    ordered = lambda *fields: F.array_sort(F.collect_list(F.struct(*fields)))
    wanted = liked.groupBy("anchor").agg(ordered("place", "score", "key").alias("positives"))
    offered = slotted.groupBy(F.col("anchor").alias("of")).agg(ordered("slot", "place", "score", "key").alias("offers"))
    schema = "row_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    order = lambda offer: (-offer["score"], offer["key"] is None, offer["key"] or 0)

    def merge(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                merged: list[dict] = []
                for slot in range(len(row["positives"]) - 1, -1, -1):
                    merged = sorted(merged + [o for o in row["offers"] if o["slot"] == slot], key=order)[: mining.negatives]
                    positive = row["positives"][slot]
                    low, high = windows(np.array([positive["score"]], dtype=np.int64), mining)
                    allowed = [o for o in merged if low[0] <= o["score"] <= high[0]]
                    out += [
                        {
                            "row_id": row["anchor"], "positive_id": positive["key"], "rank": i, "negative_id": o["key"],
                            "positive_score": positive["score"], "negative_score": o["score"],
                        }
                        for i, o in enumerate(allowed, 1)
                    ]
            yield pa.RecordBatch.from_pylist(out, schema=ANSWERS)

    joined = wanted.join(offered, F.col("anchor") == F.col("of")).select("anchor", "positives", "offers")
    answers = joined.mapInArrow(merge, schema)
    names = anchors.select(F.col("row_id").alias("of"), F.col("key").alias("anchor_id"))
    return answers.join(names, F.col("row_id") == F.col("of")).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


ANSWERS = pa.schema(
    [("row_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32())]
    + [(n, pa.int64()) for n in ("negative_id", "positive_score", "negative_score")]
)
