"""Containment matching between two columns of short texts without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Pieces that a task cuts and sorts, about.
PIECES = 1 << 20


def text_pieces(text: Column, lengths: Column) -> Column:
    """The distinct pieces of a text that have one of the given lengths."""
    size = F.length(text)

    def of(width):
        return F.transform(F.sequence(F.lit(1), size - width + 1), lambda i: F.substr(text, i, width))

    fitting = F.filter(lengths, lambda n: (n > 0) & (n <= size))
    return F.array_distinct(F.flatten(F.transform(fitting, of)))


def spread_pieces(haystacks: DataFrame, lengths: list[int], needle: str, hay: str, value: Column) -> DataFrame:
    """The pieces of the given lengths of every different hay text, as column ``needle``, with its least ``value`` as ``first``.

    However few files the hay texts come from, they are dealt to as many tasks as their pieces need.
    """
    texts = haystacks.groupBy(hay).agg(F.min(value).alias("first"))
    each = F.lit(lengths).cast("array<int>")
    size = F.length(hay)
    sizes = haystacks.groupBy(size.alias("__size")).agg(F.count(F.lit(1)).alias("__n"))
    number = F.aggregate(each, F.lit(0).cast("bigint"), lambda sum_, n: sum_ + F.greatest(F.lit(0), F.col("__size") - n + 1))
    total = sizes.agg(F.sum(F.col("__n") * number)).first()[0] or 0
    dealt = texts.repartitionByRange(total // PIECES + 1, hay)  # neighbours share pieces, which are combined before the shuffle
    cut = dealt.select(hay, "first", F.explode(each).alias("__n"))
    return cut.select("first", F.explode(text_pieces(F.col(hay), F.array("__n"))).alias(needle))


def first_containing(needles: DataFrame, haystacks: DataFrame, needle: str, hay: str, value: Column) -> DataFrame:
    """Per distinct needle the least ``value`` of the hay texts that contain it, as column ``first``.

    Every different hay text is cut into its pieces of the lengths that needles have, in tasks of equal size, and the least
    value per piece is combined before the shuffle. Rows grow with the hay texts alone: no pair of needle and hay is built.
    """
    own = needles.select(needle).distinct().where(F.length(needle) > 0)
    lengths = sorted(own.agg(F.collect_set(F.length(needle))).first()[0])
    pieces = spread_pieces(haystacks, lengths, needle, hay, value)
    return pieces.groupBy(needle).agg(F.min("first").alias("first")).join(own, needle, "left_semi")


def containing_pairs(needles: DataFrame, haystacks: DataFrame, keys: list[str], needle: str, hay: str) -> DataFrame:
    """Distinct (keys, needle, hay) where the hay text contains the needle.

    Both sides are made distinct, and hay texts of keys without a needle are dropped. The pieces of a hay text
    that have the length of a needle of its keys are joined to the needles by equality, so every joined row is
    an answer.
    """
    own = needles.select(*keys, needle).distinct().where(F.length(needle) > 0)
    lengths = own.groupBy(*keys).agg(F.collect_set(F.length(needle)).alias("__lengths"))
    hays = haystacks.join(lengths, keys).select(*keys, hay, "__lengths").distinct()
    pieces = hays.select(*keys, hay, F.explode(text_pieces(F.col(hay), F.col("__lengths"))).alias(needle))
    return pieces.join(own, [*keys, needle]).select(*keys, needle, hay)
