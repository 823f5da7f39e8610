"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Every text has ``TREES`` signatures of up to ``DEPTH`` MinHash values over its distinct five-word shingles. Texts that
share a prefix in some tree are candidates. Prefixes are shortened from full depth until the recall at the
similarity threshold, ``1 - (1 - s ** d) ** trees``, meets the target; a match at a longer prefix is one at the shorter.

Equal texts are one node from the start. Buckets of a few nodes give pairs, which are verified by joining the
shingles of both sides. Larger buckets are cut into blocks by hash, and each pair of blocks is one task that compares
its nodes by matrix products and returns sums: links per node and a spanning forest, never pairs. A pair that
meets in several buckets counts in the first large one, or once as a pair if it meets in small ones only.

Links, classes and counts are exact for all candidates; nothing is capped. Classes are connected components.

Edge cases: a text without words, or null, has no shingles and only its exact copies are linked to it (null and empty
are one text); fewer than five words are one shingle; null and repeated ids are rows like others, a class takes its
smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import bound_batches, mix64, text_slices
from docketry.session import cut_lineage


@dataclass(frozen=True)
class Forest:
    threshold: float = 0.8
    recall: float = 0.999
    trees: int = 24
    depth: int = 8
    words: int = 5
    #: Buckets up to this many nodes are joined as pairs; larger ones are compared in blocks of about ``block`` nodes.
    small: int = 24
    block: int = 512

    def prefix(self) -> int:
        """The longest prefix that meets the target recall."""
        for d in range(self.depth, 1, -1):
            if 1 - (1 - self.threshold**d) ** self.trees >= self.recall:
                return d
        return 1


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Distinct hashes of the runs of ``words`` words, sorted."""
    import xxhash

    own = text.encode("utf-8", "surrogatepass").split()
    if not own:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    width = min(words, len(own))
    with np.errstate(over="ignore"):
        value = np.zeros(len(own) - width + 1, np.uint64)
        for i in range(width):
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(value)])
    return np.unique(value)


def labels(sets: list[np.ndarray], forest: Forest) -> np.ndarray:
    """For each shingle set and tree, a number that stands for the tree and its prefix; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    prefix = forest.prefix()
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 1 << 63, size=(forest.trees, forest.depth), dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(sets), forest.trees), np.uint64)
    with np.errstate(over="ignore"):
        for tree in range(forest.trees):
            value = np.full(len(sets), np.uint64(tree + 1))
            for level in range(prefix):
                least = np.minimum.reduceat((flat * factors[tree, level]) >> np.uint64(24), starts)
                value = mix64(value * np.uint64(31) + least)
            out[:, tree] = value
    return out.view(np.int64)


def signatures(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, text_digest, n (shingles) and labels of every document."""
    bound_batches(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 2, 2 << 20):
                sets = [shingles(t, forest.words) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                lists = [[]] * len(texts)
                if full:
                    for i, row in zip(full, labels([sets[i] for i in full], forest).tolist(), strict=True):
                        lists[i] = row
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "text_digest", "n", "labels"],
                )

    return digested(docs).mapInArrow(sign, "doc_id bigint, text_digest string, n int, labels array<bigint>")


def digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("doc_id"), F.md5(text.cast("binary")).alias("text_digest"), text.alias("text"))


def compare_block(tree_labels: np.ndarray, label: int, sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, threshold: float, both: bool):
    """Links of the nodes of a block pair: the copies linked to each node, and the first node of its component.

    ``tree_labels`` has each node's large buckets by tree (0 where it has none); a pair counts only in the
    bucket of the first tree that both share. ``side`` tells the block; with ``both``, only pairs across count.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), sizes)
    useful = times[inverse] > 1
    rows, cols = rows[useful], (np.cumsum(times > 1) - 1)[inverse[useful]]
    shared, width = np.zeros((n, n), np.float32), 4096
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for low in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        a, b = np.searchsorted(cols, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[rows[a:b], cols[a:b] - low] = 1
        shared += part @ part.T
    linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-4
    np.fill_diagonal(linked, False)
    if both:
        linked &= side[:, None] != side[None, :]
    for tree in range(tree_labels.shape[1]):
        own = tree_labels[:, tree]
        if (own == label).all():
            break
        linked &= ~((own[:, None] == own[None, :]) & (own[:, None] != 0))
    links = linked @ copies.astype(np.float64)
    root = np.arange(n)
    for start in range(n):
        if root[start] != start:
            continue
        todo = [start]
        while todo:
            fresh = np.flatnonzero(linked[todo].any(axis=0) & (root == np.arange(n)) & (np.arange(n) > start))
            root[fresh] = start
            todo = fresh.tolist()
    return links.astype(np.int64), root


def components(edges: DataFrame) -> DataFrame:
    """key and root (smallest key) of every connected component of ``edges`` (a, b)."""
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "forest-edges")
    roots = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("root")), "forest-roots")
    while True:
        near = both.join(roots.select(F.col("key").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = cut_lineage(
            roots.join(near, roots["key"] == near["a"]).select("key", F.col("root").alias("was"), F.least("root", "near").alias("root")), "forest-hooks"
        )
        # Follow the root's own root, which halves long chains.
        up = hooked.select(F.col("key").alias("mid"), F.col("root").alias("upper"))
        jumped = hooked.join(up, hooked["root"] == up["mid"], "left").select("key", "was", F.least("root", F.coalesce("upper", "root")).alias("root"))
        step = cut_lineage(jumped, "forest-roots")
        if step.where("root <> was").limit(1).count() == 0:
            return step.select("key", "root")
        roots = step.select("key", "root")


def near_classes(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per document: doc_id, text_digest, root (digest that names its class), class_id (smallest id) and n_links."""
    rows = cut_lineage(signatures(docs, forest), "forest-rows")
    nodes = cut_lineage(
        rows.groupBy("text_digest", "n", "labels").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "forest-nodes"
    )
    placed = nodes.select("text_digest", "n", F.explode("labels").alias("label"))
    sizes = placed.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut_lineage(placed.join(sizes, "label"), "forest-members")
    large = members.where(F.col("size") > forest.small).groupBy("text_digest").agg(F.collect_set("label").alias("big"))  # at most one a tree
    wanted = members.select("text_digest").distinct()
    chosen = (
        nodes.join(wanted, "text_digest")
        .join(large, "text_digest", "left")
        .select(
            "text_digest",
            "first_id",
            "copies",
            F.expr("transform(labels, x -> if(array_contains(coalesce(big, array()), x), x, 0L))").alias("big"),
        )
    )
    texts = digested(docs)
    source = texts.join(
        chosen, (texts["text_digest"] == chosen["text_digest"]) & texts["doc_id"].eqNullSafe(chosen["first_id"])
    ).select(chosen["text_digest"].alias("key"), "copies", "big", "text")

    def cut(batches):
        for batch in batches:
            for part, own in text_slices(batch, 3):
                sets = pa.array([shingles(t, forest.words).view(np.int64) for t in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), sets], names=["key", "copies", "big", "shingles"])

    sets = cut_lineage(source.mapInArrow(cut, "key string, copies bigint, big array<bigint>, shingles array<bigint>"), "forest-sets")
    # Small buckets: pairs.
    left = members.where(F.col("size") <= forest.small).select("label", F.col("text_digest").alias("a"), F.col("n").alias("na"))
    right = left.select("label", F.col("a").alias("b"), F.col("na").alias("nb"))
    near = (F.col("na") >= forest.threshold * F.col("nb")) & (F.col("nb") >= forest.threshold * F.col("na"))
    pairs = left.join(right, "label").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    of_a = sets.select(F.col("key").alias("a"), F.col("copies").alias("ca"), F.col("big").alias("la"), F.col("shingles").alias("sa"))
    of_b = sets.select(F.col("key").alias("b"), F.col("copies").alias("cb"), F.col("big").alias("lb"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    apart = ~F.exists(F.zip_with("la", "lb", lambda x, y: (x == y) & (x != 0)), lambda x: x)
    links = cut_lineage(
        pairs.join(of_a, "a")
        .join(of_b, "b")
        .where(apart & (shared >= forest.threshold * (F.size("sa") + F.size("sb") - shared) - 1e-6))
        .select("a", "b", "ca", "cb")
        .distinct(),
        "forest-links",
    )
    # Large buckets: pairs of blocks.
    blocks = F.ceil(F.col("size") / forest.block).cast("int")
    mine = F.pmod(F.xxhash64("text_digest"), F.col("blocks")).cast("int")
    dealt = (
        members.where(F.col("size") > forest.small)
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "text_digest", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
        .join(sets.dropDuplicates(["key"]), F.col("text_digest") == F.col("key"))
        .drop("text_digest")
    )
    threshold = forest.threshold

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        own = [np.asarray(s, np.int64) for s in part["shingles"]]
        found, root = compare_block(
            np.stack(part["big"].to_numpy()).astype(np.int64), int(part["label"].iloc[0]), own, part["mine"].to_numpy(), part["copies"].to_numpy(),
            threshold, int(part["low"].iloc[0]) != int(part["high"].iloc[0]),
        )
        keys = part["key"].to_numpy()
        return pd.DataFrame({"key": keys, "root": keys[root], "links": found})

    sums = cut_lineage(
        dealt.groupBy("label", "low", "high").applyInPandas(compare, "key string, root string, links bigint").where("links > 0"), "forest-sums"
    )
    edges = links.select("a", "b").union(sums.where("key <> root").select(F.col("root").alias("a"), F.col("key").alias("b")))
    counted = (
        links.select(F.col("a").alias("key"), F.col("cb").alias("links"))
        .union(links.select(F.col("b").alias("key"), F.col("ca").alias("links")))
        .union(sums.select("key", "links"))
        .groupBy("key")
        .agg(F.sum("links").alias("links"))
    )
    roots = components(edges)
    named = (
        nodes.select(F.col("text_digest").alias("key"), "first_id", "copies")
        .join(roots, "key", "left")
        .join(counted, "key", "left")
        .select("key", "first_id", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    named = cut_lineage(named, "forest-named")
    classes = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    info = named.join(classes, "root").select("key", "root", "class_id", "n_links")
    return rows.join(info, rows["text_digest"] == info["key"]).select("doc_id", "text_digest", "root", "class_id", "n_links")


def keep_one(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row of ``docs``, with all its columns, for each class: that of the smallest id (then digest) in it."""
    found = cut_lineage(near_classes(docs, forest), "forest-classes")
    first = found.groupBy("root", "class_id", "doc_id", "text_digest").agg(F.count(F.lit(1)).alias("rows"))
    # The smallest id of a class is null only where all its ids are.
    kept = first.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("text_digest", "doc_id", "rows")).alias("k"))
    chosen = kept.select(F.struct(F.col("k.text_digest").alias("digest"), F.col("k.doc_id").alias("id"), F.col("k.rows").alias("rows")).alias("_forest"))
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.join(chosen, (digest == F.col("_forest.digest")) & F.col("doc_id").eqNullSafe(F.col("_forest.id")))
    once = rows.where(F.col("_forest.rows") == 1).select(*names)
    again = rows.where(F.col("_forest.rows") > 1).withColumn("_forest_digest", digest).dropDuplicates(["_forest_digest"]).select(*names)
    return once.unionByName(again)
