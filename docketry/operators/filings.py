"""Filing rows: normalising, visibility, issuer mapping, de-duplication, merging and correction links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketry import vocab
from docketry.functions import instants as ts, text as tx
from docketry.operators.matching import containing_pairs
from docketry.operators.numbering import block_of, numbered


def normalize_filings(rows: DataFrame, mode: str = vocab.LIVE_MODE, source: str = "OPENDART") -> DataFrame:
    """List rows with their matched issuer columns as filing events.

    Input: rcept_no, report_nm, corp_code, corp_cls, rcept_dt, stock_code, ticker, detected_at. The mode tag
    keeps live rows and backfilled rows apart, so it must be one of the two.
    """
    if mode not in vocab.SOURCE_MODES:
        raise ValueError(f"no source mode: {mode}")

    def or_word(name, word):
        return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(word)).alias(name)

    receipt = F.trim(F.coalesce("rcept_no", F.lit("")))
    report = F.trim(F.coalesce("report_nm", F.lit("")))
    return rows.select(
        F.lit(source).alias("source"),
        F.lit(mode).alias("source_mode"),
        or_word("corp_code", vocab.NOT_AVAILABLE),
        or_word("stock_code", vocab.NOT_AVAILABLE),
        or_word("ticker", vocab.UNKNOWN_MAPPING),
        receipt.alias("rcept_no"),
        report.alias("report_name"),
        or_word("corp_cls", vocab.NOT_AVAILABLE),
        or_word("rcept_dt", vocab.NOT_AVAILABLE),
        F.col("detected_at"),
        tx.is_ingest_correction(report).alias("is_correction"),
        F.lit(vocab.NOT_AVAILABLE).alias("corrects_rcept_no"),
        F.when(receipt != "", tx.viewer_url(receipt)).otherwise(vocab.NOT_AVAILABLE).alias("raw_source_reference"),
    )


def visible_at(events: DataFrame, detected_text: str, at_text: Column | str) -> DataFrame:
    """Events detected at or before an instant. Text that cannot be read is not visible."""
    return events.where(ts.instant_le(detected_text, at_text))


def reconcile_rows(rows: DataFrame) -> DataFrame:
    """Admissibility of listed rows of one issuer: unusable rows are labelled and kept for counting."""
    foreign = F.coalesce((F.trim("stock_code") != "") & (F.trim("stock_code") != F.col("ticker")), F.lit(False))
    unusable = (
        (F.coalesce("rcept_no", F.lit("")) == "")
        | (F.coalesce("report_nm", F.lit("")) == "")
        | foreign
    )
    return rows.withColumn("row_state", F.when(unusable, "UNINTERPRETED").otherwise("KEPT"))


def map_issuers(universe: DataFrame, registry: DataFrame) -> DataFrame:
    """Universe companies with their registry issuer by exact six-digit code.

    No hit is UNKNOWN, several hits are AMBIGUOUS; names never match. The registry is combined per code
    before the join, so a code with very many rows costs one row there.
    """
    per_code = (
        registry.withColumn("stock_code", F.trim("stock_code"))
        .where(F.col("stock_code").rlike(r"^\d{6}$"))
        .groupBy("stock_code")
        .agg(
            F.count("*").alias("candidate_count"),
            F.min(F.struct("corp_code", "corp_name")).alias("issuer"),
        )
    )
    hits = F.coalesce("candidate_count", F.lit(0))
    one = hits == 1
    return universe.join(per_code, universe["code"] == per_code["stock_code"], "left").select(
        "code",
        "name",
        "sector",
        F.when(one, "MAPPED").when(hits > 1, "AMBIGUOUS").otherwise("UNKNOWN").alias("mapping"),
        hits.alias("candidate_count"),
        F.when(one, F.col("issuer.corp_code")).alias("corp_code"),
        F.when(one, F.col("issuer.corp_name")).alias("corp_name"),
        F.when(one, "STOCK_CODE_EXACT").alias("mapped_by"),
    )


def issuer_candidates(universe: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per candidate of every ambiguous company."""
    unclear = map_issuers(universe, registry).where("mapping = 'AMBIGUOUS'").select("code")
    rows = registry.select(F.trim("stock_code").alias("code"), "corp_code", "corp_name")
    return rows.join(unclear, "code", "left_semi")


def mapping_report(mapping: DataFrame, stored_size: Column | None = None) -> DataFrame:
    """Counts of mapped, unknown and ambiguous companies, the mapping rate, and whether the stored map is outdated.

    ``stored_size`` is the number of companies the stored map was built for; a map of another size has to be
    built anew. Without a stored map it is null and nothing counts as changed.
    """
    stored = F.lit(None).cast("bigint") if stored_size is None else stored_size

    def count(state):
        return F.count_if(F.col("mapping") == state)

    return mapping.agg(
        F.count("*").alias("universe_size"),
        count("MAPPED").alias("mapped"),
        count("UNKNOWN").alias("unknown"),
        count("AMBIGUOUS").alias("ambiguous"),
        F.round(F.coalesce(F.try_divide(count("MAPPED").cast("double"), F.count("*")), F.lit(0.0)), 4).alias("mapping_rate"),
    ).withColumn("stored_size", stored).withColumn(
        "universe_changed", F.coalesce(F.col("universe_size") != F.col("stored_size"), F.lit(False))
    )


def match_issuers(rows: DataFrame, issuers: DataFrame) -> DataFrame:
    """Rows of tracked issuers, by issuer code."""
    return rows.join(issuers, "corp_code", "inner")


def match_counts(rows: DataFrame, issuers: DataFrame) -> DataFrame:
    """Detected, matched and unmatched rows. Rows are combined per issuer before they meet the issuer list."""
    per_issuer = rows.groupBy("corp_code").agg(F.count("*").alias("n"))
    seen = issuers.select("corp_code", F.lit(True).alias("tracked"))
    joined = per_issuer.join(seen, "corp_code", "left")
    return joined.agg(
        F.sum("n").alias("detected"),
        F.coalesce(F.sum(F.when(F.col("tracked"), F.col("n"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("tracked").isNull(), F.col("n"))), F.lit(0)).alias("unmatched"),
    )


def drop_acknowledged(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Rows still to process. Only acknowledged receipts are skipped; an empty receipt is never new."""
    done = states.where(F.col("state") == vocab.ACKNOWLEDGED).select("rcept_no")
    return rows.where(F.coalesce("rcept_no", F.lit("")) != "").join(done, "rcept_no", "left_anti")


def merge_filings(*sources: DataFrame) -> DataFrame:
    """One row per (code, receipt) over several sources, earlier sources first.

    The first row's fields win; ``sources`` lists the source names in order of first appearance. Each input
    has code, rcept_no, title, received_on, source. One aggregation with map-side combine: its state per receipt
    is one row and a set no larger than the number of sources, so copies collapse before the shuffle.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [df.withColumn("priority", F.lit(i)) for i, df in enumerate(sources)],
    )
    return (
        tagged.groupBy("code", "rcept_no")
        .agg(
            F.min(F.struct("priority", "received_on", "title")).alias("row"),
            F.array_sort(F.collect_set(F.struct("priority", "source"))).alias("ordered"),
        )
        .select(
            "code",
            "rcept_no",
            F.col("row.title").alias("title"),
            F.col("row.received_on").alias("received_on"),
            F.array_distinct(F.transform("ordered", lambda s: s["source"])).alias("sources"),
        )
    )


def priority_merge(*sources: DataFrame) -> DataFrame:
    """One row per receipt; the earliest source that has it wins. Inputs share one schema with rcept_no."""
    tagged = reduce(
        DataFrame.unionByName,
        [df.withColumn("__priority", F.lit(i)) for i, df in enumerate(sources)],
    )
    fields = [c for c in sources[0].columns if c != "rcept_no"]
    return (
        tagged.groupBy("rcept_no")
        .agg(F.min(F.struct("__priority", *fields)).alias("row"))
        .select("rcept_no", *[F.col(f"row.{c}").alias(c) for c in fields])
    )


def recent_source(items: DataFrame) -> DataFrame:
    """Recent-list rows usable as first source: only six-digit codes."""
    return items.where(F.col("code").rlike(r"^\d{6}$"))


# ── correction links ────────────────────────────────────────────────────────────────────────────


def _best(values: Column, keep: int) -> Column:
    return F.slice(F.array_distinct(F.sort_array(values, asc=False)), 1, keep)


def earlier_best(items: DataFrame, keys: list[str], keep: int, block: int = 1 << 10) -> DataFrame:
    """For every asking item, the ``keep`` greatest values of the items before it in its group.

    ``items`` has the keys, ``idx`` (order; null for what comes before all), ``own`` (array of values) and ``asks``; at
    one ``idx`` asking items come first. Items are cut into blocks of ``block`` consecutive ones of their group, however their order numbers are spread; a block folds a
    bounded array and hands only its best values upwards, over as many levels as the largest group needs. So no task
    ever holds more than a block of a group at once.
    """
    rows = numbered(items.withColumn("turn", (~F.col("asks")).cast("int")), keys, ["idx", "turn"])
    last, levels = rows.agg(F.max("place")).first()[0] or 0, 0
    while last >= block:
        last, levels = last // block, levels + 1
    return _earlier(rows, keys, keep, block, levels).select(*keys, "idx", "before")


def _earlier(items: DataFrame, keys: list[str], keep: int, block: int, levels: int) -> DataFrame:
    """``earlier_best`` for items with a dense ``place``; without levels a group is one block."""
    kind = dict(items.dtypes)["own"]
    part = block_of("place", block) if levels else F.lit(0).cast("bigint")
    blocks = (
        items.groupBy(*keys, part.alias("part"))
        .agg(
            F.array_sort(F.collect_list(F.struct("place", "idx", "own", "asks"))).alias("rows"),
            F.max("asks").alias("asks"),
        )
    )
    empty = F.array().cast(kind)
    asking = blocks.where("asks")
    if levels:
        own = _best(F.flatten(F.transform("rows", lambda r: r["own"])), keep)
        upper = _earlier(
            blocks.select(*keys, F.col("part").alias("place"), F.col("part").alias("idx"), own.alias("own"), "asks"), keys, keep, block, levels - 1
        ).select(*keys, F.col("idx").alias("part"), "before")
        asking = asking.join(upper, [*keys, "part"], "left")
    else:
        asking = asking.withColumn("before", empty)
    start = F.struct(
        F.coalesce(F.col("before"), empty).alias("top"),
        F.array().cast(f"array<struct<idx:bigint,before:{kind}>>").alias("out"),
    )

    def step(acc, r):
        entry = F.struct(r["idx"].alias("idx"), acc["top"].alias("before"))
        out = F.when(r["asks"], F.array_append(acc["out"], entry)).otherwise(acc["out"])
        top = F.when(F.size(r["own"]) > 0, _best(F.concat(acc["top"], r["own"]), keep)).otherwise(acc["top"])
        return F.struct(top.alias("top"), out.alias("out"))

    return (
        asking.select(*keys, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("o"))
        .select(*keys, "o.idx", "o.before")
    )


def title_state(filings: DataFrame, keep: int = 5) -> DataFrame:
    """What later corrections need to know of filings: the greatest receipts per (ticker, title).

    The rank limit is applied before the shuffle, so a title filed very often stays a handful of rows.
    """
    rank = F.row_number().over(W.partitionBy("ticker", "report_name").orderBy(F.desc("rcept_no")))
    top = filings.select("ticker", "report_name", "rcept_no").withColumn("rank", rank).where(F.col("rank") <= keep + 1)
    return top.groupBy("ticker", "report_name").agg(F.collect_list("rcept_no").alias("receipts"))


def link_corrections(events: DataFrame, state: DataFrame | None = None, keep: int = 5, block: int = 1 << 10) -> DataFrame:
    """Link corrections to the one earlier filing they can refer to.

    Input: ticker, rcept_no, report_name, is_correction, seq (unique processing order). A candidate is an
    earlier filing of the same ticker whose title contains the correction's title without its mark. One
    candidate links, several are listed (the last ``keep`` by receipt) and flagged, none leaves it alone.
    ``state`` stands for all filings processed before (see ``title_state``; several rows per title are fine).
    """
    base = F.trim(F.regexp_replace("report_name", vocab.INGEST_CORRECTION, ""))
    corrections = events.where("is_correction").withColumn("base", base).where("base <> ''")
    known = events.select("ticker", "report_name", F.col("seq").alias("idx"), F.array("rcept_no").alias("own"))
    if state is not None:
        before_all = F.lit(None).cast("bigint").alias("idx")
        known = known.unionByName(state.select("ticker", "report_name", before_all, F.col("receipts").alias("own")))
    pairs = containing_pairs(corrections, known, ["ticker"], "base", "report_name")
    candidates = known.join(pairs, ["ticker", "report_name"]).select("ticker", "base", "idx", "own", F.lit(False).alias("asks"))
    asking = corrections.select(
        "ticker", "base", F.col("seq").alias("idx"), F.array().cast("array<string>").alias("own"), F.lit(True).alias("asks")
    )
    found = earlier_best(candidates.unionByName(asking), ["ticker", "base"], keep + 1, block).select(
        "ticker", F.col("idx").alias("seq"), "before"
    )
    others = F.array_remove(F.coalesce("before", F.array().cast("array<string>")), F.col("rcept_no"))
    count = F.size("others")
    # Only corrections can have candidates, so only they are joined.
    marked = F.coalesce("is_correction", F.lit(False))
    annotated = events.where(marked).join(found, ["ticker", "seq"], "left").unionByName(
        events.where(~marked).withColumn("before", F.lit(None).cast("array<string>"))
    )
    return (
        annotated
        .withColumn("others", others)
        .withColumn(
            "corrects_rcept_no", F.when(count == 1, F.get("others", F.lit(0))).otherwise(vocab.NOT_AVAILABLE)
        )
        .withColumn(
            "correction_candidates",
            F.when(count > 1, F.sort_array(F.slice("others", 1, keep))),
        )
        .withColumn(
            "correction_link_basis",
            F.when(count == 1, "SAME_TICKER_SAME_REPORT_NAME").when(count > 1, "AMBIGUOUS_NOT_LINKED"),
        )
        .drop("before", "others")
    )


# ── as-of visibility ────────────────────────────────────────────────────────────────────────────


def visible_as_of(asks: DataFrame, events: DataFrame, block: int = 1 << 17) -> DataFrame:
    """For each ask (ticker, ask_id, at): how many events were detected by then, and the latest of them.

    Events and asks are first combined per (ticker, instant), so any number of rows at one instant is one row.
    The instants of a ticker are cut into blocks of ``block`` consecutive ones, however close together they lie; rows
    are ordered only inside a block, and running totals over blocks are small rows. A ticker with a very large share
    of the rows, or one busy minute, is therefore spread over many blocks, and no pair of ask and event is ever built.
    """
    detected = events.where("detected_at IS NOT NULL").groupBy("ticker", F.col("detected_at").alias("at")).agg(
        F.count("*").alias("n"), F.max("rcept_no").alias("rcept_no")
    )
    asked = asks.select("ticker", "at").distinct()
    marks = detected.withColumn("turn", F.lit(0)).unionByName(
        asked.select("ticker", "at", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("rcept_no"), F.lit(1).alias("turn"))
    )
    marks = numbered(marks, ["ticker"], ["at", "turn"]).withColumn("bucket", block_of("place", block))
    latest = F.max(F.when(F.col("turn") == 0, F.struct("at", "rcept_no")))
    totals = marks.groupBy("ticker", "bucket").agg(F.sum("n").alias("n"), latest.alias("last"))
    before = W.partitionBy("ticker").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        "ticker", "bucket", F.sum("n").over(before).alias("n_before"), F.max("last").over(before).alias("last_before")
    )
    inside = W.partitionBy("ticker", "bucket").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    answers = (
        marks.withColumn("n_inside", F.sum("n").over(inside))
        .withColumn("last_inside", latest.over(inside))
        .where("turn = 1")
        .join(carried, ["ticker", "bucket"], "left")
        .select(
            "ticker",
            "at",
            (F.coalesce("n_before", F.lit(0)) + F.col("n_inside")).alias("visible"),
            F.coalesce("last_inside", "last_before")["rcept_no"].alias("latest_rcept_no"),
        )
    )
    return asks.join(answers, ["ticker", "at"], "left").withColumn("visible", F.coalesce("visible", F.lit(0)))
