"""Weekly digests, glossary usage, company summaries, recommendations, feeds and page addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketry import vocab
from docketry.functions import instants as ts
from docketry.operators.classify import literal_rows
from docketry.operators.matching import first_containing
from docketry.operators.numbering import block_of, numbered


def _ranked(df: DataFrame, keys: list[str], keep: int, *order) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= keep)


def keyed_weeks(filings: DataFrame, entry_key: Column, catch_all: str = vocab.CATCH_ALL_ENTRY) -> DataFrame:
    """Filings with their week and glossary entry; no entry becomes the catch-all."""
    return filings.withColumn("week", ts.monday_of("received_on")).withColumn(
        "entry_key", F.coalesce(entry_key, F.lit(catch_all))
    )


def weekly_summary(keyed: DataFrame) -> DataFrame:
    """Rows, distinct companies and last date per week; companies are combined before weeks are."""
    per_company = keyed.groupBy("week", "code").agg(F.count("*").alias("n"), F.max("received_on").alias("last"))
    return per_company.groupBy("week").agg(
        F.sum("n").alias("filings"), F.count("*").alias("companies"), F.max("last").alias("last_date")
    )


def weekly_types(keyed: DataFrame, keep: int = 8, catch_all: str = vocab.CATCH_ALL_ENTRY) -> DataFrame:
    counts = keyed.where(F.col("entry_key") != catch_all).groupBy("week", "entry_key").agg(F.count("*").alias("n"))
    return _ranked(counts, ["week"], keep, F.desc("n"), "entry_key")


def weekly_busiest(keyed: DataFrame, keep: int = 5) -> DataFrame:
    counts = keyed.groupBy("week", "code").agg(F.count("*").alias("n"))
    return _ranked(counts, ["week"], keep, F.desc("n"), "code")


def weekly_themes(keyed: DataFrame, themes: dict[str, tuple[str, ...]] = vocab.WEEKLY_THEMES, keep: int = 12) -> DataFrame:
    """Newest rows per (week, theme) and how many more there are.

    Totals come from a combined count, rows from a rank limit applied before the shuffle, so a crowded theme
    is never gathered.
    """
    table = literal_rows(
        [{"theme": theme, "key": key} for theme, keys in themes.items() for key in keys], "theme string, key string"
    )
    mine = F.transform(F.filter(table, lambda r: r["key"] == F.col("entry_key")), lambda r: r["theme"])
    rows = keyed.withColumn("theme", F.explode(mine))
    totals = rows.groupBy("week", "theme").agg(F.count("*").alias("total"))
    newest = _ranked(rows, ["week", "theme"], keep, F.desc("received_on"), F.desc("rcept_no"))
    return newest.join(totals, ["week", "theme"]).withColumn("more", F.greatest(F.lit(0), F.col("total") - keep))


def week_neighbours(keyed: DataFrame) -> DataFrame:
    """Previous and next week that has data. Weeks are combined first: one row per calendar week remains."""
    weeks = keyed.select("week").distinct()
    w = W.orderBy("week")
    return weeks.select("week", F.lag("week").over(w).alias("previous_week"), F.lead("week").over(w).alias("next_week"))


def glossary_usage(filings: DataFrame, names: DataFrame, keep: int = 8) -> DataFrame:
    """Count per entry over all filings and the newest examples of tracked companies."""
    used = filings.where("entry_key IS NOT NULL")
    counts = used.groupBy("entry_key").agg(F.count("*").alias("n"))
    tracked = used.join(names.select("code", "name"), "code")
    examples = _ranked(tracked, ["entry_key"], keep, F.desc("received_on"), F.desc("rcept_no"))
    return counts.join(examples.select("entry_key", "rank", "code", "name", "rcept_no"), "entry_key", "left")


def company_entries(filings: DataFrame, keep: int = 8, catch_all: str = vocab.CATCH_ALL_ENTRY) -> DataFrame:
    """Distinct glossary entries of a company in order of its newest filing, without the catch-all."""
    met = filings.where((F.col("entry_key") != catch_all)).groupBy("code", "entry_key").agg(
        F.max(F.struct("received_on", "rcept_no")).alias("newest")
    )
    return _ranked(met, ["code"], keep, F.desc("newest")).select("code", "entry_key", "rank")


def company_categories(filings: DataFrame, timelines: DataFrame, chain_category: dict[str, str], keep: int = 6) -> DataFrame:
    """Up to ``keep`` distinct categories per company: by filing count, then those of its event chains."""
    counted = filings.groupBy("code", "category").agg(F.count("*").alias("n"))
    own = counted.select("code", "category", F.lit(0).alias("tier"), (-F.col("n")).alias("weight"), F.col("category").alias("name"))
    table = F.create_map(*[F.lit(x) for pair in chain_category.items() for x in pair])
    chained = timelines.select("code", table[F.col("chain")].alias("category"), F.lit(1).alias("tier"), "latest_received_on", "chain_ord").where(
        "category IS NOT NULL"
    )
    days = -F.unix_date("latest_received_on").cast("bigint")
    chained = chained.select("code", "category", "tier", days.alias("weight"), F.format_string("%06d", "chain_ord").alias("name"))
    first = own.unionByName(chained).groupBy("code", "category").agg(F.min(F.struct("tier", "weight", "name")).alias("at"))
    return _ranked(first, ["code"], keep, "at").select("code", "category", "rank")


def company_summary(
    companies: DataFrame, headers: DataFrame, change_lines: DataFrame, financial: DataFrame, timelines: DataFrame, categories: DataFrame
) -> DataFrame:
    """One row per company from products that are already one or a few rows per company.

    ``financial`` has fs_div, from_year, to_year and key_changes (see ``latest_pair_changes``).
    ``change_lines`` keeps its first two lines, ``timelines`` its two newest (chain, date and stage label), categories
    their order. A company
    without financial rows has the state NOT_COLLECTED instead of numbers.
    """
    lines = _ranked(change_lines, ["code"], 2, "position").groupBy("code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("lines")
    )
    newest = F.row_number().over(W.partitionBy("code").orderBy(F.desc("latest_received_on"), "chain_ord"))
    line = F.struct("rank", "chain", "latest_received_on", F.col("latest_stage_label").alias("stage_label"))
    chains = timelines.withColumn("rank", newest).groupBy("code").agg(
        F.count("*").alias("timeline_count"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 2, line))).alias("newest_timelines")
    ).withColumn("newest_timelines", F.transform("newest_timelines", lambda x: x.dropFields("rank")))
    cats = categories.groupBy("code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"]).alias("categories")
    )
    out = companies.select("code", "name")
    for part in (headers, lines, financial, chains, cats):
        out = out.join(part, "code", "left")
    return out.withColumn(
        "financial_state", F.when(F.col("fs_div").isNotNull(), vocab.OK).otherwise(vocab.NOT_COLLECTED)
    )


def recommended_lessons(
    categories: DataFrame, lessons: dict[str, tuple[int, ...]] = vocab.LESSONS_BY_CATEGORY, basics: tuple[int, ...] = vocab.BASIC_LESSONS, keep: int = 3
) -> DataFrame:
    """Lessons per company in the order of its ranked categories, without repeats, topped up by the basics."""
    table = literal_rows(
        [{"category": c, "at": i, "lesson": x} for c, ids in lessons.items() for i, x in enumerate(ids)],
        "category string, at int, lesson int",
    )
    basic = F.lit(list(basics)).cast("array<int>")
    # A company has at most a handful of ranked categories, so its list is a bounded array.
    per_company = categories.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("rank", "category"))).alias("cats"))
    picked = F.flatten(
        F.transform(
            "cats",
            lambda c: F.transform(F.filter(table, lambda r: r["category"] == c["category"]), lambda r: r["lesson"]),
        )
    )
    chosen = F.slice(F.array_distinct(F.concat(picked, basic)), 1, keep)
    return per_company.select("code", F.posexplode(chosen).alias("place", "lesson"))


# ── names, related items, feeds, addresses ──────────────────────────────────────────────────────


def resolve_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Code per query text: six digits as given, else the exact name, else the first name that contains the
    text, else the text itself. "First" is by ``ord`` of the name table.

    Only texts without an exact name are looked for inside names, and a piece that very many names share costs
    one row.
    """
    q = queries.withColumn("text", F.trim("query")).withColumn("is_code", F.col("text").rlike(r"^\d{6}$"))
    asked = q.where((~F.col("is_code")) & (F.col("text") != "")).select("text").distinct()
    exact = names.join(asked, F.col("name") == F.col("text")).groupBy("text").agg(F.min(F.struct("ord", "code")).alias("exact"))
    unknown = asked.join(exact, "text", "left_anti")
    partial = first_containing(unknown, names, "text", "name", F.struct("ord", "code")).withColumnRenamed("first", "partial")
    return (
        q.join(exact, "text", "left")
        .join(partial, "text", "left")
        .select(
            "query",
            F.when(F.col("is_code"), F.col("text")).otherwise(F.coalesce("exact.code", "partial.code", "text")).alias("code"),
        )
    )


def changed_addresses(new: DataFrame, live: DataFrame, host: str) -> DataFrame:
    """Addresses of the own host that are new or whose modification date differs."""
    old = live.select("loc", F.col("lastmod").alias("live_lastmod"), F.lit(True).alias("known"))
    mine = new.where(F.col("loc").startswith(f"https://{host}/"))
    return (
        mine.join(old, "loc", "left")
        .where(F.col("known").isNull() | ~F.col("lastmod").eqNullSafe(F.col("live_lastmod")))
        .select("loc", "lastmod")
    )


def merge_addresses(static: DataFrame, generated: DataFrame) -> DataFrame:
    """All addresses once; a static address keeps its own modification date."""
    rows = static.withColumn("tier", F.lit(0)).unionByName(generated.withColumn("tier", F.lit(1)))
    return rows.groupBy("loc").agg(F.min_by("lastmod", F.struct("tier", F.coalesce("lastmod", F.lit("")))).alias("lastmod"))


def thin_companies(companies: DataFrame, filings: DataFrame, financial: DataFrame, timelines: DataFrame) -> DataFrame:
    """Companies with no filing, no financial row and no timeline."""
    out = companies.select("code")
    for part in (filings, financial, timelines):
        out = out.join(part.select("code"), "code", "left_anti")
    return out


def related_items(items: DataFrame, count: int = 3, block: int = 1 << 17) -> DataFrame:
    """Related items per item: same category by id distance, then the newest others.

    Input: id (unique bigint), category, date, and optionally ord, the input order that decides between equal
    distances (by default the smaller id). The nearest ids are among the neighbours in id order, so only
    ``count`` rows on each side are looked at. A category is cut into blocks of ``block`` consecutive items, whatever
    their ids are, and the first and last ``count`` items of a block are copied to its neighbour: a category of any
    size is spread over tasks of equal size. The rest comes from the overall newest rows: a category that needs
    topping up has at most ``count`` items, so twice that many rows suffice.
    """
    ord_ = F.col("ord") if "ord" in items.columns else F.col("id")
    rows = numbered(items.select("id", "category", ord_.cast("bigint").alias("ord")), ["category"], ["id"])
    own, inner = block_of("place", block), F.col("place") % block
    copies = F.array_compact(F.array(
        F.struct(own.alias("block"), F.lit(True).alias("own")),
        F.when((inner < count) & (own > 0), F.struct((own - 1).alias("block"), F.lit(False).alias("own"))),
        F.when(inner >= block - count, F.struct((own + 1).alias("block"), F.lit(False).alias("own"))),
    ))
    local = rows.select("id", "category", "ord", F.inline(copies))
    me = F.struct("id", "ord")
    inside = W.partitionBy("category", "block").orderBy("id")
    near = F.array_compact(F.array(*[f(me, k).over(inside) for k in range(1, count + 1) for f in (F.lag, F.lead)]))
    newest = items.orderBy(F.desc("date"), F.desc("id")).limit(2 * count)
    top = newest.agg(F.sort_array(F.collect_list(F.struct("date", "id", "category")), asc=False).alias("top")).scalar()
    same = F.transform(
        F.array_sort(F.transform("near", lambda x: F.struct(F.abs(x["id"] - F.col("id")).alias("d"), x["ord"].alias("ord"), x["id"].alias("id")))), lambda s: s["id"]
    )
    others = F.transform(F.filter("top", lambda o: o["category"] != F.col("category")), lambda o: o["id"])
    return (
        local.withColumn("near", near)
        .where("own")
        .withColumn("same", same)
        .withColumn("top", top)
        .select("id", F.posexplode(F.slice(F.concat("same", others), 1, count)).alias("place", "related_id"))
    )


def feed(weekly: DataFrame, filings: DataFrame, study: DataFrame, days: int = 25, size: int = 60) -> DataFrame:
    """Newest entries over weekly pages, company-day filing groups and study items.

    ``weekly`` and ``study`` have day, kind, key, title. A filing group is titled by its first receipt. Inside a
    day weekly pages come first, then filings by falling code, then study items.
    """
    groups = (
        filings.groupBy("code", "received_on")
        .agg(F.min(F.struct("rcept_no", "title")).alias("first"), F.count("*").alias("n"))
        .orderBy(F.desc("received_on"), F.desc("code"))
        .limit(days)
        .select(
            F.col("received_on").alias("day"),
            F.lit("filing").alias("kind"),
            F.col("code").alias("key"),
            F.concat(F.col("first.title"), F.when(F.col("n") > 1, F.concat(F.lit(" +"), (F.col("n") - 1).cast("string"))).otherwise("")).alias("title"),
        )
    )
    parts = [df.withColumn("tier", F.lit(i)) for i, df in enumerate((weekly, groups, study))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    newest_code = F.when(F.col("tier") == 1, F.col("key"))
    return rows.orderBy(F.desc("day"), "tier", F.desc(newest_code), "key").limit(size).drop("tier")
