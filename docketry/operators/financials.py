"""Annual statements: account extraction, comparable pairs, changes, ratios and facts.

Long tables carry a nullable ``amount`` next to a non-null ``value_state``; a missing value is never zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from docketry import vocab
from docketry.functions import amounts as am, text as tx
from docketry.operators.classify import literal_rows


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A vocabulary as a local relation, so that its size is known to Catalyst when it picks a join."""
    return spark.range(1).select(F.inline(literal_rows(rows, schema)))


def target_rows(targets: dict) -> list[dict]:
    """Account targets as rows: tier, candidate, statement and both orders inside the tier."""
    rows = []
    for account, (statements, ids, names) in targets.items():
        for kind, tier, words in (("id", 1, ids), ("name", 2, [n.replace(" ", "") for n in names])):
            for j, word in enumerate(words):
                rows.append({"account": account, "kind": kind, "cand": word, "sj": None, "tier": tier + 2, "sj_ord": 0, "cand_ord": j})
                for i, sj in enumerate(statements):
                    rows.append({"account": account, "kind": kind, "cand": word, "sj": sj, "tier": tier, "sj_ord": i, "cand_ord": j})
    return rows


def extract_accounts(lines: DataFrame, targets: dict = vocab.ACCOUNT_TARGETS) -> DataFrame:
    """Best line per (code, year, account); accounts without any hit give no row.

    Identifier in the right statement beats name in the right statement beats identifier anywhere beats name
    anywhere; inside a tier statement order, then candidate order, then response order decides. A chosen line
    whose amount does not parse is missing: there is no fall-through to the next line. Lines that match no
    target leave before anything is sorted or shuffled.
    """
    table = small_table(
        lines.sparkSession,
        target_rows(targets),
        "account string, kind string, cand string, sj string, tier int, sj_ord int, cand_ord int",
    )
    name = F.regexp_replace(tx.text_or_empty("account_nm"), " ", "")
    keyed = lines.withColumn(
        "k",
        F.explode(
            F.array(
                F.struct(F.lit("id").alias("kind"), F.trim(tx.text_or_empty("account_id")).alias("cand")),
                F.struct(F.lit("name").alias("kind"), name.alias("cand")),
            )
        ),
    ).select("code", "year", "ord", "sj_div", "thstrm_amount", "k.kind", "k.cand")
    hit = (
        (keyed["kind"] == table["kind"])
        & (keyed["cand"] == table["cand"])
        & (table["sj"].isNull() | (table["sj"] == keyed["sj_div"]))
    )
    order = F.struct("tier", "sj_ord", "cand_ord", "ord", "thstrm_amount")
    best = keyed.join(table, hit).groupBy("code", "year", "account").agg(F.min(order).alias("best"))
    how = F.element_at(
        F.lit(["account_id", "account_nm", "account_id_any_sj", "account_nm_any_sj"]), F.col("best.tier")
    )
    amount = am.parse_amount(F.col("best.thstrm_amount"))
    return best.select("code", "year", "account", amount.alias("amount"), F.when(amount.isNotNull(), how).alias("matched_by"))


def account_grid(
    lines: DataFrame,
    sectors: DataFrame,
    targets: dict = vocab.ACCOUNT_TARGETS,
    sector_words=vocab.FINANCIAL_SECTOR_WORDS,
    inapplicable=vocab.SECTOR_INAPPLICABLE,
) -> DataFrame:
    """All target accounts of every (code, year): a number, not available, or not applicable in the sector.

    Which years exist is read from two columns only; the matched accounts of a year are at most one per target.
    """
    found = extract_accounts(lines, targets).groupBy("code", "year").agg(
        F.collect_list(F.struct("account", "amount", "matched_by")).alias("found")
    )
    years = lines.select("code", "year").distinct().join(found, ["code", "year"], "left").join(sectors, "code", "left")
    spread = years.withColumn("account", F.explode(F.lit(list(targets))))
    row = F.get(F.filter("found", lambda r: r["account"] == F.col("account")), F.lit(0))
    outside = tx.contains_any("sector", sector_words) & F.col("account").isin(*inapplicable)
    return spread.withColumn("r", row).select(
        "code",
        "year",
        "account",
        F.col("r.amount").alias("amount"),
        F.col("r.matched_by").alias("matched_by"),
        F.when(F.col("r.amount").isNotNull(), vocab.NUMBER)
        .when(F.col("r").isNull() & outside, vocab.NOT_APPLICABLE_FINANCIAL_SECTOR)
        .otherwise(vocab.NOT_AVAILABLE)
        .alias("value_state"),
    )


def statement_coverage(grid: DataFrame) -> DataFrame:
    """Found over applicable accounts per (code, year); not applicable leaves the denominator."""
    found = F.count_if(F.col("value_state") == vocab.NUMBER)
    applicable = F.count_if(F.col("value_state") != vocab.NOT_APPLICABLE_FINANCIAL_SECTOR)
    return grid.groupBy("code", "year").agg(
        found.alias("found"),
        applicable.alias("applicable"),
        F.round(F.coalesce(F.try_divide(found.cast("double"), applicable), F.lit(0.0)), 4).alias("coverage"),
    )


def year_grid(companies: DataFrame, years) -> DataFrame:
    return companies.withColumn("year", F.explode(F.lit(list(years))))


def choose_basis(companies: DataFrame, available: DataFrame, years) -> DataFrame:
    """Consolidated figures if there are any, else separate ones, else NO_DATA, per (company, year)."""
    best = available.groupBy("code", "year").agg(F.min_by("fs_div", F.when(F.col("fs_div") == "CFS", 0).otherwise(1)).alias("fs_div"))
    grid = year_grid(companies.select("code"), years)
    return grid.join(best, ["code", "year"], "left").withColumn(
        "status", F.when(F.col("fs_div").isNotNull(), vocab.OK).otherwise(vocab.NO_DATA)
    )


def point_in_time_record(records: DataFrame, mode: str = vocab.LIVE_MODE) -> DataFrame:
    """Records with the accounting period kept apart from the instant they became usable."""
    return records.select(
        "code",
        "year",
        "reprt_code",
        F.lit(mode).alias("source_mode"),
        F.coalesce("disclosed_at", F.lit(vocab.NOT_AVAILABLE)).alias("disclosed_at"),
        "detected_at",
        F.col("detected_at").alias("usable_from"),
        F.lit("DETECTED_AT").alias("usable_from_basis"),
        F.lit("CONSENSUS_DATA_UNAVAILABLE").alias("consensus"),
        F.lit("NOT_COMPUTABLE_WITHOUT_CONSENSUS").alias("surprise"),
    )


def periods(companies: DataFrame, records: DataFrame, years) -> DataFrame:
    """Status and basis per (company, year); a year never read is NOT_COLLECTED."""
    labels = F.create_map(*[F.lit(x) for pair in vocab.BASIS_LABEL.items() for x in pair])
    rows = records.where(F.col("year").isin(*years)).select("code", "year", "status", "fs_div")
    return year_grid(companies.select("code"), years).join(rows, ["code", "year"], "left").select(
        "code",
        "year",
        F.coalesce("status", F.lit(vocab.NOT_COLLECTED)).alias("status"),
        "fs_div",
        labels[F.col("fs_div")].alias("fs_div_label"),
    )


def companies_with_data(records: DataFrame, years) -> DataFrame:
    """Companies with at least one usable year, the basis of the last one, and whether the basis is mixed."""
    usable = records.where((F.col("status") == vocab.OK) & F.col("year").isin(*years))
    return usable.groupBy("code").agg(
        F.max_by("fs_div", "year").alias("fs_div"),
        (F.min("fs_div") != F.max("fs_div")).alias("mixed_basis"),
        F.count("*").alias("ok_years"),
    )


def comparable_pairs(records: DataFrame, years) -> DataFrame:
    """Consecutive usable years on the same basis. A gap or a change of basis makes no pair."""
    usable = records.where((F.col("status") == vocab.OK) & F.col("year").isin(*years)).select("code", "year", "fs_div")
    later = usable.select("code", F.col("year").alias("to_year"), (F.col("year") - 1).alias("year"), "fs_div")
    return usable.join(later, ["code", "year", "fs_div"]).select("code", F.col("year").alias("from_year"), "to_year", "fs_div")


def account_values(records: DataFrame, years, accounts) -> DataFrame:
    """Value or state per (code, account, year) for companies that have a usable year.

    ``records`` is long: code, year, status, fs_div, account, amount, applicable. One aggregation per
    (code, account) with one slot per year, so repeated records combine before the shuffle.
    """
    wanted = records.where(F.col("year").isin(*years) & F.col("account").isin(*accounts))
    entry = F.struct("year", "status", "fs_div", "amount", "applicable")
    per_account = wanted.groupBy("code", "account").agg(
        *[F.max(F.when(F.col("year") == y, entry)).alias(f"y{y}") for y in years],
        F.max(F.col("status") == vocab.OK).alias("usable"),
    ).withColumn("cells", F.array(*[f"y{y}" for y in years]))
    cell = F.get(F.filter("cells", lambda c: c["year"] == F.col("year")), F.lit(0))
    spread = per_account.where("usable").withColumn("year", F.explode(F.lit(list(years)))).withColumn("cell", cell)
    ok = F.coalesce(F.col("cell.status") == vocab.OK, F.lit(False))
    return spread.select(
        "code",
        "account",
        "year",
        F.when(ok, F.col("cell.fs_div")).alias("fs_div"),
        F.when(ok & F.col("cell.applicable"), F.col("cell.amount")).alias("amount"),
        F.when(~ok, vocab.NOT_COLLECTED)
        .when(~F.col("cell.applicable"), vocab.NOT_APPLICABLE)
        .when(F.col("cell.amount").isNull(), vocab.NOT_AVAILABLE)
        .otherwise(vocab.NUMBER)
        .alias("value_state"),
    )


def account_changes(values: DataFrame) -> DataFrame:
    """Change per comparable pair of years: absolute, percent, and the reason when there is no percent.

    The window compares each year with the previous row and keeps it only when that row is exactly the
    year before on the same basis, so gaps never pair. A partition holds one company's account.
    """
    by = W.partitionBy("code", "account").orderBy("year")
    prev = F.lag(F.struct("year", "fs_div", "amount")).over(by)
    paired = values.withColumn("prev", prev).where(
        (F.col("prev.year") == F.col("year") - 1)
        & (F.col("prev.fs_div") == F.col("fs_div"))
        & F.col("amount").isNotNull()
        & F.col("prev.amount").isNotNull()
    )
    prior = F.col("prev.amount")
    return paired.select(
        "code",
        "account",
        F.col("prev.year").alias("from_year"),
        F.col("year").alias("to_year"),
        prior.alias("prior"),
        F.col("amount").alias("current"),
        (F.col("amount") - prior).alias("change_abs"),
        am.pct_change(F.col("amount"), prior).alias("change_pct"),
        F.when(prior <= 0, "prior_zero_or_negative").alias("pct_reason"),
    )


def latest_pair_changes(pairs: DataFrame, changes: DataFrame, accounts=vocab.KEY_ACCOUNTS) -> DataFrame:
    """The last comparable pair per company and the changes of its key accounts (null entries are left out)."""
    last = pairs.groupBy("code").agg(F.max(F.struct("to_year", "from_year")).alias("p")).select("code", "p.from_year", "p.to_year")
    wanted = changes.where(F.col("account").isin(*accounts)).select(
        "code", "to_year", F.struct("account", "change_abs", "change_pct", "pct_reason").alias("c")
    )
    return last.join(wanted, ["code", "to_year"], "left").groupBy("code", "from_year", "to_year").agg(
        F.array_sort(F.collect_list("c")).alias("key_changes")
    )


def derived_ratios(records_wide: DataFrame, years) -> DataFrame:
    """Operating margin and debt to equity per usable year, null unless the denominator is positive."""
    usable = records_wide.where((F.col("status") == vocab.OK) & F.col("year").isin(*years))
    return usable.select(
        "code",
        "year",
        am.ratio_pct(F.col("operatingIncome"), F.col("revenue")).alias("operating_margin_pct"),
        am.ratio_pct(F.col("totalLiabilities"), F.col("totalEquity")).alias("debt_to_equity_pct"),
    )


def bar_widths(values: DataFrame) -> DataFrame:
    """Bar width in percent of the largest year: zero for zero, otherwise at least two."""
    size = F.abs(F.col("amount")).cast("double")
    top = F.max(size).over(W.partitionBy("code", "account"))
    width = F.when(F.col("amount") == 0, 0).otherwise(F.greatest(F.lit(2), F.round(size / top * 100).cast("int")))
    return values.where(F.col("amount").isNotNull()).withColumn("width", width)


def notable_changes(changes: DataFrame, least: float = 20.0) -> DataFrame:
    """Profit and loss turning into each other, else a change of at least ``least`` percent."""
    flag = (
        F.when((F.col("prior") > 0) & (F.col("current") < 0), "PROFIT_TO_LOSS")
        .when((F.col("prior") < 0) & (F.col("current") > 0), "LOSS_TO_PROFIT")
        .when(F.abs("change_pct") >= least, F.when(F.col("change_pct") > 0, "UP").otherwise("DOWN"))
    )
    return changes.withColumn("flag", flag).where("flag IS NOT NULL")


def fact_lines(asks: DataFrame, records_wide: DataFrame) -> DataFrame:
    """Facts of the fiscal year before an analysis: revenue growth, operating margin, year-end ROE.

    ``asks`` has code and analyzed_year. Growth needs the year before on the same basis.
    """
    cur = records_wide.where(F.col("status") == vocab.OK).withColumn("analyzed_year", F.col("year") + 1)
    prev = records_wide.where(F.col("status") == vocab.OK).select(
        "code", (F.col("year") + 2).alias("analyzed_year"), "fs_div", F.col("revenue").alias("prev_revenue")
    )
    rows = asks.join(cur, ["code", "analyzed_year"]).join(prev, ["code", "analyzed_year", "fs_div"], "left")
    basis = F.create_map(*[F.lit(x) for pair in vocab.BASIS_LABEL.items() for x in pair])[F.col("fs_div")]
    year, before = F.col("year").cast("string"), (F.col("year") - 1).cast("string")
    growth = am.pct_change(F.col("revenue"), F.col("prev_revenue"))
    margin = am.ratio_pct(F.col("operatingIncome"), F.col("revenue"))
    roe = am.ratio_pct(F.col("netIncome"), F.col("totalEquity"))
    word = F.when(F.col("revenue") >= F.col("prev_revenue"), "늘었다").otherwise("줄었다")
    # Wording of the fact lines.
    texts = {
        "REVENUE_YOY": (growth, F.concat(year, F.lit("년 매출액은 "), before, F.lit("년보다 "), growth.cast("string"), F.lit("% "), word, F.lit("("), basis, F.lit(" 기준)."))),
        "OPERATING_MARGIN": (margin, F.concat(year, F.lit("년 영업이익률(영업이익 ÷ 매출액)은 "), margin.cast("string"), F.lit("%였다("), basis, F.lit(" · 자체 계산)."))),
        "ROE_YEAR_END_EQUITY": (roe, F.concat(year, F.lit("년 ROE(당기순이익 ÷ 기말 자본총계)는 "), roe.cast("string"), F.lit("%였다("), basis, F.lit(" · 자체 계산 · 평균자본이 아닌 기말 기준)."))),
    }
    facts = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"), text.alias("text")) for k, (v, text) in texts.items()])
    return rows.select("code", "analyzed_year", "year", "fs_div", F.explode(facts).alias("f")).select(
        "code", "analyzed_year", "year", "fs_div", "f.kind", "f.value", "f.text"
    ).where("value IS NOT NULL")


def audit_facts(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Facts that differ from their recomputation, on either side."""
    keys = ["code", "analyzed_year", "kind"]
    s = stored.select(*keys, F.col("value").alias("stored_value"), F.lit(True).alias("in_store"))
    r = recomputed.select(*keys, F.col("value").alias("expected_value"), F.lit(True).alias("in_facts"))
    return s.join(r, keys, "full").withColumn(
        "problem",
        F.when(F.col("in_store").isNull(), "NOT_STORED")
        .when(F.col("in_facts").isNull(), "NOT_EXPECTED")
        .when(~F.col("stored_value").eqNullSafe(F.col("expected_value")), "VALUE_DIFFERS"),
    ).where("problem IS NOT NULL").drop("in_store", "in_facts")


# ── coverage of the store ───────────────────────────────────────────────────────────────────────


def missing_cells(companies: DataFrame, records: DataFrame, years) -> DataFrame:
    """Target (company, year) cells never read. A stored NO_DATA counts as read."""
    return year_grid(companies.select("code"), years).join(records.select("code", "year"), ["code", "year"], "left_anti")


def most_needed(companies: DataFrame, records: DataFrame, years, count: int) -> DataFrame:
    """Companies with the most missing years first, then by code."""
    cells = missing_cells(companies, records, years)
    return (
        cells.groupBy("code")
        .agg(F.count("*").alias("missing"), F.array_sort(F.collect_set("year")).alias("years"))
        .orderBy(F.desc("missing"), "code")
        .limit(count)
    )


def readiness(companies: DataFrame, records: DataFrame, years, needed: int = vocab.YEARS_NEEDED) -> DataFrame:
    """Companies with all, some or none of the target years."""
    usable = records.where((F.col("status") == vocab.OK) & F.col("year").isin(*years))
    have = usable.groupBy("code").agg(F.count_distinct("year").alias("have"))
    n = F.coalesce("have", F.lit(0))
    return companies.select("code").join(have, "code", "left").agg(
        F.count("*").alias("companies"),
        F.count_if(n >= needed).alias("ready"),
        F.count_if((n > 0) & (n < needed)).alias("partial"),
        F.count_if(n == 0).alias("no_data"),
        F.round(F.coalesce(F.try_divide(F.count_if(n >= needed).cast("double") * 100, F.count("*")), F.lit(0.0)), 1).alias("ready_pct"),
    )


def not_collected(companies: DataFrame, built: DataFrame) -> DataFrame:
    """Universe companies without a product row."""
    return companies.select("code").join(built.select("code"), "code", "left_anti")


def outside_universe(keys: DataFrame, companies: DataFrame) -> DataFrame:
    return keys.select("code").distinct().join(companies.select("code"), "code", "left_anti")
