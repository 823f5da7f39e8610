"""Missing is not zero, unseen is not absent, ambiguous is not guessed: windows, statements, coverage, ledgers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions import amounts as am, instants as ts, text as tx
from docketry.operators import changes as ch, coverage as cv, filings as fl, financials as fin, ledger as lg
from docketry.operators.classify import Category

D = dt.date


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_instants_need_an_offset(spark):
    texts = ["2026-08-15T14:20:00+09:00", "2026-08-15T05:20:00Z", "2026-08-15T14:20:00", "2026-08-15", "", None, "x", "2026-08-15T14:20:00.5+0900"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_seconds(ts.parse_instant("t")))
    base = int(dt.datetime(2026, 8, 15, 5, 20, tzinfo=dt.timezone.utc).timestamp())
    assert [r[0] for r in df.collect()] == [base, base, None, None, None, None, None, base]


def test_instants_are_compared_as_utc(spark):
    early, late = F.lit("2026-08-15T23:30:00+09:00"), F.lit("2026-08-15T15:00:00+00:00")
    assert one(spark, ts.instant_le(early, late), ts.instant_le(late, early), ts.instant_le(F.lit("2026-08-15"), late))[:] == (True, False, False)


def test_receipt_dates(spark):
    df = spark.createDataFrame([("20260915000123",), ("2026",), ("20261399000001",), (None,)], "r string")
    assert [r[0] for r in df.select(ts.compact_to_date("r")).collect()] == [D(2026, 9, 15), None, None, None]


def test_covered_until_stops_at_midnight_after_the_window(spark):
    finished = F.lit("2026-09-20T10:00:00Z").cast("timestamp")
    got = one(spark, F.unix_seconds(ts.covered_until(finished, F.lit("2026-09-14").cast("date"))))[0]
    assert got == int(dt.datetime(2026, 9, 14, 15, tzinfo=dt.timezone.utc).timestamp())


def test_fiscal_years(spark):
    got = one(spark, ts.target_years(F.lit("2026-03-31").cast("date")), ts.target_years(F.lit("2026-04-01").cast("date")))
    assert got[:] == ([2024, 2023, 2022], [2025, 2024, 2023])


@pytest.mark.parametrize(
    "since, first, last, behind", [(None, 28, 29, 0), ("2026-09-29", 28, 29, 0), ("2026-09-25", 25, 29, 0), ("2026-09-01", 1, 14, 15)]
)
def test_oldest_unconfirmed_day_first(spark, since, first, last, behind):
    src = spark.createDataFrame([("s", since)], "source string, confirmed_until string").withColumn("confirmed_until", F.to_date("confirmed_until"))
    row = cv.gap_days(src, F.lit("2026-09-29").cast("date")).first()
    assert (row.days[0].day, row.days[-1].day, row.behind_days) == (first, last, behind)


def test_trading_period_skips_holidays(spark):
    got = one(spark, cv.trading_period(F.lit("2026-09-23").cast("date"), 3).alias("p")).p
    assert (got.period_start, got.period_end) == (D(2026, 9, 28), D(2026, 9, 30))
    with pytest.raises(ValueError):
        cv.trading_period(F.lit("2026-09-23").cast("date"), 0)


def test_windows(spark):
    short = one(spark, ch.windows_between("2026-09-01", "2026-09-20").alias("w")).w
    assert (short.days, short.fully_covered, short.recent_from, short.prior_from) == (10, True, D(2026, 9, 11), D(2026, 9, 1))
    long = one(spark, ch.windows_between("2026-06-01", "2026-09-20").alias("w")).w
    assert (long.days, long.fully_covered) == (30, True)
    tiny = one(spark, ch.windows_between("2026-09-18", "2026-09-20").alias("w")).w
    assert (tiny.days, tiny.fully_covered) == (7, False)


def test_changes_compare_only_covered_windows(spark):
    cats = (Category("a", "가", ()), Category("b", "나", ()))
    rows = [("1", "a", D(2026, 9, 15), False), ("1", "a", D(2026, 9, 16), True), ("1", "b", D(2026, 9, 2), False), ("1", "zz", D(2026, 9, 15), False)]
    df = spark.createDataFrame(rows, "code string, category string, received_on date, is_correction boolean")
    got = {r.category or r.type: (r.type, r.recent, r.prior) for r in ch.window_changes(df, ch.windows_between("2026-09-01", "2026-09-20"), cats).collect()}
    assert got == {"a": ("NEW_CATEGORY", 2, 0), "b": ("FEWER", 0, 1), "zz": ("NEW_CATEGORY", 1, 0), "CORRECTIONS": ("CORRECTIONS", 1, None)}
    got = {r.category or r.type: (r.type, r.recent, r.prior) for r in ch.window_changes(df, ch.windows_between("2026-09-14", "2026-09-20"), cats).collect()}
    assert got == {"a": ("RECENT_ONLY", 2, None), "zz": ("RECENT_ONLY", 1, None), "CORRECTIONS": ("CORRECTIONS", 1, None)}


def statement(spark):
    rows = [
        ("000100", 2023, "OK", "CFS", "revenue", 100, True), ("000100", 2024, "OK", "CFS", "revenue", 110, True), ("000100", 2025, "OK", "OFS", "revenue", 90, True),
        ("000100", 2023, "OK", "CFS", "operatingIncome", -5, True), ("000100", 2024, "OK", "CFS", "operatingIncome", 10, True),
        ("000100", 2025, "OK", "OFS", "operatingIncome", 9, True), ("000100", 2024, "OK", "CFS", "interestExpense", None, True),
        ("000100", 2025, "OK", "OFS", "currentAssets", None, False), ("000660", 2025, "NO_DATA", None, "revenue", None, True),
    ]
    return spark.createDataFrame(rows, "code string, year int, status string, fs_div string, account string, amount bigint, applicable boolean")


def test_missing_values_are_states_not_zero(spark):
    values = fin.account_values(statement(spark), (2023, 2024, 2025), ("revenue", "operatingIncome", "interestExpense", "currentAssets"))
    got = {(r.account, r.year): (r.amount, r.value_state) for r in values.collect()}
    assert got["interestExpense", 2024] == (None, vocab.NOT_AVAILABLE)
    assert got["interestExpense", 2023] == (None, vocab.NOT_COLLECTED)
    assert got["currentAssets", 2025] == (None, vocab.NOT_APPLICABLE)
    assert got["revenue", 2025] == (90, vocab.NUMBER)
    assert not any(a == 0 for a, _ in got.values())
    assert {r.code for r in values.select("code").distinct().collect()} == {"000100"}


def test_pairs_need_the_same_basis_and_positive_prior(spark):
    values = fin.account_values(statement(spark), (2023, 2024, 2025), ("revenue", "operatingIncome"))
    got = {(r.account, r.from_year, r.to_year): (r.change_abs, r.change_pct, r.pct_reason) for r in fin.account_changes(values).collect()}
    assert got == {("revenue", 2023, 2024): (10, 10.0, None), ("operatingIncome", 2023, 2024): (15, None, "prior_zero_or_negative")}
    flags = {r.account: r.flag for r in fin.notable_changes(fin.account_changes(values)).collect()}
    assert flags == {"operatingIncome": "LOSS_TO_PROFIT"}


def test_ratios_need_a_positive_denominator(spark):
    wide = spark.createDataFrame(
        [("1", 2024, "OK", 110, 10, 60, 100), ("1", 2025, "OK", 0, 5, 60, -1)],
        "code string, year int, status string, revenue bigint, operatingIncome bigint, totalLiabilities bigint, totalEquity bigint",
    )
    got = {r.year: (r.operating_margin_pct, r.debt_to_equity_pct) for r in fin.derived_ratios(wide, (2024, 2025)).collect()}
    assert got == {2024: (9.1, 60.0), 2025: (None, None)}


def extract(spark, lines, sector="전기"):
    cols = "code string, year int, ord int, sj_div string, account_id string, account_nm string, thstrm_amount string"
    df = spark.createDataFrame([("1", 2025, i, *line) for i, line in enumerate(lines)], cols)
    grid = fin.account_grid(df, spark.createDataFrame([("1", sector)], "code string, sector string"))
    return {r.account: (r.amount, r.matched_by, r.value_state) for r in grid.collect()}


def test_account_tiers(spark):
    got = extract(spark, [
        ("CF", "ifrs-full_ProfitLoss", "당기순이익", "1"),
        ("CIS", "ifrs-full_ProfitLoss", "당기순이익", "2"),
        ("IS", "ifrs-full_ProfitLoss", "연결당기순이익", "3,000"),
        ("BS", "-표준계정코드 미사용-", "자산 총계", "10"),
        (None, "ifrs-full_Equity", "지배기업", "7"),
        ("XX", "", "매출 원가", "8"),
        ("IS", "ifrs-full_Revenue", "매출액", "-"),
        ("IS", "other", "매출액", "9"),
        ("IS", "dart_OperatingIncomeLoss", "영업이익", "-12"),
    ])
    assert got["netIncome"] == (3000, "account_id", vocab.NUMBER)
    assert got["totalAssets"] == (10, "account_nm", vocab.NUMBER)
    assert got["totalEquity"] == (7, "account_id_any_sj", vocab.NUMBER)
    assert got["costOfSales"] == (8, "account_nm_any_sj", vocab.NUMBER)
    assert got["revenue"] == (None, None, vocab.NOT_AVAILABLE)          # the matched row does not parse: no fall-through
    assert got["operatingIncome"] == (-12, "account_id", vocab.NUMBER)
    assert got["grossProfit"] == (None, None, vocab.NOT_AVAILABLE)
    assert len(got) == len(vocab.ACCOUNT_TARGETS)


def test_financial_sector_lines_do_not_apply(spark):
    got = extract(spark, [("BS", "ifrs-full_Assets", "자산총계", "5")], sector="은행업")
    assert got["revenue"][2] == got["currentAssets"][2] == vocab.NOT_APPLICABLE_FINANCIAL_SECTOR
    assert got["netIncome"][2] == vocab.NOT_AVAILABLE and got["totalAssets"][0] == 5


def test_empty_statement_keeps_its_grid(spark):
    got = extract(spark, [("BS", "none", "none", "5")])
    assert {s for _, _, s in got.values()} == {vocab.NOT_AVAILABLE}


def test_amounts(spark):
    texts = ["1,234", "-", "", None, "-5", "1.5", "100945394185079"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(am.parse_amount("t").cast("bigint"))
    assert [r[0] for r in df.collect()] == [1234, None, None, None, -5, None, 100945394185079]
    cases = {1_234_500_000_000: "1.2조", 2_000_000_000_000: "2조", 350_000_000: "4억", -120_000: "−12만", 950: "950원", 0: "0원"}
    df = spark.createDataFrame([(k,) for k in cases], "v bigint").select("v", am.won_text(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == cases


def test_percent_text_has_six_digits(spark):
    cases = {10.0: "+10%", -0.5: "−0.5%", 0.0: "0%", 99999.9: "+99999.9%", 123456.7: "+123457%", 1234567.8: "+1.23457e+06%", 2e6: "+2e+06%"}
    df = spark.createDataFrame([(k,) for k in cases], "v double").select("v", am.pct_text(F.col("v"), F.lit(None).cast("string")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == cases


def test_correction_rules_stay_apart(spark):
    df = spark.createDataFrame([("[첨부추가]A",), ("정정신고 B",), ("[기재정정]C",), ("D",)], "t string")
    got = [tuple(r) for r in df.select(tx.is_ingest_correction("t"), tx.research_correction_kind("t"), tx.is_site_correction("t")).collect()]
    assert got == [(False, "첨부추가", True), (True, "정정", False), (True, "기재정정", True), (False, None, False)]


def test_masking(spark):
    got = one(spark, tx.mask_parameter(F.lit("GET /x?crtfc_key=abc123&page=2 crtfc_key=zz' done"), "crtfc_key"))[0]
    assert got == "GET /x?crtfc_key=***REDACTED***&page=2 crtfc_key=***REDACTED***' done"


def test_mapping_never_guesses(spark):
    universe = spark.createDataFrame([("000001", "가", "s"), ("000002", "나", "s"), ("000003", "다", "s")], "code string, name string, sector string")
    registry = spark.createDataFrame(
        [("c1", "가", "000001 "), ("c2", "다름", "000002"), ("c3", "나", "000002"), ("c4", "다", "")], "corp_code string, corp_name string, stock_code string"
    )
    got = {r.code: (r.mapping, r.corp_code, r.candidate_count) for r in fl.map_issuers(universe, registry).collect()}
    assert got == {"000001": ("MAPPED", "c1", 1), "000002": ("AMBIGUOUS", None, 2), "000003": ("UNKNOWN", None, 0)}
    assert {r.corp_code for r in fl.issuer_candidates(universe, registry).collect()} == {"c2", "c3"}


def test_pending_rows_are_processed_again(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("",), (None,)], "rcept_no string")
    states = spark.createDataFrame([("a", "ACKNOWLEDGED"), ("b", "PENDING"), ("c", "STORED")], "rcept_no string, state string")
    assert sorted(r[0] for r in fl.drop_acknowledged(rows, states).collect()) == ["b", "c", "d"]


def test_coverage_state_precedence(spark):
    rows = [(False, 0, True, 1), (True, 1, True, 1), (True, 0, False, 1), (True, 0, True, 1), (True, 0, True, 0)]
    df = spark.createDataFrame(rows, "k boolean, e int, c boolean, n int")
    got = [r[0] for r in df.select(cv.coverage_state(F.col("k"), F.col("e"), F.col("c"), F.col("n"))).collect()]
    assert got == [
        vocab.EVENT_COVERAGE_INCOMPLETE, vocab.EVENT_DATA_ERROR, vocab.EVENT_COVERAGE_INCOMPLETE, vocab.EVENT_DETECTED, vocab.NO_OFFICIAL_EVENT_DETECTED
    ]


def test_failed_pages_are_not_zero(spark):
    pages = spark.createDataFrame(
        [("1", 1, "OK", 2, 3), ("1", 2, "API_ERROR", None, None), ("2", 1, "NO_DATA", 1, 0), ("3", 1, "OK", 3, 9)],
        "ticker string, page int, state string, total_page int, total_count int",
    )
    rows = spark.createDataFrame([("1", "r", "감자결정", "KEPT")], "ticker string, rcept_no string, report_nm string, row_state string")
    got = {r.ticker: (r.ok, r.error, r.findings) for r in cv.reconcile_issuers(pages, rows).collect()}
    assert got == {"1": (False, "API_ERROR", None), "2": (True, None, 0), "3": (False, None, None)}


def test_evidence_needs_every_page(spark):
    pages = spark.createDataFrame(
        [("gap", 1, "OK", 3, 9), ("gap", 3, "OK", 3, 9), ("all", 1, "OK", 2, 9), ("all", 2, "OK", 2, 9), ("all", 2, "OK", 2, 9),
         ("none", 1, "NO_DATA", None, None), ("bad", 1, "OK", 3, 9), ("bad", 2, "API_ERROR", None, None), ("zero", 1, "OK", 0, 0)],
        "ticker string, page int, state string, total_page int, total_count int",
    )
    rows = spark.createDataFrame([], "ticker string, rcept_no string, report_nm string, row_state string")
    got = {r.ticker: (r.ok, r.error, r.pages_expected, r.pages_collected, r.total_count, r.collected) for r in cv.reconcile_issuers(pages, rows).collect()}
    assert got == {
        "gap": (False, None, 3, 2, 9, None), "all": (True, None, 2, 2, 9, 0), "none": (True, None, 1, 1, 0, 0),
        "bad": (False, "API_ERROR", None, 1, None, None), "zero": (True, None, 0, 1, 0, 0),
    }


def test_queries_that_stopped_at_the_limit(spark):
    rows = [("known", p, 6, False, 100) for p in range(1, 7)] + [("short", p, None, False, 100 if p < 4 else 7) for p in range(1, 5)]
    rows += [("full", p, None, False, 100) for p in range(1, 5)] + [("unknown", p, None, False, None) for p in range(1, 5)]
    rows += [("gap", p, 3, False, 100) for p in (1, 3, 4)] + [("few", 1, None, False, 100), ("failed", 1, 1, True, None)]
    df = spark.createDataFrame(rows, "query string, page int, total_page int, failed boolean, page_rows int")
    limit = ["PAGE_LIMIT_REACHED"]
    got = {r["query"]: r.reasons for r in cv.page_completeness(df, 4).collect()}
    assert got == {"known": [], "short": [], "full": limit, "unknown": limit, "gap": limit, "few": [], "failed": ["API_ERROR"]}
    total = cv.overall_completeness(cv.page_completeness(df, 4)).first()
    assert (total.complete, total.reasons, total.queries) == (False, ["API_ERROR", "PAGE_LIMIT_REACHED"], 7)


LEDGER = "day string, kind string, n bigint"


def test_ledger_merge(spark):
    base = spark.createDataFrame([("2026-09-22", "list", 50)], LEDGER)
    ours = spark.createDataFrame([("2026-09-23", "list", 38), ("2026-09-23", "mapping", 1), ("2026-09-23", "ghost", 2)], LEDGER)
    theirs = spark.createDataFrame([("2026-09-23", "list", 20), ("2026-09-23", "financial", 137)], LEDGER)
    expected = {"list": 58, "mapping": 1, "financial": 137, "other": 2}
    for a, b in ((ours, theirs), (theirs, ours)):
        assert {r.kind: r.n for r in lg.merge_ledgers(base, a, b).collect()} == expected
    same = spark.createDataFrame([("2026-09-23", "list", 30)], LEDGER)
    assert {r.kind: r.n for r in lg.merge_ledgers(same, ours, theirs).collect()}["list"] == 30 + 8 + 0
    old = spark.createDataFrame([("2026-09-21", "list", 99)], LEDGER)
    assert {r.kind: r.n for r in lg.merge_ledgers(base, ours, old).collect()}["list"] == 38


def test_merged_ledger_carries_runs_and_stamp(spark):
    full = LEDGER + ", runs int, updated_at string"
    one = lambda *r: spark.createDataFrame([r], full)
    ours, theirs = one("2026-09-23", "list", 38, 3, "b"), one("2026-09-23", "mapping", 1, 2, "c")
    got = lg.merge_ledgers(one("2026-09-22", "list", 50, 9, "z"), ours, theirs)
    assert {(r.kind, r.n, r.runs, r.updated_at) for r in got.collect()} == {("list", 38, 5, "c"), ("mapping", 1, 5, "c")}
    got = lg.merge_ledgers(one("2026-09-23", "list", 30, 2, "a"), ours, theirs).where("kind = 'list'").first()
    assert (got.n, got.runs) == (38, 3)


def test_targets(spark):
    universe = spark.createDataFrame([(f"00000{i}",) for i in range(6)], "code string")
    codes = lambda df: [r.code for r in df.collect()]
    assert codes(cv.rotation_targets(universe, "000003", 3)) == ["000004", "000005", "000000"]
    assert codes(cv.rotation_targets(universe, "", 2)) == ["000000", "000001"]
    assert codes(cv.rotation_targets(universe, "000005", 2)) == ["000000", "000001"]
    wanted = spark.createDataFrame([("000004", 1), ("999999", 2), ("000001", 3)], "code string, ord int")
    assert codes(cv.listed_targets(universe, wanted, 5)) == ["000004", "000001"]
    assert codes(cv.listed_targets(universe, wanted.where("false"), 5)) == []
    assert codes(fin.outside_universe(wanted, universe)) == ["999999"]
