"""Operators with hot groups against brute force on small random data: one key holds a third of all rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from docketry.operators import changes as ch, digests as dg, filings as fl, numbering as nb
from docketry.operators.classify import Category
from docketry.operators import matching
from docketry.operators.matching import containing_pairs, first_containing, text_pieces


def hot(rng, n, keys=9):
    return ["hot" if rng.random() < 0.35 else f"k{rng.randrange(keys)}" for _ in range(n)]


def correction_rows(seed, n):
    rng = random.Random(seed)
    words = ["plan", "plan B", "report", "x", "big plan", "re"]
    rows = []
    for i, ticker in enumerate(hot(rng, n)):
        mark = rng.choice(["", "", "[기재정정]", "[정정] "])
        title = mark + rng.choice(words) if rng.random() > 0.03 else "[정정]"
        rows.append((ticker, f"{rng.randrange(10**6):06d}{i:04d}", title, mark != "" or title == "[정정]", i))
    return rows


def expected_links(rows):
    out = {}
    for ticker, no, title, fixed, seq in rows:
        base = title.replace("[기재정정]", "").replace("[정정]", "").strip()
        if not fixed or not base:
            out[no] = ("NOT_AVAILABLE", None, None)
            continue
        cands = sorted(o for t, o, n, _, s in rows if t == ticker and s < seq and base in n and o != no)
        if len(cands) == 1:
            out[no] = (cands[0], None, "SAME_TICKER_SAME_REPORT_NAME")
        elif cands:
            out[no] = ("NOT_AVAILABLE", cands[-5:], "AMBIGUOUS_NOT_LINKED")
        else:
            out[no] = ("NOT_AVAILABLE", None, None)
    return out


LINK = "ticker string, rcept_no string, report_name string, is_correction boolean, seq bigint"


def links(df):
    return {r.rcept_no: (r.corrects_rcept_no, r.correction_candidates, r.correction_link_basis) for r in df.collect()}


def test_correction_links(spark):
    rows = correction_rows(1, 400)
    df = spark.createDataFrame(rows, LINK)
    assert links(fl.link_corrections(df)) == expected_links(rows)


def test_correction_links_do_not_depend_on_block_size(spark):
    rows = correction_rows(2, 300)
    assert links(fl.link_corrections(spark.createDataFrame(rows, LINK), block=4)) == expected_links(rows)


def test_correction_links_against_history(spark):
    rows = correction_rows(3, 300)
    first, second, batch = rows[:120], rows[120:200], rows[200:]
    state = fl.title_state(spark.createDataFrame(first, LINK)).unionByName(fl.title_state(spark.createDataFrame(second, LINK)))
    got = links(fl.link_corrections(spark.createDataFrame(batch, LINK), state))
    want = expected_links(rows)
    assert got == {r[1]: want[r[1]] for r in batch}


def test_visible_as_of(spark):
    rng = random.Random(4)
    events = [(t, f"r{i:04d}", f"2026-01-{rng.randrange(1, 8):02d} {rng.randrange(24):02d}:00:00") for i, t in enumerate(hot(rng, 300))]
    asks = [(t, f"a{i}", f"2026-01-{rng.randrange(1, 9):02d} {rng.randrange(24):02d}:00:00") for i, t in enumerate(hot(rng, 100, 11))]
    to_ts = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    e = to_ts(spark.createDataFrame(events, "ticker string, rcept_no string, detected_at string"), "detected_at")
    a = to_ts(spark.createDataFrame(asks, "ticker string, ask_id string, at string"), "at")
    got = {r.ask_id: (r.visible, r.latest_rcept_no) for r in fl.visible_as_of(a, e).collect()}
    for ticker, ask, at in asks:
        seen = [(d, r) for t, r, d in events if t == ticker and d <= at]
        assert got[ask] == (len(seen), max(seen)[1] if seen else None)


def test_related_items(spark):
    rng = random.Random(5)
    cats = hot(rng, 250, 60)
    ids = rng.sample(range(3000), 250)
    items = list(zip(ids, cats, [rng.randrange(50) for _ in ids], strict=True))
    df = spark.createDataFrame(items, "id bigint, category string, date bigint")
    for block in (7, 64, 5000):
        got = defaultdict(list)
        for r in dg.related_items(df, 3, block).orderBy("id", "place").collect():
            got[r.id].append(r.related_id)
        for i, c, _ in items:
            same = sorted((x for x in items if x[1] == c and x[0] != i), key=lambda x: (abs(x[0] - i), x[0]))
            rest = [x for x in sorted(items, key=lambda x: (x[2], x[0]), reverse=True) if x[1] != c]
            assert got[i] == [x[0] for x in (same + rest)[:3]]


def test_equal_distances_follow_the_input_order(spark):
    rows = [(10, "a", 1, 2), (12, "a", 1, 1), (8, "a", 1, 3), (14, "a", 1, 0)]
    df = spark.createDataFrame(rows, "id bigint, category string, date bigint, ord bigint")
    got = [r.related_id for r in dg.related_items(df).where("id = 10").orderBy("place").collect()]
    assert got == [12, 8, 14]


def test_containing_pairs(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("ab가나") for _ in range(n))
    needles = {(rng.choice("xy"), text(rng.randrange(1, 5))) for _ in range(60)}
    hays = {(rng.choice("xy"), text(rng.randrange(0, 9))) for _ in range(120)}
    got = containing_pairs(
        spark.createDataFrame(list(needles), "k string, n string"), spark.createDataFrame(list(hays), "k string, h string"), ["k"], "n", "h"
    )
    assert {tuple(r) for r in got.collect()} == {(k, n, h) for k, n in needles for j, h in hays if k == j and n in h}


def test_name_resolution(spark):
    names = spark.createDataFrame([(0, "000010", "대한항공"), (1, "000020", "대한전선"), (2, "000030", "대한"), (3, "000040", "삼성전자")], "ord int, code string, name string")
    asks = spark.createDataFrame([("대한",), (" 전자 ",), ("123456",), ("한",), ("없음",), ("항공",)], "query string")
    got = {r.query: r.code for r in dg.resolve_names(asks, names).collect()}
    assert got == {"대한": "000030", " 전자 ": "000040", "123456": "123456", "한": "000010", "없음": "없음", "항공": "000010"}


def test_names_of_one_file_are_cut_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(matching, "PIECES", 2000)
    names = spark.range(3000, numPartitions=1).select(F.col("id").alias("ord"), F.format_string("Name#%06d", F.col("id") % 1000).alias("name"))
    needles = spark.createDataFrame([("7",), ("42",), ("#000123",), ("none",), ("",)], "text string")
    pieces = matching.spread_pieces(names, [1, 2, 4, 7], "text", "name", F.col("ord"))
    loads = [r["count"] for r in pieces.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    each = len({(w, "Name#000007"[i : i + w]) for w in (1, 2, 4, 7) for i in range(11 - w + 1)})
    assert len(loads) > 30 and max(loads) < 3 * 2000 and sum(loads) > 1000 * each / 2
    got = {r.text: r["first"] for r in first_containing(needles, names, "text", "name", F.col("ord")).collect()}
    assert got == {"7": 7, "42": 42, "#000123": 123}
    assert first_containing(needles.where("false"), names, "text", "name", F.col("ord")).count() == 0
    assert first_containing(needles, names.where("false"), "text", "name", F.col("ord")).count() == 0


def test_merge_keeps_the_first_source_and_all_names(spark):
    cols = "code string, rcept_no string, title string, received_on string, source string"
    a = spark.createDataFrame([("1", "r1", "A", "2026-01-01", "list")] * 50 + [("2", "r2", "B", "2026-01-01", "list")], cols)
    b = spark.createDataFrame([("1", "r1", "A  ", "2026-01-01", "evidence"), ("1", "r3", "C", "2026-01-02", "evidence")], cols)
    got = {r.rcept_no: (r.title, r.sources) for r in fl.merge_filings(a, b).collect()}
    assert got == {"r1": ("A", ["list", "evidence"]), "r2": ("B", ["list"]), "r3": ("C", ["evidence"])}


def test_recent_list_keeps_three_newest_inside_seven_days(spark):
    rows = [("000100", f"2026090{d}", f"2026-09-0{d}", f"2026-09-0{d} 09:00:00") for d in range(1, 6)] + [("000660", "20260801", "2026-08-01", "2026-08-01 09:00:00")]
    df = spark.createDataFrame(rows, "code string, rcept_no string, received_on string, detected_at string").withColumn("received_on", F.to_date("received_on"))
    assert sorted(r.rcept_no for r in ch.recent_list(df).collect()) == ["20260903", "20260904", "20260905"]


def test_window_changes_with_a_hot_company(spark):
    rng = random.Random(7)
    cats = (Category("a", "A", ()), Category("b", "B", ()))
    rows = [(k, rng.choice("ab"), f"2026-09-{rng.randrange(1, 21):02d}", rng.random() < 0.2) for k in hot(rng, 600)]
    df = spark.createDataFrame(rows, "code string, category string, d string, is_correction boolean").withColumn("received_on", F.to_date("d"))
    got = {(r.code, r.category): (r.recent, r.prior) for r in ch.window_changes(df, ch.windows_between("2026-09-01", "2026-09-20"), cats).collect()}
    for (code, cat), value in got.items():
        if cat is None:
            assert value == (sum(k == code and c and d >= "2026-09-11" for k, _, d, c in rows), None)
        else:
            mine = [d for k, c, d, _ in rows if (k, c) == (code, cat)]
            assert value == (sum(d >= "2026-09-11" for d in mine), sum(d < "2026-09-11" for d in mine))


def candidate_rows(spark, n):
    names = spark.range(n).select(F.format_string("Customer#%09d", "id").alias("name"), F.col("id").alias("ord"))
    own = spark.createDataFrame([("Customer",), ("#00000",), (f"{n - 1:09d}",)], "text string")
    lengths = [8, 6, 9]
    pieces = names.select(F.explode(text_pieces(F.col("name"), F.lit(lengths))).alias("text")).count()
    got = {r.text: r["first"] for r in first_containing(own, names, "text", "name", F.col("ord")).collect()}
    assert got == {"Customer": 0, "#00000": 0, f"{n - 1:09d}": n - 1}
    return pieces


def test_name_candidates_grow_linearly(spark):
    # Repeated pieces of a name count once, so not exactly tenfold.
    assert candidate_rows(spark, 15000) <= 10.5 * candidate_rows(spark, 1500)


def test_places_are_dense_for_hot_and_sparse_groups(spark):
    rng = random.Random(8)
    rows = [(None if k == "k0" else k, rng.choice([None, *range(5), *(rng.getrandbits(60) for _ in range(3))]), i) for i, k in enumerate(hot(rng, 3000))]
    df = spark.createDataFrame(rows, "k string, o bigint, id int").repartition(5)
    got = defaultdict(list)
    for r in nb.numbered(df, ["k"], ["o"]).collect():
        got[r.k].append((r.place, r.o is not None, r.o or 0, r.id))
    assert sorted(i for own in got.values() for *_, i in own) == list(range(3000))
    for own in got.values():
        own.sort()
        assert [p for p, *_ in own] == list(range(len(own))) and [x[1:3] for x in own] == sorted(x[1:3] for x in own)
    assert nb.numbered(df.limit(0), ["k"], ["o"]).count() == 0


def block_sizes(monkeypatch, module):
    """Sizes of the blocks that an operator forms, by spying on the block number."""
    seen = []
    inner = nb.numbered

    def spy(rows, keys, order, place="place"):
        done = inner(rows, keys, order, place)
        seen.append((done, keys))
        return done

    monkeypatch.setattr(module, "numbered", spy)
    return seen


def test_hashed_ids_and_one_busy_minute_give_blocks_of_bounded_size(spark, monkeypatch):
    for module in (fl, dg):
        monkeypatch.setattr(module, "numbered", nb.numbered)
    hashed = spark.range(20_000).select(F.xxhash64("id").alias("id"), F.lit("hot").alias("category"), F.lit(1).cast("bigint").alias("date"))
    seen = block_sizes(monkeypatch, dg)
    got = dg.related_items(hashed, 3, 500)
    done, keys = seen[0]
    sizes = [r["count"] for r in done.groupBy(*keys, nb.block_of("place", 500)).count().collect()]
    assert sizes == [500] * 40 and got.count() == 60_000
    events = spark.range(20_000).select(
        F.lit("hot").alias("ticker"), F.col("id").cast("string").alias("rcept_no"),
        F.timestamp_micros(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 10**8)).alias("detected_at"),
    )
    asks = events.where("id % 10 = 0").select("ticker", F.col("rcept_no").alias("ask_id"), F.col("detected_at").alias("at"))
    seen = block_sizes(monkeypatch, fl)
    visible = fl.visible_as_of(asks, events, 1000)
    done, keys = seen[0]
    assert max(r["count"] for r in done.groupBy(*keys, nb.block_of("place", 1000)).count().collect()) == 1000
    assert {r.ask_id: r.visible for r in visible.collect()} == {str(i): i // 2 + 1 for i in range(0, 20_000, 10)}


def test_correction_links_of_hashed_order_over_several_levels(spark):
    rows = [("hot", f"{i:06d}", "[정정]plan" if i % 7 == 0 else "plan", i % 7 == 0, i) for i in range(1200)]
    rng = random.Random(9)
    order = sorted(rng.sample(range(1 << 60), len(rows)))
    df = spark.createDataFrame([(*r[:4], o) for r, o in zip(rows, order, strict=True)], LINK).repartition(4)
    assert links(fl.link_corrections(df, block=8)) == expected_links(rows)


def test_correction_links_scan_little(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["jn4_correction_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    body = plan.split("== Initial Plan ==")[0]
    assert body.count("Scan parquet") <= 8 and body.count("Exchange hashpartitioning") <= 11
