"""Runs of micro-batches, late rows of any age, and the work of a batch on a growing history."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docketry import vocab
from docketry.operators.filings import link_corrections
from docketry.streaming import ingest as ing
from docketry.streaming.runs import RunTable, latest_of

SCHEMA = "rcept_no string, title string, detected_at timestamp"
DAY = "substring(rcept_no, 1, 8)"


def events(spark, *days):
    rows = [(f"202401{d:02d}{n:06d}", f"t{n % 2}", dt.datetime(2024, 1, d, 12)) for d, n in days]
    return spark.createDataFrame(rows, SCHEMA)


def store(spark, path):
    return ing.EventStore(spark, str(path), SCHEMA, "rcept_no", "detected_at", DAY, "title")


def numbers(df):
    return sorted(r.rcept_no for r in df.collect())


def test_runs_carry_like_digits_and_replays_change_nothing(spark, tmp_path):
    table = RunTable(spark, str(tmp_path), "k int, v int", latest_of("k"), fan=2)
    for batch in range(11):
        for _ in range(1 + (batch in (3, 7, 8))):  # some batches run twice, after a merge too
            table.write(batch, spark.createDataFrame([(batch % 3, batch, "a"), (batch, batch, "b")], "k int, v int, part string"))
        want = {("a", k): max(b for b in range(batch + 1) if b % 3 == k) for k in range(min(3, batch + 1))}
        assert {(r.part, r.k): r.v for r in table.read().collect()} == want | {("b", b): b for b in range(batch + 1)}
        assert len(table.cover()) == bin(batch + 1).count("1")
    assert len(list(tmp_path.glob("run=*"))) <= 8
    assert {r.v for r in table.read(parts=["b"]).collect()} == set(range(11)) and table.read(before=10, parts=["b"]).count() == 10


def test_a_run_without_its_mark_is_not_there(spark, tmp_path):
    table = RunTable(spark, str(tmp_path), "k int")
    for batch in (0, 1):
        table.write(batch, spark.createDataFrame([(batch, "a")], "k int, part string"))
    (tmp_path / "run=000000001-000000001" / "_SUCCESS").unlink()
    assert [r.k for r in table.read().collect()] == [0] and table.next_batch() == 1


def test_late_rows_of_any_age_appear_and_are_listed(spark, tmp_path):
    kept = store(spark, tmp_path)
    for batch, days in enumerate([[(20, 1), (22, 2)], [(10, 3), (23, 4), (22, 2)], [(24, 5), (10, 3), (9, 6)]]):
        kept.ingest(events(spark, *days), batch)
    assert numbers(kept.rows()) == numbers(events(spark, (20, 1), (22, 2), (23, 4), (24, 5)))
    late = {r.rcept_no: (r.batch, r.taken, r.watermark.day) for r in kept.late_rows().collect()}
    assert late == {"20240109000006": (2, False, 22), "20240110000003": (1, False, 21)} or set(late) == {"20240109000006", "20240110000003"}
    assert kept.backfill(days=1) == 1 and numbers(kept.rows())[0] == "20240109000006"  # the oldest day first
    assert kept.backfill(days=1) == 0 and kept.backfill() == 0
    every = events(spark, (9, 6), (10, 3), (20, 1), (22, 2), (23, 4), (24, 5))
    assert numbers(kept.rows()) == numbers(every) and all(r.taken for r in kept.late_rows().collect())
    want = {(r.week, r.title): r.n for r in every.groupBy(F.to_date(F.date_trunc("week", "detected_at")).alias("week"), "title").agg(F.count("*").alias("n")).collect()}
    assert {(r.week, r.kind): r.n for r in kept.weekly_counts().collect()} == want
    kept.ingest(events(spark, (10, 3), (9, 6), (24, 5)), 3)  # repeats of rows taken late are repeats
    assert kept.backfill() == 0 and numbers(kept.rows()) == numbers(every)


def test_a_batch_that_stops_half_way_runs_again(spark, tmp_path):
    kept = store(spark, tmp_path)
    kept.ingest(events(spark, (20, 1)), 0)
    for stop in ("late", "counts", "marks"):
        broken = store(spark, tmp_path)
        setattr(getattr(broken, stop), "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            broken.ingest(events(spark, (21, 2), (2, 3)), 1)
        assert numbers(store(spark, tmp_path).rows()) == ["20240120000001"] and store(spark, tmp_path).backfill() == 0
    for _ in range(2):
        kept.ingest(events(spark, (21, 2), (2, 3)), 1)
    broken = store(spark, tmp_path)
    setattr(broken.done, "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        broken.backfill()
    assert kept.rows().count() == 2 and kept.backfill() == 0 and kept.rows().count() == 3
    assert sum(r.n for r in kept.weekly_counts().collect()) == 3


def test_odd_rows_of_a_stream(spark, tmp_path):
    kept = store(spark, tmp_path)
    odd = spark.createDataFrame([("", None, None), (None, "x", None), ("20240101000001", None, None)], SCHEMA)
    for batch, rows in enumerate((odd.limit(0), odd, odd, events(spark, (5, 1)))):
        kept.ingest(rows, batch)
    assert numbers(kept.rows()) == ["", "20240101000001", "20240105000001"] and kept.backfill() == 0
    assert {(r.week, r.n) for r in kept.weekly_counts().collect()} == {(None, 2), (dt.date(2024, 1, 1), 1)}


def test_a_batch_reads_only_its_days_and_files_stay_few(spark, tmp_path):
    filings = ing.FilingStore(spark, str(tmp_path), "code string, rcept_no string, title string")
    tracked = spark.createDataFrame([("1",)], "code string")
    read, files = [], []
    for batch in range(20):
        rows = [("1", f"2024{1 + batch // 28:02d}{1 + d:02d}{batch * 10 + n:06d}", "t") for n in range(3) for d in (batch % 28, 27)]
        filings.ingest(spark.createDataFrame(rows, "code string, rcept_no string, title string"), batch, tracked)
        now = filings.log.read(batch, [f"202401{1 + batch % 28:02d}"])
        read.append(len(now.inputFiles()))
        files.append(len(list((tmp_path / "filings").glob("run=*/part=*/*.parquet"))))
    assert filings.rows().count() == 20 * 6 and filings.unconfirmed().count() == 0
    assert max(read) <= 3 * 8 and max(len(filings.log.cover(b)) for b in range(21)) <= 9
    assert files[-1] <= files[7] + 28 + 16  # merged runs hold each day once; without merging it were 40


def test_stream_links_equal_batch_links_and_read_only_corrected_tickers(spark, tmp_path):
    rnd = random.Random(5)
    rows = []
    for seq in range(160):
        ticker, mark = rnd.choice("abcdefgh"), seq > 60 and rnd.random() < 0.3
        title = rnd.choice(["annual report", "merger decision", "notice", "annual report (draft)"])
        rows.append((ticker, f"202401{1 + seq // 16:02d}{seq:06d}", ("[정정] " if mark else "") + title, mark, seq))
    schema = "ticker string, rcept_no string, report_name string, is_correction boolean, seq bigint"
    linked = ing.LinkStore(spark, str(tmp_path), schema)
    sizes = []
    for batch in range(10):
        part = spark.createDataFrame(rows[batch * 16 : batch * 16 + 16], schema)
        sizes.append(linked.history(part.where("is_correction and ticker = 'a'"), batch).count())
        linked.ingest(part, batch)
    want = {r.rcept_no: (r.corrects_rcept_no, r.correction_candidates) for r in link_corrections(spark.createDataFrame(rows, schema)).collect()}
    assert {r.rcept_no: (r.corrects_rcept_no, r.correction_candidates) for r in linked.links().collect()} == want
    assert any(v[1] for v in want.values()) and any(v[0] not in (None, vocab.NOT_AVAILABLE) for v in want.values())
    assert max(sizes) <= 8  # titles of one ticker, whatever the number of batches
    assert len(linked.titles.cover()) <= 9
