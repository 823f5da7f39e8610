"""Sources, sinks, archives and streams: odd inputs, closed days, repeats, losses and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from docketry import vocab
from docketry.operators import archive as ar, corpus as cp
from docketry.sources import partitions as pt, registry as src
from docketry.streaming import ingest as ing


def test_registry_with_missing_tags(spark, tmp_path):
    (tmp_path / "corp.xml").write_text(
        "<result><list><corp_code>00000001</corp_code><corp_name> 가나 </corp_name><stock_code>000100</stock_code></list>"
        "<list><corp_code>00000002</corp_code><corp_name>다라</corp_name></list></result>",
        encoding="utf-8",
    )
    rows = src.read_issuer_registry(spark, str(tmp_path / "corp.xml")).collect()
    assert sorted(tuple(r) for r in rows) == [("00000001", "가나", "000100"), ("00000002", "다라", "")]


def test_unreadable_statement_documents_are_skipped(spark, tmp_path):
    good = {"ticker": "005490", "years": {"2024": {"status": "OK", "fsDiv": "CFS", "coverage": 0.9, "values": {"revenue": 100945394185079, "grossProfit": "NOT_AVAILABLE"}}, "2025": {"status": "NO_DATA"}}}
    (tmp_path / "005490.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "000001.json").write_text('{"ticker": "000001", "years"')
    (tmp_path / "000002.json").write_text('{"ticker": "000002"}')
    got = {(r.code, r.year): (r.status, r["values"]) for r in src.read_financial_documents(spark, str(tmp_path)).collect()}
    assert got == {("005490", 2024): ("OK", {"revenue": "100945394185079", "grossProfit": "NOT_AVAILABLE"}), ("005490", 2025): ("NO_DATA", None)}


def test_target_list_keeps_order_and_first_appearance(spark, tmp_path):
    (tmp_path / "t.txt").write_text("000300\n# 000999\n000100 # note\nabc\n12345\n\n000300\n000200\n")
    rows = src.read_target_list(spark, str(tmp_path / "t.txt")).orderBy("ord").collect()
    assert [r.code for r in rows] == ["000300", "000100", "000200"]


def test_script_literal(spark, tmp_path):
    (tmp_path / "t.js").write_text('// const TICKERS = [];\nconst TICKERS = [\n {"code": "005930", "name": "삼성전자"} ];\n', encoding="utf-8")
    schema = "code string, name string"
    assert [tuple(r) for r in src.read_script_literal(spark, str(tmp_path / "t.js"), "TICKERS", schema).collect()] == [("005930", "삼성전자")]
    assert src.read_script_literal(spark, str(tmp_path / "t.js"), "OTHER", schema).count() == 0


def test_evidence_rows_without_id_date_or_title_are_skipped(spark):
    rows = [("1", [("r1", "20260102", "A  B "), ("", "20260102", "A"), ("r2", "x", "A"), ("r3", "20260102", None)]), ("1", []), ("9", [("r4", "20260102", "A")])]
    ev = spark.createDataFrame(rows, "ticker string, comparisonFindings array<struct<id:string,receivedOn:string,title:string>>")
    got = src.evidence_to_filings(ev, spark.createDataFrame([("1",)], "code string")).collect()
    assert [(r.rcept_no, r.title, str(r.received_on)) for r in got] == [("r1", "A B", "2026-01-02")]


RECORD = "day string, rcept_no string, title string, seq bigint"


def test_upsert_replaces_known_keys_and_refuses_closed_days(spark, tmp_path):
    path = str(tmp_path / "days")
    first = spark.createDataFrame([("2026-01-02", "a", "old", 1), ("2026-01-02", "b", "b", 2), ("2026-01-03", "c", "c", 3)], RECORD)
    again = spark.createDataFrame([("2026-01-02", "a", "mid", 4), ("2026-01-02", "a", "new", 5), ("2026-01-02", "d", "d", 6)], RECORD)
    assert {r.day: (r.added, r.replaced) for r in pt.upsert_day(spark, path, first, "rcept_no", "seq", "2026-01-02").collect()} == {"2026-01-02": (2, 0), "2026-01-03": (1, 0)}
    assert {r.day: (r.added, r.replaced) for r in pt.upsert_day(spark, path, again, "rcept_no", "seq", "2026-01-02").collect()} == {"2026-01-02": (1, 1)}
    rows = spark.read.schema(RECORD).parquet(path)
    assert sorted((r.day, r.rcept_no, r.title) for r in rows.collect()) == [
        ("2026-01-02", "a", "new"), ("2026-01-02", "b", "b"), ("2026-01-02", "d", "d"), ("2026-01-03", "c", "c")
    ]
    with pytest.raises(PermissionError):
        pt.upsert_day(spark, path, first, "rcept_no", "seq", "2026-01-03")


def test_contract_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([("1", 2, None), ("1", 3, "x"), ("2", 4, "y")], "code string, n int, t string")
    a = pt.product_contract({"p": df.repartition(5)}, "v1").first()
    b = pt.product_contract({"p": df.coalesce(1).orderBy(F.desc("n"))}, "v1").first()
    assert a == b and (a.rows, a.companies) == (3, 2) and a.record_id == f"v1:p:{a.sha256[:16]}"
    c = pt.product_contract({"p": df.withColumn("n", F.col("n") + 1)}, "v1").first()
    assert c.sha256 != a.sha256


def test_audit_finds_every_kind_of_damage(spark):
    cols = "day string, rcept_no string, detected_at string, source string"
    rows = [("2026-01-01", "a", "t1", "s"), ("2026-01-01", "b", "t2", "s"), ("2026-01-02", "c", "t3", "s"), ("2026-01-03", "d", "t4", "s")]
    good = ar.partition_stats(spark.createDataFrame(rows, cols), "rcept_no", "detected_at", ("source",))
    manifests = ar.build_manifests(good, good.limit(0), F.lit("2026-01-03"))
    assert {r.day for r in manifests.collect()} == {"2026-01-01", "2026-01-02"}
    assert {tuple(r) for r in ar.audit_archive(good, manifests, ("source",)).collect()} == {("2026-01-03", "NO_MANIFEST")}
    bad_rows = [("2026-01-01", "a", None, ""), ("2026-01-01", "a", "t2", "s"), ("2026-01-01", "b", "t2", "s")]
    bad = ar.partition_stats(spark.createDataFrame(bad_rows, cols), "rcept_no", "detected_at", ("source",))
    got = {tuple(r) for r in ar.audit_archive(bad, manifests, ("source",)).collect()}
    assert got == {
        ("2026-01-01", "COUNT 3 != 2"), ("2026-01-01", "DIGEST"), ("2026-01-01", "DUPLICATE_KEYS 1"), ("2026-01-01", "MISSING_STAMP 1"),
        ("2026-01-01", "MISSING source 1"), ("2026-01-02", "NO_PARTITION"),
    }
    month = ar.monthly_rollup(bad, ar.audit_archive(bad, manifests, ("source",))).first()
    assert (month.month, month.status) == ("2026-01", "ARCHIVE_INTEGRITY_ERROR")


def test_versions_are_counted_when_the_record_type_has_them(spark):
    rows = [("d", "a", "t", "v2"), ("d", "b", "t", "v1"), ("d", "c", "t", None), ("d", "a", "t", "v2")]
    row = ar.partition_stats(spark.createDataFrame(rows, "day string, k string, ts string, v string"), "k", "ts", (), version="v").first()
    assert (row.versions, row.missing_version, row.duplicate_keys) == (["v1", "v2"], 1, 1)


LINES = {
    "2026-01-01": b'{"k":1,"v":"a","extra":{"x":[1]}}\n{"k":2,"v\n{"k":3,"v":"c"}\r\n\xff\xfe\n{"k":3,"v":"c"}\r\n',
    "2026-01-02": b'{"k":4}\n\n{"k":4}\n',
    "2026-01-03": b'{"k":5}\n',
}


def archive_of(tmp_path):
    for day, data in LINES.items():
        folder = tmp_path / "raw" / f"day={day}"
        folder.mkdir(parents=True)
        (folder / "a.jsonl").write_bytes(data)
    return [str(tmp_path / n) for n in ("raw", "packed", "manifest")]


def unpacked(folder):
    import gzip

    return sorted(x for p in folder.glob("*.gz") for x in gzip.decompress(p.read_bytes()).split(b"\n")[:-1])


def test_compaction_keeps_every_byte_of_every_line(spark, tmp_path):
    raw, packed, manifest = archive_of(tmp_path)
    done = {r.day: r for r in pt.compact_days(spark, raw, packed, manifest, "2026-01-03").collect()}
    assert {d: (r.record_count, r.raw_bytes, r.status) for d, r in done.items()} == {
        d: (LINES[d].count(b"\n"), len(LINES[d]), "OK") for d in ("2026-01-01", "2026-01-02")
    }
    assert all(r.compression_ratio == round(r.compressed_bytes / r.raw_bytes, 4) for r in done.values())
    for day in done:
        assert unpacked(tmp_path / "packed" / f"day={day}") == sorted(LINES[day].split(b"\n")[:-1])
    pt.remove_proven(spark.read.schema(pt.MANIFEST_SCHEMA).parquet(manifest), raw, packed)
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["day=2026-01-03"]
    # A proven day is closed: late lines do not replace its copy.
    (tmp_path / "raw" / "day=2026-01-01").mkdir()
    (tmp_path / "raw" / "day=2026-01-01" / "late.jsonl").write_bytes(b'{"k":9}\n')
    assert [r.day for r in pt.compact_days(spark, raw, packed, manifest, "2026-01-04").collect()] == ["2026-01-03"]
    assert len(unpacked(tmp_path / "packed" / "day=2026-01-01")) == 5


def test_late_lines_are_archived_and_reported(spark, tmp_path, monkeypatch):
    raw, packed, manifest = archive_of(tmp_path)
    late, late_manifest = str(tmp_path / "late"), str(tmp_path / "late_manifest")
    take = lambda: {(r.run, r.day): (r.record_count, r.status) for r in pt.compact_late(spark, raw, packed, late, manifest, late_manifest, "2026-01-03").collect()}
    archived = lambda: {d: sorted(bytes(r.v) for r in pt.read_archive(spark, packed, late).where(F.col("day") == d).select(F.col("value").cast("binary").alias("v")).collect()) for d in LINES if d < "2026-01-03"}
    pt.compact_days(spark, raw, packed, manifest, "2026-01-03")
    assert take() == {}
    pt.remove_proven(spark.read.schema(pt.MANIFEST_SCHEMA).parquet(manifest).where("day = '2026-01-02'"), raw, packed)
    (tmp_path / "raw" / "day=2026-01-02").mkdir()
    # The first source is still there and has a surplus, also of a line it held before; the second one was removed.
    (tmp_path / "raw" / "day=2026-01-01" / "late.jsonl").write_bytes(b'{"k":9}\n\xff\xfe\n')
    (tmp_path / "raw" / "day=2026-01-02" / "late.jsonl").write_bytes(b'{"k":4}\n{"k":5}\n{"k":5}\n')
    # A run that stops before its rows are written is repeated under the same number.
    with monkeypatch.context() as stop:
        stop.setattr(pt, "row_hash", lambda *_: F.raise_error(F.lit("lost")).cast("decimal(38,0)"))
        with pytest.raises(Exception, match="lost"):
            take()
    assert take() == {(1, "2026-01-01"): (2, "OK"), (1, "2026-01-02"): (3, "OK")}
    want = {d: sorted(LINES[d].split(b"\n")[:-1]) for d in ("2026-01-01", "2026-01-02")}
    want["2026-01-01"] = sorted([*want["2026-01-01"], b'{"k":9}', b"\xff\xfe"])
    want["2026-01-02"] = sorted([*want["2026-01-02"], b'{"k":4}', b'{"k":5}', b'{"k":5}'])
    assert archived() == want
    pt.remove_late(spark.read.schema(pt.LATE_SCHEMA).parquet(late_manifest), raw, late)
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["day=2026-01-03"] and take() == {} and archived() == want
    # A copy that was damaged since shows in the sum.
    (tmp_path / "raw" / "day=2026-01-01").mkdir()
    (tmp_path / "raw" / "day=2026-01-01" / "late.jsonl").write_bytes(b"x\n")
    for p in (tmp_path / "packed" / "day=2026-01-01").glob("*.gz"):
        p.write_bytes(__import__("gzip").compress(b"{}\n"))
    for p in (tmp_path / "packed" / "day=2026-01-01").glob(".*.crc"):
        p.unlink()
    assert take() == {(2, "2026-01-01"): (1, "ARCHIVE_INTEGRITY_ERROR")}


def test_a_damaged_copy_is_reported_and_its_source_stays(spark, tmp_path):
    import gzip

    raw, packed, _ = archive_of(tmp_path)
    lines = pt.read_lines(spark, raw)
    pt.copy_days(lines, packed)
    for day, text in (("2026-01-01", b'{"k":1,"v":"a"}\n{}\n{"k":3}\n{}\n{}\n'), ("2026-01-02", b'{"k":4}\n{"k":4}\n')):
        for p in (tmp_path / "packed" / f"day={day}").glob("*"):
            p.unlink()
        (tmp_path / "packed" / f"day={day}" / "x.txt.gz").write_bytes(gzip.compress(text))
    proved = pt.prove_days(lines, packed)
    assert {r.day: r.status for r in proved.collect()} == {
        "2026-01-01": "ARCHIVE_INTEGRITY_ERROR", "2026-01-02": "ARCHIVE_INTEGRITY_ERROR", "2026-01-03": "OK"
    }
    pt.remove_proven(pt.cut_lineage(proved, "proved"), raw, packed)
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["day=2026-01-01", "day=2026-01-02"]
    assert sorted(p.name for p in (tmp_path / "packed").glob("day=*")) == ["day=2026-01-03"]


def test_rules_at_the_edge_of_a_sentence(spark):
    df = spark.createDataFrame([(1, "all", "Fine. Buy now. End"), (2, "all", None)], "id int, collection string, text string")
    rules = (cp.Rule("start", "^Buy"), cp.Rule("last", r"now\.$"), cp.Rule("plain", "End"))
    assert {(r.id, r.sentence_no, r.label) for r in cp.scan_sentences(df, rules).collect()} == {(1, 1, "start"), (1, 1, "last"), (1, 2, "plain")}
    risk = cp.RiskRules(risk="^Buy", estimate="nothing", sentence_end=r"(?<=[.])\s+")
    assert df.select(cp.clean_text(F.col("text"), risk)["text"]).first()[0] == "Fine. End"
    free = {r"a[^b]c": True, r"(?:x|y)+": True, "^a": False, "a$": False, r"\ba": False, "(?=a)": False, "(?i)a": False, r"\[^a": False, "a*+": False}
    assert {p: cp.context_free(p) for p in free} == free


def test_content_rules_on_korean_sentences(spark):
    rows = [
        (1, "study", "좋다. 투자의견은 없다.\n증권사는 매출 3조 원을 예상했다."), (2, "lesson", "투자의견이다. KBS 다큐 요약이다."), (3, "study", "평범하다."),
    ]
    got = {(r.id, r.sentence_no, r.label) for r in cp.scan_sentences(spark.createDataFrame(rows, "id int, collection string, text string")).collect()}
    assert got == {(1, 1, "투자의견 문장"), (1, 2, "증권사·시장 실적 추정치"), (2, 1, "방송·다큐 요약 글(제3자 저작물)")}


def test_sealed_rows_cannot_be_moved_and_need_a_key(spark):
    key, label = F.lit("k" * 32).cast("binary"), F.lit("event|2026-01-01")
    df = spark.range(1).select(ar.seal(F.lit("secret"), key, label).alias("b"), ar.seal(F.lit("secret"), key, label).alias("c"))
    row = df.select(
        ar.unseal(F.col("b"), key, label).alias("ok"), ar.unseal(F.col("b"), key, F.lit("event|2026-01-02")).alias("moved"),
        ar.unseal(F.col("b"), F.lit("x" * 32).cast("binary"), label).alias("other"), (F.col("b") == F.col("c")).alias("same"),
    ).first()
    assert (row.ok, row.moved, row.other, row.same) == ("secret", None, None, False)
    with pytest.raises(Exception, match="key missing"):
        spark.range(1).select(ar.seal(F.lit("x"), F.lit(None).cast("binary"), label)).collect()


STUDY = """# 회사 공부 — PER 12.3배
## 목표주가는 5만원
첫 문장이다. 목표주가 5만원을 제시했다. 다음 문장이다.
- 순매수 3일째
- 평범한 줄
시장은 매출 10조를 전망하며 웃었다.
시장 예상을 웃돌았다.
## 컨센서스
"""


def test_cleaning_removes_sentences_and_empty_headings(spark):
    row = spark.createDataFrame([(STUDY,)], "t string").select(cp.clean_text(F.col("t")).alias("c")).first().c
    assert row.text == "# 회사 공부\n첫 문장이다. 다음 문장이다.\n- 평범한 줄\n시장 예상을 웃돌았다."
    assert row.removed == 6


def test_retention_classes(spark):
    rows = [(1, "좋은 글이다.", "요약"), (2, "좋은 글이다. 좋은 글이다. 순매수다.", "요약"), (3, "순매수다. 가.", "요약"), (4, None, None)]
    got = {r.id: (r.classification, r.removed) for r in cp.sanitize(spark.createDataFrame(rows, "id int, body string, summary string")).collect()}
    assert got == {1: ("SAFE_AS_IS", 0), 2: ("SANITIZE_AND_RESTORE", 1), 3: ("PRIVATE_ONLY", 1), 4: ("SAFE_AS_IS", 0)}


def test_record_validator_on_korean_wording(spark):
    rows = [
        ("ok", "2025년 3분기를 보았다", ["가지 않은 길"], ["나"], "2026-01-01", {"a": "ORIGINAL_RESTATED", "b": "EDIT_SUPPLEMENT"}),
        ("bad", "PER 12", [], ["매수를 권한다"], "2026", {"a": "X", "b": "EDIT_SUPPLEMENT"}),
    ]
    df = spark.createDataFrame(rows, "record_id string, title string, a array<string>, b array<string>, edited_at string, section_origin map<string,string>")
    got = {(r.record_id, r.problem) for r in cp.validate_records(df, ("a", "b")).collect()}
    assert got == {
        ("bad", "digit:PER 12"), ("bad", "forbidden[PER]:PER 12"), ("bad", "empty:a"), ("bad", "edited_at"), ("bad", "section_origin:a"),
        ("bad", "forbidden[매수]:매수를 권한다"), ("bad", "forbidden[권한다]:매수를 권한다"),
    }


def test_record_classes_reasons_and_edits(spark):
    rows = [
        ("public", None, None, None, None, ["PER 3"]), ("private", "PRIVATE_ONLY", "r", ["SCORE"], None, []), ("odd", "X", "", ["PRICE", None], None, []),
        ("dated", "SAFE_AS_IS", "r", [], "2026-01-01", []),
    ]
    df = spark.createDataFrame(rows, "record_id string, classification string, reason string, removed array<string>, edited_at string, a array<string>")
    df = df.withColumn("title", F.lit("t")).withColumn("section_origin", F.lit(None).cast("map<string,string>"))
    assert {(r.record_id, r.problem) for r in cp.validate_records(df, ("a",)).collect()} == {
        ("public", "digit:PER 3"), ("public", "forbidden[PER]:PER 3"), ("odd", "classification"), ("odd", "reason"), ("odd", "removed:PRICE"),
        ("odd", "removed:"), ("dated", "section_origin:a"),
    }


SCHEMA = "code string, rcept_no string, title string"


def rows(spark, *names):
    return spark.createDataFrame([("1", f"2026010{n}000001", f"t{n}") for n in names], SCHEMA)


class LosingStore(ing.FilingStore):
    """Storage that keeps only some of what it is given."""

    keeps = "true"

    def _store(self, rows, batch):
        super()._store(rows.where(self.keeps), batch)


def test_lost_rows_stay_pending_and_are_taken_again(spark, tmp_path):
    store = LosingStore(spark, str(tmp_path), SCHEMA)
    tracked = spark.createDataFrame([("1",)], "code string")
    store.keeps = "title <> 't2'"
    store.ingest(rows(spark, 1, 2), 0, tracked)
    store.keeps = "true"
    assert [r.rcept_no for r in store.unconfirmed().collect()] == ["20260102000001"]
    store.ingest(rows(spark, 1, 2, 3), 1, tracked)
    assert store.unconfirmed().count() == 0
    assert store.filings.read_run(1).count() == 2                                   # the acknowledged row is skipped
    assert sorted(r.title for r in store.rows().collect()) == ["t1", "t2", "t3"]
    days = [p.parent for p in (tmp_path / "states").glob("run=*/part=*/*.parquet")]
    assert len(days) == len(set(days)) == 4                                          # one state file per day and batch


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    store = LosingStore(spark, str(tmp_path), SCHEMA)
    tracked = spark.createDataFrame([("1",)], "code string")
    untracked = spark.createDataFrame([("2", "20260109000001", "x"), ("1", "", "y")], SCHEMA)
    store.keeps = "false"
    store.ingest(rows(spark, 1, 2).unionByName(untracked), 0, tracked)
    store.keeps = "true"
    assert store.states().where(F.col("state") == vocab.PENDING).count() == 2
    for _ in range(2):
        store.ingest(rows(spark, 1, 2).unionByName(untracked), 0, tracked)
        assert store.rows().count() == 2 and store.unconfirmed().count() == 0


def test_stream_restart_reads_only_new_files(spark, tmp_path):
    base = str(tmp_path)
    seen = []
    for n in (1, 2):
        rows(spark, n).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = ing.read_files(spark, f"{base}/in", SCHEMA)
        ing.run_available(stream, f"{base}/cp", lambda df, i: seen.append(sorted(r.title for r in df.collect())))
    assert seen == [["t1"], ["t2"]]


def test_products_need_a_complete_run(spark):
    from docketry.products import NoCompleteCheck, freshness

    cols = "source string, finished_at timestamp, status string, event_state string, window_start date, window_end date"
    import datetime as dt

    at = dt.datetime(2026, 9, 20, 10, tzinfo=dt.timezone.utc)
    bad = ("list", at, "OK", "EVENT_COVERAGE_INCOMPLETE", dt.date(2026, 9, 19), dt.date(2026, 9, 20))
    good = ("list", at - dt.timedelta(days=1), "OK", "NO_OFFICIAL_EVENT_DETECTED", dt.date(2026, 9, 13), dt.date(2026, 9, 14))
    with pytest.raises(NoCompleteCheck):
        freshness(spark.createDataFrame([bad], cols))
    row = freshness(spark.createDataFrame([bad, good], cols))
    assert row.window_end == dt.date(2026, 9, 14) and row.covered_until.timestamp() == dt.datetime(2026, 9, 14, 15, tzinfo=dt.timezone.utc).timestamp()


def test_arrivals_leave_no_row_out(spark, tmp_path):
    import datetime as dt

    from docketry.plans.streams import arrivals

    days = [dt.date(2019, 5, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2027, 1, 1), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, received_on date")
    for again, times in ((0, 1), (1, 1)):
        path = str(tmp_path / f"again{again}")
        assert sum(1 for _ in arrivals(path, df, again)) == 3
        got = sorted(r.id for r in spark.read.schema("id int").parquet(path).collect())
        assert got == list(range(len(days))) * times
    assert sum(1 for _ in arrivals(str(tmp_path / "none"), df.limit(0))) == 1
