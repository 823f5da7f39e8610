"""Title rules on Korean filing titles: categories, glossary, corporate actions, event states."""

from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.functions.actions import action_facts, effect_states, in_scope, unresolved
from docketry.operators.classify import (
    Category, Glossary, GlossaryEntry, classify_titles, explain_titles, glossary_key, with_category_columns,
)
from docketry.operators.events import Chain, Stage, action_events, event_counts, match_stages, timelines

CATEGORIES = (
    Category("securities_filing", "증권신고", ("증권신고서", "증권발행실적"), form=True),
    Category("earnings", "실적", ("실적",)),
    Category("investment", "출자", ("출자",)),
    Category("group", "기업집단", ("특수관계인", "동일인등 출자", "계열회사")),
    Category("merger_split", "합병·분할", ("합병", "분할", "자산 양수")),
    Category("guarantee", "담보", ("담보제공",)),
    Category("major_shareholder", "최대주주", ("최대주주변경",)),
    Category("trading_status", "거래정지", ("매매거래정지",)),
    Category("rumor", "풍문", ("풍문",)),
    Category("capital_reduction", "감자·액면", ("액면분할",)),
    Category("capital_increase", "증자", ("유상증자",)),
    Category("equity_linked_bond", "사채", ("주식관련사채",)),
    Category("contract", "계약", ("공급계약",)),
)
GOLDEN = {
    "증권발행실적보고서": ("securities_filing", [], False),
    "특수관계인에대한출자": ("investment", ["group"], False),
    "특수관계인으로부터자산양수": ("merger_split", ["group"], False),
    "동일인등출자계열회사와의상품ㆍ용역거래": ("group", [], False),
    "최대주주변경을수반하는주식담보제공계약체결": ("guarantee", ["major_shareholder"], False),
    "주권매매거래정지 (풍문 또는 보도 관련)": ("trading_status", ["rumor"], False),
    "증권신고서(합병)": ("merger_split", ["securities_filing"], False),
    "주권매매거래정지해제 (액면분할 주권 변경상장)": ("trading_status", ["capital_reduction"], False),
    "유상증자또는주식관련사채등의발행결과(자율공시)": ("capital_increase", ["equity_linked_bond"], True),
    "[기재정정]단일판매ㆍ공급계약체결": ("contract", [], False),
    "아무 말": ("other", [], False),
    "": ("other", [], False),
}


def titles(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "title string")


def test_golden_categories(spark):
    rows = classify_titles(titles(spark, GOLDEN), "title", CATEGORIES).collect()
    got = {r.title: (r.category, r.category_tags, r.category_tie) for r in rows}
    assert got == GOLDEN


def test_null_title_is_other(spark):
    row = classify_titles(titles(spark, [None]), "title", CATEGORIES).first()
    assert (row.category, row.category_tags, row.category_tie) == ("other", [], False)


def test_same_rank_is_a_tie_in_category_order(spark):
    cats = (Category("b", "B", ("합병",)), Category("a", "A", ("합병",)))
    row = classify_titles(titles(spark, ["회사합병"]), "title", cats).first()
    assert (row.category, row.category_tags, row.category_tie) == ("b", ["a"], True)


def test_product_columns_are_null_when_absent(spark):
    rows = {r.title: r for r in with_category_columns(titles(spark, GOLDEN), "title", CATEGORIES).collect()}
    assert rows["증권발행실적보고서"].category_tags is None
    assert rows["증권발행실적보고서"].category_ambiguous is None
    assert rows["유상증자또는주식관련사채등의발행결과(자율공시)"].category_ambiguous is True


def test_bracket_depths(spark):
    df = spark.createDataFrame([("a(b(c)d)e",), (")x(",), ("plain",)], "t string")
    got = [r[0] for r in df.select(tx.bracket_depths("t")).collect()]
    assert got == [[0, 0, 1, 1, 2, 1, 1, 0, 0], [0, 0, 0], [0] * 5]


def test_longest_pattern_wins_and_order_breaks_ties(spark):
    glossary = Glossary((
        GlossaryEntry("a", "A", "a", ("공급", "계약")), GlossaryEntry("b", "B", "b", ("공급 계약",)), GlossaryEntry("c", "C", "c", ("체결",)),
    ))
    df = titles(spark, ["공급계약 체결", "체결 계약", "없음"])
    assert [r[0] for r in df.select(glossary_key("title", glossary)).collect()] == ["b", "a", None]


def test_explanation_falls_back_to_catch_all_or_category(spark):
    glossary = Glossary((GlossaryEntry("other-general", "기타", "기타 공시", ()),), (("자율", "스스로 알림"),), "고친 공시")
    df = titles(spark, ["아무 말", "[정정]공급계약(자율)"]).withColumn("is_correction", F.lit(False))
    other, contract = explain_titles(df, "title", "is_correction", CATEGORIES, glossary).collect()
    assert other.entry_key == "other-general" and other.plain == "기타 공시"
    assert contract.entry_key is None and contract.plain is None and contract.notes == ["스스로 알림", "고친 공시"]


def facts(spark, title):
    return titles(spark, [title]).select(action_facts("title").alias("f")).first().f


def test_subject(spark):
    assert facts(spark, "유상증자결정(종속회사의주요경영사항)").subject == "SUBSIDIARY"
    assert facts(spark, "주요사항보고서(감자결정)").subject == "SELF"


def test_stage_precedence(spark):
    expected = {
        "[기재정정]주요사항보고서(감자결정)": "CORRECTION",
        "합병등종료보고서(합병)": "COMPLETION",
        "증권발행실적보고서(합병등)": "RESULT",
        "주요사항보고서(무상증자결정)": "DECISION",
        "[기재정정]유상증자결정 철회": "WITHDRAWN",
        "기타시장안내(상장폐지)": "NOTICE",
    }
    assert {t: facts(spark, t).stage for t in expected} == expected


def test_halt_and_release_needs_the_document(spark):
    assert facts(spark, "매매거래정지및정지해제(중요내용공시)   ").needs_document
    assert facts(spark, "감사보고서").needs_document
    assert not facts(spark, "주요사항보고서(감자결정)").needs_document


def test_scope_keeps_effects_and_extra_terms(spark):
    df = titles(spark, ["감자결정", "현금배당결정", "사업보고서", None])
    assert [r[0] for r in df.select(in_scope("title")).collect()] == [True, True, False, False]


def test_completion_closes_only_the_company_step(spark):
    df = spark.createDataFrame([(["COMPLETION"], ["PRICE", "SHARES"]), (["DECISION"], [])], "s array<string>, e array<string>")
    states = [r[0] for r in df.select(effect_states(F.col("s"), F.col("e"))).collect()]
    assert states[0] == {
        "CORPORATE_EVENT": "RESOLVED_CONFIRMED", "PRICE": "OPEN", "SHARES": "OPEN",
        "SHARE_COUNT": "NEEDS_EXCHANGE", "PRICE_BASIS": "NEEDS_EXCHANGE",
    }
    assert states[1] == {"CORPORATE_EVENT": "OPEN"}
    left = df.select(unresolved(effect_states(F.col("s"), F.col("e")))).first()[0]
    assert left == ["PRICE", "PRICE_BASIS", "SHARES", "SHARE_COUNT"]


def test_corrections_belong_to_one_event(spark):
    rows = [
        ("1", "R1", "주요사항보고서(감자결정)"), ("1", "R2", "[기재정정]주요사항보고서(감자결정)"), ("1", "R3", "[첨부정정]주요사항보고서(감자결정)"),
        ("2", "R4", "유상증자결정(종속회사의주요경영사항)"), ("3", None, "합병등종료보고서(합병)"), ("4", "R6", "감사보고서"),
    ]
    events = action_events(spark.createDataFrame(rows, "code string, id string, title string"))
    by_code = {r.code: r for r in events.collect()}
    assert len(by_code) == 4 and by_code["1"].document_count == 3 and by_code["1"].ids == ["R1", "R2", "R3"]
    assert by_code["3"].document_count == 0 and by_code["3"].ids == [] and by_code["3"].company_completed
    assert by_code["4"].family is None and by_code["4"].ids == ["R6"]
    counts = {r.code: r for r in event_counts(events).collect()}
    assert counts["1"].open_self == 1 and counts["2"].subsidiary == 1 and counts["2"].open_self == 0
    assert counts["3"].company_done_awaiting_exchange == 1


def test_only_the_first_twenty_ids_are_listed(spark):
    rows = [("1", f"R{i:03d}", "감자결정") for i in range(50)]
    row = action_events(spark.createDataFrame(rows, "code string, id string, title string")).first()
    assert row.document_count == 50 and row.ids == [f"R{i:03d}" for i in range(20)]


def test_timeline_names_the_stages_not_found(spark):
    chain = Chain("buyback", "자기주식", (
        Stage("PLANNED", "결정", ("자기주식 취득 결정",)), Stage("REPORTED", "보고", ("취득결과",)), Stage("COMPLETED", "완료", ("소각",)),
    ))
    rows = [("1", "A", "자기주식취득 결정", "2026-01-02"), ("1", "B", "[정정]자기주식 취득결정", "2026-01-05"), ("1", "C", "사업보고서", "2026-01-06")]
    df = spark.createDataFrame(rows, "code string, rcept_no string, title string, received_on string").withColumn(
        "received_on", F.to_date("received_on")
    )
    line = timelines(match_stages(df, (chain,)), (chain,)).first()
    assert line.items == 2 and line.stages_seen == ["PLANNED"] and line.stages_not_found == ["REPORTED", "COMPLETED"]
    assert line.latest_stage == "PLANNED" and str(line.latest_received_on) == "2026-01-05"
