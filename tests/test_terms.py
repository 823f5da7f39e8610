"""Vocabularies as tables against the constant forms, with many terms, and the literals that rules need."""

import random
import re
import time

import pytest

from docketry.operators import classify as cl, corpus as cp, events as ev, terms as tm
from docketry.plans import standins as sv

TITLES = [
    "small red widget (old)", "[정정] blue gear report", "red widget or blue gear", "PROMO small PROMO (LARGE (old))", "", None, "nothing here",
    "hot bolt new cold gizmo", "blue  gear[x]", "red", "합병 결정", "합병등 종료보고서(합병)", "회사분할 또는 합병", "a", "분할합병결정 (자회사)",
]
CATEGORIES = sv.PART_CATEGORIES + (cl.Category("merge", "Merger", ("합병", "분할합병 ", "a")), cl.Category("split", "Split", ("분할",)), cl.Category("none", "None", (" ", "absent")))


def titles(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TITLES * 2)]
    return spark.createDataFrame(rows, "id int, title string, word string, ord int, key string").repartition(3)


def term_table(spark, categories):
    rows = [(i, c.key, c.form, w) for i, c in enumerate(categories) for w in c.terms]
    return spark.createDataFrame(rows, "ord int, key string, form boolean, word string")


def as_set(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("or_word", ["or", "또는"])
def test_table_classification_equals_the_constant_form(spark, or_word):
    df = titles(spark)
    fields = ["id", "title", "word", "ord", "key", "category", "category_tags", "category_tie"]
    own = tm.classify_by_table(df, "title", term_table(spark, CATEGORIES), or_word)
    assert as_set(own.select(fields)) == as_set(cl.classify_titles(df, "title", CATEGORIES, or_word).select(fields))
    assert own.columns == df.columns + fields[-3:] or set(own.columns) == set(fields)


def test_table_glossary_and_stages_equal_the_constant_forms(spark):
    df = titles(spark)
    entries = tuple(cl.GlossaryEntry(f"k{i}", "", "", (w,)) for i, w in enumerate(("red", "red widget", "gear", "blue", "합병", "합병등", "a", "")))
    patterns = spark.createDataFrame([(i, e.key, e.patterns[0]) for i, e in enumerate(entries)], "ord int, key string, word string")
    own = tm.glossary_by_table(df, "title", patterns).select("id", "entry_key")
    assert as_set(own) == as_set(df.select("id", cl.glossary_key("title", cl.Glossary(entries)).alias("entry_key")))
    chains = (
        ev.Chain("c1", "C", (ev.Stage("s1", "S", ("gear", "합병")), ev.Stage("s2", "S", ("red", "분할")))), ev.Chain("c2", "D", (ev.Stage("s1", "T", ("blue gear", "old")),)),
    )
    rows = [(c.key, i, s.stage, s.label, j, p) for i, c in enumerate(chains) for j, s in enumerate(c.stages) for p in s.patterns]
    stages = spark.createDataFrame(rows, "chain string, chain_ord int, stage string, stage_label string, stage_ord int, word string")
    assert as_set(tm.stages_by_table(df, stages)) == as_set(ev.match_stages(df, chains))


def test_no_terms_and_no_titles(spark):
    none, empty = term_table(spark, ()), titles(spark).limit(0)
    assert {r.category for r in tm.classify_by_table(titles(spark), "title", none).collect()} == {"other"}
    assert tm.classify_by_table(empty, "title", term_table(spark, CATEGORIES)).count() == 0
    assert tm.term_hits(titles(spark), "title", none).count() == 0


def test_fifty_thousand_terms(spark):
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = {"".join(rnd.choices(letters, k=rnd.randint(6, 12))) for _ in range(50_000)} | {"q", "zz"}
    some = rnd.sample(sorted(terms), 300)
    texts = [" ".join(rnd.choices(some, k=3)) + "".join(rnd.choices(letters, k=20)) for _ in range(500)]
    table = spark.createDataFrame([(w,) for w in terms], "word string").repartition(8)
    start = time.time()
    found = {(r.text, r.word) for r in tm.term_hits(spark.createDataFrame([(t,) for t in texts], "text string"), "text", table).collect()}
    assert time.time() - start < 60
    pieces = [{t[i : i + n] for i in range(len(t)) for n in (1, 2, *range(6, 13)) if i + n <= len(t)} for t in texts]
    assert found == {(t, w) for t, own in zip(texts, pieces) for w in own & terms}


def test_hits_by_key_carry_no_text(spark):
    docs = spark.createDataFrame([(1, "the red gear " * 5000), (2, None), (3, ""), (4, "gear")], "id int, text string")
    words = spark.createDataFrame([("gear",), ("red gear",), ("",), (None,), ("g",)], "word string")
    assert {(r.id, r.word) for r in tm.term_hits(docs, "text", words, key="id").collect()} == {(1, "gear"), (1, "red gear"), (1, "g"), (4, "gear"), (4, "g")}


LITERALS = {
    "^The [a-z]+": "The ", r"[a-z]+ing[.]$": "ing.", "abc": "abc", "a|b": None, "(?i)abc": None, "x*": None, "(?:foo)+bar": "foo", r"foo(bar)?baz": "foo",
    r"\bword\b": "word", "(?=look)ahead": "ahead", "(a|b)cd": "cd", r"\d+ won": " won", "[abc]": None, "a{0,3}bb": "bb", "(": None, "(?i:ab)c": "c", "매수\\s*의견": "매수",
}


def test_required_literals():
    assert {p: cp.required_literal(p) for p in LITERALS} == LITERALS
    rnd = random.Random(7)
    for pattern, literal in LITERALS.items():
        if literal:
            for _ in range(300):
                text = "".join(rnd.choices(["The ", "ing.", "foo", "bar", "baz", "a", "b", "cd", " won", "7", "word", " ", "ahead", "look", "매수", "의견"], k=6))
                assert not (match := re.search(pattern, text)) or literal in match[0] or literal in text


def test_rules_are_prefiltered_one_by_one(spark):
    rules = (cp.Rule("start", "^Buy"), cp.Rule("free", r"a[0-9]+", "study"), cp.Rule("any", r"^\d"), cp.Rule("word", r"\bxy\b"))
    rows = [(1, "study", "Fine. Buy a12 now.\n7 up"), (2, "lesson", "a12. Buy"), (3, "study", "none at all"), (4, "study", None), (5, None, "xy. axyb"), (6, "study", "")]
    got = {(r.id, r.sentence_no, r.label) for r in cp.scan_sentences(spark.createDataFrame(rows, "id int, collection string, text string"), rules).collect()}
    want = set()
    for number, scope, text in rows:
        for at, sentence in enumerate(re.split(r"(?<=[.!?])\s+|\n", text or "")):
            want |= {(number, at, r.label) for r in rules if r.scope in ("all", scope) and re.search(r.pattern, sentence)}
    assert got == want


def test_default_leak_rules(spark):
    rows = [
        ("a.py", "key sk-" + "a1" * 20), ("docs/a.md", "see tossinvest.com and ghp_" + "x" * 30), ("b.py", "tossinvest.com"), ("test_b.py", "buying-power"),
        ("c.bin", "tossinvest.com"), ("x/history.js", ""), ("snap/1.html", "gtag(1)"), ("d.html", '<script src="//evil.example.com/a.js">'), ("e.html", '<script src="//gc.zgo.at/count.js">'),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    assert {(r.path, r.label) for r in cp.scan_files(df).collect()} == {
        ("a.py", "secret"), ("docs/a.md", "secret"), ("b.py", "account"), ("x/history.js", "retired"), ("snap/1.html", "retired"),
    }
    assert {(r.path, r.label) for r in cp.scan_site(df, r"\.(html|md)$").collect()} == {
        ("a.py", "not_allowed"), ("b.py", "not_allowed"), ("test_b.py", "not_allowed"), ("c.bin", "not_allowed"), ("x/history.js", "not_allowed"),
        ("docs/a.md", "secret"), ("docs/a.md", "account"), ("snap/1.html", "tracking"), ("d.html", "external_script"),
    }
