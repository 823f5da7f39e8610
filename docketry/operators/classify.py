"""Title classification and glossary lookup by vocabulary.

The vocabularies are small configuration objects compiled into array literals, so classification is a
narrow projection: no join, no shuffle, and nothing is broadcast. Large vocabularies are tables: see ``terms``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docketry import vocab
from docketry.functions import text as tx


@dataclass(frozen=True)
class Category:
    """A filing category. ``form`` marks categories naming a document form rather than an event."""

    key: str
    label: str
    terms: tuple[str, ...]
    form: bool = False
    why: str = ""
    next: str = ""


@dataclass(frozen=True)
class GlossaryEntry:
    key: str
    name: str
    plain: str
    patterns: tuple[str, ...]
    what: str = ""
    why: str = ""


@dataclass(frozen=True)
class Glossary:
    entries: tuple[GlossaryEntry, ...]
    suffix_notes: tuple[tuple[str, str], ...] = ()
    correction_note: str = ""
    catch_all: str = vocab.CATCH_ALL_ENTRY


def literal_rows(rows: list[dict], schema: str) -> Column:
    """A constant array of structs; Catalyst folds it into a literal."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{schema}>>")


def classify_titles(df: DataFrame, title: str, categories: tuple[Category, ...], or_word: str = "또는") -> DataFrame:
    """Add ``category``, ``category_tags`` and ``category_tie``.

    Every overlapping vocabulary hit counts; a hit strictly inside a longer one is dropped. Events come
    before forms, outer brackets before inner ones, later hits before earlier ones, longer before shorter;
    category order breaks what is left. A title that says "A or B" names A first and flags the tie.
    """
    words = literal_rows(
        [
            {"ord": i, "key": c.key, "form": c.form, "word": w.replace(" ", "")}
            for i, c in enumerate(categories)
            for w in c.terms
            if w.replace(" ", "")
        ],
        "ord int, key string, form boolean, word string",
    )
    return classified(df, title, words, or_word)


def classified(df: DataFrame, title: str, words: Column, or_word: str = "또는") -> DataFrame:
    """The rules of ``classify_titles`` with the terms to look for as an array of (ord, key, form, word): a constant,
    or a column with the terms of each row's title (see ``terms``)."""
    text, depth, found = F.col("__text"), F.col("__depth"), F.col("__found")
    kept, ranked = F.col("__kept"), F.col("__ranked")

    def hits(v):
        width = F.length(v["word"])
        starts = F.filter(
            F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.substr(text, i, width) == v["word"]
        )
        return F.transform(
            starts,
            lambda i: F.struct(
                v["form"].alias("form"),
                F.element_at(depth, i).alias("depth"),
                (-(i + width)).alias("neg_stop"),
                (-width).alias("neg_width"),
                v["ord"].alias("ord"),
                v["key"].alias("key"),
                i.alias("start"),
                (i + width).alias("stop"),
            ),
        )

    def strictly_inside(m, o):
        return (o["start"] <= m["start"]) & (m["stop"] <= o["stop"]) & (o["neg_width"] < m["neg_width"])

    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    two = F.size(ranked) > 1
    level = (first["form"] == second["form"]) & (first["depth"] == second["depth"])
    same = two & level & (first["neg_stop"] == second["neg_stop"]) & (first["neg_width"] == second["neg_width"])
    swap = second["start"] < first["start"]
    gap_from = F.when(swap, second["stop"]).otherwise(first["stop"])
    gap_to = F.when(swap, first["start"]).otherwise(second["start"])
    gap = F.substr(text, gap_from, F.greatest(gap_to - gap_from, F.lit(0)))
    either = two & level & F.contains(gap, F.lit(or_word))
    reordered = F.when(
        either & swap, F.concat(F.array(second, first), F.slice(ranked, 3, F.greatest(F.size(ranked) - 2, F.lit(0))))
    ).otherwise(ranked)
    return (
        df.withColumn("__text", tx.bare(title))
        .withColumn("__depth", tx.bracket_depths("__text"))
        .withColumn("__found", F.flatten(F.transform(F.filter(words, lambda v: F.contains(text, v["word"])), hits)))
        .withColumn(
            "__kept",
            F.array_sort(F.filter(found, lambda m: ~F.exists(found, lambda o: strictly_inside(m, o)))),
        )
        .withColumn(
            "__ranked",
            F.filter(kept, lambda m, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda o: o["ord"] == m["ord"])),
        )
        .withColumn("category_tie", F.coalesce(same | either, F.lit(False)))
        .withColumn("__ranked", reordered)
        .withColumn("category", F.coalesce(F.get(F.transform(ranked, lambda m: m["key"]), F.lit(0)), F.lit("other")))
        .withColumn(
            "category_tags",
            F.transform(F.slice(ranked, 2, F.greatest(F.size(ranked) - 1, F.lit(0))), lambda m: m["key"]),
        )
        .drop("__text", "__depth", "__found", "__kept", "__ranked")
    )


def with_category_columns(df: DataFrame, title: str, categories, or_word: str = "또는") -> DataFrame:
    """Classification as product columns: tags and ambiguity are null when they do not apply."""
    done = classify_titles(df, title, categories, or_word)
    return (
        done.withColumn("category_tags", F.when(F.size("category_tags") > 0, F.col("category_tags")))
        .withColumn("category_ambiguous", F.when(F.col("category_tie"), F.lit(True)))
        .drop("category_tie")
    )


def glossary_patterns(glossary: Glossary) -> list[dict]:
    """Patterns by falling length; equal lengths keep the order given."""
    rows = [
        {"key": e.key, "word": p.replace(" ", "")} for e in glossary.entries for p in e.patterns if p.strip()
    ]
    return sorted(rows, key=lambda r: -len(r["word"]))


def glossary_key(title: Column | str, glossary: Glossary) -> Column:
    """Key of the entry with the longest pattern in the bare title, or null."""
    patterns = literal_rows(glossary_patterns(glossary), "key string, word string")
    return tx.let(tx.bare(title), lambda text: F.get(F.filter(patterns, lambda p: F.contains(text, p["word"])), F.lit(0))["key"])


def glossary_fields(key: Column, glossary: Glossary) -> dict[str, Column]:
    """Name, plain words, content and reason of an entry, looked up in constant maps."""

    def lookup(attr):
        pairs = [x for e in glossary.entries for x in (F.lit(e.key), F.lit(getattr(e, attr)))]
        return F.create_map(*pairs)[key]

    return {attr: lookup(attr) for attr in ("name", "plain", "what", "why")}


def glossary_notes(title: Column | str, is_correction: Column, glossary: Glossary) -> Column:
    """Suffix notes found in the bare title, then the correction note."""
    notes = literal_rows([{"word": w, "note": n} for w, n in glossary.suffix_notes], "word string, note string")
    suffix = tx.let(
        tx.bare(title), lambda text: F.transform(F.filter(notes, lambda n: F.contains(text, n["word"])), lambda n: n["note"])
    )
    corrected = is_correction | tx.is_site_correction(title)
    return F.when(corrected, F.array_append(suffix, F.lit(glossary.correction_note))).otherwise(suffix)


def explain_titles(
    df: DataFrame, title: str, is_correction: str, categories, glossary: Glossary, or_word: str = "또는"
) -> DataFrame:
    """Add the explanation of a title: its glossary entry, the catch-all entry when the category is unknown,
    otherwise the category's reading hint, which a tie suppresses."""
    known = F.array(*[F.lit(c.key) for c in categories])
    why = F.create_map(*[x for c in categories for x in (F.lit(c.key), F.lit(c.why))])
    following = F.create_map(*[x for c in categories for x in (F.lit(c.key), F.lit(c.next))])
    label = F.create_map(*[x for c in categories for x in (F.lit(c.key), F.lit(c.label))])
    done = classify_titles(df, title, categories, or_word).withColumn("__hit", glossary_key(title, glossary))
    unknown = ~F.array_contains(known, F.col("category"))
    done = done.withColumn(
        "entry_key", F.coalesce("__hit", F.when(unknown | (F.col("category") == "other"), glossary.catch_all))
    )
    fields = glossary_fields(F.col("entry_key"), glossary)
    tie_text = F.lit("제목만으로는 어느 종류인지 정할 수 없어 한 가지 읽는 법을 고르지 않았어요.")
    return (
        done.withColumn("plain", fields["plain"])
        .withColumn("what", F.coalesce(fields["what"], label[F.col("category")]))
        .withColumn(
            "why", F.coalesce(fields["why"], F.when(F.col("category_tie"), tie_text).otherwise(why[F.col("category")]))
        )
        .withColumn(
            "check_next",
            F.when(F.col("entry_key").isNull() & ~F.col("category_tie"), F.nullif(following[F.col("category")], F.lit(""))),
        )
        .withColumn("notes", glossary_notes(title, F.col(is_correction), glossary))
        .drop("__hit")
    )
