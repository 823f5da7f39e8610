"""Corporate-action facts read from a title alone, and the states of their effects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from docketry import vocab
from docketry.functions.text import _col, contains_any, let, words_in


@dataclass(frozen=True)
class ActionVocabulary:
    """Words that decide subject, stage, family and effects. The default is the Korean filing vocabulary."""

    subsidiary: tuple[str, ...] = vocab.SUBSIDIARY_MARKS
    stages: tuple = vocab.STAGE_WORDS
    families: tuple[str, ...] = vocab.ACTION_FAMILIES
    effects: dict | None = None
    halt: tuple[str, str] = vocab.HALT_AND_RELEASE

    @property
    def effect_map(self) -> dict:
        return vocab.ACTION_EFFECTS if self.effects is None else self.effects


def action_facts(title: Column | str, words: ActionVocabulary = ActionVocabulary()) -> Column:
    """Struct of subject, stage, terms, effects, family and needs_document."""
    table = F.create_map(*[
        x for family, effects in words.effect_map.items() for x in (F.lit(family), F.lit(list(effects)))
    ])
    none = F.array().cast("array<string>")

    def stage_of(text):
        stage = None
        for name, marks in words.stages:
            test = contains_any(text, marks)
            stage = F.when(test, name) if stage is None else stage.when(test, name)
        return stage.otherwise("DECISION")

    def facts(text, terms):
        effects = F.array_sort(F.array_distinct(F.flatten(F.transform(terms, lambda t: F.coalesce(table[t], none)))))
        both = text.contains(words.halt[0]) & text.contains(words.halt[1])
        return F.struct(
            F.when(contains_any(text, words.subsidiary), "SUBSIDIARY").otherwise("SELF").alias("subject"),
            stage_of(text).alias("stage"),
            terms.alias("terms"),
            effects.alias("effects"),
            F.get(terms, F.lit(0)).alias("family"),
            (both | (F.size(terms) == 0)).alias("needs_document"),
        )

    clean = F.trim(F.coalesce(_col(title), F.lit("")))
    return let(clean, lambda text: let(words_in(text, words.families), lambda terms: facts(text, terms)))


def in_scope(title: Column | str, words=ActionVocabulary(), extra=vocab.EXTRA_SCOPE_TERMS) -> Column:
    """Whether a title is kept: any classified effect, or any of the extra terms."""
    return (F.size(action_facts(title, words)["effects"]) > 0) | contains_any(title, extra)


def effect_states(stages: Column, effects: Column) -> Column:
    """Map of effect to state. A completion or withdrawal closes only the company's own step."""
    done = F.array_contains(stages, "COMPLETION") | F.array_contains(stages, "WITHDRAWN")
    own = F.struct(
        F.lit("CORPORATE_EVENT").alias("key"), F.when(done, "RESOLVED_CONFIRMED").otherwise("OPEN").alias("value")
    )
    direct = F.transform(
        effects,
        lambda e: F.struct(
            e.alias("key"), F.when(e.isin(*vocab.EXCHANGE_EFFECTS), "NEEDS_EXCHANGE").otherwise("OPEN").alias("value")
        ),
    )

    def extra(effect, name):
        entry = F.struct(F.lit(name).alias("key"), F.lit("NEEDS_EXCHANGE").alias("value"))
        return F.when(F.array_contains(effects, effect), F.array(entry)).otherwise(F.filter(direct, lambda _: F.lit(False)))

    return F.map_from_entries(F.concat(F.array(own), direct, extra("SHARES", "SHARE_COUNT"), extra("PRICE", "PRICE_BASIS")))


def unresolved(states: Column) -> Column:
    """Sorted names of the effects that are not closed."""
    return F.array_sort(F.map_keys(F.map_filter(states, lambda _, v: v != "RESOLVED_CONFIRMED")))
