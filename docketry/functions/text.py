"""Title text: stripping marks and spaces, bracket depth, correction marks, masking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docketry import vocab


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    Without the binding an expression used inside a lambda would run again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit(""))


def bare(title: Column | str) -> Column:
    """Title without ``[...]`` marks and without any white space."""
    unmarked = F.regexp_replace(text_or_empty(title), r"\[[^\]]*\]", "")
    return F.regexp_replace(unmarked, r"(?U)\s+", "")


def clean_title(title: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(title), r"(?U)\s+", " "))


def bracket_depths(text: Column | str) -> Column:
    """Depth of every character: an opening bracket has the outer depth, a closing one the depth after it."""
    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<int>").alias("seen"))

    def step(acc, ch):
        after = F.when(ch == ")", F.greatest(acc["level"] - 1, F.lit(0))).otherwise(acc["level"])
        level = F.when(ch == "(", acc["level"] + 1).otherwise(after)
        return F.struct(level.alias("level"), F.concat(acc["seen"], F.array(after)).alias("seen"))

    value = _col(text)
    flat = F.array_repeat(F.lit(0), F.length(value))
    folded = F.aggregate(F.split(value, ""), start, step, lambda acc: acc["seen"])
    return F.when(F.instr(value, "(") == 0, flat).otherwise(folded)


def is_ingest_correction(title: Column | str) -> Column:
    return F.coalesce(_col(title).rlike(vocab.INGEST_CORRECTION), F.lit(False))


def research_correction_kind(title: Column | str) -> Column:
    """First of the ordered marks found in the title, else the generic kind, else null."""
    value = _col(title)
    chain = None
    for mark, kind in vocab.RESEARCH_CORRECTION_KINDS:
        test = value.contains(mark)
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.when(value.rlike(vocab.INGEST_CORRECTION), F.lit("정정"))


def is_site_correction(title: Column | str) -> Column:
    return F.coalesce(_col(title).rlike(vocab.SITE_CORRECTION), F.lit(False))


def contains_any(value: Column | str, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | _col(value).contains(word)
    return F.coalesce(found, F.lit(False))


def words_in(value: Column | str, words) -> Column:
    """The words contained in the value, in the order given."""
    return F.filter(F.lit(list(words)), lambda w: F.contains(text_or_empty(value), w))


def mask_parameter(text: Column | str, parameter: str, mark: str = "***REDACTED***") -> Column:
    """Hide the value after ``parameter=`` up to a delimiter; other parameters stay."""
    return F.regexp_replace(_col(text), f"({parameter}=)[^&\"' \\n\\t]*", "$1" + mark.replace("$", "\\$"))


def viewer_url(receipt: Column | str) -> Column:
    return F.concat(F.lit(vocab.VIEWER), _col(receipt))
