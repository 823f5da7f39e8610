"""Amounts, percentages and their display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docketry import vocab
from docketry.functions.text import _col


def parse_amount(text: Column | str) -> Column:
    """Integer amount from text with thousands commas; anything else is null, never zero."""
    digits = F.trim(F.regexp_replace(_col(text), ",", ""))
    return F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("decimal(20,0)"))


def pct_change(current: Column, prior: Column) -> Column:
    """Change in percent to one decimal; null when the prior value is zero or negative."""
    cur, old = current.cast("double"), prior.cast("double")
    return F.when(old > 0, F.round((cur - old) / old * 100, 1))


def ratio_pct(part: Column, whole: Column) -> Column:
    """Share in percent to one decimal; null unless the denominator is positive."""
    return F.when(whole > 0, F.round(part.cast("double") / whole.cast("double") * 100, 1))


def won_text(amount: Column, state: Column | None = None) -> Column:
    """Amount in the largest of four units; sentinel states have their own words."""
    size = F.abs(amount)
    sign = F.when(amount < 0, "−").otherwise("")
    trillions = F.regexp_replace(F.format_number(size.cast("double") / 1e12, 1), r"\.0$", "")
    text = (
        F.when(size >= 10**12, F.concat(sign, trillions, F.lit("조")))
        .when(size >= 10**8, F.concat(sign, F.format_number(F.round(size.cast("double") / 1e8), 0), F.lit("억")))
        .when(size >= 10**4, F.concat(sign, F.format_number(F.round(size.cast("double") / 1e4), 0), F.lit("만")))
        .when(amount.isNotNull(), F.concat(sign, F.format_number(size.cast("double"), 0), F.lit("원")))
    )
    if state is None:
        return F.coalesce(text, F.lit("—"))
    words = F.when(state == vocab.NOT_COLLECTED, "아직 못 받음").when(state == vocab.NOT_APPLICABLE, "해당 없음").otherwise("—")
    return F.coalesce(text, words)


def _six_digits(size: Column) -> Column:
    """Number with at most six significant digits: no trailing zeros, an exponent from a million on."""
    plain = F.regexp_replace(F.when(size < 100000, F.format_string("%.1f", size)).otherwise(F.format_string("%.0f", F.bround(size))), r"\.0$", "")
    power = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", size), "0+e", "e"), r"\.e", "e")
    return F.when(size < 999999.5, plain).otherwise(power)


def pct_text(pct: Column, reason: Column) -> Column:
    """Signed percentage, or the words that say why there is none."""
    size = _six_digits(F.abs(pct))
    sign = F.when(pct > 0, "+").when(pct < 0, "−").otherwise("")
    none = F.when(reason == "prior_zero_or_negative", "전년이 0 이하라 증감률 안 셈").otherwise("—")
    return F.when(pct.isNotNull(), F.concat(sign, size, F.lit("%"))).otherwise(none)
