"""Checksums, as Python functions for the kernel and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def luhn(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if "0" <= c <= "9"]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def card(text: str) -> bool:
    return sum("0" <= c <= "9" for c in text) >= 13 and luhn(text)


def amka(text: str) -> bool:
    return len(text) == 11 and 1 <= int(text[:2]) <= 31 and 1 <= int(text[2:4]) <= 12 and luhn(text)


def afm(text: str) -> bool:
    if len(text) != 9 or not text.strip("0"):
        return False
    weighted = sum(int(c) << (8 - i) for i, c in enumerate(text[:8]))
    return weighted % 11 % 10 == int(text[8])


VALIDATORS = {"card": card, "amka": amka, "afm": afm}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_column(text: Column) -> Column:
    each = F.transform(F.split(F.reverse(_digits(text)), ""), lambda c, i: (lambda d: F.when(i % 2 == 1, F.floor(d * 2 / 10) + d * 2 % 10).otherwise(d))(F.coalesce(c.try_cast("int"), F.lit(0))).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def card_column(text: Column) -> Column:
    return (F.length(_digits(text)) >= 13) & luhn_column(text)


def amka_column(text: Column) -> Column:
    part = lambda a: F.substring(text, a, 2).try_cast("int")
    return F.coalesce((F.length(text) == 11) & part(1).between(1, 31) & part(3).between(1, 12) & luhn_column(text), F.lit(False))


def afm_column(text: Column) -> Column:
    total = sum((F.substring(text, i + 1, 1).try_cast("int") * (1 << (8 - i)) for i in range(8)), F.lit(0))
    return F.coalesce((F.length(text) == 9) & (text != "000000000") & (total % 11 % 10 == F.substring(text, 9, 1).try_cast("int")), F.lit(False))


COLUMNS = {"card": card_column, "amka": amka_column, "afm": afm_column}
