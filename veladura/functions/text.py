"""Normalising, formatting and displaying PII text.  Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- normalisers -----------------------------------------------------------


def normalize_cpf(c: Column) -> Column:
    return F.translate(c, "./-", "")


def normalize_cnpj(c: Column) -> Column:
    return F.translate(c, "./-", "")


def normalize_pan(c: Column) -> Column:
    return F.translate(c, " -", "")


def normalize_phone_marks(c: Column) -> Column:
    """Drop the marks a phone number is written with; anything else stays."""
    return F.translate(c, "() -", "")


def keep_digits(c: Column) -> Column:
    """Phone, RG and CNH: every character that is not a digit goes."""
    return F.regexp_replace(c, "[^0-9]", "")


def as_text(c: Column) -> Column:
    return c.cast("string")


# ---- grouped formats -------------------------------------------------------


def _cut(c: Column, *sizes: int) -> list[Column]:
    pieces, start = [], 1
    for size in sizes:
        pieces.append(F.substring(c, start, size))
        start += size
    return pieces


def format_cpf(c: Column) -> Column:
    """Eleven digits as ddd.ddd.ddd-dd; another length stays as it is."""
    digits = normalize_cpf(c)
    a, b, d, e = _cut(digits, 3, 3, 3, 2)
    dot, dash = F.lit("."), F.lit("-")
    return F.when(F.length(digits) == 11, F.concat(a, dot, b, dot, d, dash, e)).otherwise(c)


def format_cnpj(c: Column) -> Column:
    """Fourteen digits as dd.ddd.ddd/dddd-dd; another length stays as it is."""
    digits = normalize_cnpj(c)
    a, b, d, e, f = _cut(digits, 2, 3, 3, 4, 2)
    dot = F.lit(".")
    formatted = F.concat(a, dot, b, dot, d, F.lit("/"), e, F.lit("-"), f)
    return F.when(F.length(digits) == 14, formatted).otherwise(c)


def group_pan(c: Column) -> Column:
    """Sixteen digits in groups of four; another length stays as it is."""
    return F.when(F.length(c) == 16, F.concat_ws(" ", *_cut(c, 4, 4, 4, 4))).otherwise(c)


def shorten(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)


def original_length(c: Column) -> Column:
    return F.length(c)


# ---- partial displays of protected values ----------------------------------


def _all_stars(c: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(c))


def display_cpf(c: Column) -> Column:
    """***.***.ddd-dd from the last five digits; a wrong length shows stars only."""
    shown = F.concat(F.lit("***.***."), F.substring(c, 7, 3), F.lit("-"), F.substring(c, 10, 2))
    return F.when(F.length(c) == 11, shown).otherwise(_all_stars(c))


def display_phone(c: Column) -> Column:
    """(dd) *****-dddd; a wrong length shows stars only."""
    shown = F.concat(F.lit("("), F.substring(c, 1, 2), F.lit(") *****-"), F.substring(c, 8, 4))
    return F.when(F.length(c) == 11, shown).otherwise(_all_stars(c))


def display_pan(c: Column) -> Column:
    """**** **** **** dddd for sixteen digits, else stars up to the last four."""
    last = F.right(c, F.lit(4))
    return (
        F.when(F.length(c) == 16, F.concat(F.lit("**** **** **** "), last))
        .when(F.length(c) >= 13, F.concat(F.repeat(F.lit("*"), F.length(c) - 4), last))
        .otherwise(_all_stars(c))
    )


# ---- CPF check digits ------------------------------------------------------


def _check_digit(digits: list[Column]) -> Column:
    """Weights from len+1 down to 2; remainders 0 and 1 modulo 11 give zero.

    11 - r is 10 r modulo 11, which makes both cases one formula without branches.
    """
    total = sum((d * (len(digits) + 1 - i) for i, d in enumerate(digits)), F.lit(0))
    return total * 10 % 11 % 10


def cpf_number(nine: Column) -> Column:
    """The whole CPF as a number, from its first nine digits as a number."""
    digits = [F.call_function("div", nine, F.lit(10 ** (8 - i))) % 10 for i in range(9)]
    first = _check_digit(digits)
    second = _check_digit([*digits, first])
    return nine * 100 + first * 10 + second


def cpf_from_base(nine: Column) -> Column:
    """Nine digits with their check digits; null if it is not nine digits."""
    number = F.when(nine.rlike(r"^[0-9]{9}\z"), nine.cast("bigint"))
    return F.lpad(cpf_number(number).cast("string"), 11, "0")


def cpf_check_digits(nine: Column) -> Column:
    return F.right(cpf_from_base(nine), F.lit(2))
