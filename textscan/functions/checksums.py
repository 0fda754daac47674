"""Check-digit rules as native Column expressions.

Every function takes a string Column.  A value that is not made of decimal
digits gives false (or null for functions that return a digit), so that no cast
can fail under ANSI mode.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textscan.functions.regexes import to_jvm

# --- Fixed values: the tables of the Verhoeff and Damm schemes ---------------
_VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
_VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]
_DAMM = [
    [0, 3, 1, 7, 5, 9, 8, 6, 4, 2],
    [7, 0, 9, 2, 1, 5, 4, 8, 6, 3],
    [4, 2, 0, 6, 8, 7, 1, 3, 5, 9],
    [1, 7, 5, 0, 9, 8, 3, 4, 2, 6],
    [6, 1, 2, 3, 0, 4, 5, 9, 7, 8],
    [3, 6, 7, 4, 2, 0, 9, 5, 8, 1],
    [5, 8, 6, 9, 7, 2, 0, 1, 3, 4],
    [8, 9, 4, 5, 3, 6, 2, 0, 1, 7],
    [9, 4, 3, 8, 6, 1, 7, 2, 0, 5],
    [2, 5, 8, 1, 4, 3, 6, 7, 9, 0],
]
_ABA_WEIGHTS = [3, 7, 1, 3, 7, 1, 3, 7, 1]
_NUBAN_WEIGHTS = [3, 7, 3, 3, 7, 3, 3, 7, 3, 3]
# ------------------------------------------------------------------------------

_OTHER_DIGITS = {
    chr(cp): str(unicodedata.decimal(chr(cp)))
    for cp in range(128, sys.maxunicode)
    if unicodedata.category(chr(cp)) == "Nd"
}


def ascii_digits(value: Column) -> Column:
    """Decimal digits of other scripts as 0-9 (Python's ``\\d`` and ``int`` take them)."""
    other, ascii_ = "".join(_OTHER_DIGITS), "".join(_OTHER_DIGITS.values())
    return F.when(value.rlike(r"[^\x00-\x7f]"), F.translate(value, other, ascii_)).otherwise(value)


def digits_only(value: Column) -> Column:
    """All non-digits removed."""
    return F.regexp_replace(ascii_digits(value), "[^0-9]", "")


def is_digits(value: Column) -> Column:
    return value.rlike(r"\A[0-9]+\z")


def digit_array(value: Column) -> Column:
    """The digits of an all-digit string as array<int>."""
    return F.transform(F.split(value, ""), lambda c: F.ascii(c) - 48)


def matrix(rows: Sequence[Sequence[int]]) -> Column:
    """A square lookup table as one flat array literal; row r, column c is at 10r + c."""
    return F.array(*[F.lit(x) for row in rows for x in row])


def weighted_sum(digits: Column, weights: Sequence[int]) -> Column:
    """Sum of digit × weight, both from the left."""
    literal = F.array(*[F.lit(w) for w in weights])
    return F.aggregate(F.zip_with(digits, literal, lambda d, w: d * w), F.lit(0), lambda a, x: a + x)


def luhn(value: Column) -> Column:
    """Luhn check of an all-digit string."""
    return F.coalesce(is_digits(value) & F.call_function("luhn_check", value), F.lit(False))


def card_luhn(value: Column) -> Column:
    """Luhn after removing blanks; null if anything else than digits remains."""
    compact = ascii_digits(F.replace(value, F.lit(" "), F.lit("")))
    return F.when(is_digits(compact), F.call_function("luhn_check", compact))


def verhoeff_digit(value: Column) -> Column:
    """Verhoeff checksum of a number (0 for a number that carries its check digit)."""
    d, p = matrix(_VERHOEFF_D), matrix(_VERHOEFF_P)
    backwards = F.transform(F.reverse(digit_array(value)), lambda x, i: F.element_at(p, (i % 8) * 10 + x + 1))
    return F.when(
        is_digits(value), F.aggregate(backwards, F.lit(0), lambda c, x: F.element_at(d, c * 10 + x + 1))
    )


def verhoeff_valid(value: Column) -> Column:
    return F.coalesce(verhoeff_digit(value) == 0, F.lit(False))


def damm_digit(value: Column) -> Column:
    """Damm checksum of a number (0 for a number that carries its check digit)."""
    table = matrix(_DAMM)
    return F.when(
        is_digits(value),
        F.aggregate(digit_array(value), F.lit(0), lambda c, x: F.element_at(table, c * 10 + x + 1)),
    )


def mod11(value: Column) -> Column:
    """Weights 2…10 from the right, over and over; the sum must divide by 11."""
    weighted = F.transform(F.reverse(digit_array(value)), lambda x, i: x * (i % 9 + 2))
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.when(is_digits(value), total % 11 == 0), F.lit(False))


def db1a1(value: Column) -> Column:
    """Modulus 10 with every second digit from the right doubled; digits only."""
    return luhn(ascii_digits(value))


def nuban(value: Column) -> Column:
    """Nigerian account number: ten digits under fixed weights, sum divides by 10."""
    shaped = value.rlike(r"\A[0-9]{10}\z")
    total = weighted_sum(digit_array(value), _NUBAN_WEIGHTS)
    return F.coalesce(F.when(shaped, total % 10 == 0), F.lit(False))


def aba_routing(value: Column) -> Column:
    """US bank routing number: nine digits under weights 3, 7, 1."""
    number = ascii_digits(value)
    shaped = number.rlike(r"\A[0-9]{9}\z")
    return F.coalesce(F.when(shaped, weighted_sum(digit_array(number), _ABA_WEIGHTS) % 10 == 0), F.lit(False))


def iban_mod97(compact: Column) -> Column:
    """Remainder by 97 of an upper-case IBAN without blanks, its first four
    characters moved to the end and letters read as 10…35.  The remainder is
    carried character by character, so no big integer is needed."""
    turned = F.concat(compact.substr(F.lit(5), F.length(compact)), compact.substr(1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.when(
        compact.rlike(r"\A[0-9A-Z]{5,}\z"), F.aggregate(F.split(turned, ""), F.lit(0), step)
    )


IBAN_SHAPE = to_jvm(r"\A[A-Z]{2}\d{2}[A-Z\d]{11,30}")
