"""Whole numbers as English words, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ONES = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
#: Fixed values.
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def _words(n: int) -> str:
    """Words of 0 to 999, on the driver."""
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + (f"-{ONES[n % 10]}" if n % 10 else "")
    return f"{ONES[n // 100]} hundred" + (f" and {_words(n % 100)}" if n % 100 else "")


def _below_thousand(n: Column) -> Column:
    """A lookup in an array that the optimizer folds to a constant, so that the expression stays small."""
    return F.get(F.split(F.lit("|".join(map(_words, range(1000)))), r"\|"), n.cast("int"))


def number_words(n: Column) -> Column:
    """Words of 0 to 999,999; larger and negative numbers stay digits."""
    rest = F.when(n % 1000 == 0, "").otherwise(F.concat(F.when(n % 1000 < 100, " and ").otherwise(", "), _below_thousand(n % 1000)))
    large = F.concat(_below_thousand(F.floor(n / 1000)), F.lit(" thousand"), rest)
    return F.when((n >= 0) & (n < 1000), _below_thousand(n)).when((n >= 0) & (n < 1_000_000), large).otherwise(n.cast("string"))


def word_for(token: Column) -> Column:
    """A token of digits as words, any other as it is."""
    return F.when(token.rlike(r"^\d{1,6}$"), number_words(token.try_cast("bigint"))).otherwise(token)


def numbers_to_words(text: Column) -> Column:
    """Each white-space token of digits as words, joined by single spaces."""
    return F.array_join(F.transform(tokens(text), word_for), " ")


def tokens(text: Column) -> Column:
    """Words between white space, which is that of Unicode and the four separators of ASCII."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
