"""Check digits and date plausibility as native columns over digit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digit(s: Column, k: int) -> Column:
    """The k-th digit from 0; null where there is none."""
    return F.substr(s, F.lit(k + 1), F.lit(1)).try_cast("int")


def two(s: Column, k: int) -> Column:
    return F.substr(s, F.lit(k + 1), F.lit(2)).try_cast("int")


def weighted(s: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + digit(s, k) * w
    return total


def mod11(s: Column, weights: list[int]) -> Column:
    """Whether the digit after the weighted ones is their mod-11 control; a control of 10 never is."""
    return F.pmod(11 - weighted(s, weights) % 11, F.lit(11)) == digit(s, len(weights))


def plausible(day: Column, month: Column) -> Column:
    return day.between(1, 31) & month.between(1, 12)


def d_day(s: Column) -> Column:
    """Day of a national id; D-numbers add 40."""
    day = two(s, 0)
    return F.when((day > 40) & (day <= 71), day - 40).otherwise(day)


def norwegian_id(s: Column) -> Column:
    """fødselsnummer, d-nummer or null."""
    k1, k2 = [3, 7, 6, 1, 8, 9, 4, 5, 2], [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]
    ok = s.rlike(r"^[0-9]{11}$") & plausible(d_day(s), two(s, 2)) & mod11(s, k1) & mod11(s, k2)
    return F.when(ok, F.when(two(s, 0) > 40, F.lit("d-nummer")).otherwise(F.lit("fødselsnummer")))


def luhn(s: Column) -> Column:
    """Luhn over a digit string of any length: every second digit from the right counts double."""
    digits = F.transform(F.split(F.reverse(s), ""), lambda c: c.try_cast("int"))
    doubled = F.transform(digits, lambda d, k: F.when(k % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(s: Column) -> Column:
    """Remainder by 97 of letters and digits read as one number, A as 10 to Z as 35."""
    return F.aggregate(
        F.filter(F.split(s, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def iso7064(s: Column) -> Column:
    """German tax id: the mod-11,10 product over ten digits gives the eleventh."""
    product = F.aggregate(
        F.transform(F.split(F.substr(s, F.lit(1), F.lit(10)), ""), lambda c: c.try_cast("int")),
        F.lit(10),
        lambda p, d: F.when((d + p) % 10 == 0, F.lit(20)).otherwise((d + p) % 10 * 2) % 11,
    )
    return F.pmod(11 - product, F.lit(11)) % 10 == digit(s, 10)


def swedish(s: Column) -> Column:
    """Luhn from the left over ten digits."""
    return luhn(s)


def calendar(year: Column, month: Column, day: Column) -> Column:
    """Whether a date of 1900 to 2099 exists."""
    text = F.concat_ws("-", year, month, day)
    return year.try_cast("int").between(1900, 2099) & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()


def compact_date(s: Column) -> Column:
    """Eight digits that are a date as ddmmyyyy or as yyyymmdd."""
    part = lambda a, n: F.substr(s, F.lit(a), F.lit(n))
    return s.rlike("^[0-9]{8}$") & (calendar(part(5, 4), part(3, 2), part(1, 2)) | calendar(part(1, 4), part(5, 2), part(7, 2)))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    return F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda a, c: a - (lambda p: p * F.log2(p))((F.lit(1.0) * (n - F.size(F.array_remove(chars, c)))) / n),
    )
