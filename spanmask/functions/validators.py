"""Checksum validators for Italian identifiers, expressed as Columns.

Each takes the stripped candidate text and returns a boolean Column, so they
run inside the scan projection (no Python round trip).  Digits are ASCII
(a candidate made of other Unicode decimal digits is rejected; documented
deviation).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import IBAN_SHAPE, TAX_CODE_ODD_VALUES, TAX_CODE_SHAPE
from .text import digits


def valid_vat(value: Column) -> Column:
    """Partita IVA: exactly 11 digits whose last one is the Luhn check digit."""
    d = digits(value)
    return (F.length(d) == 11) & d.rlike("^[0-9]{11}$") & F.call_function("luhn_check", d)


def _no_ws_upper(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"(?U)\s", ""))


def valid_tax_code(value: Column) -> Column:
    """Codice fiscale: shape, then the check letter from the first 15 chars.

    A character's index is its place in 0-9 or A-Z; odd positions (1-based)
    go through the fixed odd-value table, even positions count their index.
    """
    cf = _no_ws_upper(value)
    odd = F.array(*[F.lit(v) for v in TAX_CODE_ODD_VALUES])

    def step(acc, pos):
        ch = F.substring(cf, pos, 1)
        idx = F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 65)
        return acc + F.when(pos % 2 == 1, F.element_at(odd, idx + 1)).otherwise(idx)

    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), step)
    check = F.chr(F.lit(65) + total % 26)
    shape_ok = cf.rlike(TAX_CODE_SHAPE)
    return shape_ok & F.coalesce(F.when(shape_ok, check == F.substring(cf, 16, 1)), F.lit(False))


def valid_iban(value: Column) -> Column:
    """Italian IBAN: shape, then ISO 7064 mod 97 over the rotated string.

    Folded one character at a time (letters are two digits), so no number
    ever exceeds a few thousand — the 42-digit form would overflow DECIMAL(38).
    """
    iban = _no_ws_upper(value)
    rotated = F.concat(F.substring(iban, 5, 1 << 30), F.substring(iban, 1, 4))

    def step(acc, pos):
        ch = F.substring(rotated, pos, 1)
        return F.when(ch.rlike("[A-Z]"), (acc * 100 + F.ascii(ch) - 55) % 97).otherwise(
            (acc * 10 + F.ascii(ch) - 48) % 97)

    rem = F.aggregate(F.sequence(F.lit(1), F.length(rotated)), F.lit(0), step)
    shape_ok = iban.rlike(IBAN_SHAPE)
    return shape_ok & F.coalesce(F.when(shape_ok, rem == 1), F.lit(False))


def valid_phone(value: Column) -> Column:
    """Italian phone: 8-11 digits starting 0 or 3 once a +39 prefix is dropped."""
    d = digits(value)
    d = F.when(value.startswith("+39") & d.startswith("39"), F.substring(d, 3, 1 << 30)).otherwise(d)
    return F.length(d).between(8, 11) & F.substring(d, 1, 1).isin("0", "3")
