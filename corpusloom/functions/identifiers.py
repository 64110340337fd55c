"""Check-digit tests of identifiers as columns; separators are to be stripped by ``digits``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the check digits.
NATIONAL = ((3, 7, 6, 1, 8, 9, 4, 5, 2, 1), (5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1))
ORGANISATION = (3, 2, 7, 6, 5, 4, 3, 2)
ACCOUNT = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _digit(c: Column, k: int) -> Column:
    return F.try_to_number(F.substring(c, k, 1), F.lit("9")).cast("int")


def _weighted(c: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + _digit(c, k + 1) * w
    return total


def _mod11(c: Column, weights: tuple[int, ...]) -> Column:
    """The digit after the weighted ones makes the sum divisible by 11; a check digit 10 does not exist."""
    check = (F.lit(11) - _weighted(c, weights) % 11) % 11
    return (check < 10) & (check == _digit(c, len(weights) + 1))


def is_national_id(d: Column) -> Column:
    """Eleven digits whose two weighted sums are divisible by 11."""
    ok = (_weighted(d, NATIONAL[0]) % 11 == 0) & (_weighted(d, NATIONAL[1]) % 11 == 0)
    return F.when(d.rlike("^[0-9]{11}$"), ok).otherwise(False)


def is_organisation_number(d: Column) -> Column:
    return F.when(d.rlike("^[0-9]{9}$"), _mod11(d, ORGANISATION)).otherwise(False)


def is_tax_id(c: Column) -> Column:
    return is_organisation_number(digits(c))


def is_account(d: Column) -> Column:
    return F.when(d.rlike("^[0-9]{11}$"), _mod11(d, ACCOUNT)).otherwise(False)


def is_luhn(d: Column) -> Column:
    return F.when(d.rlike("^[0-9]{2,}$"), F.call_function("luhn_check", d)).otherwise(False)


def is_iban_no(c: Column) -> Column:
    """NO and 13 digits: remainder 1 modulo 97 after moving the first four signs to the end (N is 23, O is 24), and a valid account inside."""
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    number = F.concat(F.substring(s, 5, 11), F.lit("2324"), F.substring(s, 3, 2))
    ok = (number.try_cast("decimal(20,0)") % 97 == 1) & is_account(F.substring(s, 5, 11))
    return F.when(s.rlike("^NO[0-9]{13}$"), ok).otherwise(False)


def is_firearms_licence(c: Column) -> Column:
    return c.rlike("^(?:[A-Z]{2}[0-9]{6}|[0-9]{7,8})$")


def is_vessel(c: Column) -> Column:
    return c.rlike("^[A-Z]{2,3}[ -]?[0-9]{3,4}$|^[A-Z]{1,2}-[0-9]{1,3}-[A-Z]{1,2}$")


#: Registry: type -> validity of a span of that type.
VALIDATORS = {
    "NATIONAL_ID": lambda c: is_national_id(digits(c)),
    "ORG_NUMBER": lambda c: is_organisation_number(digits(c)),
    "TAX_ID": is_tax_id,
    "BANK_ACCOUNT": lambda c: is_account(digits(c)),
    "CREDIT_CARD": lambda c: is_luhn(digits(c)),
    "IBAN": is_iban_no,
}


def is_valid(kind: Column, span: Column) -> Column:
    """Validity by type; null for types without a check."""
    out = F.lit(None).cast("boolean")
    for k, f in VALIDATORS.items():
        out = F.when(kind == k, f(span)).otherwise(out)
    return out
