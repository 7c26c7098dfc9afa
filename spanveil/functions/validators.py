"""Checks that a matched value must pass. All are Column expressions but base58check, whose numbers exceed any SQL type."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ints(text: Column) -> Column:
    """The decimal digits of a string as an array of ints."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _weighted(digits: Column, weights: list[int]) -> Column:
    return F.aggregate(F.zip_with(digits, F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[ \-.]", "")
    return digits.rlike(r"^[0-9]{13,19}$") & F.call_function("luhn_check", F.when(digits.rlike(r"^[0-9]{13,19}$"), digits).otherwise("0"))


def iban(value: Column) -> Column:
    """Rotated by four, letters as numbers from 10, the remainder by 97 is 1."""
    bare = F.upper(F.regexp_replace(value, r"[\s ]", ""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )
    return F.when(bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def cpf(value: Column) -> Column:
    digits = _digits(value)
    d = _ints(digits)

    def check(n: int) -> Column:
        rest = _weighted(F.slice(d, 1, n), list(range(n + 1, 1, -1))) * 10 % 11
        return F.when(rest == 10, 0).otherwise(rest) == F.get(d, F.lit(n))

    return F.when((F.length(digits) == 11) & ~digits.rlike(r"^(\d)\1{10}$"), check(9) & check(10)).otherwise(False)


def codice_fiscale(value: Column) -> Column:
    """Check letter over odd and even places; letters may stand for digits; the day is 1-31 or 41-71; one case throughout."""
    # What the characters 0-9 and A-Z count at odd places.
    odd = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
    text = F.upper(value)
    table = F.array(*[F.lit(x) for x in odd])

    def index(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)

    def even(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 65)

    total = F.aggregate(
        F.transform(F.slice(F.split(text, ""), 1, 15), lambda c, i: F.when(i % 2 == 0, F.get(table, index(c))).otherwise(even(c))), F.lit(0), lambda a, x: a + x
    )
    day = F.translate(F.substring(text, 10, 2), "LMNPQRSTUV", "0123456789")
    day_ok = F.when(day.rlike("^[0-9]{2}$"), day.cast("int").between(1, 31) | day.cast("int").between(41, 71)).otherwise(False)
    # Stand-in letters replace digits from the right: none has a plain digit to its right.
    numeric = F.concat(*[F.substring(text, k, 1) for k in (7, 8, 10, 11, 13, 14, 15)])
    order = numeric.rlike("^[0-9]*[A-Z]*$")
    same_case = (value == F.upper(value)) | (value == F.lower(value))
    return F.when(F.length(text) == 16, same_case & order & day_ok & (F.chr(total % 26 + 65) == F.substring(text, 16, 1))).otherwise(False)


def partita_iva(value: Column) -> Column:
    digits = _digits(value)
    d = _ints(digits)
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))), F.lit(0), lambda a, x: a + x)
    office = F.substring(digits, 8, 3).cast("int")
    known = office.between(1, 100) | office.isin(120, 121, 888, 999)
    return F.when(digits.rlike("^[0-9]{11}$") & ~digits.rlike("^0{11}$"), known & (total % 10 == 0)).otherwise(False)


def mac(value: Column) -> Column:
    bare = F.lower(F.regexp_replace(value, "[:-]", ""))
    return ~bare.rlike("^(?:f{12}|0{12}|01005e.*|3333.*|0180c2.*)$")


def vin(value: Column) -> Column:
    """Letters as digits, weighted, mod 11 at the ninth place."""
    # The digit of each letter and the weight of each place.
    digit = F.translate(value, "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    weights = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
    rest = _weighted(_ints(F.when(digit.rlike("^[0-9]{17}$"), digit).otherwise("")), weights) % 11
    return F.when(F.length(value) == 17, F.when(rest == 10, "X").otherwise(rest.cast("string")) == F.substring(value, 9, 1)).otherwise(False)


def lat_lon(value: Column) -> Column:
    lat, lon = (F.trim(F.split_part(value, F.lit(","), F.lit(k))).try_cast("double") for k in (1, 2))
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def basic(value: Column) -> Column:
    """Canonical base64 of printable `user:password`, at most 128 and 256 characters."""
    raw = F.try_to_binary(value, F.lit("base64"))
    text = F.try_validate_utf8(raw.cast("string"))
    canonical = F.rtrim(F.base64(raw)) == value
    parts = text.rlike(r"^[^:\x00-\x1F\x7F]{1,128}:[^\x00-\x1F\x7F]{1,256}$")
    return F.coalesce(canonical & parts, F.lit(False))


# Words that stand where a credential would, and shapes of masks and placeholders.
STAND_INS = [
    "string", "str", "bytes", "number", "int", "integer", "boolean", "bool", "none", "null", "nil", "true", "false", "undefined", "required", "optional",
    "any", "object", "secretstr", "text", "varchar", "password", "token", "secret", "hidden", "redacted", "masked", "changeme", "example", "value", "env",
    "type", "char", "function", "func", "lambda", "self", "this", "new", "await", "return", "get", "set", "default", "buffer", "uuid", "date", "datetime",
    "list", "dict",
]
MASKED, PLACEHOLDERS = r"^[xX*.#_-]+\z", r"(?i)^(?:your|my|the|some)[_-]?\w*\z|_here\z"


def stand_in(value: Column) -> Column:
    """True for a value that only stands where a secret would."""
    return F.regexp_replace(F.lower(value), "[?!]+$", "").isin(STAND_INS) | value.rlike(MASKED) | value.rlike(PLACEHOLDERS)


def userinfo(value: Column) -> Column:
    return ~value.rlike(r"^(?:\$|%\(|<.*>|\{\{)") & ~stand_in(value)


def letter_digit(value: Column) -> Column:
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]")


def pem(value: Column) -> Column:
    """The body between the marks has a run of 16 base64 characters."""
    return F.regexp_replace(value, "-----[^-]*-----", "").rlike("[A-Za-z0-9+/]{16}")


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58check_value(value: str) -> bool:
    number = 0
    for c in value:
        if c not in BASE58:
            return False
        number = number * 58 + BASE58.index(c)
    raw = number.to_bytes(max(25, (number.bit_length() + 7) // 8), "big")
    return len(raw) == 25 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def base58(value: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v is not None and base58check_value(v))

    return check(value)


#: Native checks by name.
CHECKS = {
    "luhn": luhn, "iban": iban, "cpf": cpf, "codice_fiscale": codice_fiscale, "partita_iva": partita_iva, "mac": mac, "vin": vin, "lat_lon": lat_lon,
    "basic": basic, "userinfo": userinfo, "letter_digit": letter_digit, "pem": pem, "stand_in": lambda v: ~stand_in(v),
}
