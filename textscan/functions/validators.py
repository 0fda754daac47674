"""Value validators as Column expressions.

Boolean validators give true or false and null for null input.  Validators with
details give a struct of fixed shape, with nulls for the fields that do not
apply.  Only the doubtful rows of ``is_json`` use Python workers.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.functions import network
from textscan.functions.checksums import (
    IBAN_SHAPE,
    aba_routing,
    ascii_digits,
    card_luhn,
    digits_only,
    iban_mod97,
    luhn,
    nuban,
)
from textscan.functions.regexes import let, to_jvm

# --- Fixed values: formats, code lists and weights ----------------------------
EMAIL_FORMAT = r"^[a-zA-Z0-9._%+-]+@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,63}$"
EMAIL_RFC = (
    r"^(?!(?:(?:\x22)?\x2e|\x22\x2e)(?:.*\x40)).+@"
    r"(?:(?!\x2e)[A-Za-z0-9][A-Za-z0-9-]{0,62}[A-Za-z0-9]?\x2e){1,126}[A-Za-z]{2,63}$"
)
DOMAIN_LABELS = r"^(?:[a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9]\.)+[a-zA-Z]{2,63}$"
SSN_FORMAT = r"^\d{3}-?\d{2}-?\d{4}$"
PHONE_FORMAT = r"^(\+?[1-9]\d{0,2})?[-. ]?(\(?[2-9]\d{2}\)?[-. ]?[2-9]\d{2}[-. ]?\d{4}|\d{7,15})$"
PHONE_US = r"^\(?[2-9]\d{2}\)?[-. ]?[2-9]\d{2}[-. ]?\d{4}$"
ACCOUNT_FORMAT = r"^[A-Za-z0-9][A-Za-z0-9\s.\-]{7,33}[A-Za-z0-9]$"
SWIFT_FORMAT = r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$"
SWIFT_COUNTRIES = ["US", "GB", "FR", "DE", "IN", "JP", "CN", "AU", "CA", "CH"]
HASHTAG_FORMAT = r"^#[A-Za-z0-9_]{1,139}$"
MICR_FORMAT = r"⎕(\d{9})⎕(\d+)\|(\d+)"
GEO_DECIMAL = r"^(-?\d{1,2}(?:\.\d+)?),\s*(-?\d{1,3}(?:\.\d+)?)$"
GEO_DMS = (
    r"^(-?\d{1,2})°\s*(\d{1,2})'\s*(\d{1,2}(\.\d+)?)\"\s*([NSns])?,?\s*"
    r"(-?\d{1,3})°\s*(\d{1,2})'\s*(\d{1,2}(\.\d+)?)\"\s*([EWew])?$"
)
CARD_TYPES = {
    "Visa": r"^4[0-9]{12}(?:[0-9]{3})?$",
    "MasterCard": r"^5[1-5][0-9]{14}$",
    "American Express": r"^3[47][0-9]{13}$",
    "Discover": r"^6(?:011|5[0-9]{2})[0-9]{12}$",
    "Diners Club": r"^3(?:0[0-5]|[68][0-9])[0-9]{11}$",
    "JCB": r"^(?:2131|1800|35\d{3})\d{11}$",
    "UnionPay": r"^62[0-9]{14,17}$",
}
CRYPTO_FORMATS = {
    "BTC": r"^(1|3|bc1)[a-zA-HJ-NP-Z0-9]{25,39}$",
    "ETH": r"^0x[a-fA-F0-9]{40}$",
    "LTC": r"^(L|M|ltc1)[a-zA-HJ-NP-Z0-9]{25,39}$",
    "DOGE": r"^D[a-zA-HJ-NP-Z0-9]{33}$",
    "XRP": r"^r[1-9A-HJ-NP-Za-km-z]{24,34}$",
    "USDT": r"^(0x[a-fA-F0-9]{40}|T[a-zA-HJ-NP-Z0-9]{33})$",
}
TIN_FORMATS = {
    "US": r"^\d{3}-\d{2}-\d{4}$",
    "India": r"^[A-Z]{5}[0-9]{4}[A-Z]$",
    "UK": r"^[A-CEGHJPR-TW-Z]{2}[0-9]{6}[A-D]$",
    "Germany": r"^\d{11}$",
    "France": r"^\d{13}$",
    "Canada": r"^\d{3} \d{3} \d{3}$",
    "Australia": r"^\d{8,9}$",
    "Italy": r"^[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]$",
    "Spain": r"^[0-9]{8}[A-Z]$",
    "Netherlands": r"^\d{9}$",
    "EU_VAT": r"^[A-Z]{2}[A-Z0-9]{8,12}$",
}
ASN_FORMATS = {
    16: r"^(0|[1-9][0-9]{0,4}|[1-5][0-9]{5}|6[0-4][0-9]{4}|65[0-4][0-9]{3}|655[0-2][0-9]{2}|6553[0-5])$",
    32: r"^(0|[1-9][0-9]{0,9}|[1-3][0-9]{9}|4[0-1][0-9]{8}|42[0-8][0-9]{7}|429[0-3][0-9]{6}|4294[0-8][0-9]{5}|42949[0-5][0-9]{4}|429496[0-6][0-9]{3}|4294967[0-9]{2}|42949672[0-8][0-9]|429496729[0-5])$",
}
VIN_LETTERS = {
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8,
    "J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9, "S": 2,
    "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9,
}
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
IBAN_LENGTHS = {
    "DE": 22, "GB": 22, "FR": 27, "ES": 24, "NL": 18, "IT": 27, "CH": 21, "AE": 23, "SA": 24, "IN": 34,
}
# ------------------------------------------------------------------------------


def fits(value: Column, regex: str) -> Column:
    """Python's ``re.match`` of an anchored pattern."""
    return value.rlike(to_jvm(regex))


def known(value: Column, test: Column) -> Column:
    """``test``, false where it is unknown, null where the value is null."""
    return F.when(value.isNotNull(), F.coalesce(test, F.lit(False)))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, to_jvm(r"^\s+|\s+\Z"), "")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    n = F.length(text)

    def share(c: Column) -> Column:
        return (n - F.length(F.replace(text, c, F.lit("")))) / n / F.length(c)

    shares = F.transform(F.array_distinct(F.split(text, "")), share)
    total = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(n == 0, F.lit(0.0)).otherwise(total)


# --- Dates, JSON, identifiers ---------------------------------------------------


#: Shapes of dates (RE2 and Java read them alike) and the formats that a match must have.
DATE_SHAPES = (
    (r"\b([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:\b|T)", ("yyyy-M-d",)),
    (r"\b([0-9]{4}/[0-9]{1,2}/[0-9]{1,2})\b", ("yyyy/M/d",)),
    (r"\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b", ("M/d/yyyy", "d/M/yyyy")),
    (r"\b([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})\b", ("M.d.yyyy", "d.M.yyyy")),
)
_MONTH = "(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)"
_DAY = "([0-9]{1,2})(?:st|nd|rd|th)?"
#: Dates with the month's name, and their parts as day, month, year.
NAMED_DATES = (
    (rf"\b{_MONTH}\.? +{_DAY},? +([0-9]{{4}})\b", (2, 1, 3)),
    (rf"\b{_DAY} +{_MONTH}\.?,? +([0-9]{{4}})\b", (1, 2, 3)),
)
TIME_SHAPE = r"\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\b"


def is_date(value: Column) -> Column:
    """Whether the text holds a written-out date that exists, or a time of day.

    Bare numbers, years, names of months and of weekdays are no dates.
    """

    def any_reads(shape: str, group: int, plain, forms: tuple[str, ...]) -> Column:
        found = F.regexp_extract_all(value, F.lit(shape), F.lit(group))
        return F.exists(found, lambda m: F.coalesce(*[F.try_to_timestamp(plain(m), F.lit(f)) for f in forms]).isNotNull())

    def in_order(shape: str, parts: tuple[int, ...]):
        return lambda m: F.initcap(F.regexp_replace(m, shape, " ".join(f"${i}" for i in parts)))

    result = value.rlike(TIME_SHAPE)
    for shape, forms in DATE_SHAPES:
        result |= any_reads(shape, 1, lambda m: m, forms)
    for shape, parts in NAMED_DATES:
        result |= any_reads(shape, 0, in_order(shape, parts), ("d MMM yyyy",))
    return result


@F.pandas_udf(T.BooleanType())
def _loads_as_json(values: pd.Series) -> pd.Series:
    def loads(text) -> bool | None:
        if text is None:
            return None
        try:
            json.loads(text)
        except (ValueError, RecursionError):
            return False
        return True

    return values.map(loads)


def is_json(value: Column, exact: bool = True) -> Column:
    """Whether the text is one JSON value.

    Spark's parser reads a leading value and ignores what follows, so the text is
    tried as the only element of a list and as the only member of an object;
    nothing but a single value fits both.  Spark refuses repeated keys and
    NaN/Infinity, which are accepted here: with ``exact``, only rows that Spark
    refuses are looked at again in a Python worker.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]"))).isNotNull()
    in_object = F.try_parse_json(F.concat(F.lit('{"k":'), value, F.lit("}"))).isNotNull()
    native = in_list & in_object
    if not exact:
        return F.when(value.isNotNull(), native)
    return F.when(value.isNotNull(), native | F.coalesce(_loads_as_json(F.when(~native, value)), F.lit(False)))


def is_uuid(value: Column) -> Column:
    """32 hex digits once ``urn:``, ``uuid:``, outer braces and dashes are gone."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "urn:", ""), "uuid:", ""), r"^[{}]+|[{}]+\z", "")
    digits = F.replace(bare, F.lit("-"), F.lit(""))
    return (F.length(digits) == 32) & digits.rlike(r"(?i)\A(?:0x_?)?[0-9a-f]+(?:_[0-9a-f]+)*\z")


def is_url(value: Column) -> Column:
    """http or https with a non-empty host part."""
    text = F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    host = F.regexp_extract(text, r"(?i)\Ahttps?://([^/?#]*)", 1)
    return (host != "") & (F.contains(host, F.lit("[")) == F.contains(host, F.lit("]")))


def _encodable(domain: Column) -> Column:
    """The label rules of internationalised domain names that concern ASCII:
    1–63 characters, no hyphen at either end or in places 3 and 4 (but xn--)."""

    def label_fits(label: Column) -> Column:
        return (
            F.length(label).between(1, 63)
            & ~label.rlike(r"^-|-\z")
            & (~label.substr(3, 2).eqNullSafe("--") | label.rlike("^(?i:xn--)."))
        )

    whole = F.when(F.length(domain) <= 253, F.regexp_replace(domain, r"(?<=.)\.\z", ""))
    return F.coalesce(F.forall(F.split(whole, r"\."), label_fits), F.lit(False))


def is_email(value: Column) -> Column:
    one_at = F.size(F.split(value, "@")) == 2
    return known(value, one_at & fits(value, EMAIL_FORMAT) & _encodable(F.substring_index(value, "@", -1)))


def email_tld(value: Column) -> Column:
    """Lower-case last label of an e-mail's domain; null without one."""
    domain = F.substring_index(value, "@", -1)
    return F.when(F.contains(domain, F.lit(".")), F.lower(F.substring_index(domain, ".", -1)))


def is_domain(value: Column) -> Column:
    """Labels of 2 to 63 letters, digits and inner hyphens, then an alphabetic
    top level.  A label with other letters stands for its xn-- form."""
    encoded = F.array_join(
        F.transform(
            F.split(value, r"\."),
            lambda x: F.when(x.rlike(r"\A[\p{L}\p{M}\p{N}-]*[^\x00-\x7f][\p{L}\p{M}\p{N}-]*\z"), F.lit("xn--a0"))
            .otherwise(x),
        ),
        ".",
    )
    return known(value, (F.length(encoded) <= 253) & _encodable(encoded) & fits(encoded, DOMAIN_LABELS))


def validate_email(value: Column) -> Column:
    ok = fits(value, EMAIL_RFC)
    return F.when(
        value.isNotNull(),
        F.struct(value.alias("email"), ok.alias("valid"), F.when(~ok, "Invalid email format").alias("error")),
    )


# --- Phones ---------------------------------------------------------------------


def is_phone_number(value: Column, country_codes: list[str] | None = None) -> Column:
    """7 to 15 digits, the phone shape, and an entropy of at least 3.5.  With
    ``country_codes`` the number must start with + and one of the codes (its up
    to three digits after the +)."""
    count = F.length(digits_only(value))
    ok = count.between(7, 15) & fits(value, PHONE_FORMAT) & (entropy(value) >= 3.5)
    if country_codes is not None:
        kept = F.regexp_replace(ascii_digits(value), r"[^0-9+]", "")
        ok = ok & F.regexp_extract(kept, r"\A\+([0-9]{1,3})", 1).isin(country_codes)
    return known(value, ok)


def validate_phone_number(value: Column) -> Column:
    number = strip(value)
    ok = fits(number, PHONE_FORMAT)
    us = number.startswith("+1") | fits(number, PHONE_US)
    kind = F.when(ok & us, "US").when(ok, "International").otherwise("Invalid")
    return F.when(
        value.isNotNull(), F.struct(number.alias("phone_number"), ok.alias("valid"), kind.alias("type"))
    )


def validate_ip_address(value: Column) -> Column:
    kind = network.ip_type(value)
    return F.when(
        value.isNotNull(),
        F.struct(value.alias("ip_address"), (kind != "Invalid").alias("valid"), kind.alias("type")),
    )


# --- Money ----------------------------------------------------------------------


def is_credit_card(value: Column) -> Column:
    """13 to 19 digits that pass Luhn, whatever stands between them."""
    number = digits_only(value)
    return F.length(number).between(13, 19) & luhn(number)


def detect_card_type(value: Column) -> Column:
    kind = F.when(value.isNull(), None)
    for name, regex in CARD_TYPES.items():
        kind = kind.when(fits(value, regex), name)
    return kind.otherwise("Unknown")


def validate_credit_card(value: Column) -> Column:
    """Number, issuer type and Luhn; ``valid`` is null if a character other than
    digits and blanks is present."""
    return F.when(
        value.isNotNull(),
        F.struct(value.alias("number"), detect_card_type(value).alias("type"), card_luhn(value).alias("valid")),
    )


def _compact_iban(value: Column) -> Column:
    return F.upper(F.replace(value, F.lit(" "), F.lit("")))


def is_valid_iban(value: Column, check_length: bool = False) -> Column:
    """Country, check digits and remainder 1 by 97.  ``check_length`` also asks
    for the right length in the countries of the table."""

    def of(compact: Column) -> Column:
        ok = compact.rlike(IBAN_SHAPE) & (iban_mod97(compact) == 1)
        if not check_length:
            return ok
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        expected = F.try_element_at(lengths, compact.substr(1, 2))
        return ok & (expected.isNull() | (F.length(compact) == expected))

    return known(value, let(ascii_digits(_compact_iban(value)), of))


def is_bank_account(value: Column) -> Column:
    """9 to 35 characters in account shape that hold a valid IBAN."""
    bare = F.regexp_replace(value, to_jvm(r"[\s.\-]"), "")
    return known(value, fits(value, ACCOUNT_FORMAT) & is_valid_iban(bare))


validate_routing_number = aba_routing


def parse_micr_line(value: Column) -> Column:
    """Routing, account and check number of a MICR line."""
    regex = to_jvm(r"\A" + MICR_FORMAT)
    ok = value.rlike(regex)
    routing, account, check = (F.when(ok, F.regexp_extract(value, regex, group)) for group in (1, 2, 3))
    return F.when(
        value.isNotNull(),
        F.struct(
            F.coalesce(aba_routing(routing), F.lit(False)).alias("valid"),
            F.when(~ok, "Invalid MICR format").alias("error"),
            routing.alias("routing_number"),
            F.when(ok, aba_routing(routing)).alias("routing_valid"),
            account.alias("account_number"),
            F.when(ok, F.lit(True)).alias("account_valid"),
            check.alias("check_number"),
            F.when(ok, F.lit(True)).alias("check_valid"),
        ),
    )


def validate_swift(value: Column) -> Column:
    code = F.upper(strip(value))
    size = F.length(code)
    error = (
        F.when(~size.isin(8, 11), "Invalid length")
        .when(~fits(code, SWIFT_FORMAT), "Invalid format")
        .when(~code.substr(5, 2).isin(SWIFT_COUNTRIES), "Invalid country code")
    )
    ok = error.isNull()
    return F.when(
        value.isNotNull(),
        F.struct(
            code.alias("swift_code"),
            ok.alias("valid"),
            error.alias("error"),
            F.when(ok, code.substr(1, 4)).alias("bank_code"),
            F.when(ok, code.substr(5, 2)).alias("country_code"),
            F.when(ok, code.substr(7, 2)).alias("location_code"),
            F.when(ok, F.when(size == 11, code.substr(9, 3)).otherwise("N/A")).alias("branch_code"),
        ),
    )


def validate_crypto_address(value: Column, currency: Column | str) -> Column:
    currency = F.lit(currency) if isinstance(currency, str) else currency
    supported = F.coalesce(currency.isin(list(CRYPTO_FORMATS)), F.lit(False))
    ok = F.lit(False)
    for name, regex in CRYPTO_FORMATS.items():
        ok = F.when(currency == name, fits(value, regex)).otherwise(ok)
    return F.when(
        value.isNotNull(),
        F.struct(
            value.alias("address"),
            ok.alias("valid"),
            F.when(ok, currency).alias("currency"),
            F.when(~supported, "Unsupported cryptocurrency").when(~ok, "Invalid format").alias("error"),
        ),
    )


# --- Persons and things -----------------------------------------------------------


def is_social_security(value: Column) -> Column:
    number = digits_only(value)
    area, group, serial = number.substr(1, 3), number.substr(4, 2), number.substr(6, 4)
    return (
        fits(value, SSN_FORMAT)
        & ~area.isin("000", "666")
        & ~area.startswith("9")
        & (group != "00")
        & (serial != "0000")
    )


def validate_ssn(value: Column) -> Column:
    ssn = strip(F.replace(value, F.lit("-"), F.lit("")))
    number = ascii_digits(ssn)
    error = (
        F.when(~number.rlike("^[0-9]{9}$"), "Invalid format")
        .when(number.substr(1, 3).isin("000", "666") | number.startswith("9"), "Invalid area number")
        .when(number.substr(4, 2) == "00", "Invalid group number")
        .when(number.substr(6, 4) == "0000", "Invalid serial number")
    )
    return F.when(
        value.isNotNull(), F.struct(ssn.alias("ssn"), error.isNull().alias("valid"), error.alias("error"))
    )


def validate_tin(value: Column, country: Column | str) -> Column:
    """Tax number by country; an unknown country is an error."""
    country = F.lit(country) if isinstance(country, str) else country
    supported = F.coalesce(country.isin(list(TIN_FORMATS)), F.lit(False))
    ok = F.lit(False)
    for name, regex in TIN_FORMATS.items():
        ok = F.when(country == name, fits(value, regex)).otherwise(ok)
    error = F.when(
        ~supported, F.concat(F.lit("No pattern available for "), F.coalesce(country, F.lit("None")))
    ).when(~ok, "Invalid format")
    return F.when(
        value.isNotNull(),
        F.struct(
            value.alias("tin"), ok.alias("valid"), F.when(supported, country).alias("country"), error.alias("error")
        ),
    )


def validate_vin(value: Column) -> Column:
    """17 capitals (not I, O, Q) and digits; weighted sum by 11 gives the ninth."""
    numbers = F.array(*[F.lit(VIN_LETTERS.get(chr(c), 0)) for c in range(ord("A"), ord("Z") + 1)])
    weights = F.array(*[F.lit(w) for w in VIN_WEIGHTS])

    def number(c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, F.element_at(numbers, code - 64)).otherwise(code - 48)

    total = F.aggregate(
        F.zip_with(F.split(value, ""), weights, lambda c, w: number(c) * w), F.lit(0), lambda a, x: a + x
    )
    check = F.when(total % 11 == 10, "X").otherwise((total % 11).cast("string"))
    shaped = value.rlike(r"\A[0-9A-HJ-NPR-Z]{17}\z")
    return known(value, F.when(shaped, check == value.substr(9, 1)))


def validate_asn(value: Column, bit: int = 32) -> Column:
    if bit not in ASN_FORMATS:
        raise ValueError("Invalid bit size. Only 16 or 32-bit ASNs are supported.")
    return value.between(0, 2**bit - 1)


def validate_asn_format(value: Column, bit: int = 32) -> Column:
    if bit not in ASN_FORMATS:
        raise ValueError("Invalid bit size. Only 16 or 32-bit ASNs are supported.")
    return fits(strip(value), ASN_FORMATS[bit])


def validate_hashtag(value: Column) -> Column:
    tag = strip(value)
    ok = fits(tag, HASHTAG_FORMAT)
    return F.when(
        value.isNotNull(),
        F.struct(tag.alias("hashtag"), ok.alias("valid"), F.when(~ok, "Invalid format").alias("error")),
    )


def is_geo_coordinate(value: Column) -> Column:
    """Decimal degrees within ±90, ±180, or degrees, minutes and seconds within
    range (degrees not negative)."""
    decimal, dms = to_jvm(GEO_DECIMAL), to_jvm(GEO_DMS)

    def within(text: Column, regex: str, groups: tuple[int, ...], test: Callable[[Column], Column]) -> Column:
        # only a text of that form has numbers to read, and each is read once
        numbers = F.array(*[F.regexp_extract(text, regex, g).try_cast("double") for g in groups])
        return F.coalesce(F.when(text.rlike(regex), let(numbers, test)), F.lit(False))

    def by_degrees(n: Column) -> Column:
        return n[0].between(-90, 90) & n[1].between(-180, 180)

    def by_dms(n: Column) -> Column:
        in_range = n[0].between(0, 90) & n[1].between(0, 180)
        for i in range(2, 6):
            in_range = in_range & (n[i] >= 0) & (n[i] < 60)
        return in_range

    def of(text: Column) -> Column:
        return within(text, decimal, (1, 2), by_degrees) | within(text, dms, (1, 6, 2, 3, 7, 8), by_dms)

    return known(value, let(ascii_digits(value), of))


def is_html(text: Column) -> Column:
    """Whether the text holds at least one opening tag."""
    return text.rlike(r"<[A-Za-z][^>]*>")


# --- By type name -------------------------------------------------------------------

#: Boolean validators of the types that :func:`identify` looks for, in its order.
IDENTIFYING = {
    "email": is_email,
    "url": is_url,
    "ipv4": network.is_ipv4,
    "ipv6": network.is_ipv6,
    "cidr": network.is_cidr,
    "mac": network.is_mac_address,
    "uuid": is_uuid,
    "ssn": is_social_security,
    "credit_card": is_credit_card,
    "iban": is_valid_iban,
    "routing_number": aba_routing,
    "vin": validate_vin,
    "phone_number": lambda v: validate_phone_number(v)["valid"],
    "swift": lambda v: validate_swift(v)["valid"],
    "geo_coordinate": is_geo_coordinate,
    "hashtag": lambda v: validate_hashtag(v)["valid"],
    "domain": is_domain,
    "json": lambda v: is_json(v, exact=False),
}

#: All boolean validators of one value by type name.
VALIDATORS = {
    **IDENTIFYING,
    "date": is_date,
    "hostname": network.is_hostname,
    "private_ip": network.is_private_ip,
    "loopback_ip": network.is_loopback_ip,
    "multicast_ip": network.is_multicast_ip,
    "public_ip": network.is_public_ip,
    "reserved_ip": network.is_reserved_ip,
    "bank_account": is_bank_account,
    "asn": validate_asn_format,
    "nuban": nuban,
    "card_type": lambda v: known(v, detect_card_type(v).isNotNull()),
    "micr": lambda v: parse_micr_line(v)["valid"],
    "html": is_html,
}

#: Validators that say why a value fails; whether it does is for ``VALIDATORS``.
EXPLAINED = {
    "ssn": validate_ssn,
    "swift": validate_swift,
    "email": validate_email,
    "hashtag": validate_hashtag,
    "micr": parse_micr_line,
}


def identify(value: Column, types: list[str] | None = None) -> Column:
    """The types a value passes for, in catalog order."""
    names = types or list(IDENTIFYING)
    return F.filter(
        F.array(*[F.when(VALIDATORS[n](value), F.lit(n)) for n in names]), lambda x: x.isNotNull()
    )


def validate_as(value: Column, type_name: Column | str) -> Column:
    """Validity of a value as the named type; null for an unknown type."""
    if isinstance(type_name, str):
        return VALIDATORS[type_name](value)
    # one flat list of cases: nested ones are evaluated through as many calls
    first, *others = VALIDATORS.items()
    result = F.when(type_name == first[0], first[1](value))
    for name, check in others:
        result = result.when(type_name == name, check(value))
    return result


def checked(value: Column, type_name: str) -> Column:
    """struct<valid, error> of a value as the named type."""
    missing = F.when(value.isNull(), "Missing value")
    # the reason is looked for in failing values only
    reason = EXPLAINED[type_name](value)["error"] if type_name in EXPLAINED else F.lit(None).cast("string")
    return let(
        F.coalesce(VALIDATORS[type_name](value), F.lit(False)),
        lambda ok: F.struct(
            ok.alias("valid"), F.when(~ok, F.coalesce(missing, reason, F.lit("Invalid format"))).alias("error")
        ),
    )
