"""Checked queries: validators, check digits and validation jobs."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from textscan.functions import checksums as C
from textscan.functions import network as N
from textscan.functions import validators as V
from textscan.operators import extract as E
from textscan.operators import validation as J
from textscan.plans.extraction_checks import _patterns, quoted, values_sql
from textscan.plans.inputs import order_values, order_values_sql, searched_documents, table

DIGITS = "regexp_replace({v}, '[^0-9]', '', 'g')"


def date_sql(v: str) -> str:
    """The dates of ``V.is_date``: matches that DuckDB reads in one of the formats."""
    forms = {"yyyy-M-d": "%Y-%m-%d", "yyyy/M/d": "%Y/%m/%d", "M/d/yyyy": "%m/%d/%Y", "d/M/yyyy": "%d/%m/%Y", "M.d.yyyy": "%m.%d.%Y", "d.M.yyyy": "%d.%m.%Y"}
    tests = [match(v, V.TIME_SHAPE)]
    for shape, names in V.DATE_SHAPES:
        reads = " OR ".join(f"try_strptime(m, '{forms[n]}') IS NOT NULL" for n in names)
        tests.append(f"len(list_filter(regexp_extract_all({v}, {q(shape)}, 1), lambda m: {reads})) > 0")
    for shape, parts in V.NAMED_DATES:
        plain = f"regexp_replace(m, {q(shape)}, '" + " ".join(f"\\{i}" for i in parts) + "')"
        tests.append(f"len(list_filter(regexp_extract_all({v}, {q(shape)}, 0), lambda m: try_strptime({plain}, '%d %b %Y') IS NOT NULL)) > 0")
    return "(" + " OR ".join(tests) + ")"


def q(regex: str) -> str:
    return quoted(regex)


def match(value: str, regex: str) -> str:
    return f"regexp_matches({value}, {q(regex)})"


def digits_list(v: str) -> str:
    return f"list_transform(string_split({v}, ''), lambda c: TRY_CAST(c AS INTEGER))"


def luhn_sql(v: str) -> str:
    doubled = "(CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END)"
    return (
        f"(list_sum(list_transform(list_reverse({digits_list(v)}), lambda d, i: CASE WHEN i % 2 = 0 THEN {doubled} ELSE d END)) % 10 = 0)"
    )


def weighted_sql(v: str, weights) -> str:
    return "(" + " + ".join(f"CAST(substr({v}, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights, 1)) + ")"


def verhoeff_sql(v: str) -> str:
    d = "[" + ",".join(str(x) for row in C._VERHOEFF_D for x in row) + "]"
    p = "[" + ",".join(str(x) for row in C._VERHOEFF_P for x in row) + "]"
    permuted = f"list_transform(list_reverse({digits_list(v)}), lambda n, i: ({p})[((i - 1) % 8) * 10 + n + 1])"
    return f"list_reduce({permuted}, lambda a, n: ({d})[a * 10 + n + 1], 0)"


def damm_sql(v: str) -> str:
    t = "[" + ",".join(str(x) for row in C._DAMM for x in row) + "]"
    return f"list_reduce({digits_list(v)}, lambda a, n: ({t})[a * 10 + n + 1], 0)"


def aba_sql(v: str) -> str:
    return f"(CASE WHEN {match(v, '^[0-9]{9}$')} THEN {weighted_sql(v, [3, 7, 1] * 3)} % 10 = 0 ELSE false END)"


def iban_sql(v: str) -> str:
    c = f"upper(replace({v}, ' ', ''))"
    turned = f"(substr({c}, 5) || substr({c}, 1, 4))"
    code = "CASE WHEN unicode(c) >= 65 THEN CAST(unicode(c) - 55 AS VARCHAR) ELSE c END"
    # spell the number out (two digits for a letter), then fold over its digits
    spelled = f"array_to_string(list_transform(string_split({turned}, ''), lambda c: {code}), '')"
    rest = f"list_reduce(list_transform(string_split({spelled}, ''), lambda c: TRY_CAST(c AS INTEGER)), lambda a, n: (a * 10 + n) % 97, 0)"
    return f"(CASE WHEN {match(c, '^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}')} AND {match(c, '^[A-Z0-9]+$')} THEN {rest} = 1 ELSE false END)"


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_SQL = rf"^({_OCTET}\.){{3}}{_OCTET}$"


def ip_number_sql(v: str) -> str:
    part = "CAST(split_part({v}, '.', {i}) AS BIGINT)"
    total = " + ".join(f"{part.format(v=v, i=i)} * {256 ** (4 - i)}" for i in range(1, 5))
    return f"(CASE WHEN {match(v, IPV4_SQL)} THEN {total} END)"


def in_blocks_sql(v: str, *blocks: str) -> str:
    tests = []
    for block in blocks:
        base, bits = block.split("/")
        a, b, c, d = map(int, base.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        tests.append(f"{ip_number_sql(v)} BETWEEN {low} AND {low + 2 ** (32 - int(bits)) - 1}")
    return "coalesce(" + " OR ".join(tests) + ", false)"


PRIVATE = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
           "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
PRIVATE_SQL = f"({in_blocks_sql('value', *PRIVATE)} AND value NOT IN ('192.0.0.9', '192.0.0.10'))"

# IPv6 in SQL: a dotted tail becomes two groups, then groups are counted
_TAIL = r"(^|:)(" + IPV4_SQL[1:-1] + r")$"
_V6_BODY = (
    f"(CASE WHEN {match('value', _TAIL)} THEN regexp_replace(value, {q(IPV4_SQL[1:])}, '') || "
    "printf('%02x%02x:%02x%02x', " + ", ".join(
        f"CAST(split_part(regexp_extract(value, {q(IPV4_SQL[1:])}), '.', {i}) AS INTEGER)" for i in range(1, 5)
    ) + ") ELSE value END)"
)


def _groups_sql(text: str) -> str:
    return f"list_filter(string_split({text}, ':'), lambda g: g <> '')"


IPV6_ROWS = f"""(SELECT id, value, b, {_groups_sql('b')} AS g, {_groups_sql("split_part(b, '::', 1)")} AS l, {_groups_sql("split_part(b, '::', 2)")} AS r
    FROM (SELECT id, value, {_V6_BODY} AS b FROM {order_values_sql('ipv6')}))"""
IPV6_SQL = """(len(list_filter(g, lambda x: NOT regexp_matches(x, '^[0-9a-fA-F]{1,4}$'))) = 0 AND NOT contains(b, ':::')
    AND CASE WHEN contains(b, '::') THEN len(string_split(b, '::')) = 2 AND len(g) <= 7 AND NOT regexp_matches(b, '^:[^:]|[^:]:$')
        ELSE len(g) = 8 AND NOT regexp_matches(b, '^:|:$') END)"""
IPV6_HEX = """array_to_string(list_transform(list_concat(l, list_transform(range(0, 8 - len(l) - len(r)), lambda z: '0'), r), lambda x: lpad(lower(x), 4, '0')), '')"""


def in_v6_sql(blocks) -> str:
    ranges = [(f"{int(n[0]):032x}", f"{int(n[-1]):032x}") for n in map(ipaddress.ip_network, blocks)]
    return "(" + " OR ".join(f"h BETWEEN '{low}' AND '{high}'" for low, high in ranges) + ")"


def mapped_sql(blocks) -> str:
    """Whether ::ffff:a.b.c.d lies in IPv4 blocks, by the same hex digits."""
    return in_v6_sql([f"::ffff:{b.split('/')[0]}/{96 + int(b.split('/')[1])}" for b in blocks])


MAPPED = in_v6_sql(["::ffff:0:0/96"])
V6_PRIVATE = (
    f"CASE WHEN {MAPPED} THEN {mapped_sql(PRIVATE)} AND NOT {mapped_sql(['192.0.0.9/32', '192.0.0.10/32'])} "
    f"ELSE {in_v6_sql(N._PRIVATE_V6)} AND NOT {in_v6_sql(N._NOT_PRIVATE_V6)} END"
)
V6_PROPERTIES = {
    "private": V6_PRIVATE,
    "public": f"NOT ({V6_PRIVATE})",
    "loopback": f"{in_v6_sql(['::1/128'])} OR {mapped_sql(['127.0.0.0/8'])}",
    "multicast": in_v6_sql(["ff00::/8"]),
    "reserved": in_v6_sql(N._RESERVED_V6),
}


def ipv6_property_sql(family: str) -> str:
    return f"""SELECT id, CASE WHEN ok THEN {V6_PROPERTIES[family]} ELSE false END AS result
        FROM (SELECT id, {IPV6_SQL} AS ok, CASE WHEN {IPV6_SQL} THEN {IPV6_HEX} END AS h FROM {IPV6_ROWS})"""


ENTROPY = (
    "(CASE WHEN length({v}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({v}, '')), "
    "lambda c: -(len(list_filter(string_split({v}, ''), lambda x: x = c)) / length({v})) * "
    "log2(len(list_filter(string_split({v}, ''), lambda x: x = c)) / length({v})))) END)"
)


def email_sql(v: str) -> str:
    domain = f"split_part({v}, '@', 2)"
    bad = f"len(list_filter(string_split({domain}, '.'), lambda l: length(l) NOT BETWEEN 1 AND 63 OR l LIKE '-%' OR l LIKE '%-' OR (substr(l, 3, 2) = '--' AND l NOT LIKE 'xn--%')))"
    return f"(len(string_split({v}, '@')) = 2 AND {match(v, V.EMAIL_FORMAT)} AND length({domain}) <= 253 AND {bad} = 0)"


def phone_kind_sql(v: str) -> str:
    s = f"trim({v})"
    return f"CASE WHEN NOT {match(s, V.PHONE_FORMAT)} THEN 'Invalid' WHEN {s} LIKE '+1%' OR {match(s, V.PHONE_US)} THEN 'US' ELSE 'International' END"


def ssn_error_sql(v: str) -> str:
    s = f"trim(replace({v}, '-', ''))"
    return (
        f"CASE WHEN NOT {match(s, '^[0-9]{9}$')} THEN 'Invalid format' WHEN substr({s}, 1, 3) IN ('000', '666') OR {s} LIKE '9%' THEN 'Invalid area number' "
        f"WHEN substr({s}, 4, 2) = '00' THEN 'Invalid group number' WHEN substr({s}, 6, 4) = '0000' THEN 'Invalid serial number' END"
    )


def swift_error_sql(v: str) -> str:
    s = f"upper(trim({v}))"
    countries = ", ".join(f"'{c}'" for c in V.SWIFT_COUNTRIES)
    return (
        f"CASE WHEN length({s}) NOT IN (8, 11) THEN 'Invalid length' WHEN NOT {match(s, V.SWIFT_FORMAT)} THEN 'Invalid format' "
        f"WHEN substr({s}, 5, 2) NOT IN ({countries}) THEN 'Invalid country code' END"
    )


def by_case(key: str, formats: dict, value: str = "value") -> str:
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN {match(value, r)}" for k, r in formats.items()) + " ELSE false END)"


def card_type_sql(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {match(v, r)} THEN '{k}'" for k, r in V.CARD_TYPES.items()) + " ELSE 'Unknown' END"


VIN_NUMBER = "(CASE c " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in V.VIN_LETTERS.items()) + " ELSE CAST(c AS INTEGER) END)"
VIN_SQL = (
    f"(CASE WHEN {match('value', '^[0-9A-HJ-NPR-Z]{17}$')} THEN list_extract(string_split('0123456789X', ''), CAST(list_sum(list_transform(string_split(value, ''), "
    f"lambda c, i: {VIN_NUMBER} * ({V.VIN_WEIGHTS})[i])) % 11 AS INTEGER) + 1) = substr(value, 9, 1) ELSE false END)"
)
# the look-ahead (no leading full stop) as a first character class
RFC_EMAIL_SQL = match("value", r"^[^.].*@([A-Za-z0-9][A-Za-z0-9-]{0,62}[A-Za-z0-9]?[.])+[A-Za-z]{2,63}$")
GEO_DD = r"^(-?[0-9]{1,2}(?:\.[0-9]+)?),\s*(-?[0-9]{1,3}(?:\.[0-9]+)?)$"
GEO_DMS = r"^(-?[0-9]{1,2})°\s*([0-9]{1,2})'\s*([0-9]{1,2}(?:\.[0-9]+)?)\"\s*(?:[NSns])?,?\s*(-?[0-9]{1,3})°\s*([0-9]{1,2})'\s*([0-9]{1,2}(?:\.[0-9]+)?)\"\s*(?:[EWew])?$"


def _geo_sql() -> str:
    def part(regex, i):
        return f"TRY_CAST(regexp_extract(value, {q(regex)}, {i}) AS DOUBLE)"

    dd = f"{part(GEO_DD, 1)} BETWEEN -90 AND 90 AND {part(GEO_DD, 2)} BETWEEN -180 AND 180"
    dms = f"{part(GEO_DMS, 1)} BETWEEN 0 AND 90 AND {part(GEO_DMS, 4)} BETWEEN 0 AND 180" + "".join(
        f" AND {part(GEO_DMS, i)} >= 0 AND {part(GEO_DMS, i)} < 60" for i in (2, 3, 5, 6)
    )
    return f"(coalesce({dd}, false) OR coalesce({dms}, false))"


PASSPORT_RULES = [
    ("United States", "^[A-Z0-9]{9}$", "letter or digit, nine places"),
    ("Canada", "^[A-Z]{2}[0-9]{6}$", "two letters, six digits"),
    ("India", "^[A-Z][0-9]{7,8}$", "one letter, seven or eight digits"),
]
TLDS = ["com", "org", "net", "de"]
IDENTIFIED = ["email", "url", "ipv4", "mac", "uuid", "ssn", "routing_number"]
JSON_VALUES = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props || ' x' WHEN 2 THEN '[' || props || ', 1]'
    WHEN 3 THEN replace(props, '}', '') WHEN 4 THEN cast(user_id as string) ELSE event_type END"""
URL_VALUES = """CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN 'ftp://x/' || cast(page_id as string)
    WHEN 3 THEN replace(url, '//', '') ELSE 'https:///' || cast(page_id as string) END"""


def checks() -> dict:
    out: dict = {}

    def add(name, run, sql=None):
        out[name] = (run, sql)

    def on_orders(name, source, function, sql, *more):
        """One boolean (or plain) result per order."""
        add(
            name,
            lambda spark, d: order_values(spark, d, source, *more).select(
                "id", function(F.col("value"), *map(F.col, more)).alias("result")
            ),
            sql and f"SELECT id, {sql} AS result FROM {order_values_sql(source, *more)}",
        )

    def struct_on_orders(name, source, function, fields, sql, *more):
        """Chosen fields of a struct result per order."""
        add(
            name,
            lambda spark, d: order_values(spark, d, source, *more)
            .select("id", function(F.col("value"), *map(F.col, more)).alias("s"))
            .select("id", *[F.col(f"s.{f}").alias(f) for f in fields]),
            sql and f"SELECT id, {sql} FROM {order_values_sql(source, *more)}",
        )

    # --- check digits ----------------------------------------------------------
    on_orders("C1_luhn", "number", C.luhn, luhn_sql("value"))
    on_orders("C2_verhoeff", "number", C.verhoeff_digit, verhoeff_sql("value"))
    on_orders("C3_damm", "number", C.damm_digit, damm_sql("value"))
    on_orders(
        "C4_mod11", "number", C.mod11,
        f"(list_sum(list_transform(list_reverse({digits_list('value')}), lambda d, i: d * ((i - 1) % 9 + 2))) % 11 = 0)",
    )
    on_orders("C5_db1a1", "routing", C.db1a1, luhn_sql("value"))
    on_orders(
        "C6_nuban", "nuban", C.nuban,
        f"(CASE WHEN length(value) = 10 THEN {weighted_sql('value', [3, 7, 3, 3, 7, 3, 3, 7, 3, 3])} % 10 = 0 ELSE false END)",
    )

    # --- validators --------------------------------------------------------------
    on_orders("V01_is_date", "date", V.is_date, date_sql("value"))
    add(
        "V02_entropy",
        lambda spark, d: table(spark, d, "documents").select("doc_id", F.round(V.entropy(F.col("text")), 6).alias("entropy")),
        """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents),
           n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY 1, 2),
           t AS (SELECT doc_id, k, sum(k) OVER (PARTITION BY doc_id) AS total FROM n)
           SELECT doc_id, round(-sum(k / total * log2(k / total)), 6) AS entropy FROM t GROUP BY doc_id""",
    )
    add(
        "V03_is_url",
        lambda spark, d: table(spark, d, "pages").selectExpr("page_id AS id", f"{URL_VALUES} AS value").select(
            "id", V.is_url(F.col("value")).alias("result")
        ),
        f"SELECT id, {match('value', '(?i)^https?://[^/?#]')} AS result FROM (SELECT page_id AS id, {URL_VALUES} AS value FROM pages)",
    )
    on_orders(
        "V04_is_phone_number", "phone", V.is_phone_number,
        f"(length({DIGITS.format(v='value')}) BETWEEN 7 AND 15 AND {match('value', V.PHONE_FORMAT)} AND {ENTROPY.format(v='value')} >= 3.5)",
    )
    add(
        "V04_phone_with_country_codes",
        lambda spark, d: J.validate_phone_country(
            order_values(spark, d, "phone"), "value",
            table(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit("8")).alias("code"))
            .union(table(spark, d, "nation").select((F.col("n_nationkey") + 440).cast("string").alias("code"))),
        ).select("id", F.col("valid").alias("result")),
        f"""SELECT id, (length({DIGITS.format(v='value')}) BETWEEN 7 AND 15 AND {match('value', V.PHONE_FORMAT)} AND {ENTROPY.format(v='value')} >= 3.5
            AND regexp_extract(regexp_replace(value, '[^0-9+]', '', 'g'), '^\\+([0-9]{{1,3}})', 1) IN (
            SELECT CAST(n_nationkey AS VARCHAR) || '8' FROM nation UNION SELECT CAST(n_nationkey + 440 AS VARCHAR) FROM nation)) AS result
            FROM {order_values_sql('phone')}""",
    )
    on_orders("V05_is_email", "email", V.is_email, email_sql("value"))
    add(
        "V06_email_with_known_tld",
        lambda spark, d: J.emails_with_known_tld(
            order_values(spark, d, "email"), "value",
            table(spark, d, "nation").select(
                F.element_at(F.array(*map(F.lit, TLDS)), F.col("n_nationkey") % len(TLDS) + 1).alias("tld")
            ),
        ).select("id", "value"),
        f"""SELECT id, value FROM {order_values_sql('email')} WHERE {email_sql('value')}
            AND lower(list_extract(string_split(value, '.'), -1)) IN ({', '.join(map(q, TLDS))})""",
    )
    label = "(?:[a-zA-Z0-9][a-zA-Z0-9-]{0,61}[a-zA-Z0-9])"
    on_orders(
        "V07_is_domain", "domain", V.is_domain,
        f"(length(value) <= 253 AND {match('value', f'^(?:{label}[.])+[a-zA-Z]{{2,63}}$')})",
    )
    on_orders(
        "V08_is_social_security", "ssn", V.is_social_security,
        f"({match('value', V.SSN_FORMAT)} AND {ssn_error_sql('value')} IS NULL)",
    )
    digits = DIGITS.format(v="value")
    on_orders(
        "V09_is_credit_card", "card", V.is_credit_card,
        f"(length({digits}) BETWEEN 13 AND 19 AND {luhn_sql(digits)})",
    )
    on_orders("V10_is_ipv4", "ip", N.is_ipv4, match("value", IPV4_SQL))
    add(
        "V11_is_ipv6",
        lambda spark, d: order_values(spark, d, "ipv6").select("id", N.is_ipv6(F.col("value")).alias("result")),
        f"SELECT id, {IPV6_SQL} AS result FROM {IPV6_ROWS}",
    )
    on_orders("V12_is_mac_address", "mac", N.is_mac_address, match("value", "^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"))
    on_orders(
        "V13_is_hostname", "domain", N.is_hostname,
        "(length(value) <= 253 AND value NOT LIKE '%-%' AND len(list_filter(string_split(value, '.'), lambda l: length(l) NOT BETWEEN 1 AND 63)) = 0)",
    )
    on_orders(
        "V14_is_cidr", "cidr", N.is_cidr,
        f"coalesce(len(string_split(value, '/')) = 2 AND {match(chr(40) + 'split_part(value, chr(47), 1)' + chr(41), IPV4_SQL)} AND TRY_CAST(split_part(value, '/', 2) AS INTEGER) BETWEEN 0 AND 32, false)",
    )
    on_orders("V15_is_private_ip", "ip", N.is_private_ip, PRIVATE_SQL)
    on_orders("V16_is_loopback_ip", "ip", N.is_loopback_ip, in_blocks_sql("value", "127.0.0.0/8"))
    on_orders("V17_is_multicast_ip", "ip", N.is_multicast_ip, in_blocks_sql("value", "224.0.0.0/4"))
    on_orders(
        "V18_is_public_ip", "ip", N.is_public_ip,
        f"({match('value', IPV4_SQL)} AND NOT {PRIVATE_SQL} AND NOT {in_blocks_sql('value', '100.64.0.0/10')})",
    )
    on_orders("V19_is_reserved_ip", "ip", N.is_reserved_ip, in_blocks_sql("value", "240.0.0.0/4"))
    on_orders(
        "V20_is_broadcast_ip", "ip", lambda v: N.is_broadcast_ip(v, F.concat(v, F.lit("/20"))),
        f"coalesce({ip_number_sql('value')} = {ip_number_sql('value')} - {ip_number_sql('value')} % 4096 + 4095, false)",
    )
    for family in ("private", "loopback", "multicast", "public", "reserved"):
        add(
            f"V15_V19_ipv6_{family}",
            lambda spark, d, check=getattr(N, f"is_{family}_ip"): order_values(spark, d, "ipv6").select(
                "id", check(F.col("value")).alias("result")
            ),
            ipv6_property_sql(family),
        )
    bare = "replace(regexp_replace(replace(replace(value, 'urn:', ''), 'uuid:', ''), '^[{}]+|[{}]+$', '', 'g'), '-', '')"
    on_orders("V21_is_uuid", "uuid", V.is_uuid, match(bare, "(?i)^[0-9a-f]{32}$"))
    add(
        "V22_is_json",
        lambda spark, d: table(spark, d, "events").selectExpr("event_id AS id", f"{JSON_VALUES} AS value").select(
            "id", V.is_json(F.col("value")).alias("result")
        ),
        f"SELECT id, json_valid(value) AS result FROM (SELECT event_id AS id, {JSON_VALUES} AS value FROM events)",
    )
    on_orders("V23_is_geo_coordinate", "geo", V.is_geo_coordinate, _geo_sql())
    account_bare = "regexp_replace(value, '[\\s.\\-]', '', 'g')"
    on_orders(
        "V24_is_bank_account", "account", V.is_bank_account,
        f"({match('value', V.ACCOUNT_FORMAT)} AND {iban_sql(account_bare)})",
    )
    on_orders("V25_validate_vin", "vin", V.validate_vin, VIN_SQL)
    on_orders(
        "V26_validate_asn", "asn_number", lambda v: V.validate_asn(v.cast("long"), 16),
        "(CAST(value AS BIGINT) BETWEEN 0 AND 65535)",
    )
    on_orders("V27_validate_asn_format", "asn", V.validate_asn_format, match("trim(value)", V.ASN_FORMATS[32]))
    on_orders("V28_detect_card_type", "card", V.detect_card_type, card_type_sql("value"))
    compact = "replace(value, ' ', '')"
    struct_on_orders(
        "V29_validate_credit_card", "card", V.validate_credit_card, ["number", "type", "valid"],
        f"value AS number, {card_type_sql('value')} AS type, CASE WHEN {match(compact, '^[0-9]+$')} THEN {luhn_sql(compact)} END AS valid",
    )
    on_orders("V30_is_valid_iban", "iban", V.is_valid_iban, iban_sql("value"))
    on_orders("V31_routing_number", "routing", V.validate_routing_number, aba_sql("value"))
    micr = r"^⎕([0-9]{9})⎕([0-9]+)\|([0-9]+)"
    r1, r2, r3 = (f"regexp_extract(value, {q(micr)}, {i})" for i in (1, 2, 3))
    ok = match("value", micr)
    struct_on_orders(
        "V32_parse_micr_line", "micr", V.parse_micr_line,
        ["valid", "error", "routing_number", "account_number", "check_number"],
        f"({ok} AND {aba_sql(r1)}) AS valid, CASE WHEN NOT {ok} THEN 'Invalid MICR format' END AS error, "
        f"CASE WHEN {ok} THEN {r1} END AS routing_number, CASE WHEN {ok} THEN {r2} END AS account_number, CASE WHEN {ok} THEN {r3} END AS check_number",
    )
    tin_ok = by_case("tin_country", V.TIN_FORMATS)
    known_tin = "tin_country IN (" + ", ".join(map(q, V.TIN_FORMATS)) + ")"
    struct_on_orders(
        "V33_validate_tin", "tin", V.validate_tin, ["valid", "country", "error"],
        f"{tin_ok} AS valid, CASE WHEN {known_tin} THEN tin_country END AS country, "
        f"CASE WHEN NOT {known_tin} THEN 'No pattern available for ' || tin_country WHEN NOT {tin_ok} THEN 'Invalid format' END AS error",
        "tin_country",
    )
    add(
        "V33_tin_by_rules_table",
        lambda spark, d: J.validate_by_rules(
            order_values(spark, d, "tin", "tin_country"), "value", "tin_country", J.tin_rules(spark), "No pattern available"
        ).select("id", "valid", "error"),
        f"""SELECT id, {tin_ok} AS valid, CASE WHEN NOT {known_tin} THEN 'No pattern available' WHEN NOT {tin_ok} THEN 'Invalid format' END AS error
            FROM {order_values_sql('tin', 'tin_country')}""",
    )
    pass_ok = by_case("passport_country", {c: r for c, r, _ in PASSPORT_RULES})
    details = "CASE passport_country " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, _, t in PASSPORT_RULES) + " END"
    add(
        "V34_validate_passport",
        lambda spark, d: J.validate_by_rules(
            order_values(spark, d, "passport", "passport_country"), "value", "passport_country",
            spark.createDataFrame(PASSPORT_RULES, "country string, format string, details string"),
        ).select("id", "valid", "error", "details"),
        f"""SELECT id, {pass_ok} AS valid, CASE WHEN {details} IS NULL THEN 'Country not supported' WHEN NOT {pass_ok} THEN 'Invalid format' END AS error,
            CASE WHEN {pass_ok} THEN {details} END AS details FROM {order_values_sql('passport', 'passport_country')}""",
    )
    code, error = "upper(trim(value))", swift_error_sql("value")
    struct_on_orders(
        "V35_validate_swift", "swift", V.validate_swift,
        ["swift_code", "valid", "error", "bank_code", "country_code", "location_code", "branch_code"],
        f"{code} AS swift_code, ({error}) IS NULL AS valid, {error} AS error, "
        + ", ".join(
            f"CASE WHEN ({error}) IS NULL THEN {part} END AS {name}"
            for name, part in (
                ("bank_code", f"substr({code}, 1, 4)"), ("country_code", f"substr({code}, 5, 2)"),
                ("location_code", f"substr({code}, 7, 2)"),
                ("branch_code", f"CASE WHEN length({code}) = 11 THEN substr({code}, 9, 3) ELSE 'N/A' END"),
            )
        ),
    )
    struct_on_orders(
        "V36_validate_ssn", "ssn", V.validate_ssn, ["ssn", "valid", "error"],
        f"trim(replace(value, '-', '')) AS ssn, ({ssn_error_sql('value')}) IS NULL AS valid, {ssn_error_sql('value')} AS error",
    )
    lenient = r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
    struct_on_orders(
        "V37_validate_ip_address", "ip", V.validate_ip_address, ["valid", "type"],
        f"{match('value', lenient)} AS valid, CASE WHEN {match('value', lenient)} THEN 'IPv4' ELSE 'Invalid' END AS type",
    )
    struct_on_orders(
        "V37_validate_ipv6_address", "ipv6", V.validate_ip_address, ["valid", "type"],
        f"{match('value', N._IPV6_LENIENT)} AS valid, CASE WHEN {match('value', N._IPV6_LENIENT)} THEN 'IPv6' ELSE 'Invalid' END AS type",
    )
    struct_on_orders(
        "V38_validate_phone_number", "phone", V.validate_phone_number, ["phone_number", "valid", "type"],
        f"trim(value) AS phone_number, {match('trim(value)', V.PHONE_FORMAT)} AS valid, {phone_kind_sql('value')} AS type",
    )
    struct_on_orders(
        "V39_validate_email", "email", V.validate_email, ["valid", "error"],
        f"{RFC_EMAIL_SQL} AS valid, CASE WHEN NOT {RFC_EMAIL_SQL} THEN 'Invalid email format' END AS error",
    )
    crypto_ok = by_case("currency", V.CRYPTO_FORMATS)
    struct_on_orders(
        "V40_validate_crypto_address", "crypto", V.validate_crypto_address, ["valid", "currency", "error"],
        f"{crypto_ok} AS valid, CASE WHEN {crypto_ok} THEN currency END AS currency, "
        f"CASE WHEN currency = 'ABC' THEN 'Unsupported cryptocurrency' WHEN NOT {crypto_ok} THEN 'Invalid format' END AS error",
        "currency",
    )
    tag_ok = match("trim(value)", V.HASHTAG_FORMAT)
    struct_on_orders(
        "V41_validate_hashtag", "hashtag", V.validate_hashtag, ["hashtag", "valid", "error"],
        f"trim(value) AS hashtag, {tag_ok} AS valid, CASE WHEN NOT {tag_ok} THEN 'Invalid format' END AS error",
    )
    # as it is, without opening signs, and with a blank behind each
    html_or_less = "CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(html, '<', ' ') ELSE replace(html, '<', '< ') END"
    add(
        "V42_is_html",
        lambda spark, d: table(spark, d, "pages").select(
            F.col("page_id").alias("id"), V.is_html(F.expr(html_or_less)).alias("page"), V.is_html(F.col("url")).alias("address")
        ),
        f"""SELECT page_id AS id, {match('CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(html, chr(60), chr(32)) ELSE replace(html, chr(60), chr(60) || chr(32)) END', '<[A-Za-z][^>]*>')} AS page,
            {match('url', '<[A-Za-z][^>]*>')} AS address FROM pages""",
    )
    mixed = {"email": "email", "ipv4": "ip", "uuid": "uuid", "ssn": "ssn", "routing_number": "routing", "mac": "mac"}
    pick = "(CASE id % 6 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(mixed.values())) + " END)"
    kind = "(CASE id % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(mixed)) + " END)"

    def mixed_values(spark, d):
        return order_values(spark, d, "email", *list(mixed.values())).selectExpr(
            "id", f"{pick} AS value", f"{kind} AS type"
        )

    mixed_sql = f"(SELECT id, {pick} AS value, {kind} AS type FROM {order_values_sql('email', *list(mixed.values()))})"
    passes = {
        "email": email_sql("value"), "url": match("value", "(?i)^https?://[^/?#]"), "ipv4": match("value", IPV4_SQL),
        "mac": match("value", "^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"), "uuid": match(bare, "(?i)^[0-9a-f]{32}$"),
        "ssn": f"({match('value', V.SSN_FORMAT)} AND {ssn_error_sql('value')} IS NULL)", "routing_number": aba_sql("value"),
    }
    types_sql = "list_filter([" + ", ".join(f"CASE WHEN {passes[t]} THEN '{t}' END" for t in IDENTIFIED) + "], lambda x: x IS NOT NULL)"
    add(
        "V43_identify",
        lambda spark, d: mixed_values(spark, d).select(
            "id", F.array_join(V.identify(F.col("value"), IDENTIFIED), ",").alias("types")
        ),
        f"SELECT id, array_to_string({types_sql}, ',') AS types FROM {mixed_sql}",
    )
    #: type -> (its own check, the column of values)
    checked_types = {
        "email": ("V05_is_email", "email"), "domain": ("V07_is_domain", "domain"), "ssn": ("V08_is_social_security", "ssn"),
        "credit_card": ("V09_is_credit_card", "card"), "ipv4": ("V10_is_ipv4", "ip"), "mac": ("V12_is_mac_address", "mac"),
        "hostname": ("V13_is_hostname", "domain"), "cidr": ("V14_is_cidr", "cidr"), "private_ip": ("V15_is_private_ip", "ip"),
        "loopback_ip": ("V16_is_loopback_ip", "ip"), "multicast_ip": ("V17_is_multicast_ip", "ip"), "public_ip": ("V18_is_public_ip", "ip"),
        "reserved_ip": ("V19_is_reserved_ip", "ip"), "uuid": ("V21_is_uuid", "uuid"), "geo_coordinate": ("V23_is_geo_coordinate", "geo"),
        "bank_account": ("V24_is_bank_account", "account"), "vin": ("V25_validate_vin", "vin"), "asn": ("V27_validate_asn_format", "asn"),
        "iban": ("V30_is_valid_iban", "iban"), "routing_number": ("V31_routing_number", "routing"), "swift": ("V35_validate_swift", "swift"),
        "phone_number": ("V38_validate_phone_number", "phone"), "hashtag": ("V41_validate_hashtag", "hashtag"), "date": ("V01_is_date", "date"),
        "nuban": ("C6_nuban", "nuban"), "micr": ("V32_parse_micr_line", "micr"),
    }

    def values_by_type(spark, d):
        columns = list(dict.fromkeys(column for _, column in checked_types.values()))
        each = F.array(*[F.struct(F.lit(t).alias("type"), F.col(column).alias("value")) for t, (_, column) in checked_types.items()])
        return order_values(spark, d, "email", *columns).select("id", F.inline(each))

    plain = lambda sql: "valid" if " AS valid" in sql else "result"
    add(
        "V44_validate_as_type",
        lambda spark, d: values_by_type(spark, d).select("id", "type", V.validate_as(F.col("value"), F.col("type")).alias("valid")),
        " UNION ALL ".join(f"SELECT id, '{t}' AS type, {plain(out[check][1])} AS valid FROM ({out[check][1]})" for t, (check, _) in checked_types.items()),
    )

    # --- jobs -----------------------------------------------------------------------
    types = {"ssn": "ssn", "ip": "ipv4", "swift": "swift"}

    def records(spark, d):
        return order_values(spark, d, "ssn", "ssn", "ip", "swift").select("id", *types)

    records_sql = f"(SELECT id, ssn, ip, swift FROM {order_values_sql('ssn', 'ssn', 'ip', 'swift')})"
    errors = {
        "ssn": f"coalesce({ssn_error_sql('ssn')}, CASE WHEN NOT {match('ssn', V.SSN_FORMAT)} THEN 'Invalid format' END)", "swift": swift_error_sql("swift"),
        "ip": f"CASE WHEN NOT {match('ip', IPV4_SQL)} THEN 'Invalid format' END",
    }
    add(
        "VJ1_annotate",
        lambda spark, d: J.annotate(records(spark, d), types).select(
            "id", *[F.col(f"{c}_check.{f}").alias(f"{c}_{f}") for c in types for f in ("valid", "error")]
        ),
        "SELECT id, " + ", ".join(f"({errors[c]}) IS NULL AS {c}_valid, {errors[c]} AS {c}_error" for c in types) + f" FROM {records_sql}",
    )
    add(
        "VJ2_validity_report",
        lambda spark, d: J.validity_report(records(spark, d), types),
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", ({errors[c]}) IS NULL AS valid, {errors[c]} AS error, count(*) AS \"count\" FROM {records_sql} GROUP BY 1, 2, 3"
            for c in types
        ),
    )
    all_ok = " AND ".join(f"({errors[c]}) IS NULL" for c in types)
    for index, (name, test) in enumerate((("accepted", all_ok), ("quarantined", f"NOT ({all_ok})"))):
        add(
            f"VJ3_{name}",
            lambda spark, d, index=index: J.split_valid_rows(records(spark, d), types)[index],
            f"SELECT * FROM {records_sql} WHERE {test}",
        )
    add(
        "VJ4_type_profile",
        lambda spark, d: J.type_profile(mixed_values(spark, d), "value", IDENTIFIED),
        f"""WITH t AS (SELECT id, {types_sql} AS types FROM {mixed_sql}),
            l AS (SELECT unnest(CASE WHEN len(types) > 0 THEN types ELSE ['unknown'] END) AS type FROM t)
            SELECT type, count(*) AS "values", count(*) / (SELECT count(*) FROM t) AS share FROM l GROUP BY type""",
    )
    add(
        "VJ5_valid_entities",
        lambda spark, d: J.keep_valid_entities(
            E.extract(searched_documents(spark, d), "text", "doc_id", ["ipv4", "uuid", "month"])
        ),
        values_sql(_patterns("ipv4", "uuid", "month"))
        + f" SELECT doc_id, label, value FROM x WHERE label = 'month' OR (label = 'ipv4' AND {match('value', IPV4_SQL)})"
        + f" OR (label = 'uuid' AND {match(bare, '(?i)^[0-9a-f]{32}$')})",
    )
    return out
