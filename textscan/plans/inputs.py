"""Input columns of the checked queries, derived from the tables.

The tables hold few phone numbers and no IBANs, so candidate values are computed
from their keys.  Each expression is SQL that Spark and DuckDB read alike; it
covers every row of its table and mixes right, wrong and malformed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textscan.sources.files import spread


#: Orders that a task makes values of and checks.
ORDERS_PER_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str, most_rows: int | None = None) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), most_rows)


def _s(expression: str) -> str:
    return f"cast({expression} as string)"


def _pad(expression: str, width: int) -> str:
    return f"lpad({_s(expression)}, {width}, '0')"


def _case(key: str, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE {key} % {len(values)} {whens} END)"


K = "o_orderkey"
_HASH = f"md5({_s(K)})"
_TEN = _pad(f"({K} * 7919 + 13) % 10000000000", 10)

#: name -> expression over orders
ORDER_VALUES = {
    "number": _s(f"{K} * 7919 + 13"),
    "card": _case(
        K,
        f"'4' || {_pad(f'{K} * 7919', 15)}",
        f"'5500 ' || substr({_TEN}, 1, 4) || ' ' || substr({_TEN}, 5, 4) || ' ' || substr({_TEN}, 7, 4)",
        f"'37' || {_pad(f'{K} * 31', 13)}",
        f"'6011' || {_pad(f'{K} * 104729', 12)}",
        f"'35' || {_pad(f'{K} * 17', 14)}",
        f"'62-' || {_s(K)}",
        f"'30' || {_pad(f'{K} * 13', 12)}",
    ),
    "iban": _case(
        K,
        f"'DE' || {_pad(f'{K} % 100', 2)} || {_pad(f'{K} * 104729', 18)}",
        f"'gb' || {_pad(f'{K} * 7 % 100', 2)} || ' NWBK ' || {_pad(f'{K} * 31', 14)}",
        f"'FR' || {_pad(f'{K} * 3 % 100', 2)} || upper(substr({_HASH}, 1, 23))",
        f"'X' || {_s(K)}",
        # right check digits: 98 less the account, "DE" and "00" as a number, by 97
        f"'DE' || {_pad(f'98 - (({K} * 104729 % 97) * {10**6 % 97} + 131400) % 97', 2)} || {_pad(f'{K} * 104729', 18)}",
    ),
    "account": _case(
        K,
        f"'DE' || {_pad(f'{K} % 100', 2)} || '-' || {_pad(f'{K} * 104729', 18)}",
        f"'NL' || {_pad(f'{K} * 7 % 100', 2)} || ' ABNA ' || {_pad(f'{K} * 31', 10)}",
        f"'-' || {_TEN}",
        _TEN,
    ),
    "ssn": _case(
        K,
        f"{_pad(f'{K} * 7919 % 1000', 3)} || '-' || {_pad(f'{K} * 3 % 100', 2)} || '-' || {_pad(f'{K} * 31 % 10000', 4)}",
        _pad(f"{K} * 104729 % 1000000000", 9),
        f"'666-' || {_pad(f'{K} % 100', 2)} || '-1234'",
        f"'12-345-' || {_s(K)}",
        f"'123-' || {_pad(f'{K} % 20', 2)} || '-' || {_pad(f'{K} % 30', 4)}",
    ),
    "vin": _case(
        K,
        f"upper(substr({_HASH}, 1, 17))",
        f"'1HGCM8263' || upper(substr({_HASH}, 1, 8))",
        f"'I' || upper(substr({_HASH}, 1, 16))",
        f"substr({_HASH}, 1, 17)",
    ),
    "routing": _case(K, _pad(f"{K} * 7919 % 1000000000", 9), _TEN, f"'1221051' || {_pad(f'{K} % 100', 2)}"),
    "nuban": _case(K, _TEN, _pad(f"{K} * 104729", 10), _pad(f"{K} % 1000", 9)),
    "micr": _case(
        K,
        f"'⎕' || {_pad(f'{K} * 7919 % 1000000000', 9)} || '⎕' || {_s(K)} || '|' || {_s(f'{K} % 9999')}",
        f"'⎕' || {_pad(f'{K} * 31 % 100000000', 8)} || '⎕' || {_s(K)} || '|12'",
        f"'⎕' || {_pad(f'{K} * 104729 % 1000000000', 9)} || '⎕' || {_s(K)} || '|7 tail'",
    ),
    "swift": _case(
        K,
        "'DEUT' || " + _case(f"cast(floor({K} / 5) as bigint)", "'DE'", "'US'", "'XX'", "'GB'") + " || 'FF'",
        f"' deutin' || {_pad(f'{K} % 100', 2)} || '500 '",
        f"'BOFA' || {_s(f'{K} % 10')}",
        f"'1BCDUS' || {_pad(f'{K} % 100', 2)}",
        f"'HSBCJP' || upper(substr({_HASH}, 1, 2)) || 'XXX'",
    ),
    "ip": _case(
        K,
        f"{_s(f'{K} * 7 % 300')} || '.' || {_s(f'{K} * 31 % 256')} || '.' || {_s(f'{K} % 256')} || '.' || {_s(f'{K} * 3 % 260')}",
        f"'10.0.' || {_s(f'{K} % 256')} || '.' || {_s(f'{K} * 3 % 256')}",
        f"'127.0.0.' || {_s(f'{K} % 256')}",
        f"{_s(f'224 + {K} % 32')} || '.1.2.3'",
        f"'192.0.0.' || {_s(f'{K} % 256')}",
        f"'100.' || {_s(f'60 + {K} % 80')} || '.0.1'",
        f"'172.' || {_s(f'{K} % 40')} || '.1.255'",
        f"'192.168.0' || {_s(f'{K} % 100')} || '.1'",
        "'255.255.255.' || " + _case(K, "'255'", "'25'", "'256'"),
        f"'198.' || {_s(f'{K} % 60')} || '.100.1'",
        f"{_s(K)} || '.1.1'",
        f"'203.0.113.' || {_s(f'{K} % 300')}",
        f"'169.254.' || {_s(f'{K} % 256')} || '.1'",
    ),
    "cidr": _case(
        K,
        f"'10.0.' || {_s(f'{K} % 300')} || '.0/' || {_s(f'{K} % 40')}",
        f"'10.0.0.0/' || {_s(K)}",
        f"'10.0.0.' || {_s(f'{K} % 256')}",
        "'10.0.0.0/8/1'",
        "'10.0.0.0/x'",
    ),
    "ipv6": _case(
        K,
        f"'2001:db8::' || substr({_HASH}, 1, 4)",
        f"substr({_HASH}, 1, 4) || ':' || substr({_HASH}, 5, 4) || ':' || substr({_HASH}, 9, 4) || '::1'",
        f"'::ffff:' || {_s(f'{K} % 256')} || '.0.0.1'",
        f"'fe80::' || substr({_HASH}, 1, 4) || ':' || substr({_HASH}, 5, 4)",
        "'1:2:3:4:5:6:7:' || " + _case(K, "'8'", "'8:9'", "':'"),
        f"substr({_HASH}, 1, 5) || '::'",
        f"':' || substr({_HASH}, 1, 4)",
        _case(f"cast(floor({K} / 32) as bigint)", "'ff02::1'", "'::1'", "'0:0::0:1'"),
    ),
    "mac": _case(
        K,
        f"substr({_HASH}, 1, 2) || ':' || substr({_HASH}, 3, 2) || ':' || substr({_HASH}, 5, 2) || '-' || substr({_HASH}, 7, 2) || ':' || substr({_HASH}, 9, 2) || ':' || upper(substr({_HASH}, 11, 2))",
        f"substr({_HASH}, 1, 2) || ':' || substr({_HASH}, 3, 2) || ':' || substr({_HASH}, 5, 2)",
        f"'0g:1a:2b:3c:4d:' || substr({_HASH}, 1, 2)",
    ),
    "uuid": _case(
        K,
        f"substr({_HASH}, 1, 8) || '-' || substr({_HASH}, 9, 4) || '-' || substr({_HASH}, 13, 4) || '-' || substr({_HASH}, 17, 4) || '-' || substr({_HASH}, 21, 12)",
        f"'urn:uuid:' || {_HASH}",
        "'{' || upper(" + _HASH + ") || '}'",
        f"substr({_HASH}, 1, 31)",
        f"'g' || substr({_HASH}, 1, 31)",
    ),
    "phone": _case(
        K,
        f"'+1' || {_TEN}",
        f"'(' || substr({_TEN}, 8, 3) || ') ' || substr({_TEN}, 5, 3) || '-' || substr({_TEN}, 7, 4)",
        f"'+44' || {_TEN}",
        f"substr({_TEN}, 8, 3) || '-' || substr({_TEN}, 6, 3) || '-' || substr({_TEN}, 7, 4)",
        f"' ' || substr({_TEN}, 4, 7) || ' '",
        f"'+91-' || substr({_TEN}, 8, 3) || ' ' || substr({_TEN}, 6, 3) || '.' || substr({_TEN}, 7, 4)",
        f"'x' || {_s(K)}",
        f"'+4' || {_s(f'cast(floor({K} / 8) as bigint) % 10')} || ' (235) 467-' || {_pad(f'{K} * 7919 % 10000', 4)}",
    ),
    "email": _case(
        K,
        f"'user' || {_s(K)} || '@mail' || {_s(f'{K} % 7')} || '.example.com'",
        f"'u.' || {_s(K)} || '+tag@sub-a.example.' || " + _case(f"cast(floor({K} / 10) as bigint)", "'org'", "'de'", "'invalid1'", "'zz'"),
        f"'.lead' || {_s(K)} || '@example.com'",
        f"'a@b@' || {_s(K)} || '.com'",
        f"'nodomain' || {_s(K)}",
        f"'x' || {_s(K)} || '@-bad.com'",
        f"'x y' || {_s(K)} || '@exa_mple.com'",
        f"'u' || {_s(K)} || '@localhost'",
        f"'w' || {_s(K)} || '@ab--cd.net'",
        f"'v' || {_s(K)} || '@x.co'",
    ),
    "domain": _case(
        K,
        f"'host' || {_s(K)} || '.example.com'",
        f"'a.' || {_s(K)} || '.org'",
        f"'-bad' || {_s(K)} || '.com'",
        f"'under_score' || {_s(K)} || '.net'",
        f"'plain' || {_s(K)}",
        f"'x..y' || {_s(K)} || '.com'",
        f"{_HASH} || {_HASH} || '.com'",
        f"substr({_HASH}, 1, 20) || '.' || substr({_HASH}, 1, 10) || '.info'",
    ),
    "geo": _case(
        K,
        f"{_s(f'{K} % 200 - 100')} || '.' || {_s(f'{K} % 1000')} || ', ' || {_s(f'{K} % 400 - 200')}",
        f"{_s(f'{K} % 100')} || '°' || {_s(f'{K} * 7 % 70')} || '''' || {_s(f'{K} * 3 % 70')} || '.5\"N ' || {_s(f'{K} % 190')} || '°00''21\"W'",
        f"{_s(f'{K} % 90')} || ',' || {_s(f'{K} % 180')}",
        f"'x' || {_s(K)}",
    ),
    "asn": _case(K, _s(K), _s(f"{K} * 31 % 70000"), _pad(f"{K} % 100", 3), _s(f"4294960000 + {K}"), f"' ' || {_s(K)} || ' '"),
    "asn_number": _s(_case(K, K, f"{K} * 31 % 70000", f"4294960000 + {K}", f"0 - {K}", f"{K} * 7919")),
    "date": _case(
        f"cast(floor({K} / 8) as bigint)",
        "substr(cast(o_orderdate as string), 1, 10)",
        f"'due ' || {_s(f'{K} % 40')} || '/' || {_s(f'{K} * 7 % 40')} || '/2023 at last'",
        "o_orderpriority",
        f"'at ' || {_s(f'{K} % 30')} || ':' || {_pad(f'{K} * 3 % 80', 2)} || ' sharp'",
        f"'On JULY ' || {_s(f'{K} % 36')} || 'th, 2023'",
        f"{_s(f'{K} % 36')} || ' feb. 2023, or so'",
        f"{_s(f'{K} % 36')} || '.' || {_s(f'{K} * 5 % 20')} || '.2024'",
        f"'2024/2/' || {_s(f'{K} % 34')} || ' 1/2/33'",
    ),
    "tin": _case(
        K,
        f"{_pad(f'{K} % 1000', 3)} || '-' || {_pad(f'{K} % 100', 2)} || '-' || {_pad(f'{K} % 10000', 4)}",
        f"'ABCDE' || {_pad(f'{K} % 10000', 4)} || 'F'",
        f"'AB' || {_pad(f'{K} % 1000000', 6)} || 'C'",
        _pad(K, 11),
        f"'DE' || {_pad(K, 9)}",
    ),
    "tin_country": _case(f"cast(floor({K} / 5) as bigint)", "'US'", "'India'", "'UK'", "'Germany'", "'EU_VAT'", "'Mars'"),
    "passport": _case(K, f"'A' || {_pad(K, 8)}", f"'AB' || {_pad(f'{K} % 1000000', 6)}", _pad(K, 9), f"'?' || {_s(K)}"),
    "passport_country": _case(f"cast(floor({K} / 4) as bigint)", "'United States'", "'Canada'", "'India'", "'Atlantis'"),
    "crypto": _case(
        K,
        f"'1' || replace({_HASH}, '0', '2')",
        f"'0x' || {_HASH} || substr({_HASH}, 1, 8)",
        f"'D' || {_HASH} || 'x'",
        f"'ltc1' || {_HASH}",
        f"'r' || {_HASH}",
        f"'T' || {_HASH} || 'z'",
    ),
    "currency": _case(f"cast(floor({K} / 6) as bigint)", "'BTC'", "'ETH'", "'DOGE'", "'LTC'", "'XRP'", "'USDT'", "'ABC'"),
    "hashtag": _case(K, f"'#tag_' || {_s(K)}", f"'tag' || {_s(K)}", f"' #x' || {_s(K)} || ' '", f"'#a b' || {_s(K)}", f"'#' || {_HASH} || {_HASH} || {_HASH} || {_HASH} || substr({_HASH}, 1, {5} + cast({K} % 9 as int))"),
    "path": _case(
        K,
        f"'/srv/' || {_s(f'{K} % 100')} || '/../data/./' || {_s(K)}",
        f"'C:' || chr(92) || 'data' || chr(92) || {_s(K)}",
        f"'~/notes/' || {_s(K)} || '/'",
        f"'//net//' || {_s(K)} || '/..'",
        f"'../up/' || {_s(K)} || '/../../..'",
        f"'rel/' || {_s(K)}",
        f"'./a:' || {_s(K)}",
        f"'C:/x/' || {_s(K)}",
    ),
}


def order_values(spark: SparkSession, sf_dir: str, name: str, *more: str) -> DataFrame:
    columns = [f"{ORDER_VALUES[m]} AS {m}" for m in more]
    return table(spark, sf_dir, "orders", ORDERS_PER_TASK).selectExpr(f"{K} AS id", f"{ORDER_VALUES[name]} AS value", *columns)


def order_values_sql(name: str, *more: str) -> str:
    columns = "".join(f", {ORDER_VALUES[m]} AS {m}" for m in more)
    return f"(SELECT {K} AS id, {ORDER_VALUES[name]} AS value{columns} FROM orders)"


_ID, _DOC_HASH = _s("doc_id"), f"md5({_s('doc_id')})"

#: A passage after each document, so that every label has hits: it varies with
#: the document and is part of the text that is searched.
PASSAGE = _case(
    "doc_id",
    f"' Call 203-555-' || {_pad('doc_id % 10000', 4)} || ' or +1 (203) 553-3294 on Monday or Tues, in January, Feb or May. '",
    f"' At 12:34:' || {_pad('doc_id % 60', 2)} || ' and 10:20am on 2024-01-' || {_pad('doc_id % 28 + 1', 2)} || 'T10:11:12Z, or 01/02/2024 10:11:12, 2024/8/29, 12.03.24, March 3rd 2024, Apr 4th 1922. '",
    f"' Hosts fe80::1ff:fe23:4567:' || substr({_DOC_HASH}, 1, 4) || ' 10.0.' || {_s('doc_id % 256')} || '.1/24 2001:db8::ff34:5678 aa:bb:cc:dd:ee:' || substr({_DOC_HASH}, 1, 2) || ' aabb.ccdd.ee' || substr({_DOC_HASH}, 3, 2) || ' aabbccddee' || substr({_DOC_HASH}, 5, 2) || ' '",
    f"' Files /etc/config/' || substr({_DOC_HASH}, 1, 6) || '.ini C:' || chr(92) || 'Windows' || chr(92) || chr(92) || 'x' || {_ID} || ' [section' || {_s('doc_id % 9')} || '] 0x1F' || substr({_DOC_HASH}, 1, 3) || ' $HOME %APPDATA% '",
    f"' See https://example.com/' || {_ID} || '?q=[1] and ssh://host:22/x. Id ' || substr({_DOC_HASH}, 1, 8) || '-' || substr({_DOC_HASH}, 9, 4) || '-' || substr({_DOC_HASH}, 13, 4) || '-' || substr({_DOC_HASH}, 17, 4) || '-' || substr({_DOC_HASH}, 21, 12) || ' write to user.' || {_ID} || '@mail' || {_s('doc_id % 5')} || '.example.org. '",
    "' We use HTTP, TCP and dns with Python, java and c++; json, PDF; Linux, Windows; React, Django; AWS, docker; MySQL, redis; firewall, VPN; GPU, router; modem, access point; keras, bert; git, GitHub; flutter; bitcoin; unity. '",
    f"' we do not know how the server was reached by them. The team in the north said the system ' || {_ID} || ' is down. A report came in from Alice Smith about the new release today. '",
    f"' the team in our lab completed the first phase ' || {_ID} || '. All went well today. They have a NASA JPL mission to run soon here. He also said \"we will win\" before they left town. '",
    f"' this was the Bob''s house at last. It is handled by Carol during the night ' || {_ID} || '. a very critical issue was found in the code. there is a threat to all of us. '",
    f"' do you know what this is about? they sold about 3,000 units over the last year. Order ABCDEFGHIJ with id abc123def4567890abcdefgh and 12345678' || {_ID} || ' in ab-cd-ef-gh-ij with x' || {_pad('doc_id', 6)} || ' in it. '",
)

SEARCHED_TEXT = f"text || {PASSAGE}"


def searched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, each followed by its passage."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "source", f"{SEARCHED_TEXT} AS text")


SEARCHED_SQL = f"(SELECT doc_id, lang, source, {SEARCHED_TEXT} AS text FROM documents)"
