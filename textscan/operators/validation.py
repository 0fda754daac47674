"""Validation jobs over whole tables, and validators that need a rules table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textscan.functions import validators as V
from textscan.functions.regexes import to_jvm


def annotate(df: DataFrame, types: Mapping[str, str], suffix: str = "_check") -> DataFrame:
    """One struct<valid, error> next to each checked column, in one pass."""
    return df.withColumns({c + suffix: V.checked(F.col(c), t) for c, t in types.items()})


def validity_report(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Counts by column, validity and error reason.  Each row turns into one
    small struct per column and is counted before the shuffle."""
    checks = [F.struct(F.lit(c).alias("column"), V.checked(F.col(c), t).alias("check")) for c, t in types.items()]
    return (
        df.select(F.inline(F.array(*checks)))
        .groupBy("column", "check.valid", "check.error")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def all_valid(types: Mapping[str, str]) -> Column:
    result = F.lit(True)
    for c, t in types.items():
        result = result & V.checked(F.col(c), t)["valid"]
    return result


def split_valid_rows(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows); together they are the whole table."""
    ok = all_valid(types)
    return df.filter(ok), df.filter(~ok)


def type_profile(df: DataFrame, column: str, types: list[str] | None = None) -> DataFrame:
    """How many values of a column pass for each type (and for none), with
    their share of all values."""
    names = types or list(V.VALIDATORS)
    found = V.identify(F.col(column), names)
    labelled = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))
    counts = df.select(F.posexplode(labelled).alias("pos", "type")).groupBy("type").agg(
        F.count(F.lit(1)).alias("values"), F.sum((F.col("pos") == 0).cast("long")).alias("rows")
    )
    # one row per type is left, so the window over all of them is tiny
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))
    return counts.select("type", "values", (F.col("values") / total).alias("share"))


def keep_valid_entities(found: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """Of a (…, label, value) table keep the values that pass the validator of
    their label; labels without a validator are kept."""
    types = types or {"ipv4": "ipv4", "email": "email", "mac": "mac", "uuid": "uuid", "url": "url"}
    ok = F.lit(True)
    for label, type_name in types.items():
        ok = F.when(F.col("label") == label, V.VALIDATORS[type_name](F.col("value"))).otherwise(ok)
    return found.filter(ok)


def emails_with_known_tld(df: DataFrame, email: str, tlds: DataFrame) -> DataFrame:
    """Rows whose e-mail is valid and ends in a top-level domain of ``tlds(tld)``."""
    keyed = df.withColumn("__tld", V.email_tld(F.col(email))).filter(V.is_email(F.col(email)))
    table = tlds.select(F.lower("tld").alias("__tld")).distinct()
    return keyed.join(table, "__tld", "left_semi").drop("__tld")


def validate_phone_country(df: DataFrame, phone: str, codes: DataFrame) -> DataFrame:
    """Adds ``valid``: a phone number with a country code of ``codes(code)``."""
    kept = F.regexp_replace(V.ascii_digits(F.col(phone)), r"[^0-9+]", "")
    keyed = df.withColumn("__code", F.regexp_extract(kept, r"\A\+([0-9]{1,3})", 1))
    table = codes.select(F.col("code").alias("__code"), F.lit(True).alias("__known")).distinct()
    joined = keyed.join(table, "__code", "left")
    valid = V.is_phone_number(F.col(phone)) & F.coalesce("__known", F.lit(False))
    return joined.withColumn("valid", valid).drop("__code", "__known")


def validate_by_rules(
    df: DataFrame, value: str, country: str, rules: DataFrame, unsupported: str = "Country not supported"
) -> DataFrame:
    """Numbers checked by a rules table (country, format, details), such as
    passport or tax numbers: adds valid, error and details.  Of several rules for a
    country the first counts, by format and details."""
    table = rules.groupBy(F.col("country").alias(country)).agg(F.min(F.struct("format", "details")).alias("rule")).select(country, "rule.*")
    joined = df.join(table, country, "left")
    ok = F.regexp_like(F.col(value), F.concat(F.lit(r"(?d)\A(?:"), F.col("format"), F.lit(")")))
    error = F.when(F.col("format").isNull(), F.lit(unsupported)).when(~ok, F.lit("Invalid format"))
    return joined.withColumns(
        {
            "valid": F.coalesce(ok, F.lit(False)),
            "error": error,
            "details": F.when(ok, F.col("details")),
        }
    ).drop("format")


def tin_rules(spark) -> DataFrame:
    """The tax-number formats as a rules table."""
    rows = [(country, to_jvm(regex).removeprefix("(?d)"), None) for country, regex in V.TIN_FORMATS.items()]
    return spark.createDataFrame(rows, "country string, format string, details string")
