"""A spread of the checked queries against DuckDB on the smallest tables."""

import importlib.util
import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
NAMES = [
    "X04_datetime", "X07_ipv6", "X12_email", "X33_analyze", "X35_reporting_statement", "X41_proper_noun", "EX05_stitch_span",
    "EX11_entity_profile", "EX13_redact", "X39_action_context", "T14_prepare_text", "LQ05_left_to_right", "LQ08_field_term", "LQ12_grouping", "C2_verhoeff", "V05_is_email",
    "V18_is_public_ip", "V15_V19_ipv6_private", "V30_is_valid_iban", "V34_validate_passport", "VJ2_validity_report", "V01_is_date",
    "V44_validate_as_type", "V26_validate_asn", "N1_nested_normalisation", "N2_nested_values", "LQ02_and", "LQ04_not", "M2_gram_weights", "M3_position_counts",
    "T05_lemmatize_words", "T09_remove_duplicates", "A04_top_words_by_language", "A06_corpus_statistics_cube",
    "A07_conversation_ngrams", "F15_normalize_path", "SNK4_table_to_markdown", "M6_classification_report",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def entry():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def duck():
    connection = pytest.importorskip("duckdb").connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


#: Checks whose result must be true on some rows and false on others.
TWO_SIDED = (
    "V01_is_date", "V04_is_phone_number", "V04_phone_with_country_codes", "V05_is_email", "V08_is_social_security", "V09_is_credit_card",
    "V15_V19_ipv6_loopback", "V16_is_loopback_ip", "V25_validate_vin", "V26_validate_asn", "V30_is_valid_iban", "V31_routing_number",
)


@pytest.mark.parametrize("name", TWO_SIDED)
def test_checks_have_both_outcomes(entry, spark, name):
    counts = {r["result"]: r["count"] for r in entry.queries()[name](spark, DATA).groupBy("result").count().collect()}
    total = sum(counts.values())
    assert min(counts.get(True, 0), counts.get(False, 0)) >= total / 100, counts


def test_entry_points(entry, spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 180
    assert entry.entry(spark).columns == ["doc_id", "label", "value"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(entry, duck, spark, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    expected = sorted(([row[i] for i in order] for row in cursor.fetchall()), key=str)
    got = sorted(([row[c] for c in columns] for row in df.collect()), key=str)
    assert got == [pytest.approx(e) if any(isinstance(x, float) for x in e) else e for e in expected]
