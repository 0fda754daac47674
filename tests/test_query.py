import pytest
from pyspark.sql import functions as F

from textscan.operators import query as Q

TEXT = """
10.0.0.1
8.8.8.8
300.1.1.1
user@example.com bob@gmail.com
https://example.com
/home/user/documents
2024-01-02T10:11:12Z and 2023-12-31
"""


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, TEXT), (2, "nothing here"), (3, "bob sees comcast at 10.0.1.7")], "id int, text string")


def one(df, column):
    return df.filter("id = 1").select(column.alias("r")).first()["r"]


def ids(df, query):
    return [r["id"] for r in df.filter(Q.text_filter("text", query)).orderBy("id").collect()]


def test_match_sets_and_chain(df):
    t = F.col("text")
    assert sorted(one(df, Q.match_set(t, "misc"))) == ["/home/user/documents", "bob@gmail.com", "https://example.com", "user@example.com"]
    assert one(df, Q.combine(t, "ipv4:ipv4 OR misc:url")) == ["10.0.0.1", "8.8.8.8"]
    assert one(df, Q.combine(t, "ipv4:ipv4 AND misc:email")) == []
    assert one(df, Q.combine(t, "ipv4:ipv4 NOT misc:unix_path")) == ["10.0.0.1", "8.8.8.8"]
    assert one(df, Q.combine(t, "misc:x NOT email:x")) == ["/home/user/documents", "https://example.com"]
    assert one(df, Q.combine(t, "email:x AND misc:x OR unix_path:x")) == ["/home/user/documents", "bob@gmail.com", "user@example.com"]
    with pytest.raises(ValueError, match="Unknown field"):
        Q.combine(t, "nope:x")


def test_batch_captures_errors(df):
    rows = Q.run_queries(df, "text", "id", ["ipv4:x", "bad", "nope:x"]).filter("id = 1").collect()
    assert [(r["query"], r["error"]) for r in rows] == [
        ("ipv4:x", None), ("bad", "Invalid term format: bad"), ("nope:x", "Unknown field: nope"),
    ]
    assert rows[0]["matches"] == ["10.0.0.1", "8.8.8.8"] and rows[1]["matches"] is None


def test_field_terms(df):
    t = F.col("text")
    assert one(df, Q.field_values(t, "ipv4:10.0.*")) == ["10.0.0.1"]
    # the term may stand later on the line, so both addresses are in front of "bob"
    assert one(df, Q.field_values(t, "email:bob")) == ["user@example.com", "bob@gmail.com"]
    assert one(df, Q.field_values(t, "unix_path:/etc")) == []
    assert one(df, Q.field_values(t, "datetime:2023*")) == ["2024-01-02T10:11:12Z", "2023-12-31"]


def test_value_conditions(df):
    assert one(df, Q.matching_values("text", "email:(com NOT bob)")) == ["user@example.com"]
    assert one(df, Q.matching_values("text", "datetime:(2023 OR 2024) AND NOT datetime:2023-12-31")) == ["2024-01-02T10:11:12Z"]
    assert one(df, Q.matching_values("text", "ipv4:10.0.* AND NOT ipv4:10.0.0.*")) == []


def test_row_conditions(df):
    assert ids(df, "bob") == [1, 3]
    assert ids(df, "bob AND NOT gmail") == [3]
    assert ids(df, '"nothing here" OR comcast') == [2, 3]
    assert ids(df, "n?thing h*e") == [2]
    assert ids(df, "bob+20+comcast") == [3]
    assert ids(df, "bob+2+comcast") == []
    assert ids(df, "[7 TO 9]") == [1, 3]
    assert ids(df, "url:example AND email:gmail") == [1]
    assert ids(df, "ipv4:(10.0.1 OR 8.8)") == [1, 3]
    assert ids(df, "ipv4:10.0.* AND NOT ipv4:10.0.0.*") == [3]
    assert ids(df, "(bob OR nothing) AND NOT (gmail OR comcast)") == [2]


def test_column_names_and_phrases_of_a_field(df):
    odd = df.withColumnRenamed("text", "my `text`")
    assert [r["id"] for r in odd.filter(Q.text_filter("my `text`", "gmail")).collect()] == [1]
    assert [r["id"] for r in odd.select("id", Q.matching_values("my `text`", "ipv4:8").alias("v")).filter("size(v) > 0").collect()] == [1]
    nested = df.selectExpr("id", "struct(text) AS s")
    assert [r["id"] for r in nested.filter(Q.text_filter("s.text", "gmail")).collect()] == [1]
    assert ids(df, 'unix_path:("home/user" OR "a b")') == [1]
    assert ids(df, 'unix_path:("a b")') == []
