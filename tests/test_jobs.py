import pytest
from pyspark.sql import functions as F

from textscan.catalog import label_names
from textscan.functions import validators as V
from textscan.operators import extract as E
from textscan.operators import model
from textscan.operators import validation as J
from textscan.plans import actions
from textscan.plans.inputs import searched_documents


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "123-45-6789", "10.0.0.1"), (2, "000-45-6789", "10.0.0.1"), (3, None, "x"), (4, "123-45-6789", "1.2.3.4")]
    return spark.createDataFrame(rows, "id int, ssn string, ip string")


TYPES = {"ssn": "ssn", "ip": "ipv4"}


def test_annotation_report_and_split(people):
    checked = {r["id"]: r for r in J.annotate(people, TYPES).collect()}
    assert checked[2]["ssn_check"]["error"] == "Invalid area number" and checked[3]["ssn_check"]["error"] == "Missing value"
    report = {(r["column"], r["valid"], r["error"]): r["count"] for r in J.validity_report(people, TYPES).collect()}
    assert report == {("ssn", True, None): 2, ("ssn", False, "Invalid area number"): 1, ("ssn", False, "Missing value"): 1,
                      ("ip", True, None): 3, ("ip", False, "Invalid format"): 1}
    good, bad = J.split_valid_rows(people, TYPES)
    assert sorted(r["id"] for r in good.collect()) == [1, 4] and sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_lookups(spark):
    emails = spark.createDataFrame([(1, "a@b.com"), (2, "a@b.zz"), (3, "bad"), (4, "a@c.COM")], "id int, email string")
    tlds = spark.createDataFrame([("com",), ("COM",), ("org",)], "tld string")
    assert sorted(r["id"] for r in J.emails_with_known_tld(emails, "email", tlds).collect()) == [1, 4]
    rules = spark.createDataFrame([("India", "^[A-Z][0-9]{8}$", "one letter")], "country string, format string, details string")
    numbers = spark.createDataFrame([(1, "P12345678", "India"), (2, "X", "India"), (3, "P1", "Mars")], "id int, no string, country string")
    got = {r["id"]: (r["valid"], r["error"], r["details"]) for r in J.validate_by_rules(numbers, "no", "country", rules).collect()}
    assert got == {1: (True, None, "one letter"), 2: (False, "Invalid format", None), 3: (False, "Country not supported", None)}
    phones = spark.createDataFrame([(1, "+1 (283) 456-7905"), (2, "+44 2345678901")], "id int, phone string")
    codes = spark.createDataFrame([("128",)], "code string")
    assert {r["id"]: r["valid"] for r in J.validate_phone_country(phones, "phone", codes).collect()} == {1: True, 2: False}


def test_type_profile(people):
    got = {r["type"]: (r["values"], r["share"]) for r in J.type_profile(people.filter("id <> 3"), "ip", ["ipv4", "ssn"]).collect()}
    assert got == {"ipv4": (3, 1.0)}


def test_actions(spark, people):
    df = spark.createDataFrame([(1, "Mail a@b.co NOW")], "id int, text string")
    assert actions.run(df, "extract", "text", "id", "email").first()["value"] == "a@b.co"
    assert actions.run(df, "redact", "text", ["email"]).first()["text"] == "Mail [EMAIL] NOW"
    assert actions.run(df, "normalize", "text", ["to_lowercase", "remove_special_chars"]).first()["text"] == "mail ab.co now"
    assert actions.run(df, "search", "text", "email:b.co").count() == 1
    assert actions.run(people, "identify", "ip", ["ipv4"]).first()["types"] == ["ipv4"]
    assert actions.run(df, "diagnose", "text", "Look").first()["prompt"].startswith("Look\n\nObject: Mail")
    with pytest.raises(ValueError, match="not defined"):
        actions.run(df, "nothing")


def test_sql_functions(spark):
    names = actions.register_functions(spark)
    assert "find_email" in names
    row = spark.sql("select has_email('x a@b.co') h, find_email('x a@b.co') f, is_date('2024-01-02') d, find_url('it''s http://a') u").first()
    assert tuple(row) == (True, ["a@b.co"], True, ["http://a"])


def test_sql_names_give_what_the_columns_give(spark):
    names = actions.register_functions(spark)
    assert {f"entities_{x}" for x in label_names()} | {f"is_{x}" for x in V.VALIDATORS} <= set(names)
    df = searched_documents(spark, "/root/testdata/sf0.001").limit(40).select("doc_id", "text").cache()
    df.createOrReplaceTempView("texts_of_names")
    total = 0
    for label in ("datetime", "analyze", "ipv6", "action_context", "reporting_statement", "protocol", "windows_path", "month"):
        want = sorted((r["doc_id"], r["value"]) for r in E.extract(df, "text", "doc_id", label).collect())
        got = spark.sql(f"SELECT doc_id, e.value FROM texts_of_names, LATERAL entities_{label}(text) e").collect()
        assert sorted(map(tuple, got)) == want, label
        total += len(want)
        held = spark.sql(f"SELECT doc_id FROM texts_of_names WHERE has_{label}(text)").count()
        assert held == df.filter(E.has_entity(F.col("text"), label)).count()
    assert total > 100
    values = ["a@b.co", "10.0.0.1", "2024-01-02", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "078-05-1120", "x", "", None, "#tag", "00:11:22:33:44:55", "https://a.b/c", "+44 20 7946 0958", "{\"a\": 1}"]
    data = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).cache()
    data.createOrReplaceTempView("values_of_names")
    want = data.select(*[c(F.col("v")).alias(k) for k, c in V.VALIDATORS.items()]).collect()
    assert spark.sql("SELECT " + ", ".join(f"is_{k}(v) AS {k}" for k in V.VALIDATORS) + " FROM values_of_names").collect() == want


def test_classifier(spark):
    samples = model.character_samples(spark, per_class=60)
    assert samples.count() == 540 and samples.filter(F.length("text") != 15).count() == 0
    predicted = model.train_and_predict(samples, trees=20).cache()
    accuracy = predicted.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
    assert accuracy > 0.6
    report = model.classification_report(predicted).collect()
    assert sum(r["support"] for r in report) == predicted.count()
    tiny = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, prediction string")
    got = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in model.classification_report(tiny).collect()}
    assert got == {"a": (1.0, 0.5, 2), "b": (0.5, 1.0, 1)}


def test_character_counts(spark):
    df = spark.createDataFrame([("a1 é²!\n",)], "t string")
    assert df.select(model.character_counts(F.col("t"))).first()[0] == [1, 2, 2, 1]


def test_vectors_by_broadcast_equal_those_by_join(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["abab", "Abc", "", "b" * 40, "xyz abc", None])], "i int, t string")
    known = model.vocabulary(df.limit(5), "t", 3)

    def found():
        out = model.vectors(df, "t", known, 3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        return plan, sorted((r["i"], r["indices"], [round(v, 9) for v in r["values"]]) for r in out.select("i", "indices", "values").collect())

    plan, small = found()
    assert "SortMergeJoin [kind" not in plan and "hashpartitioning(kind" not in plan  # pairs stay where their rows are
    monkeypatch.setattr(model, "MOST_BYTES", 0)
    assert found()[1] == small and len(small) == 6 and small[5][1] == []


def test_the_forest_reads_vectors_that_are_built_once(spark, monkeypatch):
    seen, kept = [], model.kept
    monkeypatch.setattr(model, "kept", lambda df: seen.append(df.columns) or kept(df))
    samples = model.character_samples(spark, per_class=5)
    assert model.train_and_predict(samples, trees=2, depth=2).count() > 0
    assert any("features" in columns for columns in seen)
