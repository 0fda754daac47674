"""Queries against DuckDB, and every operator and stage on odd tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textscan.llm import decontamination, packing, token_count, url_filter
from textscan.llm.queries import ORACLES, QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "It was there and of the other one, so that nobody minded it. Then came rain over all of the hills again."


def odd_documents():
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t", "en", None, 3), (4, PROSE, "en", "a", 9), (4, PROSE, "en", "a", 9), (5, PROSE, None, None, 9),
        (None, PROSE + " More words stand here.", "en", "a", 1), (None, None, None, None, None), (6, "word " * 20_000, "fr", "b", 1), (7, "x" * 200_000, "fr", "b", 1),
        (8, "Ünïcödé 日本語 🙂 a@b.co 1.2.3.4 and +1 (243) 555-5526 or 4111 1111 1111 1111 " + PROSE, "de", "b", 1), (9, "| a | b |\n" * 40, "de", "b", 1),
        (10, "Nothing of this stands in any test. It tells of a river and of two boats, and of an old man who mended them both.", "en", "a", 1),
    ]
    return rows


def folder(spark, path, rows=(), extra=False):
    """All tables of the queries, small or empty, with more columns on wish."""
    tables = {
        "documents": (rows, SCHEMA),
        "pages": ([(1, "HTTP://A.Example.COM/en/x?ref=1", ""), (2, None, ""), (3, "no scheme", ""), (None, "https://b.net", ""), (3, "http://b.net/es/#a", "")] if rows else [], "page_id long, url string, html string"),
        "benchmark": ([(1, PROSE), (None, PROSE), (2, None), (3, "hills again")] if rows else [], "item_id long, text string"),
        "labels": ([(4, 1, 0), (9, 0, 1), (None, 1, 0), (8, None, 0), (4, 0, 0)] if rows else [], "doc_id long, quality int, toxic int"),
        "conversations": ([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "<s>"), (None, 1, "assistant", "a"), (2, 0, "tool", "")] if rows else [], "conv_id long, turn long, role string, text string"),
    }
    for name, (data, schema) in tables.items():
        df = spark.createDataFrame(list(data), schema)
        if extra:
            names = "score predicted held_out spans n_email n_words kept base_failed fp row fingerprint component_id n_tokens n_hit item_ids contaminated host path verdict rule q_n_words start length offset sequence_id text_ redacted covered kind conv message".split()
            df = df.withColumns({n: F.lit("clash") for n in names})
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("odd"), odd_documents())


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", list(ORACLES))
@pytest.mark.parametrize("data", [DATA, "odd"])
def test_query_equals_sql(spark, name, data, odd):
    path = odd if data == "odd" else data
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        files = f"{path}/{t}.parquet" + ("/*.parquet" if data == "odd" else "")
        con.execute(f"create view {t} as select * from '{files}'")
    df = QUERIES[name](spark, path)
    cursor = con.execute(ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == sorted(df.columns)
    at = [theirs.index(c) for c in sorted(theirs)]
    assert rows_of(df) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=str)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, name, tmp_path):
    assert QUERIES[name](spark, folder(spark, tmp_path)).count() == (1 if name == "op10_chat" else 0)


@pytest.mark.parametrize("name", list(QUERIES))
def test_more_columns_change_nothing(spark, name, odd, tmp_path):
    plain = rows_of(QUERIES[name](spark, odd))
    assert rows_of(QUERIES[name](spark, folder(spark, tmp_path, odd_documents(), extra=True))) == plain
    if name not in ("op1_url_filter", "op9_packing", "op10_chat", "op12_turn_repair", "op13_prefix_trie", "pipeline"):
        assert len(plain) == len(odd_documents())


def test_odd_documents(spark, odd):
    n = {r["doc_id"]: r for r in QUERIES["op5_token_count"](spark, odd).collect()}
    assert n[1]["n_tokens"] == n[1]["n_bytes"] == n[2]["n_tokens"] == 0 and n[6]["over_limit"]
    found = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, odd).collect()}
    assert [found[8][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [1, 1, 1, 1]
    classes = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash"](spark, odd).collect()]
    assert {c for d, _, c in classes if d in (4, 5)} == {4} and {c for d, f, c in classes if f == "0" * 16} == {1}
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op7_quality_rules"](spark, odd).collect()}
    assert kept[4] and kept[5] and not kept[1] and not kept[2] and not kept[6]


def test_stages_keep_the_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.dtypes == spark.read.parquet(f"{odd}/documents.parquet").dtypes
        seen[name] = sorted(str(r["doc_id"]) for r in docs.collect())
    assert seen["quality_rules"].count("4") == 2 and "1" not in seen["quality_rules"]
    assert seen["simhash"].count("4") == 1 and "5" not in seen["simhash"]
    assert "4" not in seen["decontamination"]
    pieces = corpus_pipeline.run(spark, odd)
    assert {str(r["doc_id"]) for r in pieces.collect()} == set(seen["pii"])


def test_the_packed_corpus_is_in_the_result(spark, odd):
    docs = spark.createDataFrame([(1, PROSE), (2, None)], "doc_id long, text string")
    want = token_count.tokenizer(tokenizer_path("word_bpe_49k.json")).encode_batch([PROSE, ""], add_special_tokens=False)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, odd).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {1: [*want[0].ids, 1], 2: [1]}


def test_stages_with_clashing_columns(spark, tmp_path):
    path = folder(spark, tmp_path, odd_documents(), extra=True)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() > 0


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_filter.HostRule("block", "example.com", "/en/"), url_filter.PatternRule("block", "^ref="), url_filter.PatternRule("block", "*x*")]
    index = url_filter.RuleIndex(rules, {"example": 5, "com": 90, "en": 2, "ref": 7})
    assert set(index.by_token) == {"en", "ref"} and len(index.always) == 1
    assert [str(r) for r, _ in index.candidates("http://a.example.com/fr/")] == [str(rules[2])]


def test_rule_regexes():
    judge = lambda url, *rules: url_filter.RuleIndex(list(rules), {}).judge(url)
    block = url_filter.PatternRule("block", "|https:*/a^b|")
    assert judge("https://x/a?b", block)[3] == "block" and judge("https://x/a?bc", block)[3] == "allow"
    rules = [url_filter.HostRule("block", "net", "/es/"), url_filter.HostRule("allow", "a.net", "/es/")]
    assert judge("http://b.a.NET/es/1#x", *rules)[:4] == ("b.a.net", "/es/1", "a.net/es/", "allow")
    assert judge("http://xa.net/es/1", *rules)[2] == "net/es/" and judge("http://net?/es/", *rules)[2] is None


def test_contamination_keeps_columns(spark):
    docs = spark.createDataFrame([(1, PROSE, "mine", 7), (2, None, None, 8)], "doc_id long, text string, n_words string, N_HIT int")
    items = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    out = decontamination.contamination(docs, "text", items, "item_id", "text")
    assert out.columns == ["doc_id", "text", "n_words", "N_HIT", "_n_words", "_n_hit", "item_ids", "contaminated"]
    assert [tuple(r)[2:] for r in out.orderBy("doc_id").collect()] == [("mine", 7, 22, 22, ["1"], True), (None, 8, 0, 0, [], False)]


def test_packing_is_a_function_of_the_rows(spark):
    rows = odd_documents() + [(None, None, None, None, None)] * 300 + [(i, PROSE * (i % 90), "en", "a", 1) for i in range(100, 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, other = (rows_of(packing.pack(d, "doc_id", "text", tokenizer_path("word_bpe_49k.json"))) for d in (df.coalesce(1), df.orderBy(F.rand(3)).repartition(7)))
    assert one == other
    held = packing.pack(df, "doc_id", "text", tokenizer_path("word_bpe_49k.json"), with_ids=True)
    assert rows_of(held.drop("ids")) == one and held.filter(F.size("ids") != F.col("length")).count() == 0
