import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textscan import catalog
from textscan.catalog import PATTERNS
from textscan.functions.regexes import markable, marked, running, sanitize, spans, to_jvm
from textscan.operators import extract as E
from textscan.plans.inputs import searched_documents

# pieces of text around the shapes of the catalog, with awkward neighbours
PIECES = [
    "the", "a", "how", "why", "said", "stated", '"', '".', "Alice", "Bob Smith", "by", "from", "to", "USA", "NASA", "critical",
    "10", "3,000", "5.5", "percent", "threat", "?", "!", ".", ",", "'s", "’s", "owned by", "completed", "developed", "é", "ñandú",
    "Éric", "12:34:56", "12:34", "2024-01-02", "2024-01-02T10:11:12Z", "01/02/2024", "01/02/2024 10:11:12", "Jan", "May",
    "march", "monday", "Tues", "thu", "3rd 2024", "10:20am", "12pm", "AA:BB:CC:DD:EE:FF", "aabbccddeeff", "aabb.ccdd.eeff",
    "fe80::1", "2001:db8::", "::1", "1.2.3.4", "10.0.0.1/24", "+1 (203) 553-3294", "942 282 1445", "/etc/passwd", "/a//b/", "/",
    "C:\\Windows\\x", "\\\\srv\\x", "a@b.co", "x.y@z-w.a.b.", "@", "https://e.com/x?y=[1]", "ssh://", "[ini]", "0x1F", "$HOME",
    "%APP%", "550e8400-e29b-41d4-a716-446655440000", "c++", "C#", "python", "next.js", "visual  basic", "access point", "²", "½",
    "_", "e\u0301", "٣", "abcdefghij1234567890xyz", "ABCDEFGHIJ", "12345678", "ab,cd:ef|gh.ij-kl", "!1.2.3.", "!::a::", "\n",
    "\t", " ", "  ", "😀", "\u200b", "\u00a0", "\u0001", "in the", "word", "of", " is ",
]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return [
        "".join(rnd.choice(PIECES) + rnd.choice([" ", " ", "", ". "]) for _ in range(rnd.randint(0, 40))) for _ in range(n)
    ]


def python_sanitize(text):
    return re.sub(r"\s+", " ", "".join(filter(str.isprintable, text)))


@pytest.fixture(scope="module")
def texts():
    return random_texts(700, 7) + ["", "12:34:56"]


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").cache()


@pytest.mark.parametrize("sanitized", [True, False])
def test_every_pattern_matches_as_in_python(df, texts, sanitized):
    prepared = df.select("id", (sanitize(F.col("text")) if sanitized else F.col("text")).alias("t"))
    original = None if sanitized else F.col("t")
    found = F.array(
        *[F.struct(F.lit(p.ordinal).alias("o"), marked(markable(F.col("t"), sanitized), p).alias("m")) for p in PATTERNS]
    )
    rows = prepared.select("id", "t", F.transform(found, lambda x: spans(x["m"], original)).alias("spans")).collect()
    for row in rows:
        text = python_sanitize(texts[row["id"]]) if sanitized else texts[row["id"]]
        assert row["t"] == text
        for p, got in zip(PATTERNS, row["spans"]):
            expected = [(m.group(), m.start(), m.end()) for m in re.finditer(p.regex, text)]
            assert [tuple(g) for g in got] == expected, (p.label, text)


def restated(text, mode):
    """Stitching and cleaning in plain Python, from their description."""
    text, by_label, out = python_sanitize(text), {}, {}
    for p in PATTERNS:
        for m in re.finditer(p.regex, text):
            by_label.setdefault(p.label, []).append((m.start(), p.ordinal, m.end(), m.group()))
    for label, found in by_label.items():
        values, value, end = set(), None, -1
        for start, _, stop, match in sorted(found):
            if value is not None and end >= start:
                value += match if mode == "concat" else text[end:stop]
                end = stop if mode == "concat" else max(end, stop)
            else:
                values.add(value)
                value, end = match, stop
        values = {v.strip() for v in values | {value} if v is not None}
        if label == "windows_path":
            values = {v.replace("\\\\", "\\") for v in values}
        out[label] = {v.rstrip(".") for v in values}
    return out


@pytest.mark.parametrize("mode", ["concat", "span"])
def test_extract_equals_the_restatement(df, texts, mode):
    got = {}
    for r in E.extract(df, "text", "id", stitch=mode).collect():
        got.setdefault(r["id"], {}).setdefault(r["label"], set()).add(r["value"])
    for i, text in enumerate(texts):
        assert got.get(i, {}) == restated(text, mode)


def test_window_and_in_row_span_stitching_agree(df):
    labels = ["datetime", "ipv6", "time", "date"]
    merged = E.merge_spans(E.find_matches(df, "text", "id", labels), "id").collect()
    by_window = {(r["id"], r["label"], r["value"].strip().rstrip(".")) for r in merged}
    assert by_window == {tuple(r) for r in E.extract(df, "text", "id", labels, stitch="span").collect()}


def test_overlapping_matches_are_concatenated_by_default(spark):
    df = spark.createDataFrame([(1, "at 12:34:56 sharp")], "id int, text string")
    # the catalog holds the short form twice, so it is appended twice
    assert E.extract(df, "text", "id", "datetime").first()["value"] == "12:34:5612:3412:34"
    assert E.extract(df, "text", "id", "datetime", stitch="span").first()["value"] == "12:34:56"
    with pytest.raises(ValueError):
        E.extract(df, "text", "id", "datetime", stitch="other")


def test_labels_filters_and_shapes(spark, df):
    assert len(catalog.label_names()) == 45 and len(PATTERNS) == 69
    assert {r["label"] for r in E.extract(df, "text", "id", "email").collect()} == {"email"}
    assert {r["label"] for r in E.extract(df, "text", "id", ["ipv4", "email"]).collect()} == {"ipv4", "email"}
    assert E.extract(df, "text", "id", "no such label").count() == 0
    long = E.extract(df, "text", "id", ["ipv4", "email"])
    assert long.count() == long.distinct().count()
    wide = E.extract_wide(df, "text", "id", ["ipv4", "email"])
    assert wide.columns == ["id", "email", "ipv4"] and wide.count() == df.count()
    assert wide.select(F.sum(F.size("email") + F.size("ipv4"))).first()[0] == long.count()
    assert [r["label"] for r in catalog.label_table(spark).collect()] == catalog.label_names()


def test_null_text_gives_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a@b.co")], "id int, text string")
    assert [tuple(r) for r in E.extract(df, "text", "id").collect()] == [(2, "email", "a@b.co")]


def test_invalid_and_custom_patterns(spark):
    own = catalog.from_regexes([r"(?P<order>ORD-\d+)", r"(?P<bad>(", "no label", r"\b(?P<order>PO\d+)\b"])
    valid, rejected = catalog.split_valid(own)
    assert [p.label for p in valid] == ["order", "order"] and rejected[0][0].label == "bad"
    df = spark.createDataFrame([(1, "ORD-12 and PO7, éPO8")], "id int, text string")
    assert sorted(r["value"] for r in E.extract(df, "text", "id", patterns=own).collect()) == ["ORD-12", "PO7"]
    refused = catalog.split_valid(catalog.from_regexes([r"(?P<x>a)(?(1)b|c)", r"(?P<y>ab)"]))
    assert [p.label for p in refused[0]] == ["y"] and refused[1][0][0].label == "x" and refused[1][0][1]
    assert catalog.is_regex(r"\d+") and not catalog.is_regex("(")
    with pytest.raises(ValueError, match="not a regular expression"):
        catalog.checked_regex("(")


def test_redaction_and_predicates(spark):
    df = spark.createDataFrame([(1, "mail a@b.co from 10.0.0.1"), (2, "none")], "id int, text string")
    assert df.select(E.redact(F.col("text"), ["email", "ipv4"])).first()[0] == "mail [EMAIL] from [IPV4]"
    assert df.filter(E.has_entity(F.col("text"), "email")).count() == 1
    profile = E.entity_profile(df, "text", (), ["email", "ipv4"]).orderBy("label").collect()
    assert [tuple(r) for r in profile] == [("email", 1, 1), ("ipv4", 1, 1)]
    assert [tuple(r) for r in E.email_domains(df, "text", "id").collect()] == [("b.co", 1)]


def test_long_texts_do_not_exhaust_the_stack(spark):
    words = "word " * 20000
    hostile = {
        "reporting_statement": words + "said it was so. ",
        "action_context": words + "completed the run. Then it went on",
        "entity_name": "we went there from " + "Xy " * 20000 + "and so on",
        "all_caps_phrase": "we went there " + "XY " * 20000 + "and so on",
        "proper_noun": "we went there " + "Xy " * 20000 + "and so on",
        "unix_path": " /" + "a/" * 20000 + "b ",
        "email": "a@" + "b." * 20000 + "c " + "x" * 50000,
        "url": "x" * 50000 + " http://a",
        "quoted_text": words + '"quoted" and more words ',
        "number_context": "there are about 1" + ",000" * 20000 + " units of it here",
        "analyze": "ab-" * 20000,
    }
    df = spark.createDataFrame([(k, v) for k, v in hostile.items()], "name string, text string")
    found = E.extract(df, "text", "name").collect()
    for label in hostile:
        if label not in ("number_context", "analyze"):
            assert any(r["name"] == label and r["label"] == label for r in found), label


def test_running_merges_blocks(spark):
    rnd = random.Random(1)
    for n in (0, 1, 7, 600):
        values = [rnd.randint(0, 9) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums = df.select(running(F.col("v"), lambda a, b: a + b, F.lit(0), block=16)).first()[0]
        assert sums == [sum(values[:i]) for i in range(n)]
        peaks = df.select(running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(-1), block=16)).first()[0]
        assert peaks == [max(values[:i], default=-1) for i in range(n)]


def test_translation_of_boundaries(spark):
    for regex in (r"\bab\b", r"a\b", r"\b[+]", r"[\w-]+", r"\S+\s\W", r"(?i:straße)\b", r"x\Z"):
        texts = ["ab", "éab abé", "a+ +", "²ab", "e\u0301ab", "x-y ", "STRASSE straße", "x\n", "x"]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        rows = df.select("i", F.regexp_extract_all("t", F.lit(to_jvm(regex)), F.lit(0)).alias("m")).collect()
        for r in rows:
            assert r["m"] == [m.group() for m in re.finditer(regex, texts[r["i"]])], (regex, texts[r["i"]])


def test_redaction_never_matches_a_tag(spark):
    df = spark.createDataFrame([("mail a@b.co now [x] 10.0.0.1/8 http://10.0.0.1/a",), (None,), ("",)], "text string")
    labels = ["email", "ini", "ipv4", "url"]
    assert [r[0] for r in df.select(E.redact(F.col("text"), labels)).collect()] == ["mail [EMAIL] now [INI] [IPV4] [URL]", None, ""]
    assert df.select(E.redact(F.col("text"), ["email", "ini"])).first()[0].startswith("mail [EMAIL] now [INI]")


@pytest.mark.parametrize("label, verbs", [("action_context", ["completed", "developed"]), ("reporting_statement", ["said", "noted"])])
def test_last_verbs_match_as_in_python(spark, label, verbs):
    rnd = random.Random(label)
    joints = [" "] * 12 + ["  ", "\n", " \n", ". ", ".", "! ", ", ", ' "', '" ', "? ", "\t", "\u00a0", " - ", "\x04", "\x05"]
    texts = []
    for _ in range(4000):
        words = [rnd.choice(verbs + ["a", "bc", "Déf", "x9", "unsaid", verbs[0] + "s"]) if rnd.random() < 0.5 else "w" for _ in range(rnd.randint(0, 45))]
        texts.append("".join(w + (" " if rnd.random() < 0.5 else rnd.choice(joints)) for w in words))
    (pattern,) = [p for p in PATTERNS if p.label == label]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for sanitized in (False, True):
        cleaned = {r["i"]: r["t"] for r in df.select("i", (sanitize(F.col("text")) if sanitized else F.col("text")).alias("t")).collect()}
        got = {}
        for r in E.find_matches(df, "text", "i", label, sanitized=sanitized).collect():
            got.setdefault(r["i"], []).append((r["start"], r["end"], r["value"]))
        want = {i: [(m.start(), m.end(), m.group()) for m in re.finditer(pattern.regex, t)] for i, t in cleaned.items()}
        assert sum(map(len, want.values())) > 500
        for i, matches in want.items():
            assert sorted(got.get(i, [])) == matches, (sanitized, texts[i])


@pytest.mark.parametrize("label, verb, end", [("action_context", "completed", ". And so on"), ("reporting_statement", "said", ". And so on")])
def test_context_phrases_take_linear_time(spark, label, verb, end):
    def words(*at, n=20_000, gap=" "):
        out = ["word"] * n
        for i in at:
            out[i] = verb
        return gap.join(out)

    rnd = random.Random(7)
    shapes = [
        words(), words(10_000), words(1) + end, words(19_999), words(*range(20_000)), words(*range(20_000)) + end, f"He {verb} it. And so " + words(10_000),
        f"He has often {verb} it was. And so " + words(*range(0, 20_000, 3)), (f"one two three four {verb} it" + end + " ") * 3000 + words(9_000),
        words(2, 10, 100, gap="  ") + end, words(15_000, gap="  "), f"a b c d {verb} it, " * 4000, f"a b c d {verb} it, " * 4000 + end, words(gap=", ") + f" a b c {verb} x",
        f'a b c d {verb} "' * 3000, f'a b c d e {verb} ' * 4000 + '"', words(*rnd.sample(range(20_000), 2000)) + "\n" + words(5, n=5000) + end, "\n".join(words(k, n=20) for k in range(10)) * 100,
    ]
    df = spark.createDataFrame(list(enumerate(shapes)), "id int, text string").repartition(1)
    for sanitized in (True, False):
        for i in range(len(shapes)):
            start = time.monotonic()
            E.extract(df.filter(F.col("id") == i), "text", "id", label, sanitized=sanitized).count()
            assert time.monotonic() - start < 5, (i, sanitized)


def test_giant_texts_in_stretches(spark):
    rnd = random.Random(11)
    parts = [p for r in searched_documents(spark, "/root/testdata/sf0.001").limit(60).collect() for p in r["text"][-900:].split(" ")]
    parts += [".", "/a. /b.c", "a.b@c.de.", '"', "1.", "2. 34 555 6789", "C:\\x.", "::", "Mon.", "U. N. Corp", "\n", "said", "completed"]
    texts = [" ".join(rnd.choice(parts) for _ in range(n)) for n in (0, 5, 3000, 4000, 2500)] + ["x" * 5000 + ". " + "10.0.0.1 " * 900, None, "no stop " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    for sanitized in (True, False):
        want = rows(E.find_matches(df, "text", "id", sanitized=sanitized))
        assert len(want) > 1500
        for stretch in (50, 1000):
            assert rows(E.find_matches(df, "text", "id", sanitized=sanitized, stretch=stretch)) == want
        assert rows(E.extract(df, "text", "id", sanitized=sanitized, stretch=300)) == rows(E.extract(df, "text", "id", sanitized=sanitized))
    spread = E.find_matches(df.filter("id = 3"), "text", "id", "email", stretch=50)
    assert "Exchange hashpartitioning(__start" in spread._jdf.queryExecution().executedPlan().toString()
