"""Texts in pieces: the same matches as in the whole text, from few pieces."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from textscan.catalog import PATTERNS, select_patterns
from textscan.functions import pieces
from textscan.operators import extract as E
from textscan.plans.inputs import PASSAGE

_WORDS = [
    "the", "team", "Alice", "Bob's", "NASA", "JPL", "how", "What", "said", "stated", "completed", "from", "by", "threat", "critical", "risk",
    "owned by", "units", "3,000", "12.5", "7", "Kotlin", "ıos", "İonic", "ſql", "DNS", "c++", "F#", "node.js", "access point", "May", "Tues",
    "fridAy", "10:20am", "12:34:56", "2024-01-02T10:11:12Z", "01/02/2024 10:11:12", "March 3rd 2024", "fe80::1ff:fe23", "!.::a::", "10.0.0.1/24",
    "555.", "+1 (203) 553-3294", "203-555-1234", "aa:bb:cc:dd:ee:ff", "aabb.ccdd.eeff", "/etc/x", "/a.", "C:\\x", "a@b.org", "https://a.b/c",
    "[ini]", "0x1F", "$HOME", "%X%", "٣٤٥", "ñandú", "abcdef1234", "ab-cd-ef-gh", '"', '"we win"', "here?", "here!", "e\u0301", "漢字",
]
_GAPS = [" "] * 8 + [". ", ". ", ".\n", "  ", "\t", ".", "\u2028", ", ", ".\u00a0", "\x01"]


def _texts(n: int) -> list:
    rng = random.Random(7)
    made = ["".join(rng.choice(_WORDS) + rng.choice(_GAPS) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return [*made, "", None, ".", ". . ", " "]


def _both(monkeypatch, run):
    cut = sorted(map(tuple, run().collect()), key=repr)
    with monkeypatch.context() as m:
        m.setattr(E, "MANY", 1000)
        assert cut == sorted(map(tuple, run().collect()), key=repr)
    return cut


def test_matches_as_in_whole_texts(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(_texts(400))), "id long, text string")
    passages = spark.range(40).select(F.col("id").alias("doc_id")).selectExpr("doc_id + 1000 AS id", f"{PASSAGE} AS text")
    df = df.unionByName(passages).repartition(4)
    for sanitized in (True, False):
        found = _both(monkeypatch, lambda: E.find_matches(df, "text", "id", sanitized=sanitized))  # noqa: B023
        assert len({row[2] for row in found}) > 55
    assert _both(monkeypatch, lambda: E.extract(df, "text", "id"))
    assert _both(monkeypatch, lambda: E.extract(df, "text", "id", stitch="span"))


def test_few_pieces_are_searched():
    """A label's pattern runs on the sentences that may hold it, not on a text of which one sentence does."""
    chosen = select_patterns(["number_context", "protocol", "quoted_text"])
    plain = "So it goes on and on. " * 500
    text = f"{plain}we sold about 30 units over the year. {plain}use HTTP now. {plain}"
    out = pieces.cutter(pieces._tests(chosen))(pa.array([None, text, "", 'all of us "say" so'])).to_pylist()
    hits = [[x["text"].strip() for x in out[1]["pieces"] if x["mask0"] >> i & 1] for i in range(3)]
    assert [p.label for p in chosen] == ["quoted_text", "number_context", "protocol"]
    assert hits == [[], ["we sold about 30 units over the year."], ["use HTTP now."]]
    assert "".join(x["text"] for x in out[1]["pieces"]) == text
    assert [row["mask0"] for row in out] == [0, 6, 0, 1]
    assert out[0]["pieces"] == out[2]["pieces"] == []


def test_many_masks():
    """More patterns than bits of one mask."""
    text = "see https://a.b/c. or a@b.org, 0x1F"
    row = pieces.cutter(pieces._tests(PATTERNS))(pa.array(["x", text]).slice(1)).to_pylist()[0]
    labels = {p.label for i, p in enumerate(PATTERNS) if row[f"mask{i // 60}"] >> i % 60 & 1}
    assert {"url", "email", "hex_number"} <= labels
    assert not labels & {"uuid", "ini", "quoted_text"}
