import hashlib
import json
import math
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textscan.sources import files as S
from textscan.sources import sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    content = {
        "a.txt": b"plain text with http://x.example/y inside\n",
        "bad.txt": b"a\xffb",
        "sub/data.json": b'{"k": 1}',
        "sub/image.png": b"\x89PNG\r\n\x1a\n" + bytes(range(256)) * 3,
        "sub/fake.png": b"just text, no picture",
        "sub/noext": b"w\x00i\x00d\x00e\x00s\x00 \x00t\x00" + b"\x01\x02readable",
        "empty.csv": b"",
        "build/out.txt": b"ignored",
        "keep.log": b"kept log",
        "drop.log": b"dropped log",
        ".hidden": b"hidden",
        ".git/config": b"hidden too",
    }
    for name, data in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root, content


GITIGNORE = ["# comment", "build/", "*.log", "!keep.log", ""]


def test_scan_skips_hidden_and_ignored(spark, folder):
    root, _ = folder
    names = {r["relative"] for r in S.scan(spark, str(root)).select("relative").collect()}
    assert names == {"a.txt", "bad.txt", "sub/data.json", "sub/image.png", "sub/fake.png", "sub/noext",
                     "build/out.txt", "keep.log", "drop.log"}
    kept = {r["relative"] for r in S.scan(spark, str(root), GITIGNORE).select("relative").collect()}
    assert names - kept == {"build/out.txt", "drop.log"}
    assert S.scan(spark, str(root), glob="*.png").count() == 2
    giant = S.scan(spark, str(root), max_bytes=10).filter("relative = 'sub/image.png'").first()
    assert giant["content"] is None and giant["skipped"] == "larger than 10 bytes" and giant["length"] > 10


def test_gitignore_rules(spark):
    cases = {
        "/top.txt": {"top.txt": False, "a/top.txt": True},
        "**/tmp": {"tmp/x": False, "a/tmp/x": False, "a/tmpx": True},
        "doc/*.txt": {"doc/a.txt": False, "doc/b/a.txt": True, "x/doc/a.txt": True},
        "file[0-9].md": {"a/file1.md": False, "filex.md": True},
        "a/**": {"a/b/c": False, "b/a": True},
    }
    for rule, paths in cases.items():
        df = spark.createDataFrame([(p,) for p in paths], "p string")
        got = {r["p"]: r["keep"] for r in df.select("p", S.gitignore_filter(F.col("p"), [rule]).alias("keep")).collect()}
        assert got == paths, rule


def test_inventory(spark, folder):
    root, content = folder
    rows = {os.path.relpath(r["file_path"].removeprefix("file:"), root): r for r in S.inventory(S.scan(spark, str(root))).collect()}

    def entropy(data):
        n = len(data)
        return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0

    for name, r in rows.items():
        data = content[name]
        assert r["sha256"] == hashlib.sha256(data).hexdigest() and r["md5"] == hashlib.md5(data).hexdigest()
        assert r["entropy"] == pytest.approx(entropy(data))
        assert r["magic_numbers"] == data[:4].hex() and r["file_size"] == len(data)
        assert r["is_empty"] == (not data)
    assert rows["a.txt"]["embedded_urls"] == ["http://x.example/y"]
    assert rows["a.txt"]["mime_type"] == "text/plain" and rows["a.txt"]["is_text"]
    assert rows["sub/noext"]["readable_strings"] == ["readable", "w\x00i\x00d\x00e\x00s\x00 \x00t\x00"]
    assert rows["sub/image.png"]["is_image"] and rows["sub/image.png"]["mismatches"] == []
    assert [m["type"] for m in rows["sub/fake.png"]["mismatches"]] == ["MIME vs Content"]
    assert [os.path.basename(r["path"]) for r in S.empty_files(spark, str(root)).collect()] == ["empty.csv"]
    assert rows["sub/noext"]["magic_type"] == "application/octet-stream"


def test_extracted_text_and_reports(spark, folder):
    root, _ = folder
    texts = {os.path.basename(r["path"]): r["text"] for r in S.extract_text(S.scan(spark, str(root))).collect()}
    assert texts["bad.txt"] == "ab" and texts["data.json"] == '{"k": 1}'
    assert texts["image.png"].startswith("# Catch-All Analysis Report\n\n**File Path**: ")
    assert "**Entropy**: 7." in texts["image.png"]
    report = json.loads(S.json_report(S.scan(spark, str(root), glob="a.txt")).first()["report"])
    assert report["embedded_urls"] == ["http://x.example/y"]
    markdown = S.markdown_report(S.scan(spark, str(root), glob="a.txt")).first()["report"]
    assert "## Readable Strings\n- plain text with http://x.example/y inside\n\n## Embedded URLs\n- http://x.example/y\n" in markdown
    whole = S.read_text_files(spark, str(root / "a.txt")).first()
    assert whole["text"].startswith("plain text")


def test_listing_by_tasks(spark, tmp_path):
    for name in ("a.txt", "b/empty.csv", "b/c/d e+%.bin", "b/.hidden", ".git/x", "_tmp/y"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"xyz")
    for name in ("none", "b/none/below", "b/c/.only"):
        (tmp_path / name).mkdir(parents=True)
    rows = {r["relative"]: r for r in S.list_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b", "b/empty.csv", "b/c", "b/c/d e+%.bin", "none", "b/none", "b/none/below"}
    assert {k for k, r in rows.items() if r["empty"]} == {"b/empty.csv", "none", "b/none/below"}
    scanned = {r["relative"]: (r["length"], int(r["modificationTime"].timestamp())) for r in S.scan(spark, str(tmp_path)).collect()}
    assert scanned == {k: (r["length"], int(r["modificationTime"].timestamp())) for k, r in rows.items() if not r["is_folder"] and r["length"]}
    assert [os.path.basename(r["path"]) for r in S.empty_folders(spark, f"file:{tmp_path}/").orderBy("path").collect()] == ["below", "none"]


def test_entropy_is_one_pass(spark):
    data = os.urandom(20_000_000) + b"\0" * 20_000_000
    start = time.monotonic()
    assert S._histogram_function()(data).sum() == len(data) and time.monotonic() - start < 0.05 * 40
    df = spark.createDataFrame([(bytes(range(256)) * 9,), (b"",), (None,), (b"aaab",)], "c binary")
    got = [r[0] for r in df.select(S.byte_entropy("c")).collect()]
    assert got == [8.0, 0.0, None, pytest.approx(0.811278, abs=1e-6)]


def test_concatenation_per_directory(spark):
    rows = [(f"d{i % 3}/e/{i:03d}" if i % 5 else f"{i:03d}", "x" * (i % 7)) for i in range(60)] + [("d0/e/000", "again")] * 2
    df = spark.createDataFrame(rows, "path string, text string").repartition(5)
    for size in (1, 100, 10**6):
        parts = sinks.concatenate(df, size, per_directory=True).orderBy("directory", "part").collect()
        for d in ("", "d0/e", "d1/e", "d2/e"):
            expected = "".join(f"## File: {p}\n```\n{t}\n```\n\n" for p, t in sorted(rows) if t and p.rpartition("/")[0] == d)
            assert "".join(r["content"] for r in parts if r["directory"] == d) == expected


def test_concatenation_in_pieces(spark):
    rows = [(f"d{i % 3}/{i:03d}", "x" * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "path string, text string").repartition(5)
    expected = "".join(f"## File: {p}\n```\n{t}\n```\n\n" for p, t in sorted(rows) if t)
    for size in (1, 100, 10**6):
        parts = sinks.concatenate(df, size).orderBy("part").collect()
        assert "".join(r["content"] for r in parts) == expected


def test_tables_and_conversion(spark, tmp_path):
    df = spark.createDataFrame([([["a", "b"], ["1", "2"]],), ([],)], "rows array<array<string>>")
    got = [tuple(r) for r in df.select(sinks.table_to_markdown(F.col("rows")), sinks.table_to_markdown(F.col("rows"), True)).collect()]
    assert got[0] == ("| a | b |\n| 1 | 2 |\n|---|---|\n", "| a | b |\n|---|---|\n| 1 | 2 |\n") and got[1] == ("", "")
    sinks.convert(spark.range(3), "json", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        sinks.convert(spark.range(1), "xlsx", str(tmp_path / "no"))
    row = spark.createDataFrame([('{"a":1,"b":"x"}',)], "v string")
    assert row.select(sinks.convert_column(F.col("v"), "json", "csv", "a INT, b STRING")).first()[0] == "1,x"
