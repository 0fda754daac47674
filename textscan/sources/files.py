"""Files as rows: scan, inventory, content and reports."""

from __future__ import annotations

import mimetypes
import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.functions.regexes import let
from textscan.sources.listing import list_tree

# --- Fixed values: MIME types -----------------------------------------------------
TEXT_TYPES = ["application/json", "application/xml", "application/x-yaml", "text/markdown"]
CATEGORIES = {
    "pdf": ["application/pdf"],
    "archive": [
        "application/zip", "application/x-tar", "application/gzip", "application/x-7z-compressed",
        "application/x-rar-compressed",
    ],
    "executable": ["application/x-executable", "application/x-msdownload"],
    "spreadsheet": [
        "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "text/csv",
    ],
    "script": ["text/x-python", "text/x-shellscript", "application/x-perl", "application/x-javascript"],
}
PREFIX_CATEGORIES = ["text", "image", "audio", "video"]
EXPECTED_TYPES = {
    ".txt": "text/plain", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif",
    ".json": "application/json", ".yaml": "application/x-yaml", ".yml": "application/x-yaml",
    ".xml": "application/xml", ".html": "text/html", ".csv": "text/csv", ".mp3": "audio/mpeg", ".mp4": "video/mp4",
    ".zip": "application/zip", ".pdf": "application/pdf",
}
# first bytes (hex) of well-known formats
MAGIC_TYPES = {
    "25504446": "application/pdf", "504b0304": "application/zip", "1f8b": "application/gzip",
    "377abcaf": "application/x-7z-compressed", "52617221": "application/x-rar-compressed",
    "89504e47": "image/png", "ffd8ff": "image/jpeg", "47494638": "image/gif", "424d": "image/bmp",
    "49443303": "audio/mpeg", "fffb": "audio/mpeg", "4f676753": "audio/ogg", "664c6143": "audio/flac",
    "52494646": "audio/x-wav", "7f454c46": "application/x-executable", "4d5a": "application/x-msdownload",
    "1a45dfa3": "video/x-matroska",
}
# ------------------------------------------------------------------------------


def spread(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Spread a scan that yields fewer tasks than there are cores.

    A small file is one task however costly its rows are.  A big table has more
    splits than cores and is returned as it is, so nothing large is shuffled.
    Several tasks per core even out rows of very different length.

    With ``most_rows``, for small rows with much work on each, a task gets that many rows, however large the table and
    its row groups, which a scan cannot split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if most_rows is not None:
        return df.repartition(max(4 * cores, -(-df.count() // most_rows)))
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def _gitignore_regex(lines: Iterable[str]) -> list[tuple[bool, str]]:
    """(excluded?, regular expression on the path below the root) per rule."""
    rules = []
    for line in lines:
        rule = line.rstrip("\n").rstrip()
        if not rule or rule.startswith("#"):
            continue
        excluded = not rule.startswith("!")
        rule = rule.removeprefix("!")
        anchored = "/" in rule.rstrip("/")
        folder = rule.endswith("/")
        body = rule.strip("/")
        parts = re.split(r"(\*\*/|/\*\*$|\*|\?|\[[^\]]+\])", body)
        glob = {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}
        regex = "".join(glob.get(p, p if p.startswith("[") and p.endswith("]") else re.escape(p)) for p in parts if p)
        rules.append((excluded, ("^" if anchored else "^(?:.*/)?") + regex + ("/.*$" if folder else "(?:/.*)?$")))
    return rules


def gitignore_filter(relative_path: Column, lines: Iterable[str]) -> Column:
    """Whether a path is kept; the last rule that applies decides."""
    kept = F.lit(True)
    for excluded, regex in _gitignore_regex(lines):
        kept = F.when(relative_path.rlike(regex), F.lit(not excluded)).otherwise(kept)
    return kept


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan(
    spark: SparkSession,
    path: str,
    gitignore: Iterable[str] = (),
    glob: str | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """All files below a folder: (path, relative, modificationTime, length,
    content, skipped).  Hidden files and folders are skipped; Spark also skips names that
    begin with an underscore, and empty files (see ``list_tree``).  Columns that are not used are not read; a content
    is one value in one task, so files of more than ``max_bytes`` have a row
    without content that says so in ``skipped``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    root = path.rstrip("/")
    files = reader.load(path)
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.removeprefix("file:")) + "/", "")
    files = files.withColumn("relative", relative).filter(~F.col("relative").rlike(r"(^|/)\."))
    if max_bytes is None:
        files = files.withColumn("skipped", F.lit(None).cast("string"))
    else:  # two scans: the content of a file is read only where its column is used
        giants = files.filter(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
        files = (
            files.filter(F.col("length") <= max_bytes)
            .withColumn("skipped", F.lit(None).cast("string"))
            .unionByName(giants.withColumn("skipped", F.lit(f"larger than {max_bytes} bytes")))
        )
    return files.filter(gitignore_filter(F.col("relative"), gitignore))


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of files without content, which a scan leaves out, as tasks list them."""
    return list_tree(spark, path).filter("empty and not is_folder").select("path")


def empty_folders(spark: SparkSession, path: str) -> DataFrame:
    """(path) of folders without an entry (hidden ones aside), as tasks list them."""
    return list_tree(spark, path).filter("empty and is_folder").select("path")


# --- Content ------------------------------------------------------------------------


def decode_text(content: Column) -> Column:
    """UTF-8 with undecodable bytes left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def latin1(content: Column) -> Column:
    """One character per byte."""
    return F.decode(content, "ISO-8859-1")


def readable_strings(content: Column, limit: int | None = None) -> Column:
    """Runs of four or more printable ASCII bytes, then the same in UTF-16LE;
    ``limit`` keeps the first of them."""

    def runs(text: Column) -> Column:
        ascii_runs = F.regexp_extract_all(text, F.lit("[ -~]{4,}"), F.lit(0))
        wide_runs = F.regexp_extract_all(text, F.lit(r"(?:[ -~]\x00){4,}+"), F.lit(0))
        found = F.concat(ascii_runs, wide_runs)
        return found if limit is None else F.slice(found, 1, limit)

    return let(latin1(content), runs)


def embedded_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://[^ \t\n\r\f\x0b]+"), F.lit(0))


def _histogram_function() -> Callable[[bytes], np.ndarray]:
    def histogram(data: bytes) -> np.ndarray:
        """How often each byte value occurs; slices are counted one by one, so no wider copy of the file is made."""
        counts = np.zeros(256, np.int64)
        values = np.frombuffer(data, np.uint8)
        for at in range(0, len(values), 1 << 20):
            counts += np.bincount(values[at : at + (1 << 20)], minlength=256)
        return counts

    return histogram


def _entropies() -> Callable[[pd.Series], pd.Series]:
    count = _histogram_function()

    def entropy(data: bytes | None) -> float | None:
        if data is None:
            return None
        shares = count(data) / max(1, len(data))
        shares = shares[shares > 0]
        return float(-(shares * np.log2(shares)).sum()) + 0.0

    def entropies(contents: pd.Series) -> pd.Series:
        return pd.Series([entropy(c) for c in contents], dtype=object)

    return entropies


#: Shannon entropy of a binary Column in bits per byte, from a histogram made in one pass.
byte_entropy = F.pandas_udf(_entropies(), T.DoubleType())


def magic_number(content: Column) -> Column:
    return F.lower(F.hex(F.substring(content, 1, 4)))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1))


def magic_type(content: Column) -> Column:
    """MIME type by the first bytes; text/plain for clean text, else binary."""
    first = magic_number(content)
    by_magic = F.when(content.isNull(), None)
    for prefix, mime in MAGIC_TYPES.items():
        by_magic = by_magic.when(first.startswith(prefix), mime)
    text = F.is_valid_utf8(content.cast("string")) & ~F.contains(latin1(content), F.lit("\u0000"))
    return by_magic.when(F.octet_length(content) == 0, "inode/x-empty").when(text, "text/plain").otherwise(
        "application/octet-stream"
    )


def _mime_map() -> Column:
    # the standard library's own table, plus the fixed expectations it lacks
    known = mimetypes.MimeTypes().types_map[True]
    table = {**{e: t for e, t in EXPECTED_TYPES.items() if e not in known}, **known}
    return F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])


def mime_type(path: Column, content: Column) -> Column:
    """By extension, else by content."""
    return F.coalesce(F.try_element_at(_mime_map(), extension(path)), magic_type(content))


def file_flags(mime: Column) -> dict[str, Column]:
    """is_text … is_script for a MIME type."""
    flags = {f"is_{c}": mime.startswith(c + "/") for c in PREFIX_CATEGORIES}
    flags.update({f"is_{c}": mime.isin(types) for c, types in CATEGORIES.items()})
    return flags


def mismatches(path: Column, mime: Column, magic: Column) -> Column:
    """Where extension, MIME type and content disagree, as
    array<struct<type, expected, actual>>."""
    table = F.create_map(*[F.lit(x) for pair in EXPECTED_TYPES.items() for x in pair])
    expected = F.try_element_at(table, extension(path))

    def entry(kind: str, wanted: Column, actual: Column) -> Column:
        return F.when(
            wanted.isNotNull() & actual.isNotNull() & (wanted != actual),
            F.struct(F.lit(kind).alias("type"), wanted.alias("expected"), actual.alias("actual")),
        )

    both = F.array(entry("Extension vs MIME type", expected, mime), entry("MIME vs Content", mime, magic))
    return F.filter(both, lambda m: m.isNotNull())


def inventory(files: DataFrame) -> DataFrame:
    """Metadata, hashes, entropy, strings, URLs and type of each file."""
    content, path = F.col("content"), F.col("path")
    return (
        files.withColumn("mime_type", mime_type(path, content))
        .withColumn("magic_type", magic_type(content))
        .select(
            path.alias("file_path"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("modification_time"),
            "mime_type",
            "magic_type",
            extension(path).alias("extension"),
            F.sha2(content, 256).alias("sha256"),
            F.md5(content).alias("md5"),
            magic_number(content).alias("magic_numbers"),
            byte_entropy(content).alias("entropy"),
            readable_strings(content).alias("readable_strings"),
            embedded_urls(latin1(content)).alias("embedded_urls"),
            (F.col("length") == 0).alias("is_empty"),
            *[flag.alias(name) for name, flag in file_flags(F.col("mime_type")).items()],
            mismatches(path, F.col("mime_type"), F.col("magic_type")).alias("mismatches"),
        )
    )


def json_report(files: DataFrame) -> DataFrame:
    """(file_path, report): each inventory record as JSON."""
    records = inventory(files)
    return records.select("file_path", F.to_json(F.struct(*records.columns)).alias("report"))


def markdown_report_column() -> Column:
    """The Markdown report over inventory columns."""

    def bullets(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")

    def line(title: str, value: Column) -> Column:
        return F.concat(F.lit(f"**{title}**: "), F.coalesce(value.cast("string"), F.lit("None")), F.lit("\n"))

    return F.concat(
        F.lit("# Catch-All Analysis Report\n\n"),
        line("File Path", F.col("file_path")),
        line("File Size", F.concat(F.col("file_size").cast("string"), F.lit(" bytes"))),
        line("MIME Type", F.col("mime_type")),
        line("Modification Time", F.col("modification_time")),
        line("SHA-256 Hash", F.col("sha256")),
        line("MD5 Hash", F.col("md5")),
        line("Magic Numbers", F.col("magic_numbers")),
        line("Entropy", F.format_string("%.4f", F.col("entropy"))),
        F.lit("\n\n## Readable Strings\n"),
        bullets(F.slice("readable_strings", 1, 10)),
        F.lit("\n\n## Embedded URLs\n"),
        bullets(F.col("embedded_urls")),
        F.lit("\n"),
    )


def markdown_report(files: DataFrame) -> DataFrame:
    return inventory(files).select("file_path", markdown_report_column().alias("report"))


def is_text_type(mime: Column) -> Column:
    return mime.startswith("text/") | mime.isin(TEXT_TYPES)


def extract_text(files: DataFrame) -> DataFrame:
    """(path, mime_type, text): decoded text for text types, the Markdown report
    for everything else."""
    typed = files.withColumn("mime_type", mime_type(F.col("path"), F.col("content")))
    text = typed.filter(is_text_type(F.col("mime_type"))).select(
        "path", "mime_type", decode_text(F.col("content")).alias("text")
    )
    other = inventory(typed.filter(~is_text_type(F.col("mime_type"))).drop("mime_type"))
    return text.unionByName(
        other.select(F.col("file_path").alias("path"), "mime_type", markdown_report_column().alias("text"))
    )

