"""Results as documents and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscan.operators.ordered import running

FORMATS = ("csv", "json", "parquet", "orc", "text")


def fenced(path: Column, text: Column) -> Column:
    """One file as a titled, fenced block."""
    return F.concat(F.lit("## File: "), path, F.lit("\n```\n"), text, F.lit("\n```\n\n"))


def fenced_blocks(texts: DataFrame) -> DataFrame:
    """(path, block) of non-empty files in path order, over range partitions."""
    kept = texts.filter(F.length("text") > 0)
    return kept.select("path", fenced(F.col("path"), F.col("text")).alias("block")).orderBy("path")


def directory(path: Column) -> Column:
    """The folder of a path; empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def concatenate(texts: DataFrame, part_chars: int = 16_000_000, per_directory: bool = False) -> DataFrame:
    """(part, offset, content): all files in path order as consecutive pieces of one document, or (directory, part,
    offset, content): one document per directory, of the files that lie in it.

    A document may be of any size, so neither it nor a directory is ever gathered: running sums of the sizes over
    ranges of paths give each file its offset, and the files that begin in the same ``part_chars`` characters are a piece.  The
    pieces in order of ``part`` are the document; a part that lies inside one long file has no piece.
    """
    blocks = texts.filter(F.length("text") > 0).select(directory(F.col("path")).alias("directory"), "path", fenced(F.col("path"), F.col("text")).alias("block"))
    by = ["directory"] if per_directory else []
    placed = running(blocks, by, ["path", F.xxhash64("block")], {"offset": F.length("block")})
    pieces = placed.groupBy(*by, F.floor(F.col("offset") / part_chars).alias("part")).agg(F.array_sort(F.collect_list(F.struct("offset", "block"))).alias("blocks"))
    content = F.array_join(F.transform("blocks", lambda b: b["block"]), "")
    return pieces.select(*by, "part", F.col("blocks")[0]["offset"].alias("offset"), content.alias("content"))


def table_to_markdown(rows: Column, gfm: bool = False) -> Column:
    """array<array<string>> as a Markdown table.  The separator follows all rows;
    with ``gfm`` it follows the first, as renderers expect."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |\n")))
    separator = F.concat(F.repeat(F.lit("|---"), F.size(F.element_at(rows, 1))), F.lit("|\n"))
    after = F.lit(1) if gfm else F.size(rows)
    placed = F.concat(
        F.slice(lines, F.lit(1), after), F.array(separator), F.slice(lines, after + 1, F.size(rows))
    )
    return F.when(F.size(rows) > 0, F.array_join(placed, "")).otherwise(F.lit(""))


def convert(df: DataFrame, target: str, path: str, **options) -> None:
    """Write a table in another format."""
    if target not in FORMATS:
        raise ValueError(f"Unsupported format: {target}")
    df.write.format(target).options(**options).mode("overwrite").save(path)


def convert_column(value: Column, source: str, target: str, schema: str) -> Column:
    """Turn a text column from csv or json into csv or json, by a DDL schema."""
    readers = {"json": F.from_json, "csv": F.from_csv}
    writers = {"json": F.to_json, "csv": F.to_csv}
    if source not in readers or target not in writers:
        raise ValueError(f"Unsupported conversion: {source} to {target}")
    return writers[target](readers[source](value, schema))
