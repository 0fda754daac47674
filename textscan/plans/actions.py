"""Named actions on a table of texts, and the functions offered to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscan.catalog import label_names, select_patterns
from textscan.functions import text as X
from textscan.functions import validators as V
from textscan.functions.regexes import jvm_regex, sanitize
from textscan.operators import extract as E
from textscan.operators import query as Q
from textscan.operators import validation as J
from textscan.plans.column_text import column_text
from textscan.sources import files, sinks


def identify(df: DataFrame, column: str, types: list[str] | None = None) -> DataFrame:
    """Adds ``types``: what each value of a column passes for."""
    return df.withColumn("types", V.identify(F.col(column), types))


def validate(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return J.annotate(df, types)


def normalize(df: DataFrame, column: str, steps: list[str]) -> DataFrame:
    """Apply named normalisers to a column, in order."""
    result = F.col(column)
    for step in steps:
        result = X.NORMALIZATIONS[step](result)
    return df.withColumn(column, result)


def redact(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    return df.withColumn(column, E.redact(F.col(column), labels))


def search(df: DataFrame, column: str, query: str) -> DataFrame:
    return df.filter(Q.text_filter(column, query))


def diagnose(df: DataFrame, column: str, prompt: str, args: str = "[]", arg_prompts: str = "") -> DataFrame:
    """Adds ``prompt``: what would be asked about each object.  Nothing is sent."""
    return df.withColumn("prompt", X.render_prompt(F.col(column), prompt, args, arg_prompts))


#: Actions by name: DataFrame → DataFrame (convert writes files).
ACTIONS: dict[str, Callable] = {
    "identify": identify,
    "validate": validate,
    "extract": E.extract,
    "matches": E.find_matches,
    "profile": E.entity_profile,
    "redact": redact,
    "normalize": normalize,
    "search": search,
    "query": Q.run_queries,
    "convert": sinks.convert,
    "diagnose": diagnose,
    "summarize": files.extract_text,
}


def run(df: DataFrame, action: str, *args, **options):
    """Run an action by name on a table."""
    if action not in ACTIONS:
        raise ValueError(f"Action '{action}' is not defined")
    return ACTIONS[action](df, *args, **options)


def register_functions(spark: SparkSession) -> list[str]:
    """Make functions available to SQL, as native SQL functions but for the last:

    * ``entities_<label>(text)`` for every label: a table of its stitched, cleaned values, as ``extract`` gives them;
    * ``has_<label>(text)`` for every label, and ``find_<label>(text)``, the raw matches, for labels of one pattern;
    * ``is_<type>(value)`` for every validator;
    * ``byte_entropy(binary)`` and ``strip_accents(text)``, which run in Python workers.
    """
    names = []

    def scalar(name: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {returns} RETURN {body}")
        names.append(name)

    for label in label_names():
        patterns = select_patterns(label)
        found = E.entities(sanitize(F.col("t")), label)
        values = F.flatten(F.transform(found, lambda e: e["values"]))
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION entities_{label}(t STRING) RETURNS TABLE(value STRING) "
            f"RETURN SELECT explode({column_text(values)}) AS value"
        )
        names.append(f"entities_{label}")
        scalar(f"has_{label}", "BOOLEAN", column_text(E.has_entity(F.col("t"), label)))
        if len(patterns) == 1:
            scalar(f"find_{label}", "ARRAY<STRING>", f"regexp_extract_all(t, {Q.sql_string(jvm_regex(patterns[0]))}, 0)")
    for kind, check in V.VALIDATORS.items():
        scalar(f"is_{kind}", "BOOLEAN", column_text(check(F.col("t"))))
    spark.udf.register("byte_entropy", files.byte_entropy)
    spark.udf.register("strip_accents", X._strip_accents)
    return [*names, "byte_entropy", "strip_accents"]
