"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textscan.operators import corpus, validation  # noqa: E402
from textscan.operators import extract as E  # noqa: E402
from textscan.plans.inputs import order_values, table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def headline():
    return {
        "extract_all_labels": lambda s: E.extract(table(s, SF_DIR, "documents"), "text", "doc_id"),
        "extract_pii_labels": lambda s: E.extract(
            table(s, SF_DIR, "documents"), "text", "doc_id", ["email", "ipv4", "phone_number"]
        ),
        "span_stitching_window": lambda s: E.merge_spans(
            E.find_matches(table(s, SF_DIR, "documents"), "text", "doc_id", ["datetime", "date", "time", "ipv6", "month"]),
            "doc_id",
        ),
        "entity_profile_by_source": lambda s: E.entity_profile(
            table(s, SF_DIR, "documents"), "text", "source", ["email", "ipv4", "phone_number", "analyze"]
        ),
        "reporting_statement": lambda s: E.extract(table(s, SF_DIR, "documents"), "text", "doc_id", "reporting_statement"),
        "word_frequency_top_k": lambda s: corpus.top_words(table(s, SF_DIR, "documents"), "text", "doc_id", 100),
        "bigram_top_k": lambda s: corpus.top_ngrams(table(s, SF_DIR, "documents"), "text", 2, 100),
        "corpus_statistics": lambda s: corpus.corpus_statistics(table(s, SF_DIR, "documents"), "text", ["lang", "source"]),
        "validity_report": lambda s: validation.validity_report(
            order_values(s, SF_DIR, "card", "card", "iban", "ssn", "ip", "email"),
            {"card": "credit_card", "iban": "iban", "ssn": "ssn", "ip": "ipv4", "email": "email"},
        ),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("textscan-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the session before timing
    times = {}
    for name, query in headline().items():
        start = time.perf_counter()
        query(spark).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
