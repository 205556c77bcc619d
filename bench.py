"""Times the headline queries once warm and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from benchset.catalog import QUERIES, entity_document_text, inputs
from grouptrace.plans import registry
from grouptrace.session import build_session, work_path
from grouptrace.sources import readers, schemas

HEADLINE = [
    "qualified_groups", "consistent_threshold", "qualified_local_companies", "merge_batches",
    "merge_search_batches", "local_search_sheet", "minimum_tax_panel", "totals_by_country_year",
    "network_profile", "tax_country", "foreign_subsidiary_countries", "subject_to_rule_by_year",
    "local_to_parent", "group_rule_status", "country_rule_summary", "ranked_group_table",
    "registry_entities", "foreign_active", "detail_dates", "events_by_year", "detailed_sample", "decree_list",
    "exact_name_match", "text_search_top1", "text_search_top5", "unmatched_grantee_search_top1", "merge_batches_from_files", "review_merge", "search_back_match",
    "json_documents_parse", "ingest_pages_batch", "ingest_pages_stream",
]


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def scan_of_small_files(spark, sf_dir: str) -> float:
    """Documents of one file each, read, their dates parsed and written as Parquet: files per second.

    The files are written before the clock starts.
    """
    tables = inputs(spark, sf_dir)
    folder = work_path(spark, "small-files")
    text = entity_document_text(tables)
    text.write.option("maxRecordsPerFile", 1).text(folder)
    files = text.count()
    started = time.perf_counter()
    documents = readers.read_json_documents(spark, folder, schemas.ENTITY_DOCUMENT)
    registry.detail_dates(documents).write.parquet(work_path(spark, "dates"))
    return round(files / (time.perf_counter() - started), 1)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(min(run(QUERIES[name], spark, sf_dir) for _ in range(2)), 3)
    files_per_second = scan_of_small_files(spark, sf_dir)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "small_files_per_second": files_per_second, "sf": float(scale[1]) if scale else None, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
