"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from cellweave.queries import all_queries
from cellweave.session import local_session

HEADLINE = [
    "t1_concat_portions",
    "t2_clean_cells",
    "t3_expand_column_on_regex",
    "t6_fold_rows",
    "t8_transpose",
    "t9_wrap_row_every_n",
    "t11_step_sequence",
    "t5_prepend_long_tables",
    "t6_fold_long_tables",
    "t9_wrap_long_tables",
    "t11_wrap_transpose_wrap_long_tables",
    "g4_grouper_chain",
    "x3_suffix_sections",
    "x6_section_items",
    "x8_ditto_fill",
    "r5_all_tags_lookup",
    "r8_inherit_tags",
    "r15_merge_records",
    "r20_incremental_run",
    "p1_items_in_regions",
    "p2_overlapping_regions",
    "p5_non_overlapping_batches",
    "p7_reading_order",
    "q5_trade_table",
    "q6_formatted",
    "n5_law_levels",
    "n8_classify_worlds",
    "s1_k1_csv_tables",
    "s10_flatten_recognised",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    # One small query first, so that the start of the JVM is not counted.
    known["r4_enabled"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
