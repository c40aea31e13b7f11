"""Times the headline queries and prints one JSON line.

Each query runs twice; the second run is reported, so code generation and file
listing are warm.  Results are consumed by the no-op sink: every row and column
is computed, none is brought to the driver.
"""

from __future__ import annotations

import json
import os
import time

from recordloom.plans import QUERIES
from recordloom.session import local_session

HEADLINE = [
    "enrich_rate", "enrich_rows", "load_sheets", "header_detect", "text_key", "parse_date", "swap_columns",
    "filter_bundle", "left_join_indicator", "left_join_year", "anti_unmatched", "fuzzy_match", "freq_cum_pct",
    "freq_cum_pct_wide", "group_stats", "describe_ext", "quantiles", "quantile_trim", "histogram", "boxplot_stats",
    "mode_share", "crosstab_margins", "topn_crosstab", "corr_pearson", "corr_spearman", "corr_kendall", "kruskal_wallis",
    "anova_oneway", "chi2_independence", "topk_per_group", "yoy_change", "executive_summary", "victim_profile", "star_schema",
    "sink_roundtrip", "unified_records", "cleaned_year",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(spark, name, folder)
        times[name] = round(run(spark, name, folder), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}
        )
    )


if __name__ == "__main__":
    main()
