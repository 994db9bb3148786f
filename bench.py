"""Time the queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Usage: python bench.py [name prefix...]. Without names every headline query runs; ``all`` runs all.
Each query is planned, run once in full and written to a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from gridloom import build_session
from gridloom.plans import all_queries
from gridloom.plans.registry import QUERIES

HEADLINE = [
    "A1_read_ascii_raster", "A8_extract_page_json", "A15_delta_messages",
    "B4_match_aliases", "B5_select_reports", "B8_active_readings", "B10_variogram_bins", "B11_fit_variogram", "B12_krige_cells",
    "C5_block_mean", "C7_series_asof", "C10_align_bilinear", "C11_mosaic", "C20_classify", "C27_hillshade", "C29_stack_layers",
    "D1_neighbours", "D3_route_once", "D4_grow_region", "D5_rasterize",
    "E2_to_tiles", "E3_active_tiles", "E9_tile_pixels",
    "F0_wet_by_level", "F2_frame_diff", "F4_apply_deltas", "F6_assign_chunks", "F8_densify",
    "G3_explode_cells", "G8_assemble_frames", "G9_commit_changes", "G10_snapshots_at_sync", "G11_grid_at", "G14_frame_timeouts", "G15_frames_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    all_queries.load()
    args = sys.argv[1:]
    names = HEADLINE if not args else [n for n in QUERIES if args == ["all"] or any(n.startswith(a) for a in args)]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1).count()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
