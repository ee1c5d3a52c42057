"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. BENCH_ALL=1 times every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from freshet.plans.catalog import catalog
from freshet.session import get_spark

HEADLINE = """
p16_measured_half_mdl_zero a1_resample_sum_month a2_flow_weighted_mean a1_resample_complete_weeks a3_fan_monthly a3_fan_daily
a4_bands_half_the_runs a5_mean_daily_flow a7_erosion_monthly j1_samples_to_load_as_na_zero j2_load_to_concentration_own_flow
j5_local_window_nearest_3 j6_nearest_day m11_pairwise_metrics m1_to_m10_metrics_by_station m14_band_coverage_nearest_day
m19_best_lag_by_r m20_local_window_summary_1 a21_distribution_all_samples m22_shift_set_both m24_event_shift
w4_event_flags_gauge w4_event_flags_daily w19_outlier_days_mad_log_upper w7_exceedance_of_samples w8_duration_curve
w10_paired_duration_median w12_flow_stratified_threshold b1_sediment_balance_a b3_nitrogen_balance_c2 a20_nutrient_comparison
w13_climatology_median w3_rolling_median z2_interpolated_years z5_point_loads j12_pixels_in_zones a13_zonal_sum a16_zone_uncertainty_p90
r3_overrides_extreme p9_column_operations k1_soil_file_lines k2_point_file_lines s1_reach_lines s2_sub_lines l1_ledger_summary
l2_parameter_choices l3_run_targets a18_difference_metrics u4_reconciled_files m28_evaluate_fit
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    queries = catalog().queries
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    if len(sys.argv) > 1:
        names = [n for n in queries if any(a in n for a in sys.argv[1:])]
    queries["a3_fan_monthly"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    took: dict[str, float] = {}
    for name in names:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
