"""Headline queries, warm: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from fluxframe.plans import QUERIES
from fluxframe.session import local_session

HEADLINE = [
    "detrended_ccf_peak", "detrended_ccf_peak_long", "d1_rebin_shared_grid", "d1_rebin_daily", "d2_interpolation_join", "d3_bilinear_lookup", "d4_chemistry_lookup",
    "d6_star_lookup", "e2_gaussian_loglik", "e4_covariance_loglik", "e8_best_sample", "e9_posterior_quantiles", "e11_hist2d", "e14_envelope_rank",
    "e16_psis_loo", "e21_doppler_ccf", "e22_co_add", "e25_best_measurement", "e31_combine_quantiles", "f3_gauss_reflect", "f4_gauss_full",
    "f6_cumulative_trapz", "f7_hydrostatic_variable", "g3_throughput_fit", "g4_tellurics_fit", "g6_sysrem", "i2_guillot_profiles", "k1_fit_chain",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):  # the second run counts
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total warm seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
