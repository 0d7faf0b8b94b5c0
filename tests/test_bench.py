"""bench.py prints exactly one JSON line with the agreed keys."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF_SMALL


def test_bench_json_contract():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2", BENCH_REPEAT="1",
               BENCH_QUERIES="dim_lists,airline_revenue_split")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    result = json.loads(out[0])
    assert result["metric"] == "total_query_seconds" and result["unit"] == "sec"
    assert set(result["queries"]) == {"dim_lists", "airline_revenue_split"}
    assert result["sf"] == 0.001 and result["value"] > 0 and "failed" not in result
