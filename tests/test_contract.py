"""Driver contract: bench.py prints exactly one JSON line with the required fields."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_RUNS="1", BENCH_CPUS="2",
               BENCH_QUERIES="wallet_balance,all_subjects")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True,
                         timeout=600, check=True)
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    doc = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(doc)
    assert doc["unit"] == "sec" and set(doc["queries"]) == {"wallet_balance", "all_subjects"}
    assert doc["value"] == round(sum(doc["queries"].values()), 3) and doc["sf"] == 0.001
