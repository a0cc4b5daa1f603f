"""The benchmark runs to its end and prints one line."""

import json
import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_line(sf):
    env = os.environ | {"BENCH_SF_DIR": sf, "BENCH_CPUS": "4"}
    done = subprocess.run([sys.executable, f"{HERE}/bench.py"], env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    found = json.loads(done.stdout.strip().splitlines()[-1])
    assert found["unit"] == "sec" and len(found["queries"]) >= 15 and all(v >= 0 for v in found["queries"].values())
    assert found["recall_at_10"] >= 0.9
