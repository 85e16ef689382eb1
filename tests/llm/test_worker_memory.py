"""A worker gives freed memory back after each batch, as it stays for the stages that follow."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import re
import numpy as np, pyarrow as pa
from tallyspring.llm.words import slices

pins = []

def batches():
    blocks = [np.ones(12_000) for _ in range(2_000)]  # 192 MB in small blocks, and one above them that stays
    pins.append(np.ones(12_000))
    del blocks
    yield pa.RecordBatch.from_pydict({"text": ["a", None, "b"]})

assert [p.column(0).to_pylist() for p in slices(batches())] == [["a", "", "b"]]
print(int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_freed_memory_goes_back():
    told = subprocess.run([sys.executable, "-c", CODE], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True)
    assert int(told.stdout) < 120
