"""Workers give memory back at the end of a task."""

import os
import subprocess
import sys

import pytest

if not os.path.exists("/proc/self/smaps_rollup"):
    pytest.skip("memory can't be read here", allow_module_level=True)

SCRIPT = """
import re, sys
sys.path.insert(0, {repo!r})
import pyarrow as pa
from quire.llm import packing, shared, tokens

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

texts = pa.array([" ".join(f"word{{i * k % 9973}}" for k in range(300)) for i in range(3000)])
batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), texts], ["doc_id", "text"])
run = packing._pieces(tokens.vocabulary_path(), 2048)
run = shared.giving_back(run) if {back} else run
before = held()
assert sum(out.num_rows for out in run([batch])) >= 3000
print("held", held() - before)
"""


def test_a_task_leaves_little_memory_behind():
    """The vocabulary of a task that encodes texts is some 100 MB, which an idle worker kept."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    left = {}
    for back in (False, True):
        done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, back=back)], capture_output=True, text=True, timeout=120, check=False)
        assert "held" in done.stdout, done.stderr[-2000:]
        left[back] = int(done.stdout.split()[-1])
    assert left[True] < 60 < left[False]


def test_rows_pass_unchanged():
    from quire.llm.shared import giving_back

    assert list(giving_back(lambda batches: (x * 2 for x in batches))([1, 2, 3])) == [2, 4, 6]
