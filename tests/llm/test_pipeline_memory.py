"""What the pipeline's Python workers hold: their number for a task, and what they keep after it."""

import os
import re
import subprocess
import sys

from quadrille.llm import _spark, shingle_join

KEEPS = """
import re
from pathlib import Path
import pyarrow as pa
from quadrille.llm import _text

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

before = held()
rest = [bytes(100_000) for _ in range(1500)]
rest = rest[-1]  # at the heap's end, so that the memory below isn't given back by itself
batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["a b", None])})
assert [(p.num_rows, d.tobytes(), o.tolist()) for p, d, o in _text.slices([batch])] == [(2, b"a b", [0, 3, 3])]
print(held() - before)
"""


def test_texts_give_back_what_was_freed():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", KEEPS], capture_output=True, text=True, cwd=root, check=True)
    assert float(out.stdout) < 50  # MB, of 150 that were freed


def test_near_copies_need_one_worker_for_a_task(spark, monkeypatch):
    plans, put = [], _spark.materialise
    monkeypatch.setattr(_spark, "materialise", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or put(df, *a))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "another text"), (None, text)], "doc_id long, text string")
    assert [sorted(r) for r in shingle_join.similar_documents(docs).collect()] == [[1, 2]]
    apart = re.compile("Join|Aggregate|Repartition|Sort|Union")
    for plan in plans:
        depths = []  # of the MapInArrows above a line that nothing parts from it
        for line in plan.splitlines():
            depth = len(re.match(r"[ :+-]*", line)[0])
            depths = [d for d in depths if d < depth]
            if "MapInArrow" in line:
                assert not depths, plan
                depths.append(depth)
            elif apart.match(line[depth:]):
                depths = []
