"""Operators on workers that cannot import this repository: only the driver's path holds it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from tidemeter.session import build_session
from tidemeter.llm import periodicity, quality, toxicity, vectorcodes
spark = build_session("remote", 2)
def seen(batches):
    import importlib.util, pyarrow as pa
    found = importlib.util.find_spec("tidemeter") is not None
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([found] * b.num_rows)], names=["found"])
assert [r.found for r in spark.range(1).mapInArrow(seen, "found boolean").collect()] == [False]
docs = spark.createDataFrame([(i, ("bad blatherscum word " if i % 2 else "calm and quiet word ") * 3) for i in range(40)], "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
assert toxicity.report(docs, labels).count() == 40
kept = toxicity.clean(docs, toxicity.train(docs, labels))
assert 0 < kept.count() < 40
assert quality.report(docs, labels).count() == 40
assert periodicity.report(docs).count() == 40
vectors = spark.createDataFrame([(i, [i / 40, 1.0, -i / 40, 0.0], 0) for i in range(40)], "vec_id long, embedding array<double>, label int")
assert vectorcodes.report(vectors).count() == 40
print("all ran")
"""


def test_no_copy_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
