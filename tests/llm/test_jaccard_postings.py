"""What the near-copy join sends and keeps before pairs are made."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemeter.llm import jaccard
from tidemeter.llm.packed import planes


def test_counts_travel_small():
    text = " ".join(str(i) for i in range(2000))
    batch = pa.RecordBatch.from_pydict({"text": [text]})
    sent = sum(sum(map(len, b.column("counts").to_pylist())) for b in jaccard._counted(4)([batch]))
    assert sent < 200 * 1997  # raw blocks of 8,192 bytes each are some 6,000 bytes a shingle


def test_levels_count_what_tasks_counted():
    made = [b for text in ("a b c d e", "a b c d f") for b in jaccard._counted(4)([pa.RecordBatch.from_pydict({"text": [text]})])]
    (out,) = jaccard._levels(made)
    levels = np.concatenate([np.frombuffer(x, np.uint8) for x in out.column("levels").to_pylist()])
    assert sorted(levels[levels > 0].tolist()) == [6, 6, 9]  # once, once, twice


def test_postings_stay_only_with_a_partner():
    rng = random.Random(5)
    posts = sorted({(rng.randrange(40), rng.randrange(20, 80), rng.randrange(8), node) for node in range(400)})
    posts += [(99, 50, 0, 1000 + i) for i in range(jaccard.OFFSETS + 2)]  # longer than the offsets: all stay

    def fits(x, y):
        lo, hi = min(x[1], y[1]), max(x[1], y[1])
        return 100 * lo >= 85 * hi and 185 * min(x[1] - x[2], y[1] - y[2]) >= 85 * (lo + hi)

    want = {(h, node) for h, n, pos, node in posts if any(o[0] == h and o[3] != node and fits((h, n, pos), o) for o in posts)}
    h, n, pos, node = (np.array(c) for c in zip(*posts, strict=True))
    short = planes(h.astype(np.uint64))[: jaccard.SHORT * len(h)]
    # Every posting sent twice, as by two tasks.
    cols = {"h": short, "node": planes(node.astype(np.int64)), "n": planes(n.astype(np.uint32)), "pos": planes(pos.astype(np.uint32))}
    table = pa.table({"bucket": pa.array([3, 3], pa.int32()), **{k: [v, v] for k, v in cols.items()}})
    got = jaccard._shared_shingles(85)(table)
    found = list(zip(((got["token"].to_numpy() - 3) >> (62 - 8 * jaccard.SHORT)).tolist(), got["node"].to_pylist(), strict=True))
    assert len(found) == len(set(found)) and set(found) == want
    assert 0 < len(want) < len(posts)


def test_rounds_of_neighbours_change_no_result(spark, monkeypatch):
    """A chain of near copies, and many copies of one text that differ in a word, with and without more rounds."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(60):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.col("text"))
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    want = sorted(map(tuple, jaccard.report(df).collect()))
    monkeypatch.setattr(jaccard, "ROUNDS", 3)
    monkeypatch.setattr(jaccard, "PAIRS", 0)
    assert sorted(map(tuple, jaccard.report(df).collect())) == want
