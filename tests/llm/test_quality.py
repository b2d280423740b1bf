"""The byte network: forward against a plain version, gradients against differences, held-out accuracy."""

import random
import zlib

import numpy as np

from tests.llm.test_text import prose
from tidemeter.llm import quality


def plain_odds(net, text):
    """One document, filter by filter and chunk by chunk."""
    data = list(text.encode())
    n = max(1, -(-len(data) // quality.SEGMENT))
    weights = net["filters"].reshape(quality.WIDTH, quality.EMBED, -1)
    byte = lambda i: data[i] if i < len(data) else quality.PAD
    answers = []
    for s in range(n):
        best = np.full(quality.FILTERS, -np.inf)
        for i in range(s * quality.SEGMENT, (s + 1) * quality.SEGMENT, quality.STRIDE):
            best = np.maximum(best, sum(net["embed"][byte(i + k)] @ weights[k] for k in range(quality.WIDTH)))
        answers.append(np.maximum(best + net["bias"], 0))
    pairs = [np.maximum(answers[i], answers[min(i + 1, n - 1)]) for i in range(max(1, n - 1))]
    hidden = [np.maximum(p @ net["hidden"] + net["hidden_bias"], 0) for p in pairs]
    return float(np.concatenate((np.max(hidden, 0), np.mean(hidden, 0))) @ net["final"] + net["final_bias"][0])


def some(texts):
    raw = [t.encode() for t in texts]
    return quality.segments(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))


def test_forward_covers_every_byte(monkeypatch):
    rng, net = random.Random(2), quality.start(3)
    net["bias"] += 0.1
    texts = ["", "a", prose(rng, 200, 50), "x" * 256, "y" * 257, prose(rng, 40, 50) + "é", "z" * 511, "", prose(rng, 90, 9)]
    monkeypatch.setattr(quality, "BLOCK", 3)
    odds, _ = quality.forward(net, *some(texts))
    assert np.allclose(odds, [plain_odds(net, t) for t in texts], atol=1e-3)
    # A change anywhere, the last byte included, can reach the score: every byte lies in a window.
    codes, first = some([prose(rng, 120, 50)])
    seen = {(s * quality.SEGMENT + i + k) for s in range(len(codes)) for i in range(0, quality.SEGMENT, quality.STRIDE) for k in range(quality.WIDTH)}
    assert set(range(len(codes) * quality.SEGMENT)) <= seen and first.tolist() == [0, len(codes)]


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    net = {k: v.astype(np.float64) for k, v in quality.start(5).items()}
    net = {k: v + rng.normal(0, 0.05, v.shape) for k, v in net.items()}
    codes, first = some(["the cat sat " * 40, "dog", prose(random.Random(1), 70, 30)])
    wrong = np.array([0.3, -0.7, 0.4])
    odds, kept = quality.forward(net, codes, first, True)
    grad = quality.backward(net, codes, kept, wrong)
    for name, value in net.items():
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in value.shape) if name != "embed" else (int(rng.choice(np.unique(codes))), int(rng.integers(quality.EMBED)))
            was, h = value[at], 1e-6
            value[at] = was + h
            up = quality.forward(net, codes, first)[0] @ wrong
            value[at] = was - h
            down = quality.forward(net, codes, first)[0] @ wrong
            value[at] = was
            assert abs((up - down) / (2 * h) - np.ravel(grad[name].reshape(value.shape)[at])[0]) < 1e-3, (name, at)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(6)
    junk = lambda n: " ".join(w.upper() + rng.choice(("###", "!!")) for w in prose(rng, n, 3000).split())
    docs, labels = [], []
    for i in range(360):
        good = rng.random() < 0.7
        docs.append((i, prose(rng, rng.randrange(5, 160), 3000) if good else junk(rng.randrange(5, 160)), "en", "s"))
        labels.append((i, int(good), 0))
    extra = [(1000, None), (1001, ""), (1002, "a"), (1003, prose(rng, 9000, 3000)), (None, "calm words"), (5, docs[5][1]), (1004, docs[5][1])]
    docs += [(i, t, "xx", "t") for i, t in extra]
    labels += [(2, None, 1), (3, 7, 0), (None, 1, 0), (9999, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as score", "'k' as key").repartition(4)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.report(df, y).collect()
    assert len(got) == len(docs) and {r.doc_id for r in got} == {d[0] for d in docs}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    asked = [(i, q) for i, q, _ in labels[:360] if out(i)]
    assert sum(by[i].predicted == q for i, q in asked) >= 0.95 * len(asked)
    assert by[5].score == by[1004].score and by[1000].score == by[1001].score
    # Nothing but the text counts, and labels of held-out rows do not.
    other = spark.createDataFrame([(i, 1 - q if out(i) and q is not None and q < 2 else q, 1) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in quality.report(df.withColumns({"lang": df.source, "source": df.lang}), other).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-4 for r in got)
    assert quality.report(df.where("false"), y).count() == 0
    assert {r.score for r in quality.report(df, y.where("quality = 1")).collect()} == {r.score for r in quality.report(df.limit(1), y.where("quality = 1")).collect()}
    assert {r.score for r in quality.report(df, y.where("false")).collect()} == {0.5}
