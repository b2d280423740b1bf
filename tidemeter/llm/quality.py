"""Quality: a byte-level convolutional network in numpy over overlapping chunks of the whole document.

Bytes have learned vectors; filters of ``WIDTH`` bytes slide over them. A chunk is two neighbouring segments of
``SEGMENT`` bytes, so chunks overlap by half and cover every byte. A filter's greatest answer in a chunk is
kept (max-pooling), a hidden layer combines the filters, and the greatest and the mean hidden values over all
chunks of the document give one probability. Training is by gradient descent (Adam) on the driver over at most
``TRAIN_ROWS`` labelled documents of each class and at most ``TRAIN_SEGMENTS`` segments of each, evenly spread;
a score reads every byte of its text and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemeter.llm.common import chunks, flat, fresh, keyed

#: Labelled rows of each class, and segments of each of them, that the network learns from, at most.
TRAIN_ROWS, TRAIN_SEGMENTS = 1000, 24
SEGMENT, WIDTH, STRIDE = 256, 8, 2
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: What fills up a document's last segment.
PAD = 256
EPOCHS, BATCH, RATE, DECAY = 14, 16, 0.004, 1e-4
#: Segments whose answers a task holds at once.
BLOCK = 256

_PLACES = np.arange(0, SEGMENT, STRIDE)


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(segments, SEGMENT + WIDTH - 1)`` byte codes with the bytes that filters reach beyond, and the ``n + 1``
    places where each document's segments begin. An empty document has one segment of padding."""
    sizes = np.diff(at)
    counts = np.maximum(1, -(-sizes // SEGMENT))
    first = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = at[doc] + (np.arange(len(doc)) - first[doc]) * SEGMENT
    place = start[:, None] + np.arange(SEGMENT + WIDTH - 1)
    inside = place < at[doc + 1][:, None]
    codes = np.full(place.shape, PAD, np.uint16)
    codes[inside] = data[place[inside]]
    return codes, first


def _answers(net: dict, codes: np.ndarray, learning: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Greatest answer of each filter in each segment and, for learning, the position that gave it."""
    vectors = net["embed"][codes]
    windows = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH, 1)[:, ::STRIDE]  # segment, position, embed, width
    flat_windows = np.ascontiguousarray(windows.transpose(0, 1, 3, 2)).reshape(-1, WIDTH * EMBED)
    out = (flat_windows @ net["filters"]).reshape(len(codes), len(_PLACES), -1)
    if not learning:
        return np.maximum(out.max(1) + net["bias"], 0), None
    best = out.argmax(1)
    return np.maximum(np.take_along_axis(out, best[:, None], 1)[:, 0] + net["bias"], 0), best


def _chunked(answers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbouring segments (a lone segment is a pair of itself), and where each document's begin."""
    counts = np.maximum(1, np.diff(first) - 1)
    start = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(counts)), counts)
    left = first[doc] + np.arange(len(doc)) - start[doc]
    right = np.minimum(left + 1, first[doc + 1] - 1)
    return left, right, start


def forward(net: dict, codes: np.ndarray, first: np.ndarray, learning: bool = False) -> tuple[np.ndarray, dict]:
    """Log-odds of each document, and what the way back needs."""
    made = [_answers(net, codes[lo: lo + BLOCK], learning) for lo in range(0, len(codes), BLOCK)]
    answers, best = np.concatenate([a for a, _ in made]), np.concatenate([b for _, b in made]) if learning else None
    left, right, start = _chunked(answers, first)
    pooled = np.maximum(answers[left], answers[right])
    raw = pooled @ net["hidden"] + net["hidden_bias"]
    hidden = np.maximum(raw, 0)
    counts = np.diff(start)[:, None]
    most = np.maximum.reduceat(hidden, start[:-1], axis=0)
    mean = np.add.reduceat(hidden, start[:-1], axis=0) / counts
    both = np.concatenate((most, mean), 1)
    return both @ net["final"] + net["final_bias"], dict(answers=answers, best=best, left=left, right=right, start=start, pooled=pooled, raw=raw, hidden=hidden, most=most, both=both)


def backward(net: dict, codes: np.ndarray, kept: dict, wrong: np.ndarray) -> dict:
    """Gradients for the errors ``wrong`` of the documents' log-odds."""
    start, left, right, answers = kept["start"], kept["left"], kept["right"], kept["answers"]
    counts = np.diff(start)
    doc = np.repeat(np.arange(len(counts)), counts)
    grad = {"final": kept["both"].T @ wrong, "final_bias": wrong.sum(keepdims=True)}
    h = net["hidden"].shape[1]
    out = wrong[:, None] * net["final"]
    top = (kept["hidden"] == kept["most"][doc]).astype(np.float32)
    ties = np.add.reduceat(top, start[:-1], axis=0)[doc]
    d_hidden = (out[doc, :h] * top / ties + out[doc, h:] / counts[doc, None]) * (kept["raw"] > 0)
    grad["hidden"], grad["hidden_bias"] = kept["pooled"].T @ d_hidden, d_hidden.sum(0)
    d_pooled = d_hidden @ net["hidden"].T
    d_answers = np.zeros_like(answers)
    first_side = answers[left] >= answers[right]
    np.add.at(d_answers, left, d_pooled * first_side)
    np.add.at(d_answers, right, d_pooled * ~first_side)
    d_answers *= answers > 0
    grad["bias"] = d_answers.sum(0)
    # Only the window that gave a filter's greatest answer has a part in it.
    window = codes[np.arange(len(codes))[:, None, None], (kept["best"] * STRIDE)[:, :, None] + np.arange(WIDTH)]
    vectors = net["embed"][window]
    grad["filters"] = np.einsum("sf,sfke->kef", d_answers, vectors, optimize=True).reshape(WIDTH * EMBED, -1)
    weights = net["filters"].reshape(WIDTH, EMBED, -1).transpose(2, 0, 1)
    d_embed = (d_answers[:, :, None, None] * weights[None]).reshape(-1, EMBED)
    flat_window = window.ravel()
    grad["embed"] = np.stack([np.bincount(flat_window, d_embed[:, e], PAD + 1) for e in range(EMBED)], 1).astype(np.float32)
    return grad


def start(seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {"embed": normal(PAD + 1, EMBED, scale=0.5), "filters": normal(WIDTH * EMBED, FILTERS, scale=0.25), "bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(FILTERS, HIDDEN, scale=0.25), "hidden_bias": np.zeros(HIDDEN, np.float32), "final": normal(2 * HIDDEN, scale=0.25), "final_bias": np.zeros(1, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -60, 60)))


def fit(found: list[tuple[int, np.ndarray]], prior: float, epochs: int = EPOCHS) -> dict:
    """``found``: (label, segments). Both classes weigh alike in training; ``prior``, the share of ones among all
    training labels, then moves the log-odds."""
    net = start()
    labels = np.array([y for y, _ in found], np.float32)
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:  # nothing to tell apart: the prior alone
        net["final"][:] = 0
        net["final_bias"][:] = np.log(np.clip(prior, 1e-3, 1 - 1e-3) / (1 - np.clip(prior, 1e-3, 1 - 1e-3)))
        return net
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first_moment, second_moment = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    rng, step = np.random.default_rng(1), 0
    steps = epochs * -(-len(found) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for lo in range(0, len(order), BATCH):
            picked = order[lo: lo + BATCH]
            codes = np.concatenate([found[i][1] for i in picked])
            first = np.concatenate(([0], np.cumsum([len(found[i][1]) for i in picked])))
            odds, kept = forward(net, codes, first, True)
            wrong = ((sigmoid(odds) - labels[picked]) * weight[picked] / len(picked)).astype(np.float32)
            step += 1
            rate = RATE * min(1.0, step / 50) * max(0.02, 1 - step / steps)
            for k, g in backward(net, codes, kept, wrong).items():
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                move = first_moment[k] / (1 - 0.9 ** step) / (np.sqrt(second_moment[k] / (1 - 0.999 ** step)) + 1e-8)
                net[k] = (net[k] - rate * (move + DECAY * net[k])).astype(np.float32)
    net["final_bias"] = (net["final_bias"] + np.log(prior / (1 - prior))).astype(np.float32)
    return net


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _spread(most: int):
    """Of each text at most ``most`` segments, evenly spread."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            for row in range(batch.num_rows):
                data, at = flat(batch.column("text").slice(row, 1))
                n = max(1, -(-len(data) // SEGMENT))
                taken = np.unique(np.linspace(0, n - 1, min(n, most)).round().astype(np.int64))
                piece = b"".join(segments(data[lo: lo + SEGMENT + WIDTH - 1], np.array([0, min(len(data) - lo, SEGMENT + WIDTH - 1)]))[0][:1].tobytes() for lo in (taken * SEGMENT).tolist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, 1), batch.column("quality").slice(row, 1), pa.array([piece], pa.binary())], names=["doc_id", "quality", "piece"])
    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_SEGMENTS) -> dict:
    """Learns from the labelled rows that are not held out: the ``rows`` of each class whose ids hash lowest."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        "doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    y = y.where(~held_out(F.col("doc_id")))
    shares = {r.quality: r["count"] for r in y.groupBy("quality").count().collect()}
    text = keyed(docs).where("text is not null")
    known = y.join(text.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    # A bounded number of rows is picked, so they fit a broadcast; at most ``most`` segments of each come back.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    found = text.join(chosen, "doc_id").select("doc_id", "quality", "text").mapInArrow(_spread(most), "doc_id long, quality int, piece binary")
    width = SEGMENT + WIDTH - 1
    got = sorted(((r.doc_id, bytes(r.piece), r.quality) for r in found.collect()))
    prior = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
    return fit([(q, np.frombuffer(p, np.uint16).reshape(-1, width)) for _, p, q in got], prior)


def _score(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in chunks(batches):
            codes, first = segments(*flat(batch.column("text")))
            odds, _ = forward(net, codes, first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(odds))], names=[*batch.schema.names, column])
    return run


def score(docs: DataFrame, net: dict, column: str = "score") -> DataFrame:
    """All columns of ``docs`` (but one of that name) and the probability of label 1 for each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop(column)
    return docs.mapInArrow(_score(shared, column), T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; ``predicted`` is 1 from a score of 0.3.

    A null or empty text is a segment of padding and has its score. Repeated rows have equal scores; a null id
    gets a score, is not held out and does not train. Labels that are null or neither 0 nor 1 do not train; a
    document with several labels counts as 0 if any says so. Without labels of both classes every score is the
    share of ones (0.5 without labels). A text beyond a chunk of two megabytes is read alone, at some twenty
    bytes of arrays a byte. Other columns are not read.
    """
    net, column = train(docs, labels), fresh("score")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = score(rows, net, column)
    return made.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col(column).alias("score"),
                       (F.col(column) >= 0.3).cast("int").alias("predicted"))
