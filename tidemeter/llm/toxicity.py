"""Toxicity: a support vector machine over the gap-weighted subsequence kernel, with Nystroem landmarks.

A text is a bag of words: ``score`` is a calibrated function of its largest word decision and of the sum
and share of what lies beyond the border (multiple-instance learning, so document labels suffice). The kernel counts common
subsequences of ``ORDER`` characters, each damped by ``DECAY`` for every character it spans, so gaps and
inserted characters lower a similarity and do not break it. Shorter strings get an edge sign on both sides, so
that one or two characters with the edges make a subsequence. Neighbouring words shorter than ``ORDER`` are also
joined, in all runs of 2 to ``JOINED`` of them, and count as further words: spaces between single letters or
pairs hide nothing. A piece of three characters or more between spaces is not joined with others. Landmarks span the feature space
``K_mm^-1/2 k(word)`` in which the machine is linear; training is on at most ``TRAIN_ROWS`` labelled
documents of each class, never on held-out ones, and only from their texts. Every distinct word is scored
once per worker; every word of every text counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemeter.llm.common import BYTE_CODES, LOWER, SPACES, U64, chunks, fresh, keyed, rolling, trim, words
from tidemeter.llm.tokenizing import worker_state

#: Labelled rows of each class that the machine learns from, at most; the lowest hashes of the id are taken.
TRAIN_ROWS = 1000
ORDER, DECAY = 3, 0.6
LANDMARKS = 56
#: The least log-odds times root of count of a word that may speak for toxicity.
WEAKEST = 5.0
#: Word decisions beyond these count as evidence.
BORDERS = (-0.2, 0.2, 0.6)
#: A longer word is scored in overlapping parts of this many characters.
PART = 24
#: So many neighbouring short words are joined, at most.
JOINED = 8
#: Words that a worker remembers the decision of.
REMEMBERED = 3_000_000

_LETTERS = ~SPACES & ((np.arange(256) >= 0x80) | np.array([chr(i).isalnum() for i in range(256)]) & (np.arange(256) < 0x80))


def codes(strings: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(strings), width), pad, np.uint32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    return out


def _kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unnormalised kernels; ``s`` is (n, ls) codes, ``t`` broadcasts as (n or 1, m, lt) codes."""
    lt = t.shape[-1]
    gap = np.arange(lt)
    toeplitz = np.where(gap[None] >= gap[:, None], DECAY ** (gap[None] - gap[:, None]).clip(0), 0).astype(np.float32)
    shape = (len(s), t.shape[1], lt)
    # inner[i][..., j]: weight of subsequences of i characters of the part of s so far and of t before j.
    inner = [np.ones(shape, np.float32)] + [np.zeros(shape, np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(shape[:2], np.float32)
    for x in range(s.shape[1]):
        equal = (s[:, x, None, None] == t) * np.float32(DECAY ** 2)
        if not equal.any():
            for i in range(1, ORDER):
                inner[i] *= np.float32(DECAY)
            continue
        total += np.einsum("nmj,nmj->nm", equal, inner[ORDER - 1])
        for i in range(ORDER - 1, 0, -1):
            new = ((equal * inner[i - 1]).reshape(-1, lt) @ toeplitz).reshape(shape)
            inner[i] *= np.float32(DECAY)
            inner[i][..., 1:] += new[..., :-1]
    return total


def edged(strings: list[str]) -> list[str]:
    """Strings of fewer than ``ORDER`` characters between two signs that no word has."""
    return [s if len(s) >= ORDER or not s else f"\x02{s}\x03" for s in strings]


def self_kernel(strings: list[str], block: int = 2048) -> np.ndarray:
    out = np.zeros(len(strings), np.float32)
    for at in range(0, len(strings), block):
        part = strings[at: at + block]
        width = max(map(len, part))
        out[at: at + block] = _kernel(codes(part, width, 1), codes(part, width, 0)[:, None])[:, 0]
    return out


def similarities(strings: list[str], marks: list[str], block: int = 256) -> np.ndarray:
    """Cosine-normalised kernels (n, m); short strings are compared with their edges, an empty one is like nothing."""
    strings, marks = edged(strings), edged(marks)
    # Short and long landmarks apart, as all of a group are padded to its longest.
    short = [j for j, m in enumerate(marks) if len(m) <= 7]
    sets = [(g, codes([marks[j] for j in g], max(len(marks[j]) for j in g), 0)[None])
            for g in (short, [j for j in range(len(marks)) if len(marks[j]) > 7]) if g]
    own = np.sqrt(self_kernel(marks))
    out = np.zeros((len(strings), len(marks)), np.float32)
    order = sorted((i for i, s in enumerate(strings) if len(s) >= ORDER), key=lambda i: len(strings[i]))
    for at in range(0, len(order), block):
        rows = order[at: at + block]
        part = [strings[i] for i in rows]
        mine = np.sqrt(self_kernel(part, block))
        mine, coded = mine[:, None], codes(part, max(map(len, part)), 1)
        for g, t in sets:
            out[np.ix_(rows, g)] = _kernel(coded, t) / np.maximum(mine * own[g], 1e-12)
    return out


def parts(word: str) -> list[str]:
    return [word] if len(word) <= PART else [word[i: i + PART] for i in range(0, len(word) - PART // 2, PART // 2)]


def cut(strings: list[str]) -> tuple[list[str], np.ndarray]:
    """Lower-cased parts of all words, and the word of each."""
    pieces, sizes = [], np.zeros(len(strings), np.int64)
    for i, s in enumerate(strings):
        own = parts(s.lower())
        pieces += own
        sizes[i] = len(own)
    return pieces, np.repeat(np.arange(len(sizes)), sizes)


class Machine:
    """Word decisions and their calibration; plain data, so that it travels to the executors."""

    def __init__(self, marks: list[str], weights: np.ndarray, bias: float, final: np.ndarray):
        self.marks, self.weights, self.bias, self.final = marks, weights, bias, final

    def combine(self, like: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
        """The largest decision on a part of each word."""
        out = np.full(words, -np.inf)
        np.maximum.at(out, owner, like @ self.weights + self.bias)
        return out

    def decide(self, strings: list[str]) -> np.ndarray:
        if not self.marks:
            return np.full(len(strings), self.bias)
        pieces, owner = cut(strings)
        return self.combine(similarities(pieces, self.marks), owner, len(strings))

    def probability(self, decisions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of texts whose words, ``decisions[first[i]:first[i + 1]]`` for text i, were decided on."""
        return 1 / (1 + np.exp(-np.clip(evidence(decisions, first, self.bias) @ self.final, -50, 50)))


def evidence(decisions: np.ndarray, first: np.ndarray, bias: float) -> np.ndarray:
    """Largest decision, sum and share of decisions beyond several borders, and a constant, for each text."""
    n, some = np.diff(first), np.flatnonzero(np.diff(first))
    out = np.zeros((len(n), 2 * len(BORDERS) + 2))
    out[:, 0], out[:, -1] = bias, 1
    if len(some):
        out[some, 0] = np.maximum.reduceat(decisions, first[some])
        for i, border in enumerate(BORDERS):
            total = np.add.reduceat(np.maximum(decisions - border, 0).astype(np.float64), first[some])
            out[some, 1 + 2 * i] = np.log1p(total)
            out[some, 2 + 2 * i] = np.sqrt(total / n[some])
    return out


def _spans(texts: pa.Array):
    """Space-separated words without the signs around them, and joined runs of short ones: bytes, starts, ends,
    spans before each text."""
    w = words(texts, SPACES, True)
    letters = np.flatnonzero(_LETTERS[w.data])
    lo, hi = np.searchsorted(letters, w.starts), np.searchsorted(letters, w.ends)
    full = hi > lo
    starts, ends = letters[lo[full]], letters[hi[full] - 1] + 1
    first = np.concatenate(([0], np.cumsum(full)))[w.first]
    # Words end to end, so that neighbours are one span.
    size = ends - starts
    to = np.cumsum(size)
    data = w.data[np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - size), size)]
    starts, ends = to - size, to
    begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    short = begun[ends] - begun[starts] < ORDER
    doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    # The place where the run of short words from each word ends, at its text's end at the latest.
    stop = np.append(np.flatnonzero(~short), len(short))
    reach = np.minimum(stop[np.searchsorted(stop, np.arange(len(short)))], first[doc + 1]) - np.arange(len(short))
    joined = [(at, at + k - 1) for k in range(2, JOINED + 1) for at in [np.flatnonzero(reach >= k)]]
    head = np.concatenate((np.arange(len(starts)), *(a for a, _ in joined)))
    tail = np.concatenate((np.arange(len(starts)), *(z for _, z in joined)))
    order = np.argsort(doc[head], kind="stable")
    head, tail = head[order], tail[order]
    return data, starts[head], ends[tail], np.searchsorted(doc[head], np.arange(len(first)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        data, starts, ends, first = _spans(batch.column("text"))
        bags = [[data[starts[i]: ends[i]].tobytes().decode("utf-8", "ignore").lower() for i in range(a, b)]
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(bags, pa.list_(pa.string()))], names=["doc_id", "toxic", "bag"])


def _svm(x: np.ndarray, y: np.ndarray, often: np.ndarray, cost: float = 2000.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; classes weigh alike, and words as ``often``."""
    x1 = np.hstack((x, np.ones((len(x), 1)))).astype(np.float64)
    weight = cost * np.where(y > 0, often / often[y > 0].sum(), often / often[y < 0].sum())
    u, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (x1 @ u) < 1
        xa = x1[active] * weight[active, None]
        new = np.linalg.solve(ridge + xa.T @ x1[active], xa.T @ y[active])
        if np.abs(new - u).max() < 1e-7:
            break
        u = new
    return u[:-1], float(u[-1])


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-3) -> np.ndarray:
    """Calibration with Platt's smoothed targets; classes weigh as they occur."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0)
    u, damp = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    damp[-1] = 1e-9
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ u, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(damp), x.T @ (weight * (p - target)) + damp * u)
        u = u - step * min(1, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return u


def _numbered(bags: pa.Table) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """The distinct words, sorted, and the toxic and the clean documents as numbers of words: the driver holds each
    word once, not each occurrence."""
    number: dict[str, int] = {}
    docs = []
    for batch in bags.to_batches():
        if not batch.num_rows:
            continue
        bag = batch.column("bag")
        coded = bag.flatten().dictionary_encode()
        own = np.array([number.setdefault(w, len(number)) for w in coded.dictionary.to_pylist()], np.int32)
        taken = own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else own
        ends = np.cumsum(bag.value_lengths().to_numpy(zero_copy_only=False))
        docs += zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), np.split(taken, ends[:-1]), strict=True)
    every = sorted(number)
    place = np.empty(len(every), np.int32)
    place[np.array([number[w] for w in every], np.int64)] = np.arange(len(every))
    docs = [(ident, y, place[b]) for ident, y, b in docs]
    docs.sort(key=lambda d: (d[0], d[2].tolist()))
    return every, [b for _, y, b in docs if y == 1], [b for _, y, b in docs if y != 1]


def fit(every: list[str], toxic: list[np.ndarray], clean: list[np.ndarray], prior: float | None = None, seed: int = 7) -> Machine:
    """From the documents of both classes, as places of their words in ``every``, which is sorted; ``prior`` is the
    share of toxic ones among all labelled rows. With one class only, every text gets that class's side."""
    rng = np.random.default_rng(seed)
    if not toxic or not clean:
        return Machine([], np.zeros(0), 0.0, np.array([0.0] * (2 * len(BORDERS) + 1) + [3.0 if toxic else -3.0]))
    counts = np.array([np.bincount(np.concatenate([np.unique(b) for b in side]), minlength=len(every)) for side in (toxic, clean)])

    def tell(i: int) -> float:
        n = int(counts[0, i])
        return (np.log((n + 0.5) / (len(toxic) + 1)) - np.log((int(counts[1, i]) + 0.5) / (len(clean) + 1))) * np.sqrt(n)

    in_toxic, in_clean = np.flatnonzero(counts[0]), np.flatnonzero(counts[1])
    strength = np.array([tell(i) for i in in_toxic.tolist()])
    most = strength.max(initial=0)
    best = np.argsort(-strength, kind="stable")[:300]
    best = best[strength[best] >= max(WEAKEST, most / 8)]
    telling_at, strength = in_toxic[best], strength[best]
    plain_at = in_clean[rng.permutation(len(in_clean))[:6000]]
    if not len(telling_at) or not len(plain_at):
        return Machine([], np.zeros(0), 0.0, np.array([0.0] * (2 * len(BORDERS) + 1) + [-3.0]))
    telling = [every[i] for i in telling_at.tolist()]
    # Landmarks: telling words that are least like those already taken, and a share of plain words.
    like = similarities(telling, [t[:PART] for t in telling])
    marks, near = [0], like[:, 0].copy()
    while len(marks) < min(len(telling), LANDMARKS * 3 // 4) and near.min() < 0.95:
        value = strength * (1 - near).clip(0)
        value[marks] = -1
        marks.append(int(value.argmax()))
        near = np.maximum(near, like[:, marks[-1]])
    names = [telling[i][:PART] for i in marks] + [every[i][:PART] for i in plain_at[: LANDMARKS // 4].tolist()]
    values, vectors = np.linalg.eigh(similarities(names, names).astype(np.float64) + 1e-4 * np.eye(len(names)))
    root = (vectors / np.sqrt(values.clip(1e-6))) @ vectors.T

    pieces, owner = cut(every)
    like = similarities(pieces, names)
    whole = np.searchsorted(owner, np.arange(len(every)))  # the first part of each word

    def machine(witnesses: np.ndarray, negatives: np.ndarray) -> tuple[Machine, np.ndarray]:
        """Trained on these words; and the decision on every word."""
        x = like[whole[np.concatenate((witnesses, negatives))]] @ root
        often = np.sqrt(np.concatenate((counts[0][witnesses], counts[1][negatives])).clip(1))
        u, bias = _svm(x, np.r_[np.ones(len(witnesses)), -np.ones(len(negatives))], often)
        made = Machine(names, (root @ u).astype(np.float32), bias, np.zeros(2 * len(BORDERS) + 2))
        return made, made.combine(like, owner, len(every))

    found, decided = machine(telling_at, plain_at)
    for _ in range(2):
        # Witnesses anew, and the clean words nearest to the border as further negatives.
        tops = np.array([b[decided[b].argmax()] for b in toxic if len(b)], np.int64)
        witnesses = np.union1d(tops[(decided[tops] > 0) & (counts[1][tops] == 0)], telling_at)
        hard = in_clean[np.argsort(-decided[in_clean], kind="stable")[:3000]]
        found, decided = machine(witnesses, np.concatenate((plain_at, hard)))
    sample = toxic + clean
    first = np.concatenate(([0], np.cumsum([len(b) for b in sample])))
    x = evidence(decided[np.concatenate(sample)], first, found.bias)
    found.final = _logistic(x, np.r_[np.ones(len(toxic)), np.zeros(len(clean))], prior or len(toxic) / len(sample))
    return found


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Learns from the labelled rows that are not held out: the ``rows`` of each class whose ids hash lowest."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.where(~held_out(F.col("doc_id")))
    shares = {r.toxic: r["count"] for r in y.groupBy("toxic").count().collect()}
    text = keyed(docs).where("text is not null")
    known = y.join(text.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    bags = text.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_bags, "doc_id long, toxic int, bag array<string>")
    # At most 2 * rows documents come back, as Arrow lists of words.
    try:
        return fit(*_numbered(bags.toArrow()), shares.get(1, 0) / max(sum(shares.values()), 1))
    finally:
        pa.default_memory_pool().release_unused()
        trim()


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


class _Known:
    """Hash of a word -> decision."""

    def __init__(self):
        self.keys, self.values = np.zeros(0, U64), np.zeros(0, np.float32)

    def get(self, hashes: np.ndarray, text, machine: Machine) -> np.ndarray:
        found, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(found) > REMEMBERED:
            self.__init__()
        place = np.searchsorted(self.keys, found)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != found) if len(self.keys) else np.arange(len(found))
        if len(new):
            made = machine.decide([text(i) for i in where[new].tolist()]).astype(np.float32)
            self.keys = np.insert(self.keys, place[new], found[new])
            self.values = np.insert(self.values, place[new], made)
            place = np.searchsorted(self.keys, found)
        return self.values[place][back]


def _shared(docs: DataFrame, machine: Machine):
    """The machine with its class, as bytes: executors need no copy of this package to read it."""
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(machine))


def _score(shared, name: str, column: str = "score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pickle.loads(shared.value)
        known = worker_state("decisions", name, _Known)
        for batch in chunks(batches):
            data, starts, ends, first = _spans(batch.column("text"))
            decided = known.get(rolling(BYTE_CODES[LOWER[data]], starts, ends), lambda i: data[starts[i]: ends[i]].tobytes().decode("utf-8", "ignore"), machine)
            score = machine.probability(decided, first)
            names = [c for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, column])
    return run


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, key, score`` for each row; the score reads the text and nothing else.

    Null and wordless texts get the score of no telling word. Rows without id or label do not train; a
    repeated label row counts once, toxic if any says so.
    """
    machine = train(docs, labels, rows)
    shared = _shared(docs, machine)
    scored = keyed(docs).mapInArrow(_score(shared, fresh("decisions")), "doc_id long, key long, text string, score double")
    return scored


def clean(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    shared, column = _shared(docs, machine), fresh("score")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(_score(shared, fresh("decisions"), column), schema).where(F.col(column) < threshold).drop(column)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
