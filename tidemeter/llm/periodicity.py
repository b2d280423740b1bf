"""Runs of words that repeat with a period, found through longest common extensions over a difference cover.

A run of period ``q`` and at least ``4 * q`` words holds a word ``i`` of the grid of every ``3 * q``-th word whose
distance-``q`` neighbour it also holds, so ``n / 3 * (1 + 1/2 + 1/3 + ...)`` pairs ``(i, i + q)`` see every run
of a text (a harmonic grid). From such a pair the common extensions to both sides give the run's ends.

An extension compares a few words until both places are synchronised, that is until both lie in the difference
cover: of any ``MODULUS`` places, ``len(COVER)`` are sampled so that every distance occurs between two samples.
Only sampled suffixes are sorted (by names of ``MODULUS`` words and then by doubling), and the rest of an
extension is the least of the neighbours' common prefixes between two ranks, read from a sparse table. Texts
whose pairs all differ before the samples need no table. Documents are independent: no row leaves its task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import SPACES, chunks, words

#: A perfect difference set: every distance but 0 occurs once between two of its places.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: A run repeats its period so often, and has so many words, at least.
TIMES, LEAST = 4, 6
#: Pairs, and words joined, that a task holds at once.
PAIRS, JOINED = 1 << 20, 1 << 18

_SLOT = np.full(MODULUS, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))
#: By distance and place: words until both places are sampled.
_WAIT = np.array([[next(t for t in range(MODULUS) if _SLOT[(i + t) % MODULUS] >= 0 and _SLOT[(i + t + d) % MODULUS] >= 0)
                   for i in range(MODULUS)] for d in range(MODULUS)])


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense names from 1 of pairs, in their order."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64) + 1


def _after(names: np.ndarray, step: int) -> np.ndarray:
    return np.concatenate((names[step:], np.zeros(min(step, len(names)), np.int64)))


def direct(text: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, way: int = 1) -> np.ndarray:
    """Equal words from ``i`` and ``j`` on (``way`` -1: backwards), up to ``limit``. A unique sign ends each document."""
    same = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for t in range(int(limit.max(initial=0))):
        live = live[limit[live] > t]
        live = live[text[i[live] + way * t] == text[j[live] + way * t]]
        if not len(live):
            break
        same[live] = t + 1
    return same


def wait(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return _WAIT[(j - i) % MODULUS, i % MODULUS]


class Extensions:
    """Longest common extensions of a text that unique signs end."""

    def __init__(self, text: np.ndarray):
        self.text, size = text, len(COVER)
        names = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        for step in (1, 2, 4, 8):
            names = _named(names, _after(names, step))
        at = np.arange(len(text))
        self.samples = at[_SLOT[at % MODULUS] >= 0]
        levels = [_named(names[self.samples], _after(names, MODULUS - 16)[self.samples])]
        while int(levels[-1].max(initial=0)) < len(self.samples):
            levels.append(_named(levels[-1], _after(levels[-1], size << (len(levels) - 1))))
        self.rank = levels[-1] - 1
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        prefix = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            both = np.flatnonzero((a < len(order)) & (b < len(order)))
            both = both[levels[k][a[both]] == levels[k][b[both]]]
            prefix[both] += MODULUS << k
            a[both] += size << k
            b[both] += size << k
        prefix += self._few(self.samples[order[:-1]] + prefix, self.samples[order[1:]] + prefix)
        self.least = [prefix.astype(np.int32 if len(text) < 1 << 31 else np.int64)]
        while (half := 1 << (len(self.least) - 1)) * 2 <= len(prefix):
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _few(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = np.minimum(len(self.text) - np.maximum(i, j), MODULUS)
        return direct(self.text, i, j, inside)

    def place(self, at: np.ndarray) -> np.ndarray:
        return at // MODULUS * len(COVER) + _SLOT[at % MODULUS]

    def synchronised(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of two different sampled places."""
        r, s = self.rank[self.place(i)], self.rank[self.place(j)]
        low, high = np.minimum(r, s), np.maximum(r, s)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level).tolist():
            x = np.flatnonzero(level == k)
            out[x] = np.minimum(self.least[k][low[x]], self.least[k][high[x] - (1 << k)])
        return out


def _grid(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(document, place in it, period)`` of all pairs, a bounded number at a time."""
    most = np.where(counts >= LEAST, counts // TIMES, 0)
    ends = np.cumsum(most)
    doc = np.repeat(np.arange(len(counts)), most)
    q = np.arange(len(doc)) - (ends - most)[doc] + 1
    step = np.maximum((TIMES - 1) * q, LEAST - q)
    steps = -(-(counts[doc] - q) // step)
    total = np.concatenate(([0], np.cumsum(steps)))
    at = 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        row = np.repeat(np.arange(at, stop), steps[at:stop])
        yield doc[row], (np.arange(len(row)) + total[at] - total[row]) * step[row], q[row]
        at = stop


def runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, length, period)`` of all runs of the documents ``ids[first[d]:first[d + 1]]``, by document, start, period."""
    counts = np.diff(first)
    # Each document stands between signs of its own.
    text = np.empty(len(ids) + len(first), np.int64)
    signs = first + np.arange(len(first))
    text[signs] = -1 - np.arange(len(first))
    begin = signs[:-1] + 1
    text[np.arange(len(ids)) + np.repeat(np.arange(1, len(first)), counts)] = ids
    held: list[tuple] = []
    for doc, place, q in _grid(counts):
        i = begin[doc] + place
        same = np.flatnonzero(text[i] == text[i + q])
        if len(same):
            held.append((doc[same], i[same], q[same]))
    if not held:
        return (np.zeros(0, np.int64),) * 4
    doc, i, q = (np.concatenate(x) for x in zip(*held, strict=True))
    # The few words until the samples; backwards the text is read from its end, with samples of its own.
    last = len(text) - 1
    limit, back = wait(i, i + q), wait(last - i + 1, last - i - q + 1)
    ahead, behind = direct(text, i, i + q, limit), direct(text, i - 1, i + q - 1, back, -1)
    open_ahead, open_behind = ahead == limit, behind == back
    # A pair can still lie in a run if a side is open or both sides suffice.
    stays = open_ahead | open_behind | (ahead + behind + q >= np.maximum(LEAST, TIMES * q))
    doc, i, q, ahead, behind, limit, back, open_ahead, open_behind = (x[stays] for x in (doc, i, q, ahead, behind, limit, back, open_ahead, open_behind))
    asked = np.unique(doc[open_ahead | open_behind])
    if len(asked):
        # Tables for the documents with an open pair; places keep their class modulo MODULUS.
        length = counts[asked] + 2
        room = -(-length // MODULUS) * MODULUS + MODULUS
        for way, open_, got, due in ((1, open_ahead, ahead, limit), (-1, open_behind, behind, back)):
            x = np.flatnonzero(open_)
            if not len(x):
                continue
            start = signs[asked] if way == 1 else last - signs[asked + 1]
            shift = start % MODULUS
            base = np.cumsum(room) - room + shift
            part = -1 - len(first) - np.arange(int(room.sum()))  # signs, all different, where no document lies
            spot = np.repeat(base, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            source = np.repeat(start, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            part[spot] = text[source] if way == 1 else text[last - source]
            table = Extensions(part)
            d = np.searchsorted(asked, doc[x])
            a, b = (i[x], i[x] + q[x]) if way == 1 else (last - i[x] + 1, last - i[x] - q[x] + 1)
            got[x] = due[x] + table.synchronised(a + due[x] - start[d] + base[d], b + due[x] - start[d] + base[d])
    length = ahead + behind + q
    good = np.flatnonzero(length >= np.maximum(LEAST, TIMES * q))
    doc, start, length, q = doc[good], (i - behind - begin[doc])[good], length[good], q[good]
    # A multiple of the period ends at the same words: the smallest stays.
    order = np.lexsort((q, length, start, doc))
    doc, start, length, q = doc[order], start[order], length[order], q[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, q = doc[new], start[new], length[new], q[new]
    order = np.lexsort((q, start, doc))
    return doc[order], start[order], length[order], q[order]


def _identified(w) -> np.ndarray:
    """The same number for equal words."""
    sizes = w.ends - w.starts
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    packed = np.ascontiguousarray(w.data[np.cumsum(inside[:-1], dtype=np.int8) > 0])
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return array.dictionary_encode().indices.to_numpy().astype(np.int64)


def _joined(w, which: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The words ``which`` of each document with one space between them."""
    made: list[list[bytes]] = [[] for _ in range(len(first) - 1)]
    for at in range(0, len(which), JOINED):
        part = which[at: at + JOINED]
        sizes = w.ends[part] - w.starts[part] + 1
        ends = np.cumsum(sizes)
        out = np.full(int(ends[-1]), 0x20, np.uint8)
        place = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
        inside = place < np.repeat(sizes - 1, sizes)
        out[inside] = w.data[(np.repeat(w.starts[part], sizes) + place)[inside]]
        d = int(np.searchsorted(first, at, "right")) - 1
        while d < len(first) - 1 and first[d] < at + len(part):
            lo, hi = max(first[d], at) - at, min(first[d + 1], at + len(part)) - at
            if hi > lo:
                made[d].append(out[ends[lo] - sizes[lo]: ends[hi - 1]].tobytes())
            d += 1
    return [b"".join(m)[:-1] for m in made]


def _find(rewrite: Callable[[int, int], np.ndarray | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = words(batch.column("text"), SPACES, False)
            ids, counts = _identified(w), np.diff(w.first)
            source = None
            if rewrite is not None:
                source = np.arange(len(ids))
                for d, doc in enumerate(batch.column("doc_id").to_pylist()):
                    if doc is not None and counts[d] and (places := rewrite(doc, int(counts[d]))) is not None:
                        source[w.first[d]: w.first[d + 1]] = w.first[d] + places
                ids = ids[source]
            doc, start, length, period = runs(ids, w.first)
            gone = np.zeros(len(ids) + 1, np.int64)
            np.add.at(gone, w.first[doc] + start + period, 1)
            np.add.at(gone, w.first[doc] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            texts = _joined(w, source[kept] if source is not None else kept, np.searchsorted(kept, w.first))
            offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            found = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(offsets, found), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def find(docs: DataFrame, rewrite: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs``.

    ``runs`` lists ``(start, length, period)`` by start, then period: maximal stretches of smallest period ``q``
    and at least ``max(6, 4 * q)`` words. ``collapsed`` keeps of each run its first period only; what is left is
    joined by one space. ``rewrite(doc_id, n)`` may give for each of the ``n`` words the place of the word that
    stands for it, or None.

    Null and wordless texts have no word and no run. Every row is a document of its own, so repeated rows and
    ids give a row each; a null id is never rewritten. A text beyond a chunk of two megabytes is read alone, with
    some ten bytes of arrays for each of its bytes and a hundred for each of its words. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(rewrite), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc: int, n: int) -> np.ndarray | None:
    """In a tenth of all documents the words from one on repeat with one period."""
    h = zlib.crc32(str(doc).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % p
    return places


def report(docs: DataFrame) -> DataFrame:
    """Digest of ``find`` over the documents with ``planted`` repeats: the number of runs, the longest one (ties:
    smallest start, then period), and hashes of all runs and of the collapsed text."""
    found = find(docs, planted)
    # Fields in the order of the wanted minimum.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.expr("1000L * (-best.less) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
