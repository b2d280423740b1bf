"""Best-fit packing after Martello-Toth dominance reduction.

All pieces of one length are alike, so the plan is made on the number of pieces of each length, at most
``CAPACITY`` counts whatever the data: first every set of at most three lengths that provably dominates all
others holding its largest is fixed, again and again; then the rest goes best-fit decreasing. A plan line
says how many sequences hold the same pattern. Pieces find their line by their rank within their length,
counted in salted shards so that a length which a third of all documents share is no hot group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.llm.common import chunks, keyed, settle
from tidemeter.llm.tokenizing import encode

CAPACITY = 2048
#: Shards in which the pieces of one length are ranked.
SALTS = 64
PIECE = "doc_id long, key long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, at = encode(batch.column("text"), path)
            out: list[list] = [[] for _ in range(6)]
            for d in range(batch.num_rows):
                own = np.append(ids[at[d]: at[d + 1]], 0).astype("<u4")
                for p, lo in enumerate(range(0, len(own), capacity)):
                    part = own[lo: lo + capacity].tobytes()
                    for o, x in zip(out, (d, p, lo, len(part) // 4, zlib.crc32(part), part), strict=True):
                        o.append(x)
            doc = pa.array(out[0], pa.int64())
            cols = [batch.column("doc_id").take(doc), batch.column("key").take(doc), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
            names = ["doc_id", "key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(out[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document's ids and a closing 0, cut only if longer than ``capacity``. Null texts are empty."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return keyed(docs).mapInArrow(_cut(path, capacity, with_ids), PIECE + (", ids binary" if with_ids else ""))


class _Sizes:
    """Counts by size, and the sizes that still have some, ascending."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c}
        self.sizes = sorted(self.n)

    def below(self, most: int) -> int:
        """The largest size of at most ``most``, or 0."""
        i = bisect_left(self.sizes, most + 1)
        return self.sizes[i - 1] if i else 0

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.sizes.remove(size)

    def smallest(self, count: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes[:count]:
            out += [s] * min(self.n[s], count)
        return out[:count]


def _room(left: _Sizes, used: list[int], room: int) -> int:
    """The largest size of at most ``room`` of which a piece is left besides those in ``used``."""
    s = left.below(room)
    while s and left.n[s] <= used.count(s):
        s = left.below(s - 1)
    return s


def dominating(left: _Sizes, s: int, capacity: int) -> list[int] | None:
    """A set with ``s``, the largest piece, that can replace any other set holding ``s`` without another
    sequence, or None if no set of up to three shows it."""
    room = capacity - s
    k = _room(left, [s], room)
    if not k:
        return [s]
    left.n[s] -= 1  # what else there is
    few = [x for x in left.smallest(4) if left.n.get(x)]
    left.n[s] += 1
    if k == room or len(few) < 2 or few[0] + few[1] > room:
        return [s, k]
    if len(few) > 2 and sum(few[:3]) <= room:
        return None
    # At most two pieces fit beside s: (k, b) dominates if no pair has a smaller half above b.
    b = _room(left, [s, k], room - k)
    return [s, k, b] if b and b >= left.below(room // 2) else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(number of sequences, {size: pieces in each})`` lines that use up all counts."""
    left = _Sizes(counts)
    lines: list[tuple[int, dict[int, int]]] = []
    changed = True
    while changed:
        changed = False
        for s in reversed(left.sizes.copy()):
            while left.n.get(s) and (found := dominating(left, s, capacity)):
                pattern = {x: found.count(x) for x in found}
                many = min(left.n[x] // c for x, c in pattern.items())
                for x, c in pattern.items():
                    left.take(x, many * c)
                lines.append((many, pattern))
                changed = True
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []

    def put(many: int, pattern: dict[int, int], room: int) -> None:
        if room not in open_:
            rooms.insert(bisect_left(rooms, room), room)
            open_[room] = []
        open_[room].append((many, pattern))

    for s in reversed(left.sizes):
        n = left.n[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                many, pattern, room = n, {}, capacity
            else:
                room = rooms[i]
                many, pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            each = min(room // s, n)
            full = min(many, n // each)
            n -= full * each
            put(full, pattern | {s: each}, room - each * s)
            if many > full and pattern:
                put(many - full, pattern, room)
    return lines + [line for group in open_.values() for line in group]


def slots(lines: list[tuple[int, dict[int, int]]]) -> tuple[dict[int, np.ndarray], int]:
    """By size, rows ``(first rank, first sequence, pieces in each sequence, offset of the first)``."""
    found: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for many, pattern in lines:
        offset = 0
        for s, c in pattern.items():
            found.setdefault(s, []).append((ranks.get(s, 0), sequence, c, offset))
            ranks[s] = ranks.get(s, 0) + many * c
            offset += s * c
        sequence += many
    return {s: np.array(x, np.int64) for s, x in found.items()}, sequence


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = shared.value
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "salt", "rank"))
            rank = rank - 1 + base[length, salt]
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                at = np.flatnonzero(length == s)
                rows = table[s][np.searchsorted(table[s][:, 0], rank[at], "right") - 1]
                beside = rank[at] - rows[:, 0]
                sequence[at] = rows[:, 1] + beside // rows[:, 2]
                offset[at] = rows[:, 3] + beside % rows[:, 2] * s
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c not in ("salt", "rank")), pa.array(sequence), pa.array(offset)],
                names=[*(c for c in batch.schema.names if c not in ("salt", "rank")), "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``; see ``pieces``.

    Rows repeated exactly are packed as often as they occur. Ties between pieces of one length go by
    (document id, text hash, piece). An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, path, capacity, with_ids), "pieces")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(SALTS)).cast("int"))
    # At most capacity * SALTS rows, whatever the data.
    base = np.zeros((capacity + 1, SALTS), np.int64)
    for length, salt, n in salted.groupBy("length", "salt").count().toLocalIterator():
        base[length, salt] = n
    table, _ = slots(plan({s: int(n) for s, n in enumerate(base.sum(1)) if n}, capacity))
    shared = spark.sparkContext.broadcast((np.cumsum(base, 1) - base, table))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "key", "piece")))
    schema = PIECE + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(shared), schema)


def report(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
