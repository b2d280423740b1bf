"""Suffix-array dedup: every byte inside a ``SPAN``-byte string that starts at two places or more is removed.

Suffixes need sorting only where repeats are possible and not already certain:

* *Anchors.* The smallest hash of ``W`` neighbouring ``K``-byte strings marks an anchor, so each span has
  an anchor within its first ``W`` bytes and equal spans have it at the same place. An anchor's *class* is
  the hash of the ``SPAN - W + 1`` bytes from it, its *surroundings* are all bytes of all spans that can
  have it. Both are counted over all documents, packed by the thousand.
* Equal surroundings make all spans of an anchor repeats. A class of one kind of surroundings holds no
  other repeats. What is left, classes of several surroundings, lies near the ends of shared passages; its
  spans are sorted, those of equal surroundings once for a chunk of documents.
* *Deep-shallow sorting.* Spans of one class meet in a task. A multikey quicksort on eight-byte characters
  splits them to ``SHALLOW`` bytes; the groups left share long prefixes and are ordered by blind tries,
  which compare each new suffix with one leaf only. Neighbours in that order that share ``SPAN`` bytes are
  repeats.
* A class of more than ``CROWD`` such anchors (a passage that very many documents hold in different
  surroundings) is not gathered: its spans are counted by the hash of the whole span instead, which spreads
  them. That is exact for any number of members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import BYTE_CODES, U64, chunks, fan_out, flat, keyed, mix, rolling, settle
from tidemeter.llm.packed import NULL_ID, by_bucket, deltas, planes, undeltas, unplanes

SPAN, K, W = 400, 16, 64
CLASS = SPAN - W + 1
SHALLOW, CROWD = 24, 4096
#: Bytes of text in arrays at once: a byte takes about a hundred bytes of arrays here.
CHUNK = 1 << 20
#: Bits of the filter of documents: 8 MB, a fixed bound.
BITS = 1 << 26

_PACKED = "bucket int, hashes binary, places binary, ids binary, keys binary, firsts binary, flags binary, extra binary"
_NAMES = ["bucket", "hashes", "places", "ids", "keys", "firsts", "flags", "extra"]


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of ``n`` neighbours, by doubling."""
    done, out = 1, x
    while done < n:
        step = min(done, n - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors with a whole class inside their text, and the text of each."""
    if len(data) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = BYTE_CODES[data]
    places = np.arange(len(data) - K + 1)
    h = rolling(codes, places, places + K)
    # Only windows of W strings that stay inside one text count.
    low = _least(h, W)
    begin = np.arange(len(low))
    inside = begin + SPAN <= at[np.searchsorted(at, begin, "right")]
    low = np.where(inside, low, U64(0))  # no string but one of hash 0 equals it
    # A string is an anchor if it is the minimum of a window that holds it: the largest of these minima.
    padded = ~np.concatenate((np.zeros(W - 1, U64), low, np.zeros(W - 1, U64)))
    top = ~_least(padded, W)
    found = np.flatnonzero((h == top) & (top != 0))
    text = np.searchsorted(at, found, "right") - 1
    whole = found + CLASS <= at[text + 1]
    return found[whole], text[whole]


class _Anchors:
    """The anchors of a chunk and what decides about them."""

    def __init__(self, texts: pa.Array):
        self.data, self.at = flat(texts)
        self.p, self.text = anchors(self.data, self.at)
        lo, end = self.at[self.text], self.at[self.text + 1]
        self.left = np.minimum(self.p - lo, W - 1)
        self.right = np.minimum(end - self.p, SPAN)
        codes = BYTE_CODES[self.data]
        self.cls = rolling(codes, self.p, self.p + CLASS)
        around = rolling(codes, self.p - self.left, self.p + self.right)
        # Texts that end sooner give other surroundings.
        self.around = mix(around + mix((self.left * 1024 + self.right).astype(U64)))

    def spans(self, i) -> tuple[np.ndarray, np.ndarray]:
        """First and last start, in the chunk, of the spans that anchors ``i`` stand for."""
        return self.p[i] - self.left[i], np.minimum(self.p[i], self.p[i] + self.right[i] - SPAN)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=_NAMES)


def _shards(ids: np.ndarray, keys: np.ndarray, places: np.ndarray, flags: np.ndarray, shards: int, base: int) -> list[tuple]:
    home = (mix(ids.view(U64) ^ (keys.astype(U64) << U64(32))) % U64(shards)).astype(np.int64)
    return [(base + b, b"", planes(places[i].astype(np.uint32)), planes(ids[i]), planes(keys[i]), b"", flags[i].astype(np.uint8).tobytes(), b"")
            for b, i in by_bucket(home, shards)]


def _sorted_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Null ids by their stand-in."""
    return batch.set_column(0, "doc_id", batch.column("doc_id").fill_null(int(NULL_ID)))


#: Flags of an anchor: its class has other surroundings too; its surroundings occur elsewhere.
_CLASS, _AROUND = 1, 2


def _scan(buckets: int):
    """Class and surroundings of every anchor, each sent once for a chunk; what shows inside the chunk is
    told to its documents at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK):
            batch = _sorted_batch(batch)
            a = _Anchors(batch.column("text"))
            if not len(a.p):
                continue
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy().view(U64).astype(np.uint32)
            inside = a.p - a.at[a.text]
            table = (deltas(ids), planes(keys), deltas(a.at[:-1].astype(np.uint32)))

            def tell(who: np.ndarray, flag: int):
                return _shards(ids[a.text[who]], keys[a.text[who]], inside[who], np.full(len(who), flag), buckets, buckets)

            def send(who: np.ndarray, h: np.ndarray, kind: int, extra: np.ndarray | None):
                return [(b, planes(h[who[i]]), deltas(a.p[who[i]].astype(np.uint32)), *table, bytes([kind]), b"" if extra is None else planes(extra[i]))
                        for b, i in by_bucket((mix(h[who] ^ U64(kind)) % U64(buckets)).astype(np.int64), buckets)]

            order = np.lexsort((a.p, a.around, a.cls))
            cls, around = a.cls[order], a.around[order]
            new_class = np.concatenate(([True], cls[1:] != cls[:-1]))
            new_around = new_class | np.concatenate(([True], around[1:] != around[:-1]))
            kinds = np.flatnonzero(new_around)
            size = np.diff(np.append(kinds, len(order)))
            yield _rows(tell(order[np.repeat(size, size) > 1], _AROUND))
            # One place for each kind of surroundings; a class with several tells them all.
            first_kind = np.flatnonzero(new_class[kinds])
            several = np.diff(np.append(first_kind, len(kinds)))
            yield _rows(tell(order[kinds[np.repeat(several, several) > 1]], _CLASS))
            lead = order[kinds[first_kind]]
            extra = np.where(several > 1, 0, a.around[lead] | U64(1)).astype(np.uint32)
            by_place = np.argsort(lead)
            yield _rows(send(lead[by_place], a.cls, _CLASS, extra[by_place]))
            yield _rows(send(np.sort(order[kinds]), a.around, _AROUND, None))
    return run


def _count(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            return table.select(_NAMES)
        out = []
        for kind in (_CLASS, _AROUND):
            parts = []
            for r in table.filter(pc.equal(table.column("flags"), pa.scalar(bytes([kind]), pa.binary()))).to_pylist():
                place, first = undeltas(r["places"], np.uint32), undeltas(r["firsts"], np.uint32)
                doc = np.searchsorted(first, place, "right") - 1
                parts.append((unplanes(r["hashes"], U64), undeltas(r["ids"], np.int64)[doc], unplanes(r["keys"], np.uint32)[doc], place - first[doc],
                              unplanes(r["extra"], np.uint32) if kind == _CLASS else np.zeros(len(place), np.uint32)))
            if not parts:
                continue
            h, ids, keys, places, extra = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h)
            start = np.flatnonzero(np.concatenate(([True], h[order[1:]] != h[order[:-1]])))
            size = np.diff(np.append(start, len(h)))
            told = size > 1
            if kind == _CLASS:  # of several chunks, one that has several surroundings or two that differ
                low, high = np.minimum.reduceat(extra[order], start), np.maximum.reduceat(extra[order], start)
                told &= (low == 0) | (low != high)
            again = order[np.repeat(told, size)]
            out += _shards(ids[again], keys[again], places[again], np.full(len(again), kind), buckets, buckets)
        return pa.Table.from_batches([_rows(out)])
    return run


def _collect(table: pa.Table) -> pa.Table:
    """For each document the anchors with flags: ``known`` packs places and flags."""
    rows = table.to_pylist()
    ids, keys, places = (np.concatenate([unplanes(r[c], t) for r in rows]) for c, t in (("ids", np.int64), ("keys", np.uint32), ("places", np.uint32)))
    flags = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in rows])
    order = np.lexsort((places, keys, ids))
    ids, keys, places, flags = ids[order], keys[order], places[order], flags[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])))
    at = np.flatnonzero(new)
    flags, ids, keys, places = np.bitwise_or.reduceat(flags, at), ids[at], keys[at], places[at]
    doc = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
    known = [places[i:j].tobytes() + flags[i:j].tobytes() for i, j in zip(doc, np.append(doc[1:], len(ids)), strict=True)]
    return pa.table({"gone_id": ids[doc], "gone_key": keys[doc].astype(np.int64), "known": pa.array(known, pa.binary())})


def merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Maximal runs ``(lo, hi)`` of a union of intervals; touching ones are one run."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    cut = np.flatnonzero(lo[1:] > hi[:-1])
    return np.stack((lo[np.concatenate(([0], cut + 1))], hi[np.concatenate((cut, [len(hi) - 1]))]), 1) if len(lo) else np.zeros((0, 2), np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Certain removals of each document, and the undecided anchors with the bytes of their spans."""
    for batch in chunks(batches, CHUNK):
        a = _Anchors(batch.column("text"))
        ids, keys, known = (batch.column(c).to_pylist() for c in ("gone_id", "gone_key", "known"))
        out: list[tuple] = []
        bound = np.searchsorted(a.text, np.arange(batch.num_rows + 1))
        for d in range(batch.num_rows):
            n = len(known[d]) // 5
            flags = np.frombuffer(known[d], np.uint8, offset=4 * n)
            places = np.frombuffer(known[d], np.uint32, n).astype(np.int64) + a.at[d]
            mine = bound[d] + np.searchsorted(a.p[bound[d]: bound[d + 1]], places)
            lo, hi = a.spans(mine)
            sure = (flags & _AROUND > 0) & (hi >= lo)
            cover = merged(lo[sure] - a.at[d], hi[sure] + SPAN - a.at[d])
            out.append((ids[d], keys[d], None, None, None, cover.astype(np.int32).tobytes()))
            open_ = (flags & _CLASS > 0) & (hi >= lo)
            for i, first, last in zip(mine[open_].tolist(), lo[open_].tolist(), hi[open_].tolist(), strict=True):
                out.append((ids[d], keys[d], int(a.cls[i: i + 1].view(np.int64)[0]), first - int(a.at[d]), last - first + 1, a.data[first: last + SPAN].tobytes()))
        cols = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())],
            names=["gone_id", "gone_key", "cls", "start", "many", "bytes"])


class _Trie:
    """A blind (Patricia) trie: inner nodes know their depth and one branch byte for each child."""

    def __init__(self, text: bytes):
        self.text, self.root = text, None

    def insert(self, place: int) -> None:
        s = self.text[place: place + SPAN]
        if self.root is None:
            self.root = [SPAN, [place]]
            return
        node = self.root
        while node[0] < SPAN:  # blindly to a leaf
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = self.text[node[1][0]: node[1][0] + SPAN]
        if s == other:
            node[1].append(place)
            return
        differ = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = SPAN - (differ.bit_length() + 7) // 8
        node, parent, branch = self.root, None, 0
        while node[0] < depth:
            parent, branch = node, s[node[0]]
            node = node[1].get(branch)
            if node is None:
                parent[1][branch] = [SPAN, [place]]
                return
        if node[0] == depth:
            node[1][s[depth]] = [SPAN, [place]]
            return
        new = [depth, {other[depth]: node, s[depth]: [SPAN, [place]]}]
        if parent is None:
            self.root = new
        else:
            parent[1][branch] = new

    def leaves(self) -> Iterator[list[int]]:
        """Places of equal suffixes, suffixes ascending."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == SPAN:
                yield node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def deep_shallow(text: bytes, starts: np.ndarray) -> Iterator[list[int]]:
    """Places of suffixes, cut after ``SPAN`` bytes, in order; equal ones together. ``text`` holds all of them whole."""
    data = np.frombuffer(text, np.uint8)
    group, order = np.zeros(len(starts), np.int64), np.arange(len(starts))
    for depth in range(0, SHALLOW, 8):
        # One character of eight bytes; every open group splits at once.
        char = np.ascontiguousarray(data[starts[order][:, None] + depth + np.arange(8)]).view(">u8").ravel().astype(U64)
        sort = np.lexsort((char, group))
        order, group, char = order[sort], group[sort], char[sort]
        group = np.cumsum(np.concatenate(([False], (group[1:] != group[:-1]) | (char[1:] != char[:-1]))))
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    places = starts[order].tolist()
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(places)], strict=True):
        if hi - lo == 1:
            yield [places[lo]]
        elif hi - lo == 2:
            a, b = places[lo: hi]
            yield from [[a, b]] if text[a: a + SPAN] == text[b: b + SPAN] else ([x] for x in sorted((a, b), key=lambda x: text[x: x + SPAN]))
        else:
            trie = _Trie(text)
            for p in places[lo:hi]:
                trie.insert(p)
            yield from trie.leaves()


def _sort(table: pa.Table) -> pa.Table:
    ids, keys, begins, many, pieces = (table.column(c).to_pylist() for c in ("gone_id", "gone_key", "start", "many", "bytes"))
    text = b"".join(pieces)
    many = np.array(many, np.int64)
    base = np.cumsum([0, *map(len, pieces)][:-1])
    owner = np.repeat(np.arange(len(many)), many)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    doc = np.unique(np.array([ids, keys], np.int64), axis=1, return_inverse=True)[1].ravel()
    begins = np.array(begins, np.int64)
    equal = [e for e in deep_shallow(text, base[owner] + offset) if len(e) > 1]
    again = np.array([p for e in equal for p in e], np.int64)
    owner = np.searchsorted(base, again, "right") - 1
    inside = again - base[owner] + begins[owner]
    if len(again):
        # Neighbouring anchors share spans: only different places make a repeat.
        place, first = (doc[owner] << 32) + inside, np.cumsum([0, *map(len, equal)][:-1])
        several = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
        several = np.repeat(several, [len(e) for e in equal])
        order = np.lexsort((inside[several], owner[several]))
        owner, inside = owner[several][order], inside[several][order]
    cut = np.flatnonzero(np.diff(owner)) + 1
    rows = [(ids[o[0]], keys[o[0]], merged(s, s + SPAN).astype(np.int32).tobytes()) for o, s in zip(np.split(owner, cut), np.split(inside, cut), strict=True) if len(o)]
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.table({"gone_id": pa.array(cols[0], pa.int64()), "gone_key": pa.array(cols[1], pa.int64()), "gone": pa.array(cols[2], pa.binary())})


def _span_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        pieces, many = batch.column("bytes").to_pylist(), batch.column("many").to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        base = np.cumsum([0, *map(len, pieces)][:-1])
        owner = np.repeat(np.arange(len(many)), many)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        h = rolling(BYTE_CODES[data], base[owner] + offset, base[owner] + offset + SPAN)
        yield pa.RecordBatch.from_arrays(
            [batch.column("gone_id").take(pa.array(owner)), batch.column("gone_key").take(pa.array(owner)), pa.array(batch.column("start").to_numpy()[owner] + offset), pa.array(h.view(np.int64))],
            names=["gone_id", "gone_key", "start", "h"])


def _union(key: tuple, table: pa.Table) -> pa.Table:
    cut = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("gone").to_pylist()]).reshape(-1, 2)
    return pa.table({"gone_id": table.column("gone_id")[:1], "gone_key": table.column("gone_key")[:1], "gone": pa.array([merged(cut[:, 0], cut[:, 1]).astype(np.int32).tobytes()], pa.binary())})


def _ident():
    return F.coalesce("doc_id", F.lit(int(NULL_ID))), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))


def _filter(spark, rows: DataFrame):
    """A function that tells whether a document may be among ``rows``: a bitmap of fixed size, broadcast."""
    bits = np.zeros(BITS // 8, np.uint8)
    p = rows.select((F.xxhash64("gone_id", "gone_key").bitwiseAND(F.lit(BITS - 1)) + 1).alias("p"))
    for b, block in p.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p"))).toLocalIterator():
        bits[(b - 1) * 4096: b * 4096] = np.frombuffer(bytes(block), np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes())


def _split(shared, inside: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            low = batch.column("h").to_numpy() & (BITS - 1)
            yield batch.filter(pa.array(((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1) == inside))
    return run


def _among(docs: DataFrame, shared, inside: bool) -> DataFrame:
    ident, low = _ident()
    marked = docs.withColumn("h", F.xxhash64(ident, low))
    return marked.mapInArrow(_split(shared, inside), marked.schema).drop("h")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, CHUNK):
        out: list[list] = [[], [], [], [], []]
        gone = batch.column("gone").to_pylist()
        for text, cut in zip(batch.column("text").to_pylist(), gone, strict=True):
            raw = (text or "").encode()
            runs = np.frombuffer(cut or b"", np.int32).reshape(-1, 2).tolist()
            parts, at = [], 0
            for lo, hi in runs:
                parts.append(raw[at:lo])
                at = hi
            kept = b"".join([*parts, raw[at:]])
            for o, x in zip(out, (kept, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()), strict=True):
                o.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out[0], pa.binary()), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array(out[4])],
            names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated(docs: DataFrame) -> tuple[DataFrame, object]:
    """``(gone_id, gone_key, gone)``: packed maximal byte runs to remove, and a filter of the documents that may have some."""
    spark = docs.sparkSession
    buckets = fan_out(docs, 8)
    told = docs.mapInArrow(_scan(buckets), _PACKED).groupBy("bucket").applyInArrow(_count(buckets), _PACKED)
    known = settle(told.groupBy("bucket").applyInArrow(_collect, "gone_id long, gone_key long, known binary"), "known")
    shared = _filter(spark, known)
    ident, low = _ident()
    several = _among(docs, shared, True).join(known, (ident == F.col("gone_id")) & (low == F.col("gone_key")))
    found = several.mapInArrow(_segments, "gone_id long, gone_key long, cls long, start long, many int, bytes binary")
    found = settle(found, "segments")
    sure = found.where("cls is null").select("gone_id", "gone_key", F.col("bytes").alias("gone"))
    open_ = found.where("cls is not null")
    crowded = open_.groupBy("cls").count().where(F.col("count") > CROWD).select("cls")
    crowd = open_.join(crowded, "cls", "left_semi").select("gone_id", "gone_key", "start", "many", "bytes")
    spans = crowd.mapInArrow(_span_hashes, "gone_id long, gone_key long, start long, h long").distinct()
    twice = spans.groupBy("h").count().where("count > 1").select("h")
    counted = spans.join(twice, "h", "left_semi").select("gone_id", "gone_key", F.col("start").cast("int").alias("lo"))
    counted = counted.mapInArrow(_single, "gone_id long, gone_key long, gone binary")
    sets = open_.join(crowded, "cls", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("cls"), F.lit(buckets * 4)))
    ordered = sets.groupBy("bucket").applyInArrow(_sort, "gone_id long, gone_key long, gone binary")
    every = sure.union(ordered).union(counted).where(F.length("gone") > 0)
    return every.groupBy("gone_id", "gone_key").applyInArrow(_union, "gone_id long, gone_key long, gone binary"), shared


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lo = batch.column("lo").to_numpy()
        cuts = np.stack((lo, lo + SPAN), 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("gone_id"), batch.column("gone_key"), pa.array([c.tobytes() for c in cuts], pa.binary())], names=["gone_id", "gone_key", "gone"])


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, kept`` (bytes), ``n_bytes, n_removed, n_spans, kept_sha256`` for each row.

    Null texts are empty. Spans are judged on the input and never cross documents; rows repeated exactly are
    copies, and rows that share an id with other text are documents of their own. Other columns are not read.
    """
    docs = keyed(docs)
    gone, shared = repeated(docs)
    ident, low = _ident()
    some = _among(docs, shared, True).join(gone, (ident == F.col("gone_id")) & (low == F.col("gone_key")), "left").select("doc_id", "text", "gone")
    rest = _among(docs, shared, False).select("doc_id", "text", F.lit(None).cast("binary").alias("gone"))
    return some.union(rest).mapInArrow(_keep, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
