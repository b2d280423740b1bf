"""N-gram Jaccard join by prefixes.

A document is the set of its hashed ``n``-word shingles, in an order that puts frequent shingles last.
Two sets of Jaccard ``percent`` or more share a shingle in their prefixes, the first
``n - ceil(percent n / 100) + 1``. Documents of equal sets are one node, and nodes are posted under the shingles
of their prefixes. A posting stays where another node of its list is left by the filters of size and of position;
pairs pass the same filters, and nodes are verified on whole sets.

Only components are asked for, so a pair whose nodes are known to be connected needs no check. Rounds of
neighbours check a few neighbours of each node in posting lists, which joins the large groups of near copies; they
go on while lists would still make many pairs and links are found. The last round checks every pair that passes the
filters and still lies in two components; nodes of one component make no
pairs. Long lists are salted among neighbours. In all, parity sketches
(a set's shingles folded to ``SKETCH`` bits) rule out pairs before any set is fetched: they bound what two sets do not share.

Frequencies are counted over all documents in a table of fixed size, by hash; the order may be any without a change
of results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.llm.common import SPACES, U64, Words, chunks, fan_out, keyed, mix, rolling, settle, windows, word_hashes, words
from tidemeter.llm.components import components
from tidemeter.llm.packed import NULL_ID, by_bucket, planes, unplanes

#: Of the query and its SQL twin.
N, PERCENT = 4, 85
#: Places in which shingles are counted: 16 MB at one byte each, a fixed bound.
BITS_COUNTED, BLOCK = 24, 4096
COUNTERS = 1 << BITS_COUNTED
#: Neighbours that a node is compared with in a round, and the length of a salted list.
NEAR, LIST = 4, 256
#: Pairs of two components and one band that a posting may have, on average, before the last round; if it is more, another
#: round of neighbours comes first, ``ROUNDS`` at most. It looks at ``BESIDE`` postings on a side and takes the nearest sketches.
PAIRS, ROUNDS, BESIDE = 32, 3, 8
#: Offsets at which the postings of a list, by size, are compared; longer lists are kept whole.
OFFSETS = 64
#: Bytes of a shingle's hash in a posting: with the bucket some 50 bits. Shingles taken for equal only add candidates.
SHORT = 5
#: Bits of a node's parity sketch.
SKETCH = 512
_SKETCH = [f"s{i}" for i in range(SKETCH // 64)]
#: Bits of the filter that picks documents whose sets are needed: 8 MB, a fixed bound.
BITS = 1 << 26


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(document, hash)``, sorted; a text of fewer than ``n`` words is one shingle."""
    codes = word_hashes(w)
    at = windows(w.first, n)
    h, doc = rolling(codes, at, at + n), np.searchsorted(w.first, at, "right") - 1
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < n))
    h = np.concatenate((h, rolling(codes, w.first[short], w.first[short + 1])))
    doc = np.concatenate((doc, short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _counted(n: int):
    """Counts of a task's shingles in ``COUNTERS`` places by hash, as rows of ``BLOCK`` places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.uint16)
        for batch in chunks(batches):
            _, h = shingles(words(batch.column("text"), SPACES, True), n)
            place, count = np.unique(h >> U64(64 - BITS_COUNTED), return_counts=True)
            table[place] = np.minimum(table[place].astype(np.int64) + count, 65535)
        for lo in range(0, COUNTERS // BLOCK, 256):
            rows = table.reshape(-1, BLOCK)[lo: lo + 256]
            some = np.flatnonzero(rows.any(1))
            if len(some):
                packed = [pa.compress(planes(rows[i]), "zstd", asbytes=True) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array((lo + some).astype(np.int32)), pa.array(packed, pa.binary())], names=["block", "counts"])
    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of a partition, each on a logarithmic scale of one byte."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            held.setdefault(block, np.zeros(BLOCK, np.int64))
            held[block] += unplanes(pa.decompress(counts.as_buffer(), 2 * BLOCK, "zstd"), np.uint16)
    blocks = sorted(held)
    yield pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int32()), pa.array([np.minimum(6 * np.log2(1 + held[b]), 255).astype(np.uint8).tobytes() for b in blocks], pa.binary())], names=["block", "levels"])


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """For each of ``COUNTERS`` places by hash, how often its shingles occur in all documents, on a logarithmic scale.

    Shingles that share a place are taken together. It only orders shingles, and every order is right; a frequent
    shingle has a full place in any company. ``COUNTERS`` bytes reach the driver and the executors.
    """
    tasks = docs.mapInArrow(_counted(n), "block int, counts binary")
    made = tasks.repartition("block").mapInArrow(_levels, "block int, levels binary")
    out = np.zeros(COUNTERS, np.uint8)
    for block, levels in made.toLocalIterator():
        out[block * BLOCK: (block + 1) * BLOCK] = np.frombuffer(bytes(levels), np.uint8)
    return out


class _Sets:
    """The sets of a chunk: shingles by document, frequent ones last, with sizes and node names."""

    def __init__(self, texts: pa.Array, n: int, percent: int, levels: np.ndarray):
        doc, h = shingles(words(texts, SPACES, True), n)
        order = np.lexsort((levels[h >> U64(64 - BITS_COUNTED)], doc))
        self.h, self.first = h[order], np.searchsorted(doc, np.arange(len(texts) + 1))
        self.n = np.diff(self.first)
        total = np.concatenate(([0], np.cumsum(mix(self.h ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=U64))).astype(U64)
        self.node = mix((total[self.first[1:]] - total[self.first[:-1]]) + self.n.astype(U64))
        self.prefix = np.where(self.n > 0, self.n - (percent * self.n + 99) // 100 + 1, 0)

    def sketches(self) -> pa.Array:
        """``SKETCH`` bits for each document, a bit for whether an odd number of its shingles fall on it."""
        doc = np.repeat(np.arange(len(self.n)), self.n)
        key, count = np.unique(doc * SKETCH + (self.h & U64(SKETCH - 1)).astype(np.int64), return_counts=True)
        key = key[count % 2 == 1]
        out = np.zeros((len(self.n), SKETCH // 64), U64)
        np.bitwise_or.at(out, (key // SKETCH, key % SKETCH // 64), U64(1) << (key % 64).astype(U64))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(out[:, i]).view(np.int64)) for i in range(SKETCH // 64)], names=_SKETCH)

    def of(self, i: int, prefix: bool = False) -> np.ndarray:
        return self.h[self.first[i]: self.first[i] + self.prefix[i] if prefix else self.first[i + 1]]


def _profiles(n: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            s = _Sets(batch.column("text"), n, percent, shared.value)
            prefixes = [planes(s.of(i, True)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(s.n.astype(np.int64)), pa.array(s.node.view(np.int64), mask=s.n == 0),
                 pa.array(prefixes, pa.binary()), s.sketches()],
                names=["doc_id", "key", "n", "node", "prefix", "sketch"])
    return run


def _spread(buckets: int):
    """Postings by bucket; a task posts a node once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            names, first = np.unique(batch.column("node").to_numpy(), return_index=True)
            batch = batch.take(pa.array(np.sort(first[~np.isin(names, seen)])))
            seen = np.union1d(seen, names)
            if not batch.num_rows:
                continue
            rows = [unplanes(x, U64) for x in batch.column("prefix").to_pylist()]
            sizes = np.array([len(r) for r in rows])
            h = mix(np.concatenate(rows))
            node, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "n"))
            pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            short = h >> U64(64 - 8 * SHORT)
            out = [(b, planes(short[at])[: SHORT * len(at)], planes(node[at]), planes(n[at].astype(np.uint32)), planes(pos[at].astype(np.uint32)))
                   for b, at in by_bucket((h % U64(buckets)).astype(np.int64), buckets)]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "h", "node", "n", "pos"])
    return run


def _partners(h: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Postings, sorted by shingle and size, with another one in their list that ``_fits``; lists of more than ``OFFSETS`` stay whole."""
    found = np.zeros(len(h), bool)
    at = np.arange(len(h))
    for d in range(1, OFFSETS + 1):
        at = at[at + d < len(h)]
        at = at[h[at] == h[at + d]]
        if not len(at):
            return found
        x, y = at, at + d
        fits = (100 * n[x] >= percent * n[y]) & ((100 + percent) * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= percent * (n[x] + n[y]))
        found[x[fits]] = found[y[fits]] = True
    # Whoever still has a posting at the last offset lies in a longer list, as does that posting.
    return found | np.isin(h, np.unique(h[at]))


def _shared_shingles(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Postings that have a partner in their list, with the length of the list."""
        short = (x + bytes(len(x) // SHORT * (8 - SHORT)) for x in table.column("h").to_pylist())
        h = np.concatenate([unplanes(x, np.int64) for x in short])
        node, n, pos = (np.concatenate([unplanes(x, t) for x in table.column(c).to_pylist()]) for c, t in (("node", np.int64), ("n", np.uint32), ("pos", np.uint32)))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        order = np.lexsort((node, n, h))
        h, node, n, pos = h[order], node[order], n[order], pos[order]
        new = np.ones(len(h), bool)
        # The same node, posted by several tasks; two shingles of a node taken for equal keep the first place.
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, n = h[new], node[new], n[new]
        pos = np.minimum.reduceat(pos, np.flatnonzero(new))
        keep = _partners(h, n, pos, percent)
        h, node, n, pos = h[keep], node[keep], n[keep], pos[keep]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
        size = np.diff(np.append(start, len(h)))
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"token": (h << (62 - 8 * SHORT)) + bucket, "node": node, "n": n, "pos": pos, "m": np.repeat(size, size)})
    return run


def _pick(n: int, percent: int, shared, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = np.frombuffer(wanted.value, np.uint8)
        for batch in chunks(batches):
            s = _Sets(batch.column("text"), n, percent, shared.value)
            ids = batch.column("doc_id").fill_null(int(NULL_ID)).to_numpy().view(U64)
            stamp = s.node ^ (batch.column("key").to_numpy().view(U64) >> U64(3)) ^ (ids << U64(20))
            low = (stamp & U64(BITS - 1)).astype(np.int64)
            keep = np.flatnonzero(((allowed[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1) & (s.n > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.node[keep].view(np.int64)), pa.array([_narrow(s.of(i)) for i in keep.tolist()], pa.binary())], names=["node", "items"])
    return run


def _narrow(h: np.ndarray) -> bytes:
    """A sorted set by the upper six bytes of its hashes: two sets have to agree by chance in 48 bits to be mistaken."""
    return np.ascontiguousarray(np.sort(h).view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _widen(data: memoryview) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.concatenate((np.zeros((len(six), 2), np.uint8), six), 1).view(U64).ravel()


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = _widen(x.as_buffer()), _widen(y.as_buffer())
                if len(x) > len(y):
                    x, y = y, x
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[place] == x).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
    return run


def _fits(na, ia, nb, ib, percent: int):
    """Sizes allow a link, and so do the places of the shared shingle, if it is the first that both share.

    The first shared shingle of a linked pair always fits, so a pair with none that fits is not linked.
    """
    most = 1 + F.least(na - ia - 1, nb - ib - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def _apart(sa: str, sb: str):
    return sum((F.bit_count(F.col(f"{sa}.{c}").bitwiseXOR(F.col(f"{sb}.{c}"))) for c in _SKETCH), F.lit(0))


def _near(na, sa: str, nb, sb: str, percent: int):
    """The sketches allow a link: each shingle that only one of two sets has turns one bit, so the sets differ in as
    many shingles as the sketches in bits, at least."""
    return (100 + percent) * _apart(sa, sb) <= (100 - percent) * (na + nb)


def _bitmap(rows: DataFrame, hashed) -> bytes:
    """A bit for each value; ``BITS / 32768`` rows of 4 kB at most reach the driver."""
    bits = np.zeros(BITS // 8, np.uint8)
    p = rows.select((hashed.bitwiseAND(F.lit(BITS - 1)) + 1).alias("p"))
    for b, block in p.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p"))).toLocalIterator():
        bits[(b - 1) * 4096: b * 4096] = np.frombuffer(bytes(block), np.uint8)
    return bits.tobytes()


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, component`` for each row: the smallest id that links reach,
    and a name of the component that no other has.

    Null or wordless texts are linked with nothing and keep their own id. Rows repeated exactly are linked,
    as are all rows of equal sets; a null id is never a component's name unless there is no other. Other
    columns are not read.
    """
    spark = docs.sparkSession
    docs = keyed(docs)
    hints = spark.sparkContext.broadcast(frequencies(docs, n))
    made = docs.mapInArrow(_profiles(n, percent, hints), f"doc_id long, key long, n long, node long, prefix binary, sketch struct<{', '.join(f'{c}: bigint' for c in _SKETCH)}>")
    made = settle(made, "profiles")
    profiles = made.where("node is not null")
    nodes = settle(profiles.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("id"), "key")).alias("one"), F.min("n").alias("n"), F.any_value("sketch").alias("sketch")), "nodes")
    buckets = fan_out(docs, 16)
    spread = profiles.select("node", "n", "prefix").mapInArrow(_spread(buckets), "bucket int, h binary, node binary, n binary, pos binary")
    posts = settle(spread.groupBy("bucket").applyInArrow(_shared_shingles(percent), "token long, node long, n long, pos long, m long"), "posts")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among candidates; the sets of one row of each node in question are read from its text anew."""
        pairs = settle(pairs, "pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        stamp = F.col("node").bitwiseXOR(F.shiftrightunsigned("one.key", 3)).bitwiseXOR(F.shiftleft("one.id", 20))
        wanted = spark.sparkContext.broadcast(_bitmap(nodes.join(ends, "node", "left_semi"), stamp))
        sets = docs.mapInArrow(_pick(n, percent, hints, wanted), "node long, items binary").groupBy("node").agg(F.first("items").alias("items"))
        x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(_verify(percent), "a long, b long")

    def neighbours(lists: DataFrame, turn: int) -> DataFrame:
        """Up to ``NEAR`` pairs of a node with nodes of other components that stand beside it in a list."""
        salt = F.pmod(F.xxhash64("node", "token", F.lit(turn)), F.greatest(F.lit(1), F.floor(F.col("m") / LIST)))
        row = Window.partitionBy("token", "salt").orderBy("n", F.xxhash64("node", "token", F.lit(turn)), "node")
        one = F.struct("node", "comp", "n", "pos")
        lags = range(1, 2 if turn == 1 else BESIDE + 1)
        beside = lists.withColumn("salt", salt).withColumn("others", F.array(*(F.lag(one, k).over(row) for k in lags)))
        beside = beside.select("node", "comp", "n", "pos", F.explode("others").alias("o"))
        pairs = beside.where((F.col("comp") != F.col("o.comp")) & _fits(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos"), percent))
        pairs = pairs.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(_near(F.col("n_a"), "s_a", F.col("n_b"), "s_b", percent))
        if turn == 1:
            few = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"))
            return pairs.select("a", "b").withColumn("k", F.row_number().over(few)).where(F.col("k") <= NEAR).drop("k")
        far = _apart("s_a", "s_b") / (F.col("n_a") + F.col("n_b"))
        ways = pairs.select(far.alias("far"), F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("far", "p.*")
        few = Window.partitionBy("a").orderBy("far", F.xxhash64("a", "b"))
        nearest = ways.withColumn("k", F.row_number().over(few)).where(F.col("k") <= NEAR)
        return nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def opened(labels: DataFrame) -> DataFrame:
        """Postings of lists that hold several components, with the band of their size.

        Sizes of a linked pair lie in one band or in neighbouring ones; each pair meets in the smaller set's band.
        """
        held = settle(posts.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label"), "held")
        open_ = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        band = F.col("n").cast("int") if percent >= 100 else F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")
        return settle(held.join(open_, "token", "left_semi").withColumn("band", band), "open")

    def crowded(lists: DataFrame) -> bool:
        """More pairs of two components in one band than ``PAIRS`` for each posting."""
        each = lists.groupBy("token", "band", "comp").agg(F.count("*").alias("c"))
        here = each.groupBy("token", "band").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
        row = here.agg(F.sum((F.col("c").cast("double") * F.col("c") - F.col("own")) / 2), F.sum("c")).first()
        return (row[0] or 0) > PAIRS * (row[1] or 0)

    def every(lists: DataFrame) -> DataFrame:
        """All pairs of two components that the filters leave. They are part of the join, so only pairs that may be linked come out of it."""
        lists = lists.join(nodes.select("node", "sketch"), "node")
        a, b = (x.select("token", "band", *(F.col(c).alias(f"{c}_{s}") for c in ("comp", "node", "n", "pos", "sketch")))
                for s, x in (("a", lists), ("b", lists.withColumn("band", F.explode(F.array("band", F.col("band") - 1))))))
        first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
        meets = ((a["token"] == b["token"]) & (a["band"] == b["band"]) & (F.col("comp_a") != F.col("comp_b")) & first
                 & _fits(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"), percent)
                 & _near(F.col("n_a"), "sketch_a", F.col("n_b"), "sketch_b", percent))
        return a.join(b, meets).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()

    links = settle(verified(neighbours(posts.withColumn("comp", F.col("node")), 1)), "links")
    labels = components(links)
    lists, turn, grown = opened(labels), 1, not links.isEmpty()
    while grown and turn < ROUNDS and crowded(lists):
        turn += 1
        found = settle(verified(neighbours(lists, turn)), "links")
        grown = not found.isEmpty()
        if grown:
            links = links.union(found)
            labels = components(links)
            lists = opened(labels)
    labels = components(settle(links.union(verified(every(lists))), "links"))
    named = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(names, "comp").select("node", "component_id", F.col("comp").alias("component"))
    # A null node joins with nothing; its rows are spread by their own id instead.
    alone = made.where("node is null").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.xxhash64("doc_id", "key", F.lit("alone")).alias("component"))
    return profiles.select("doc_id", "key", F.col("n").alias("n_shingles"), "node").join(named, "node").select(
        "doc_id", "key", "n_shingles", "component_id", "component").union(alone)


def distinct(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """All columns of the one row of each component that stays: smallest id, null ids last, then text hash.

    Texts without words are components of their own; of rows repeated exactly one stays.
    """
    found = join(docs, n, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = found.groupBy("component").agg(F.min(order).alias("one")).select(F.coalesce("one.doc_id", F.lit(int(NULL_ID))).alias("d"), F.col("one.key").alias("key"))
    row = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    first = Window.partitionBy("d", "key").orderBy(F.lit(0))
    return row.join(kept, ["d", "key"]).withColumn("k", F.row_number().over(first)).where("k = 1").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), {N}) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= {PERCENT} * (x.n + y.n - o)),
reach(node, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT node, b FROM reach JOIN links ON seen = a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(seen) AS component_id
FROM d JOIN reach ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
