"""Vector code compression: product quantisation whose nearest entries are found by slicing and intersecting.

A codebook of one part of the vectors is turned to its principal axes (a turn keeps distances, and the first
axes carry most of the spread). Along every axis its entries lie sorted, and each place of that order carries
the mask of all entries before it. A vector starts with the distance to the entry that stands for its cell of
the first axes; with that radius two binary searches on an axis give a range, the masks at its two ends
(uint64 words) give the entries inside, and ANDed over all axes they give every entry that can be as near.
The first axes sharpen the radius once more, then the whole-number distances of what is left decide.

Codebooks are learnt on Spark: a round assigns all vectors where they lie, sums parts by entry inside the
task, and only those sums are shuffled. The driver holds the codebooks (``entries`` vectors) and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemeter.llm.common import fresh, settle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a task searches at once; axes and bins of the cells that give the first radius.
BLOCK, AXES, BINS = 2048, 4, 4


def bound(dims: int) -> int:
    """Whole components stay within this size, so that the squared distance of any two vectors is a long."""
    return int((2 ** 62 / max(dims, 1)) ** 0.5 / 2)


def _whole(lists: pa.Array, scale: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that take part and their components, filled up with zeros to ``dims``."""
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    bad = np.concatenate(([0], np.cumsum(bad | ~np.isfinite(values))))
    rows = np.flatnonzero((sizes >= 0) & (bad[starts[1:]] == bad[starts[:-1]]))
    place = np.arange(dims)[None, :] < sizes[rows, None]
    out = np.zeros((len(rows), dims), np.int64)
    most = bound(dims)
    with np.errstate(over="ignore"):
        taken = np.clip(np.floor(values[(starts[rows, None] + np.arange(dims))[place]] * scale), -most, most)
    out[place] = taken.astype(np.int64)
    return rows, out


class Slices:
    """One part's codebook, ready for search."""

    def __init__(self, book: np.ndarray):
        k, d = book.shape
        self.book = book
        middle = book - book.mean(0)
        self.axes = np.linalg.eigh(middle.T @ middle)[1][:, ::-1] if d else np.zeros((0, 0))
        turned = book @ self.axes
        order = np.argsort(turned, axis=0, kind="stable")
        self.turned, self.sorted = turned, np.take_along_axis(turned, order, 0)
        self.words = (k + 63) // 64
        one = np.zeros((k, self.words), np.uint64)
        one[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.before = np.zeros((d, k + 1, self.words), np.uint64)
        for j in range(d):
            self.before[j, 1:] = np.bitwise_or.accumulate(one[order[:, j]], axis=0)
        self.slack = 1e-9 * (np.abs(turned).max(initial=0) + 1)
        # A cell of the first axes is stood for by the entry nearest to its middle.
        self.first = min(AXES, d)
        cuts = [self.sorted[[k * b // BINS for b in range(1, BINS)], j] for j in range(self.first)]
        mids = [self.sorted[[k * (2 * b + 1) // (2 * BINS) for b in range(BINS)], j] for j in range(self.first)]
        self.cuts = cuts
        grid = np.stack([g.ravel() for g in np.meshgrid(*mids, indexing="ij")], 1) if mids else np.zeros((1, 0))
        self.stands = ((grid[:, None, :] - turned[None, :, : self.first]) ** 2).sum(2).argmin(1)

    def candidates(self, turned: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """``(n, words)`` masks of the entries inside the box of ``radius`` round each vector."""
        mask = np.full((len(turned), self.words), np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(turned.shape[1]):
            low = np.searchsorted(self.sorted[:, j], turned[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], turned[:, j] + radius, "right")
            mask &= self.before[j, high] ^ self.before[j, low]
        if not turned.shape[1]:
            mask &= np.bitwise_or.reduce(np.uint64(1) << (np.arange(len(self.book)) % 64).astype(np.uint64))
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest entry (ties: the lower one), its squared distance, and the number of distances taken."""
        n = len(x)
        turned = x @ self.axes
        cell = np.zeros(n, np.int64)
        for j in range(self.first):
            cell = cell * BINS + np.searchsorted(self.cuts[j], turned[:, j], "right")
        best = ((x - self.book[self.stands[cell]]) ** 2).sum(1)
        slack = self.slack + 1e-9 * np.abs(turned).max(1, initial=0)
        bits = np.unpackbits(self.candidates(turned, np.sqrt(best) * (1 + 1e-9) + slack).view(np.uint8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        # The first axes alone: the entry nearest by them gives a sharper radius, and what lies beyond it goes.
        near = ((turned[row, : self.first] - self.turned[entry, : self.first]) ** 2).sum(1)
        at = np.searchsorted(row, np.arange(n))
        lead = np.flatnonzero(near == np.minimum.reduceat(near, at)[row]) if n else at
        lead = lead[np.concatenate(([True], np.diff(row[lead]) > 0))] if len(lead) else lead
        best = np.minimum(best, ((x - self.book[entry[lead]]) ** 2).sum(1))
        keep = near <= ((np.sqrt(best) * (1 + 1e-9) + 2 * slack) ** 2)[row]
        row, entry = row[keep], entry[keep]
        exact = ((x[row] - self.book[entry]) ** 2).sum(1)
        at = np.searchsorted(row, np.arange(n))
        least = np.minimum.reduceat(exact, at) if n else exact
        hit = np.flatnonzero(exact == least[row])
        hit = hit[np.concatenate(([True], np.diff(row[hit]) > 0))] if len(hit) else hit
        return entry[hit], least, len(row) + 2 * n


def _assigned(shared, scale: int, dims: int):
    """Rows that take part, their parts, and by part the codes and squared distances, a block at a time."""
    books = shared.value
    slices = [Slices(b) for b in books]
    wide = dims // len(books)

    def of(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            rows, x = _whole(piece.column("embedding"), scale, dims)
            found = [s.nearest(x[:, p * wide: (p + 1) * wide])[:2] for p, s in enumerate(slices)]
            yield piece, rows, x, found
    return of


def _sums(shared, scale: int, dims: int):
    """``(part, entry, place, total, members)``: sums of the task's vectors by entry; place -1 has no total."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _assigned(shared, scale, dims)
        parts, k = len(shared.value), len(shared.value[0])
        wide = dims // parts
        total, members = np.zeros((parts, k, wide), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for _, _, x, found in of(batch):
                for p, (code, _) in enumerate(found):
                    np.add.at(total[p], code, x[:, p * wide: (p + 1) * wide])
                    members[p] += np.bincount(code, minlength=k)
        for p in range(parts):
            used = np.flatnonzero(members[p])
            n = len(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n * (wide + 1), p, np.int32)), pa.array(np.repeat(used, wide + 1).astype(np.int32)),
                 pa.array(np.tile(np.arange(-1, wide, dtype=np.int32), n)),
                 pa.array(np.concatenate((np.zeros((n, 1), np.int64), total[p][used]), axis=1).ravel()), pa.array(np.repeat(members[p][used], wide + 1))],
                names=["part", "entry", "place", "total", "members"])
    return run


def _codes(shared, scale: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _assigned(shared, scale, dims)
        for batch in batches:
            for piece, rows, _, found in of(batch):
                codes = np.stack([c for c, _ in found], 1).astype(np.uint16 if len(shared.value[0]) > 256 else np.uint8)
                code = [r.astype(">u2").tobytes().hex() if codes.dtype == np.uint16 else r.tobytes().hex() for r in codes]
                taken = piece.take(pa.array(rows))
                rest = [taken.column(c) for c in taken.schema.names if c != "embedding"]
                names = [c for c in taken.schema.names if c != "embedding"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(code, pa.string()), pa.array(sum(d for _, d in found))], names=[*names, "code", "error"])
    return run


def _narrow(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _kept(embedding) -> F.Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & finite


def width(vectors: DataFrame, parts: int = PARTS) -> int:
    """The longest length that takes part, raised to a multiple of ``parts``."""
    e = F.col("embedding").cast("array<double>")
    longest = vectors.where(_kept(e)).agg(F.max(F.size(e))).first()[0] or 0
    return -(-longest // parts) * parts


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks, one ``(entries, dims / parts)`` array of whole numbers for each part.

    A codebook starts as the parts of the ``entries`` smallest ids (null ids last, equal ids by their
    components; fewer vectors make a smaller codebook). Each of ``rounds`` rounds moves every used entry to the
    floor of the mean of its parts.
    """
    rows, dims = _narrow(vectors), width(vectors, parts)
    first = rows.where(_kept(F.col("embedding"))).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    _, x = _whole(pa.array([r.embedding for r in first], pa.list_(pa.float64())), scale, dims)
    books = [np.ascontiguousarray(b) for b in np.split(x, parts, axis=1)]
    sc = vectors.sparkSession.sparkContext
    for _ in range(rounds if first else 0):
        shared = sc.broadcast(books)
        sums = rows.select("embedding").mapInArrow(_sums(shared, scale, dims), "part int, entry int, place int, total long, members long")
        books = [b.copy() for b in books]
        # A row for each component of a codebook.
        for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members")).where("place >= 0").collect():
            books[r.part][r.entry, r.place] = int(r.total) // r.members
        shared.destroy()
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """All columns of ``vectors`` but ``embedding`` with ``code`` (hex digits of each part's entry) and ``error`` (squared distance)."""
    if not len(books[0]):
        return vectors.where("false").drop("embedding").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")})
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*(f for f in vectors.schema.fields if f.name not in ("embedding", "code", "error")), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    rows = vectors.drop("code", "error").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(_codes(shared, scale, sum(b.shape[1] for b in books)), schema)


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """Adds ``embedding``: the vector that ``code`` stands for, within half a step of ``scale`` of the entry."""
    digits = 2 if len(books[0]) <= 256 else 4
    table = F.array([F.array([F.array([F.lit((int(v) + 0.5) / scale) for v in entry]) for entry in b]) for b in books])
    parts = [F.element_at(F.element_at(table, p + 1), F.conv(F.substring("code", p * digits + 1, digits), 16, 10).cast("int") + 1) for p in range(len(books))]
    return codes.withColumn("embedding", F.concat(*parts))


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each row that takes part.

    Rows whose vector is null or holds a null or non-finite component take no part. A shorter vector, or a
    length that ``PARTS`` does not divide, is filled up with zeros; an empty vector is all zeros. Components
    beyond ``bound(dims)`` after scaling (some 130,000 before it, at 64 dimensions) count as that bound, since a
    squared distance could not be a long. A repeated id or row counts each time; a null id gives a null id. A sum
    of errors beyond a long is the largest long. An empty table gives no rows. Other columns are not read.
    """
    books, label = learn(vectors), fresh("label")
    given = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    coded = settle(encode(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", given.alias(label)), books), "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col(label).alias("sum_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("sum_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    def assign(n: int) -> str:
        return f"""
b{n} AS MATERIALIZED (
  SELECT p.r, p.part, p.label, p.v, arg_min({{'i': c.entry, 'd': d}}, d * {entries} + c.entry) AS hit
  FROM p JOIN c{n} c ON p.part = c.part,
  LATERAL (SELECT list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d)
  GROUP BY p.r, p.part, p.label, p.v)"""

    steps = [assign(0)]
    for n in range(1, rounds + 1):
        steps.append(f"""
m{n} AS MATERIALIZED (
  SELECT part, entry, list(mean ORDER BY place) AS v FROM (
    SELECT part, hit.i AS entry, place, floor_div AS mean FROM (
      SELECT part, hit, place, (CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END)::BIGINT AS floor_div FROM (
        SELECT part, hit, place, sum(x) AS s, count(*) AS n FROM (
          SELECT part, {{'i': hit.i}} AS hit, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM b{n - 1}) GROUP BY ALL)))
  GROUP BY part, entry),
c{n} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{n - 1} c LEFT JOIN m{n} m ON c.part = m.part AND c.entry = m.entry)""")
        steps.append(assign(n))
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, label, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] AS v FROM k, generate_series(0, {parts - 1}) g(part)),
c0 AS MATERIALIZED (SELECT part, r AS entry, v FROM p WHERE r < {entries}),
{",".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
found AS (SELECT r, string_agg(format('{{:02x}}', hit.i), '' ORDER BY part) AS code, sum(hit.d)::BIGINT AS error FROM b{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM found JOIN k USING (r), books
"""


ORACLE_SQL = _oracle()
