"""Benchmark decontamination by winnowing.

Every run of ``WINDOW`` words holds ``W`` consecutive ``K``-grams; the smallest hash among them is a
fingerprint of both texts that share the run, whatever surrounds it, so a join of fingerprints finds
every shared run. Each joined pair is extended word by word to the left and right and counts only if
it spans a whole window, so hashes decide nothing. Items shorter than a window are one window of their
own length, fingerprinted whole.

A bitmap of fixed size (``BITS``) over the benchmark's fingerprints travels to the scan; a document
fingerprint that it rules out joins with nothing and is not shuffled. It may let others through, never
the reverse, so its size changes cost and not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.llm.common import NOT_ALNUM, Words, chunks, keyed, mix, rolling, settle, windows, word_hashes, words

WINDOW, K = 10, 6
W = WINDOW - K + 1
#: Bits of the filter: 8 MB, a fixed bound.
BITS = 1 << 26

_FPS = "doc_id long, key long, n_words long, span int, hash long, pos int, ctx string, off int"


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` over each ``n`` neighbours."""
    out = x[: len(x) - n + 1]
    for j in range(1, n):
        out = pick(out, x[j: len(x) - n + 1 + j])
    return out


def winnow(w: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the K-grams that are the smallest of some window; all, where several tie."""
    full = windows(w.first, WINDOW)
    grams = len(codes) - K + 1
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(grams)
    h = rolling(codes, at, at + K)
    least = _slide(h, W, np.minimum)
    inside = np.zeros(len(least), bool)
    inside[full] = True
    # A K-gram is chosen if it equals the minimum of a window, inside one text, that holds it.
    chosen = np.zeros(grams, bool)
    for j in range(W):
        hit = inside & (h[j: j + len(least)] == least)
        chosen[j: j + len(least)] |= hit
    places = np.flatnonzero(chosen)
    return places, h[places]


def _context(w: Words, doc: int, pos: int, k: int, span: int) -> tuple[str, int]:
    """The words around a K-gram that a window over it may hold, and the K-gram's place among them."""
    lo, hi = max(int(w.first[doc]), pos + k - span), min(int(w.first[doc + 1]), pos + span)
    return b" ".join(w.text(i) for i in range(lo, hi)).decode("utf-8", "replace"), pos - lo


def _prints(w: Words, codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, int]:
    if span == WINDOW:
        return *winnow(w, codes), K
    at = windows(w.first, span)
    return at, rolling(codes, at, at + span), span


def _salted(h: np.ndarray, span: int) -> np.ndarray:
    return mix(h + np.uint64(span))


def _scan(bits, spans: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = np.frombuffer(bits.value, np.uint8)
        for batch in chunks(batches):
            ids, keys = batch.column("doc_id"), batch.column("key")
            w = words(batch.column("text"), NOT_ALNUM, True)
            codes, n = word_hashes(w), np.diff(w.first)
            rows: list[list] = [[] for _ in range(4)]
            docs = [np.arange(batch.num_rows)]
            kinds = [np.zeros(batch.num_rows, np.int32)]
            # A document's own row carries a key of its own through the join.
            hashes = [keys.to_numpy().view(np.uint64)]
            for span in spans:
                at, h, k = _prints(w, codes, span)
                h = _salted(h, span)
                low = (h & np.uint64(BITS - 1)).astype(np.int64)
                keep = (allowed[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                at, h = at[keep], h[keep]
                doc = np.searchsorted(w.first, at, "right") - 1
                for d, p in zip(doc.tolist(), at.tolist(), strict=True):
                    ctx, off = _context(w, d, p, k, span)
                    rows[0].append(p - int(w.first[d]))
                    rows[1].append(ctx)
                    rows[2].append(off)
                docs.append(doc)
                kinds.append(np.full(len(at), span, np.int32))
                hashes.append(h)
            doc, none = np.concatenate(docs), [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(doc)), keys.take(pa.array(doc)), pa.array(n[doc].astype(np.int64)),
                 pa.array(np.concatenate(kinds)), pa.array(np.concatenate(hashes).view(np.int64)),
                 pa.array(none + rows[0], pa.int32()), pa.array(none + rows[1], pa.string()),
                 pa.array(none + rows[2], pa.int32())],
                names=["doc_id", "key", "n_words", "span", "hash", "pos", "ctx", "off"])
    return run


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        w = words(batch.column("text"), NOT_ALNUM, True)
        codes = word_hashes(w)
        lengths = np.diff(w.first)
        out: list[tuple] = []
        for span in sorted({min(int(n), WINDOW) for n in lengths if n}):
            at, h, k = _prints(w, codes, span)
            doc = np.searchsorted(w.first, at, "right") - 1
            for d, p, x in zip(doc.tolist(), at.tolist(), _salted(h, span).view(np.int64).tolist(), strict=True):
                if span == WINDOW or lengths[d] == span:
                    out.append((d, span, x, *_context(w, d, p, k, span)))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()),
             pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int32())],
            names=["item_id", "span", "hash", "item_ctx", "item_off"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word for word from the shared K-gram outwards; what spans less than a window becomes no hit."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("span", "pos", "ctx", "off", "item_ctx", "item_off")]
        starts, ends = [], []
        for span, pos, ctx, off, other, there in zip(*cols, strict=True):
            lo = hi = None
            if other is not None:
                a, b = ctx.split(" "), other.split(" ")
                left = 0
                while left < min(off, there) and a[off - left - 1] == b[there - left - 1]:
                    left += 1
                right, most = 0, min(len(a) - off, len(b) - there)
                while right < most and a[off + right] == b[there + right]:
                    right += 1
                if left + right >= span:
                    lo, hi = pos - left, pos + right
            starts.append(lo)
            ends.append(hi)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "key", "n_words", "item_id")), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            names=["doc_id", "key", "n_words", "item_id", "start", "stop"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Shared word spans: ``(doc_id, key, n_words, item_id, start, stop)``, and one row with null span for
    every document. Spans count words of the document from 0.

    Null or wordless texts share nothing. Rows repeated exactly are one document; rows that share an id
    with other text stay apart by ``key``. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    items = keyed(benchmark, "item_id").dropDuplicates(["doc_id", "key"])
    prints = settle(items.mapInArrow(_item_prints, "item_id long, span int, hash long, item_ctx string, item_off int").distinct(), "items")
    spans = sorted(r[0] for r in prints.select("span").distinct().collect())  # WINDOW values at most
    bit = F.col("hash").bitwiseAND(F.lit(BITS - 1)) + 1
    blocks = (
        prints.select(bit.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")))
    bitmap = np.zeros(BITS // 8, np.uint8)
    for b, block in blocks.toLocalIterator():  # BITS / 32768 rows of 4 kB at most
        bitmap[(b - 1) * 4096: b * 4096] = np.frombuffer(bytes(block), np.uint8)
    scanned = keyed(docs).mapInArrow(_scan(spark.sparkContext.broadcast(bitmap.tobytes()), spans), _FPS)
    joined = scanned.join(prints, ["span", "hash"], "left")
    return joined.mapInArrow(_extend, "doc_id long, key long, n_words long, item_id long, start long, stop long")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, key, n_words, n_hit, items`` (sorted item ids as strings)."""
    before = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.col("start")))
    spans = overlaps(docs, benchmark).withColumn("hit", F.greatest(hit, F.lit(0)))
    item = F.when(F.col("start").isNotNull(), F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    return spans.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"),
        F.array_sort(F.collect_set(item)).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with an item."""
    none = F.lit(-(1 << 63))
    bad = overlaps(docs, benchmark).where("start is not null").select(F.coalesce("doc_id", none).alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    row = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("k"))
    return row.join(bad, (F.col("d") == F.col("bad_id")) & (F.col("k") == F.col("bad_key")), "left_anti").select("row.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, p, dw.n, item_id FROM dw JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
