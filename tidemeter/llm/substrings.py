"""Substring dedup: every window of ``WINDOW`` words is hashed, equal windows meet by hash, and all but
the earliest are removed; overlapping removed windows merge into maximal intervals.

A window travels as eight bytes of Rabin-Karp hash and about a byte of place, packed by the thousand, to
the bucket that a second, independent hash names; two different windows are taken for one only if both
agree. Each task first folds the windows of a chunk of documents, so a passage that a third of all
documents hold reaches its bucket once per chunk: later copies inside the chunk are removed there and
then. Order is (document id, text hash, start), null id first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import SPACES, U64, chunks, fan_out, keyed, mix, rolling, windows, word_hashes, words
from tidemeter.llm.packed import NULL_ID, by_bucket, deltas, planes, undeltas, unplanes

WINDOW = 20
#: Bytes of text in a chunk whose equal windows are folded before they are sent.
FOLD = 4 << 20

_PACKED = "bucket int, hashes binary, places binary, ids binary, keys binary, firsts binary"
_NAMES = ["bucket", "hashes", "places", "ids", "keys", "firsts"]
_NONE = b""


def _order(batch: pa.RecordBatch) -> pa.RecordBatch:
    """By (id, key), rows repeated exactly once."""
    t = pa.Table.from_batches([batch]).set_column(0, "doc_id", pc.fill_null(batch.column("doc_id"), int(NULL_ID)))
    t = t.sort_by([("doc_id", "ascending"), ("key", "ascending")]).combine_chunks()
    ids, keys = t.column("doc_id").to_numpy(), t.column("key").to_numpy()
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    return t.filter(pa.array(new)).combine_chunks().to_batches()[0]


def _shards(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, shards: int, base: int) -> list[tuple]:
    """Removed window starts, packed by the shard of their document."""
    home = (mix(ids.view(U64) ^ (keys.astype(U64) << U64(32))) % U64(shards)).astype(np.int64)
    return [(base + b, _NONE, planes(starts[at].astype(np.uint32)), planes(ids[at]), planes(keys[at]), _NONE)
            for b, at in by_bucket(home, shards)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=_NAMES)


def _scan(window: int, buckets: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, FOLD):
            batch = _order(batch)
            ids = batch.column("doc_id").to_numpy()
            keys = batch.column("key").to_numpy().view(U64).astype(np.uint32)
            w = words(batch.column("text"), SPACES, False)
            codes = word_hashes(w)
            at = windows(w.first, window)
            if not len(at):
                continue
            h = rolling(codes, at, at + window)
            second = rolling(mix(codes ^ U64(0x5851F42D4C957F2D)), at, at + window)
            order = np.argsort(h, kind="stable")
            new = np.ones(len(h), bool)
            new[1:] = h[order[1:]] != h[order[:-1]]
            again = order[~new]
            if len(again):
                doc = np.searchsorted(w.first, at[again], "right") - 1
                yield _batch(_shards(ids[doc], keys[doc], at[again] - w.first[doc], shards, buckets))
            once = np.sort(order[new])
            table = (deltas(ids), planes(keys), deltas(w.first[:-1].astype(np.uint32)))
            yield _batch([
                (b, planes(h[once[i]]), deltas(at[once[i]].astype(np.uint32)), *table)
                for b, i in by_bucket((second[once] % U64(buckets)).astype(np.int64), buckets)])
    return run


def _settle(buckets: int, shards: int):
    """Of equal windows in a bucket, all but the earliest are removed."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            return table.select(_NAMES)
        parts = []
        for r in table.to_pylist():
            place, first = undeltas(r["places"], np.uint32), undeltas(r["firsts"], np.uint32)
            doc = np.searchsorted(first, place, "right") - 1
            parts.append((unplanes(r["hashes"], U64), undeltas(r["ids"], np.int64)[doc], unplanes(r["keys"], np.uint32)[doc], place - first[doc]))
        h, ids, keys, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        several = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        h, ids, keys, starts = h[several], ids[several], keys[several], starts[several]
        order = np.lexsort((starts, keys, ids, h))
        h, ids, keys, starts = h[order], ids[order], keys[order], starts[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else order
        later = (ids != ids[lead]) | (keys != keys[lead]) | (starts != starts[lead])
        return pa.Table.from_batches([_batch(_shards(ids[later], keys[later], starts[later], shards, buckets))])
    return run


def merged(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal runs, as ``(lo, hi)`` pairs, of places covered by windows with these sorted starts."""
    cut = np.flatnonzero(np.diff(starts) > window)
    return np.stack((starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + window), 1)


def _intervals(window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids = np.concatenate([unplanes(r["ids"], np.int64) for r in rows])
        keys = np.concatenate([unplanes(r["keys"], np.uint32) for r in rows])
        starts = np.concatenate([unplanes(r["places"], np.uint32) for r in rows]).astype(np.int64)
        order = np.lexsort((starts, keys, ids))
        ids, keys, starts = ids[order], keys[order], starts[order]
        at = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
        cuts = [merged(x, window).astype(np.int32).tobytes() for x in np.split(starts, at[1:])]
        return pa.table({"gone_id": ids[at], "gone_key": keys[at].astype(np.int64), "gone": pa.array(cuts, pa.binary())})
    return run


def removed_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(gone_id, gone_key, gone)`` for every document of ``keyed()`` rows that loses words; ``gone`` packs
    maximal ``(lo, hi)`` word intervals as 32-bit numbers."""
    buckets = fan_out(docs, 8)
    moved = docs.mapInArrow(_scan(window, buckets, buckets), _PACKED)
    back = moved.groupBy("bucket").applyInArrow(_settle(buckets, buckets), _PACKED)
    return back.groupBy("bucket").applyInArrow(_intervals(window), "gone_id long, gone_key long, gone binary")


def with_gone(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``keyed()`` rows with the packed intervals of their document, or null."""
    ident = F.coalesce("doc_id", F.lit(int(NULL_ID)))
    low = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    return docs.join(gone, (ident == F.col("gone_id")) & (low == F.col("gone_key")), "left")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        out: list[list] = [[], [], [], []]
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            w = (text or "").encode().split()
            kept, at = [], 0
            for lo, hi in np.frombuffer(gone or b"", np.int32).reshape(-1, 2).tolist():
                kept += w[at:lo]
                at = hi
            kept = b" ".join(kept + w[at:] if at else w)
            left = kept.count(b" ") + 1 if kept else 0
            for o, x in zip(out, (kept.decode(), len(w), len(w) - left, hashlib.sha256(kept).hexdigest()), strict=True):
                o.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3])],
            names=["doc_id", "kept", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, kept, n_words, n_removed, kept_sha256`` for each row.

    Null texts have no words. Rows repeated exactly are one document and give the same result each; rows
    that share an id with other text are documents of their own. Other columns are not read.
    """
    docs = keyed(docs)
    return with_gone(docs, removed_intervals(docs, window)).mapInArrow(
        _keep, "doc_id long, kept string, n_words long, n_removed long, kept_sha256 string")


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


_W = WINDOW
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(w[p : p + {_W - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_W} + 2)) AS p FROM d WHERE len(w) >= {_W})),
later AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + {_W})) AS q FROM later)),
kept AS (
  SELECT doc_id, x, q FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d)
  ANTI JOIN gone USING (doc_id, q)),
texts AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN texts USING (doc_id)
"""
