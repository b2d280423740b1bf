"""Line dedup: repeated runs of whole lines, the first copy of which stays.

Lines become ids, and blocks of lines are ranked by distributed prefix doubling: level k ranks all blocks of
``2**k`` lines that occur twice or more, from pairs of ranks of level k - 1, by a sort of the distinct pairs.
Blocks that occur once drop out, so levels shrink fast. Two ranks of one level name any longer run (its first
and its last block): runs of equal names are equal. Neither a suffix array of all lines nor intervals of longest
common prefixes are built; only repeated blocks have ranks, and runs are grouped by name instead.

A run counts if it has ``words`` words; ``MIN_WORDS`` is only the default, that of the query's SQL twin, and with 1
every repeated line with a word counts. Every maximal repeated run is the union of the least such runs
that begin, or end, at its lines, so those are named; all but the earliest of equal ones are deleted, and
what overlaps or touches merges into maximal runs again. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.llm.common import settle

MIN_WORDS = 25
_DOC = ("doc_id", "key")


def _lines(text: str) -> Column:
    return F.split(F.col(text).cast("string"), "\n", -1)


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, key, pos, h, c, before``: two hashes of each line and the words before it, and a last row
    with null hashes for the end of the text. Null texts have no rows."""
    rows = docs.where("text is not null").select(*_DOC, F.posexplode(F.concat(_lines("text"), F.array(F.lit(None).cast("string")))).alias("pos", "line"))
    count = F.coalesce(F.regexp_count("line", F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))
    rows = rows.select(*_DOC, "pos", F.when(F.col("line").isNotNull(), F.xxhash64("line")).alias("h"), F.crc32(F.col("line").cast("binary")).alias("c"), count.alias("words"))
    rows = rows.repartition(*_DOC).dropDuplicates([*_DOC, "pos"])  # of rows repeated exactly
    order = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))).drop("words")


def ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and their dense rank in a global sort; ``pairs`` has distinct keys, so no range is hot."""
    parts = pairs.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, F.spark_partition_id().alias("part"))
    parts = settle(parts, "ranks")
    sizes = parts.groupBy("part").count()
    # A row for each partition.
    bases = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return parts.withColumn("inside", inside).join(F.broadcast(bases), "part").select(*keys, (F.col("base") + F.col("inside")).alias("r"))


def doubled(rows: DataFrame, most: int) -> list[DataFrame]:
    """Level k holds ``doc_id, key, pos, r`` for the blocks of ``2**k`` lines that occur twice or more, up to ``most`` lines."""
    found = rows.where("h is not null")
    twice = found.groupBy("h", "c").count().where("count > 1").select("h", "c")
    level = found.join(ranked(twice, ["h", "c"]), ["h", "c"]).select(*_DOC, "pos", "r")
    levels, size = [settle(level, "level")], 1
    while 2 * size <= most:
        order = Window.partitionBy(*_DOC).orderBy("pos")
        pairs = levels[-1].select(*_DOC, "pos", F.col("r").alias("r1"), F.lead("r", size).over(order).alias("r2"), F.lead("pos", size).over(order).alias("there"))
        pairs = settle(pairs.where(F.col("there") == F.col("pos") + size).select(*_DOC, "pos", "r1", "r2"), "pairs")
        twice = pairs.groupBy("r1", "r2").count().where("count > 1").select("r1", "r2")
        levels.append(settle(pairs.join(ranked(twice, ["r1", "r2"]), ["r1", "r2"]).select(*_DOC, "pos", "r"), "level"))
        size *= 2
        if levels[-1].isEmpty():
            break
    return levels


def least_runs(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, key, pos, size``: for each line the shortest run from it, and for each end the shortest run up
    to it, of at least ``words`` words. One sorted pass over a text each: no line is compared with all others."""
    def nearest(shift: int, descending: bool, pick):
        asks = rows.select(*_DOC, (F.col("before") + shift).alias("at"), F.lit(1).alias("ask"), "pos")
        has = rows.select(*_DOC, F.col("before").alias("at"), F.lit(0).alias("ask"), "pos")
        order = Window.partitionBy(*_DOC).orderBy(F.desc("at") if descending else F.asc("at"), "ask").rowsBetween(Window.unboundedPreceding, 0)
        other = pick(F.when(F.col("ask") == 0, F.col("pos"))).over(order)
        return asks.union(has).withColumn("other", other).where("ask = 1 and other is not null")

    ahead = nearest(words, True, F.min).select(*_DOC, "pos", (F.col("other") - F.col("pos")).alias("size"))
    back = nearest(-words, False, F.max).select(*_DOC, F.col("other").alias("pos"), (F.col("pos") - F.col("other")).alias("size"))
    return ahead.union(back).where("size > 0").distinct()


def repeated_runs(docs: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, key, lo, hi``: maximal runs of lines to delete from documents with a ``key``."""
    rows = settle(lines(docs), "lines")
    runs = settle(least_runs(rows, words), "runs")
    most = runs.agg(F.max("size")).first()[0] or 0
    levels = doubled(rows, most)
    blocks = levels[0].withColumn("k", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        blocks = blocks.union(level.withColumn("k", F.lit(k)))
    deep = F.floor(F.log2(F.col("size") + F.lit(0.5))).cast("int")
    named = runs.withColumn("k", deep).withColumn("last", F.col("pos") + F.col("size") - F.pow(F.lit(2), F.col("k")).cast("int"))
    doc = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "key"]
    named = named.select(*doc, "k", "pos", "last", "size")
    blocks = blocks.select(*doc, "k", "pos", "r")
    named = named.join(blocks.withColumnRenamed("r", "r1"), ["d", "key", "k", "pos"]).join(
        blocks.select("d", "key", "k", F.col("pos").alias("last"), F.col("r").alias("r2")), ["d", "key", "k", "last"])
    named = settle(named.select("d", "key", "pos", "size", "r1", "r2"), "named")
    name = ["size", "r1", "r2"]
    firsts = named.groupBy(*name).agg(F.min(F.struct("d", "key", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = named.join(firsts, name).where(F.struct("d", "key", "pos") != F.col("first"))
    later = later.select("d", "key", F.col("pos").alias("lo"), (F.col("pos") + F.col("size")).alias("hi"))
    order = Window.partitionBy("d", "key").orderBy("lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = later.withColumn("new", (reach.isNull() | (F.col("lo") > reach)).cast("int"))
    island = new.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("d", "key", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("d", "key", "lo", "hi")


def dedup(docs: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, with ``text`` without the deleted lines, and ``n_lines, n_removed, n_runs``.

    A null text stays null, and an emptied one is empty. Order is (id, text hash, line), null ids first; rows
    repeated exactly are one document, all of whose rows lose the same lines. Columns of ``docs`` named like
    an added one give way to it.
    """
    text = F.col("text").cast("string")
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    runs = repeated_runs(narrow, words)
    cuts = runs.groupBy("d", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    row = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("key"))
    both = row.join(cuts, ["d", "key"], "left")
    kept = F.filter(_lines("row.text"), lambda x, i: ~F.exists("cuts", lambda c: (i >= c.lo) & (i < c.hi)))
    total = F.coalesce(F.size(_lines("row.text")), F.lit(0))
    gone = F.coalesce(F.aggregate("cuts", F.lit(0), lambda a, c: a + c.hi - c.lo), F.lit(0))
    cut = F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return both.select(
        *((cut if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns),
        F.when(F.col("row.text").isNull(), 0).otherwise(total).cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"),
        F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts")).cast("long").alias("n_runs"))


def report(docs: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    return dedup(docs.select("doc_id", "text"), words).select(
        "doc_id", "n_lines", "n_removed", "n_runs",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH l0 AS (SELECT doc_id, unnest(list_append(string_split(text, chr(10)), NULL)) AS line, unnest(range(len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, pos, line, coalesce(len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS w FROM l0),
l AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l1),
runs AS (
  SELECT a.doc_id, a.pos AS lo, min(z.pos) AS hi FROM l a JOIN l z ON a.doc_id = z.doc_id AND z.b >= a.b + {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT a.doc_id, max(z.pos) AS lo, a.pos AS hi FROM l a JOIN l z ON a.doc_id = z.doc_id AND z.b <= a.b - {MIN_WORDS} GROUP BY a.doc_id, a.pos),
body AS (
  SELECT r.doc_id, lo, hi, string_agg(line, chr(10) ORDER BY pos) AS t
  FROM runs r JOIN l ON l.doc_id = r.doc_id AND pos >= lo AND pos < hi WHERE hi > lo GROUP BY ALL),
later AS (SELECT * FROM body QUALIFY row_number() OVER (PARTITION BY t, hi - lo ORDER BY doc_id, lo) > 1),
gone AS (SELECT DISTINCT doc_id, pos FROM later JOIN l USING (doc_id) WHERE pos >= lo AND pos < hi),
marked AS (SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS g FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE line IS NOT NULL),
edges AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY pos), FALSE) AS e FROM marked),
s AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g) AS n_removed, count(*) FILTER (e) AS n_runs,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT g), '') AS t FROM edges GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""
