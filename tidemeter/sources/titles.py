"""Session titles and summaries from landed files.

Two kinds of file meet by session: the logs themselves, whose first useful user utterance is the title, and
sidecars, JSON objects from session ids to summaries that another tool wrote. A session's log is the last path
that carries its id, even when that file says nothing useful.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemeter.functions import labels
from tidemeter.operators import titles as tt
from tidemeter.operators.dedup import session_index
from tidemeter.operators.once import once
from tidemeter.sources import logs

# Fixed value: lines beyond it are not read for a title.
MAX_LINE_CHARS = 4 * 1024 * 1024


def read_titles(
    spark: SparkSession, path: str | list[str], pattern: str | None = None, session: Column | None = None,
    sessions: DataFrame | None = None, max_line_chars: int | None = MAX_LINE_CHARS, bundled: bool = False,
) -> DataFrame:
    """(session, file_path, title) of every log; the title is empty where no utterance is useful.

    ``session`` takes the id from ``file_path`` (by default its stem), ``sessions`` limits the result. Each split
    sends its first useful utterance only, cut to a title, so neither a long log nor a long prompt is shuffled.
    ``bundled`` reads logs that were landed together (``logs.scan_bundles``); one without a line is not known there.
    """
    lines = logs.scan_bundles(spark, path, "claude", pattern) if bundled else logs.scan_lines(spark, path, "claude", pattern)
    index = session_index(lines.select("file_path") if bundled else logs.list_files(spark, path, "claude", pattern), session)
    if sessions is not None:
        index = index.join(sessions.select("session").distinct(), "session", "left_semi")
    if max_line_chars is not None:
        lines = lines.where(F.char_length(labels.strip(F.col("value"))) <= max_line_chars)
    spoken = tt.utterances(lines.select(
        F.col("file_path").alias("session"), F.struct("block", "seq").alias("line_no"), "value"))
    first = tt.session_titles(spoken).withColumnRenamed("session", "file_path")
    return index.join(first, "file_path", "left").select("session", "file_path", F.coalesce("title", F.lit("")).alias("title"))


def read_summaries(
    spark: SparkSession, path: str | list[str], pattern: str = "*.json", max_file_bytes: int | None = logs.MAX_FILE_BYTES,
) -> DataFrame:
    """(session, summary) of sidecar files, each one JSON object.

    A missing path, a file that is no object, and an empty summary give nothing. Of a session named twice the
    last path, and in one file the last entry, wins.
    """
    try:
        files = (
            spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
            .where(logs.fits(F.col("_metadata.file_size"), max_file_bytes))
            .select(F.col("_metadata.file_path").alias("file_path"), "value"))
    except AnalysisException:
        return spark.createDataFrame([], "session string, summary string")
    parsed = once(files, found=F.from_json("value", "map<string, string>"))
    entries = parsed.select("file_path", F.posexplode("found").alias("place", "session", "summary"))
    last = F.row_number().over(W.partitionBy("session").orderBy(F.desc("file_path"), F.desc("place")))
    return entries.withColumn("_r", last).where("_r = 1 and summary <> ''").select("session", "summary")


def label_records(
    spark: SparkSession, rec: DataFrame, path: str | list[str], sidecar: str | list[str] | None = None, hidden: bool = False, **how,
) -> DataFrame:
    """(session, label) of every session of ``rec``: summary, else title, else the short id.

    With ``hidden`` ids are aliases already, and neither logs nor sidecars are opened.
    """
    sessions = rec.where("session <> ''").select("session").distinct()
    if hidden:
        return tt.label_sessions(sessions, None, hidden=True)
    found = read_titles(spark, path, sessions=sessions, **how).select("session", "title")
    return tt.label_sessions(sessions, found, read_summaries(spark, sidecar) if sidecar else None)
