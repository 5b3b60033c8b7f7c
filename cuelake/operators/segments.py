"""Segments in order of time or list: turns, dialogue, paragraphs, chunks, stitching, overlap with outside turns.

All functions take a set of recordings keyed by ``media_id``. ``timed_segments`` drops repeated rows and rows without
both times; list order is ``seg_ix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cuelake.functions.text import strip
from cuelake.operators.ordered import with_previous, with_running_sum
from cuelake.session import arrow_batch, partitions_for, struct


def timed_segments(segments: DataFrame) -> DataFrame:
    rows = segments.select("media_id", "seg_ix", "start_s", "end_s", "text", "speaker").where("media_id IS NOT NULL AND seg_ix IS NOT NULL")
    return rows.dropDuplicates(["media_id", "seg_ix"]).where("start_s IS NOT NULL AND end_s IS NOT NULL")


def spoken_segments(segments: DataFrame) -> DataFrame:
    """Timed segments with a text that is not blank, stripped."""
    return timed_segments(segments).withColumn("text", strip(F.col("text"))).where("text <> ''")


def speaker_turns(segments: DataFrame, gap: float = 1.2, speakers: int = 2) -> DataFrame:
    """Adds ``turn`` (from 0) and ``speaker`` by silence: a gap of more than ``gap`` seconds passes to the next label."""
    if speakers < 1:
        raise ValueError("speakers must be at least 1")
    rows = with_previous(timed_segments(segments), ["media_id"], "seg_ix", ["end_s"])
    rows = rows.withColumn("_step", F.coalesce((F.col("start_s") - F.col("_prev.end_s") > gap).cast("int"), F.lit(0)))
    turned = with_running_sum(rows, ["media_id"], "seg_ix", "_step", "turn").drop("_step", "_prev")
    return turned.withColumn("speaker", F.concat(F.lit("Speaker "), (F.col("turn") % speakers + 1).cast("string")))


def talk_time(turns: DataFrame) -> DataFrame:
    """Turns, segments and milliseconds of every speaker."""
    ms = F.rint((F.col("end_s") - F.col("start_s")) * 1000).cast("long")
    return turns.groupBy("media_id", "speaker").agg(F.countDistinct("turn").alias("n_turns"), F.count(F.lit(1)).alias("n_segments"), F.sum(F.greatest(ms, F.lit(0))).alias("talk_ms"))


def _islands(rows: DataFrame, begins: Column, name: str) -> DataFrame:
    """Numbers runs from 0 by where they begin (null: there); ``begins`` may use ``_prev``, the row before."""
    rows = with_previous(rows, ["media_id"], "seg_ix", ["end_s", "speaker"]).withColumn("_b", F.coalesce(begins.cast("int"), F.lit(1)))
    return with_running_sum(rows, ["media_id"], "seg_ix", "_b", name).withColumn(name, F.col(name) - 1).drop("_b", "_prev")


def dialogue(segments: DataFrame) -> DataFrame:
    """``media_id, dialogue``: consecutive segments of a speaker merged, blocks set apart by a blank line."""
    rows = spoken_segments(segments).withColumn("speaker", F.coalesce(F.nullif("speaker", F.lit("")), F.lit("Speaker 1")))
    blocks = _islands(rows, F.col("speaker") != F.col("_prev.speaker"), "block")
    merged = blocks.groupBy("media_id", "block").agg(F.min_by("speaker", "seg_ix").alias("speaker"), F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY seg_ix)").alias("said"))
    lines = merged.withColumn("line", F.concat("speaker", F.lit(": "), "said"))
    return lines.groupBy("media_id").agg(F.expr("listagg(line, '\n\n') WITHIN GROUP (ORDER BY block)").alias("dialogue"))


def paragraphs(segments: DataFrame, gap: float = 2.0) -> DataFrame:
    """``media_id, paragraph_ix, paragraph``: a pause of more than ``gap`` seconds begins a new one."""
    rows = spoken_segments(segments)
    islands = _islands(rows, F.col("start_s") - F.col("_prev.end_s") > gap, "paragraph_ix")
    return islands.groupBy("media_id", "paragraph_ix").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY seg_ix)").alias("paragraph"))


def chunk_windows(recordings: DataFrame, length: float = 30.0, overlap: float = 2.0) -> DataFrame:
    """``media_id, chunk_ix, chunk_start, chunk_end, lo, hi``: overlapping windows over ``duration`` with what each owns.

    Ownership passes at the middle of an overlap; it is unbounded (null) at both ends."""
    if overlap >= length > 0:
        raise ValueError("overlap must be shorter than the chunks")
    step = length - overlap
    d = F.coalesce("duration", F.lit(0.0))
    last = F.when((d <= 0) | F.lit(length <= 0) | (d <= length), F.lit(0)).otherwise(F.ceil((d - length) / step)).cast("int")
    rows = recordings.select("media_id", d.alias("_d"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_ix"))
    start = F.col("chunk_ix") * F.lit(step)
    end = F.when(F.col("_d") <= 0, F.lit(0.0)).otherwise(F.least(start + F.lit(length), F.col("_d")) if length > 0 else F.col("_d"))
    rows = rows.select("media_id", "chunk_ix", start.alias("chunk_start"), end.alias("chunk_end"))
    w = Window.partitionBy("media_id").orderBy("chunk_ix")
    cut = (F.lead("chunk_start").over(w) + F.col("chunk_end")) / 2
    return rows.withColumn("hi", cut).withColumn("lo", F.lag("hi").over(w)).select("media_id", "chunk_ix", "chunk_start", "chunk_end", "lo", "hi")


def stitch(chunked: DataFrame) -> DataFrame:
    """Keep what starts inside ``[lo, hi)`` of each row of ``start_s, end_s, text, words, lo, hi`` (null bounds are open).

    A segment that straddles a bound is rebuilt from its words inside; one without words goes by its start."""
    lo, hi = F.coalesce("lo", F.lit(float("-inf"))), F.coalesce("hi", F.lit(float("inf")))
    words = F.coalesce("words", F.expr("cast(array() as array<struct<start_s:double,end_s:double,word:string>>)"))
    rows = chunked.withColumn("words", words).withColumn("_in", F.filter("words", lambda w: (w["start_s"] >= lo) & (w["start_s"] < hi)))
    bare = F.size("words") == 0
    rows = rows.where((bare & (F.col("start_s") >= lo) & (F.col("start_s") < hi)) | (F.size("_in") > 0))
    cut = ~bare & (F.size("_in") < F.size("words"))
    first = F.element_at("_in", 1)["start_s"] == F.element_at("words", 1)["start_s"]
    last = F.element_at("_in", -1)["start_s"] == F.element_at("words", -1)["start_s"]
    return (
        rows.withColumn("start_s", F.when(cut & ~first, F.try_element_at("_in", F.lit(1))["start_s"]).otherwise(F.col("start_s")))
        .withColumn("end_s", F.when(cut & ~last, F.try_element_at("_in", F.lit(-1))["end_s"]).otherwise(F.col("end_s")))
        .withColumn("text", F.when(cut, strip(F.array_join(F.transform("_in", lambda w: w["word"]), ""))).otherwise(F.col("text")))
        .withColumn("words", F.when(bare, F.col("words")).otherwise(F.col("_in")))
        .drop("_in")
    )


def overlap_speakers(segments: DataFrame, turns: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Adds the speaker of the turn (``media_id, turn_ix, t_start, t_end, t_speaker``) that overlaps a segment most.

    Ties go to the first turn, segments without any overlap to "Speaker 1". The join has an equality on recording and time
    bucket, so a long recording spreads over tasks; a pair that meets in several buckets counts once."""
    rows = timed_segments(segments).select("media_id", "seg_ix", "start_s", "end_s")
    span = lambda a, b: F.sequence(F.floor(a / bucket), F.floor(F.greatest(a, b) / bucket))
    left = rows.where("end_s > start_s").withColumn("_b", F.explode(span(F.col("start_s"), F.col("end_s"))))
    right = turns.where("t_end > t_start").withColumn("_b", F.explode(span(F.col("t_start"), F.col("t_end"))))
    pairs = left.join(right, ["media_id", "_b"]).where("start_s < t_end AND t_start < end_s")
    # The pair belongs to the bucket in which its overlap begins.
    pairs = pairs.where(F.floor(F.greatest("start_s", "t_start") / bucket) == F.col("_b"))
    shared = F.least("end_s", "t_end") - F.greatest("start_s", "t_start")
    best = pairs.groupBy("media_id", "seg_ix").agg(F.max_by("t_speaker", F.struct(shared.alias("o"), -F.col("turn_ix"))).alias("_s"))
    return rows.join(best, ["media_id", "seg_ix"], "left").withColumn("speaker", F.coalesce("_s", F.lit("Speaker 1"))).drop("_s")


def recording_stats(segments: DataFrame) -> DataFrame:
    """Text, duration, number of segments and whether any has a speaker, by recording."""
    rows = timed_segments(segments).withColumn("said", strip(F.coalesce("text", F.lit(""))))
    return rows.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.max("end_s").alias("duration"),
        F.max(F.coalesce(F.col("speaker") != "", F.lit(False))).alias("has_speakers"),
        F.expr("coalesce(listagg(nullif(said, ''), ' ') WITHIN GROUP (ORDER BY start_s, seg_ix), '')").alias("text"),
    )


_BUCKETED = struct("media_id long, seg_ix int, bucket_ix int, anchor double, said string")


def timed_buckets(segments: DataFrame, step: float = 30.0) -> DataFrame:
    """``media_id, bucket_ix, bucket_start, bucket_text``: lines of about ``step`` seconds in list order.

    A bucket closes with the segment that ends ``step`` after the bucket's first start; as that anchor moves, a recording is
    walked in order in one task, one row at a time."""
    rows = timed_segments(segments).withColumn("said", strip(F.coalesce("text", F.lit("")))).select("media_id", "seg_ix", "start_s", "end_s", "said")
    schema = to_arrow_schema(_BUCKETED)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, number, anchor = None, 0, None
        for b in batches:
            out = []
            for media, seg, start, end, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if media != owner:
                    owner, number, anchor = media, 0, None
                anchor = start if anchor is None else anchor
                out.append((media, seg, number, anchor, said))
                if end - anchor >= step:
                    number, anchor = number + 1, None
            yield arrow_batch(out, schema)

    walked = rows.repartition(partitions_for(rows), "media_id").sortWithinPartitions("media_id", "seg_ix").mapInArrow(walk, _BUCKETED)
    return walked.groupBy("media_id", "bucket_ix").agg(F.min("anchor").alias("bucket_start"), F.expr("listagg(said, ' ') WITHIN GROUP (ORDER BY seg_ix)").alias("bucket_text"))


APPROXIMATE = "Speaker labels are approximate: they follow pauses, not voices."


def transcript_text(segments: DataFrame, heuristic: DataFrame | None = None) -> DataFrame:
    """``media_id, body``: dialogue where any segment has a speaker, else paragraphs. ``heuristic`` lists the recordings
    (``media_id``) whose speakers come from pauses; a note goes before their dialogue."""
    named = spoken_segments(segments).where("speaker IS NOT NULL AND speaker <> ''").select("media_id").distinct()
    talk = dialogue(segments).join(named, "media_id", "left_semi").withColumnRenamed("dialogue", "body")
    if heuristic is not None:
        noted = heuristic.select("media_id").distinct().withColumn("_n", F.lit(1))
        talk = talk.join(noted, "media_id", "left").select("media_id", F.when(F.col("_n") == 1, F.concat(F.lit(APPROXIMATE + "\n\n"), "body")).otherwise(F.col("body")).alias("body"))
    plain = paragraphs(segments).join(named, "media_id", "left_anti").groupBy("media_id").agg(F.expr("listagg(paragraph, '\n\n') WITHIN GROUP (ORDER BY paragraph_ix)").alias("body"))
    return talk.unionByName(plain).withColumn("body", F.concat(strip(F.col("body")), F.lit("\n")))
