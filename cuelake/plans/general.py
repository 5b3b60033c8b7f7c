"""Queries of the general problems: p5 (nested records) and p7 (intervals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators.intervals import merge_intervals, milliseconds
from cuelake.operators.nested import flatten_nested, payload_tables
from cuelake.session import read_table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of all segments (``word_ix`` -1) and words of the readable payloads."""
    tables = payload_tables(read_table(spark, folder, "raw_transcripts"))
    segments = tables["transcript_segments"].select("raw_id", F.col("_ord").alias("seg_ix"), F.lit(-1).alias("word_ix"))
    words = tables["transcript_segments_words"].select("raw_id", F.element_at(F.split("_parent", "/"), -1).cast("int").alias("seg_ix"), F.col("_ord").alias("word_ix"))
    return segments.unionByName(words)


def p5_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return payload_tables(read_table(spark, folder, "raw_transcripts"))["transcript"]


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    return payload_tables(read_table(spark, folder, "raw_transcripts"))["transcript_segments"]


def p5_words(spark: SparkSession, folder: str) -> DataFrame:
    return payload_tables(read_table(spark, folder, "raw_transcripts"))["transcript_segments_words"]


def p5_recording_words(spark: SparkSession, folder: str) -> DataFrame:
    """The word table of ``transcripts.segments``."""
    table = read_table(spark, folder, "transcripts").select("media_id", F.struct("segments").alias("_record"))
    words = flatten_nested(table, "media_id", "_record", "transcript")["transcript_segments_words"]
    return words.select("media_id", F.element_at(F.split("_parent", "/"), -1).cast("int").alias("seg_ix"), F.col("_ord").alias("word_ix"), "start_s", "end_s", "word")


def interval_rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        read_table(spark, folder, name).select(F.lit(name).alias("origin"), "media_id", milliseconds("start_s").alias("f"), milliseconds("end_s").alias("t")).where("t > f") for name in ("segments", "cues")
    ]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return merge_intervals(interval_rows(spark, folder), ["origin", "media_id"], F.col("f"), F.col("t"))


QUERIES = {"p5_found": p5_found, "p5_transcripts": p5_transcripts, "p5_segments": p5_segments, "p5_words": p5_words, "p5_recording_words": p5_recording_words, "p7_found": p7_found}

READABLE = """
    j AS (SELECT raw_id, try_cast(regexp_replace(payload, '^\\x{FEFF}', '') AS JSON) AS j FROM raw_transcripts),
    a AS (SELECT raw_id, j, CAST(json_extract(j, '$.segments[*]') AS JSON[]) AS s FROM j WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.segments') = 'ARRAY'),
    b AS (SELECT raw_id, s, unnest(range(len(s))) AS i FROM a), c AS (SELECT raw_id, CAST(i AS INTEGER) AS seg_ix, s[i + 1] AS x FROM b),
    d AS (SELECT raw_id, seg_ix, x, CASE WHEN json_type(x, '$.words') = 'ARRAY' THEN CAST(json_extract(x, '$.words[*]') AS JSON[]) ELSE [] END AS w,
          json_type(x) = 'OBJECT' AND coalesce(json_type(x, '$.words'), 'NULL') IN ('NULL', 'ARRAY') AND coalesce(json_type(x, '$.start'), '') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') AND try_cast(x ->> '$.start' AS DOUBLE) IS NOT NULL
          AND coalesce(json_type(x, '$.end'), '') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') AND try_cast(x ->> '$.end' AS DOUBLE) IS NOT NULL AS ok FROM c),
    e AS (SELECT *, coalesce(len(list_filter(w, lambda y: NOT coalesce(json_type(y) = 'OBJECT' AND try_cast(y ->> '$.start' AS DOUBLE) IS NOT NULL AND try_cast(y ->> '$.end' AS DOUBLE) IS NOT NULL, false))), 0) = 0 AS wok FROM d),
    g AS (SELECT raw_id FROM a WHERE raw_id NOT IN (SELECT raw_id FROM e WHERE NOT coalesce(ok AND wok, false)))"""

ORACLES = {
    "p5_found": f"""WITH {READABLE}, f AS (SELECT * FROM e WHERE raw_id IN (SELECT raw_id FROM g))
        SELECT raw_id, seg_ix, -1 AS word_ix FROM f UNION ALL SELECT raw_id, seg_ix, CAST(unnest(range(len(w))) AS INTEGER) FROM f""",
    "p5_transcripts": f"""WITH {READABLE} SELECT a.raw_id, CAST(a.raw_id AS VARCHAR) AS _key, NULL::VARCHAR AS _parent, 0 AS _ord, j ->> '$.diarization' AS diarization, j ->> '$.duration' AS duration, j ->> '$.language' AS language,
        j ->> '$.model_size' AS model_size, j ->> '$.text' AS text FROM a JOIN g ON g.raw_id = a.raw_id""",
    "p5_segments": f"""WITH {READABLE} SELECT raw_id, raw_id || '/segments/' || seg_ix AS _key, CAST(raw_id AS VARCHAR) AS _parent, seg_ix AS _ord, x ->> '$.end' AS "end", x ->> '$.meta.decode.temperature' AS meta_decode_temperature,
        x ->> '$.speaker' AS speaker, x ->> '$.start' AS start, x ->> '$.text' AS text FROM e WHERE raw_id IN (SELECT raw_id FROM g)""",
    "p5_words": f"""WITH {READABLE}, f AS (SELECT raw_id, seg_ix, w, unnest(range(len(w))) AS k FROM e WHERE raw_id IN (SELECT raw_id FROM g)), h AS (SELECT raw_id, seg_ix, k, w[k + 1] AS y FROM f)
        SELECT raw_id, raw_id || '/segments/' || seg_ix || '/words/' || k AS _key, raw_id || '/segments/' || seg_ix AS _parent, CAST(k AS INTEGER) AS _ord, y ->> '$.end' AS "end", y ->> '$.probability' AS probability, y ->> '$.start' AS start, y ->> '$.word' AS word FROM h""",
    "p5_recording_words": """
        WITH s AS (SELECT media_id, segments, unnest(range(len(segments))) AS seg_ix FROM transcripts WHERE segments IS NOT NULL),
             w AS (SELECT media_id, CAST(seg_ix AS INTEGER) AS seg_ix, segments[seg_ix + 1].words AS words FROM s),
             x AS (SELECT media_id, seg_ix, words, unnest(range(len(words))) AS word_ix FROM w WHERE words IS NOT NULL)
        SELECT media_id, seg_ix, CAST(word_ix AS INTEGER) AS word_ix, words[word_ix + 1].start_s AS start_s,
               words[word_ix + 1].end_s AS end_s, words[word_ix + 1].word AS word FROM x""",
    "p7_found": """
        WITH r AS (SELECT 'segments' AS origin, media_id, CAST(round_even(start_s * 1000, 0) AS BIGINT) AS f, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS t FROM segments
                   UNION ALL
                   SELECT 'cues', media_id, CAST(round_even(start_s * 1000, 0) AS BIGINT), CAST(round_even(end_s * 1000, 0) AS BIGINT) FROM cues),
             o AS (SELECT *, max(t) OVER (PARTITION BY origin, media_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE t > f),
             i AS (SELECT *, sum(CASE WHEN before IS NULL OR f > before THEN 1 ELSE 0 END) OVER (PARTITION BY origin, media_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS n FROM o),
             p AS (SELECT origin, media_id, n, min(f) AS f, max(t) AS t FROM i GROUP BY origin, media_id, n),
             g AS (SELECT origin, media_id, t AS f, lead(f) OVER (PARTITION BY origin, media_id ORDER BY n) AS t FROM p)
        SELECT origin, media_id, 'period' AS kind, f AS from_ms, t AS to_ms FROM p
        UNION ALL SELECT origin, media_id, 'gap', f, t FROM g WHERE t IS NOT NULL""",
}
