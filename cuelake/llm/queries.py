"""Queries of the language problems over the tables of TESTDATA.md."""

from __future__ import annotations

import functools
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import abuse, distinctive, language, mixing, pii, sentences, tokens, turns
from cuelake.session import materialise, partitions_for, read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets of every sentence of every transcript."""
    return sentences.sentences(read_table(spark, folder, "transcripts").select("media_id", "text"), "media_id")


def p1_segment_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence units of the segments' texts."""
    rows = read_table(spark, folder, "segments").select("media_id", "seg_ix", "text").dropDuplicates(["media_id", "seg_ix"])
    rows = rows.select(F.concat_ws("/", "media_id", "seg_ix").alias("segment"), "text")
    return sentences.sentences(rows, "segment", with_text=True)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that recur in a recording and are rare in the collection, by the counts of the definition alone: in a recording
    with a large part of all tokens a case can have a score below 0."""
    scored = distinctive.distinctive_terms(read_table(spark, folder, "segments"))
    return scored.where("n_segments >= 3 AND n_recordings <= 3").select("media_id", "term")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.distinctive_terms(read_table(spark, folder, "segments")).withColumn("z", F.round("z", 6))


def _segment_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with a text, repeated rows once."""
    rows = read_table(spark, folder, "segments").select("media_id", "seg_ix", "text").where("text IS NOT NULL")
    # One exchange in explicit partitions, which adaptive execution doesn't merge before the work in Python.
    return rows.repartition(partitions_for(rows), "media_id", "seg_ix").dropDuplicates(["media_id", "seg_ix"])


def _languages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parts of all segments (and of the texts of recordings that have no segment rows), and the recordings' languages."""
    transcripts = read_table(spark, folder, "transcripts").select("media_id", "language", "text")
    model = language.fit_on(transcripts)
    texts = _segment_texts(spark, folder)
    whole = transcripts.where("text IS NOT NULL").join(texts.select("media_id").distinct(), "media_id", "left_anti")
    rows = texts.unionByName(whole.select("media_id", F.lit(-1).alias("seg_ix"), "text"))
    parts = materialise(language.language_parts(rows, model))
    return parts, language.recording_languages(parts, transcripts)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings whose label names no or another language, and every language of each mixed segment."""
    parts, recordings = _languages(spark, folder)
    wrong = recordings.where("label IS NULL OR label <> lang").select("media_id", F.lit(-1).alias("seg_ix"), "lang")
    return wrong.unionByName(parts.where("mixed AND seg_ix >= 0").select("media_id", "seg_ix", "lang"))


def p3_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every recording."""
    return _languages(spark, folder)[1]


def p3_mixed_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Languages and confidences of the mixed segments."""
    return _languages(spark, folder)[0].where("mixed AND seg_ix >= 0").select("media_id", "seg_ix", "lang", "confidence")


_fresh_key = functools.lru_cache(maxsize=1)(lambda: secrets.token_bytes(32))


def _secret(spark: SparkSession) -> bytes:
    """The key of pseudonyms: ``spark.cuelake.pii.key`` of the session, at least 16 characters; where none is set, a fresh one,
    which links values within one application only."""
    named = spark.conf.get("spark.cuelake.pii.key", None)
    return named.encode() if named else _fresh_key()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Type and occurrence of every personal detail of the segments."""
    return pii.find_details(_segment_texts(spark, folder), ["media_id", "seg_ix"]).select("media_id", "seg_ix", "pii_type", "occurrence")


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with placeholders."""
    return pii.redact(read_table(spark, folder, "segments").select("media_id", "seg_ix", "text").dropDuplicates(["media_id", "seg_ix"]), ["media_id", "seg_ix"], "text", _secret(spark))


def p4_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts with placeholders."""
    return pii.redact(read_table(spark, folder, "transcripts").select("media_id", "text"), ["media_id"], "text", _secret(spark))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """First and last segment of every speaker turn."""
    return turns.speaker_turns(read_table(spark, folder, "segments")).select("media_id", "first_seg_ix", "last_seg_ix")


def p6_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.speaker_turns(read_table(spark, folder, "segments"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_column(read_table(spark, folder, "documents"), "doc_id")


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens of every document, and whether decoding gives the text again."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text")
    again = tokens.decode_column(tokens.encode_column(documents, "doc_id"), "doc_id").withColumnRenamed("text", "decoded")
    return documents.join(again, "doc_id").select("doc_id", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mix with the number of times each occurs."""
    return mixing.mix(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of the sources."""
    return mixing.mix(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))[1]


def _abuse(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.score_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Categories that documents hold."""
    return abuse.held_categories(_abuse(spark, folder))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score, categories and evidence of every document."""
    return _abuse(spark, folder)


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of every source."""
    return abuse.rates_by_source(_abuse(spark, folder))


QUERIES = {
    "p1_found": p1_found,
    "p1_segment_sentences": p1_segment_sentences,
    "p2_found": p2_found,
    "p2_scores": p2_scores,
    "p3_found": p3_found,
    "p3_recordings": p3_recordings,
    "p3_mixed_segments": p3_mixed_segments,
    "p4_found": p4_found,
    "p4_segments": p4_segments,
    "p4_transcripts": p4_transcripts,
    "p6_found": p6_found,
    "p6_turns": p6_turns,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

_P2 = """
    WITH d AS (SELECT DISTINCT media_id, seg_ix, text FROM segments WHERE text IS NOT NULL AND media_id IS NOT NULL),
         e AS (SELECT media_id, seg_ix, lower(unnest(list_filter(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{00FF}]+'), lambda t: length(t) >= 4))) AS term FROM d),
         c AS (SELECT media_id, term, count(*) AS tf, count(DISTINCT seg_ix) AS n_segments FROM e GROUP BY media_id, term),
         w AS (SELECT term, sum(tf) AS all_tf, count(*) AS n_recordings FROM c GROUP BY term),
         m AS (SELECT media_id, sum(tf) AS n FROM c GROUP BY media_id),
         t AS (SELECT sum(tf) AS total FROM c),
         j AS (SELECT c.*, w.n_recordings, CAST(c.tf AS DOUBLE) + 500.0 * w.all_tf / t.total AS own, CAST(w.all_tf - c.tf AS DOUBLE) + 500.0 * w.all_tf / t.total AS rest,
                      CAST(m.n AS DOUBLE) AS n, CAST(t.total AS DOUBLE) AS total FROM c JOIN w USING (term) JOIN m USING (media_id), t),
         z AS (SELECT media_id, term, tf, n_segments, n_recordings,
                      (ln(own / (n + 500.0 - own)) - ln(rest / greatest(total - n + 500.0 - rest, 1e-9))) / sqrt(1.0 / own + 1.0 / rest) AS z FROM j)
"""

ORACLES = {
    # What a round trip must give: every text again.
    "p8_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p2_found": _P2 + "SELECT media_id, term FROM z WHERE n_segments >= 3 AND n_recordings <= 3",
    "p2_scores": _P2 + "SELECT media_id, term, CAST(tf AS BIGINT) AS tf, n_segments, n_recordings, round(z, 6) AS z FROM z",
}
