import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import types as T

from cuelake.session import local_session, ship

WORD = T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("word", T.StringType())])
SEGMENT = T.StructType(
    [T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("speaker", T.StringType()), T.StructField("words", T.ArrayType(WORD))]
)
#: Columns that queries make themselves; every table gets them as strangers.
STRANGERS = "term z kind ids source_ n _b _key _block turn sentence char_from score"


def _schema(fields: str, extra: str = "") -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "ts": T.TimestampNTZType(), "lines": T.ArrayType(T.StringType()), "segments": T.ArrayType(SEGMENT)}
    made = [T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in fields.split())]
    taken = {f.name for f in made}
    return T.StructType(made + [T.StructField(n, T.StringType()) for n in extra.split() if n not in taken])


TABLES = {
    "transcripts": "media_id:long channel_id:long language:string duration:double text:string model_size:string diarization:string finished_at:ts segments:segments",
    "segments": "media_id:long seg_ix:int channel_id:long start_s:double end_s:double text:string speaker:string ingested_at:ts",
    "cues": "media_id:long cue_index:int channel_id:long start_s:double end_s:double lines:lines speaker:string label:string",
    "raw_transcripts": "raw_id:long file_name:string received_at:ts payload:string",
    "channels": "channel_id:long channel_name:string home_language:string max_speakers:int",
    "documents": "doc_id:long text:string lang:string source:string n_chars:long kind:string channel_id:long created_at:ts",
    "labels": "doc_id:long annotator:string quality:int toxic:int",
    "mix_targets": "source:string target_share:double max_repeats:int",
    "events": "event_id:long ts:ts user_id:long event_type:string value:double props:string",
}

LONG = "The host praised the bridge. " * 4000
NOW = dt.datetime(2024, 5, 1)

EDGE = {
    "transcripts": [
        (1, 1, "en", 20.0, "Hello there. It works!", "tiny", "", NOW, [(0.0, 2.0, "Hello there.", "A", [(0.0, 1.0, " Hello"), (1.0, 2.0, " there.")]), (2.0, 4.0, "It works!", None, None)]),
        (2, None, None, None, None, None, None, None, None),
        (3, 1, " ", 0.0, "", "", None, NOW, []),
        (4, 1, "xx", 5.0, "   \n ", None, None, NOW, [(None, None, None, None, [])]),
        (5, 1, "de", 9.0, LONG, "base", "pyannote", NOW, [(0.0, 9.0, LONG, "B", [])]),
    ],
    "segments": [
        (1, 0, 1, 0.0, 2.0, "Hello there.", "A", NOW), (1, 0, 1, 0.0, 2.0, "Hello there.", "A", NOW + dt.timedelta(days=2)), (1, 1, 1, 2.0, 4.0, "It works!", None, NOW), (1, 2, 1, 2.0, 4.0, "um,", "?", NOW),
        (2, 0, None, None, None, None, None, None), (3, 0, 1, 5.0, 3.0, "", "", NOW), (4, 0, 1, 1.0, 1.0, "   ", " ", NOW), (None, 0, 1, 1.0, 2.0, "lost", "A", NOW), (4, None, 1, 1.0, 2.0, "lost", "A", NOW), (5, 0, 1, 0.0, 9.0, LONG, "B", NOW), (5, 1, 1, 0.0, 9.0, "same start", "B", NOW),
    ],
    "cues": [(1, 1, 1, 0.0, 2.0, ["Hello"], "A", "[A]"), (1, 1, 1, 0.0, 2.0, ["Hello"], "A", "[A]"), (1, 2, 1, 1.0, 1.0, [], None, None), (1, 3, 1, None, 4.0, None, None, None), (2, None, None, None, None, [None, " "], "", ""), (None, 1, 1, 0.0, 1.0, ["x"], None, None)],
    "raw_transcripts": [
        (1, "a.transcript.json", NOW, '{"segments":[{"start":0,"end":"1.5","text":"Hi","words":[{"start":0,"end":1,"word":" Hi"}]}]}'), (2, "b.transcript.json", NOW, None), (3, None, None, ""), (4, "A.transcript.json", NOW, "WEBVTT"), (5, "c.transcript.json", NOW, '﻿{"segments":[]}'), (6, "d.transcript.json", NOW, '{"segments":[null]}'), (7, "e.transcript.json", NOW, '{"segments":[{"start":"x","end":1}]}'), (8, "e.transcript.json", NOW, '{"segments":[{"start":1,"end":2,"words":[{"start":1}]}]}'), (9, "f", NOW, '{"segments":[]} rest'), (10, "g.transcript.json", NOW, '{"segments":{"0":{"start":1,"end":2}}}'),
    ],
    "channels": [(1, "A", "en", 2), (2, None, None, None)],
    "documents": [(1, "Hello there. You useless fool, go jump off a bridge.", "en", "podcast", 50, "notes", 1, NOW), (2, None, None, None, None, None, None, None), (3, "", "en", "Podcast ", 0, "notes", 1, NOW), (4, " \n\t", "en", "lecture", 3, "summary", 1, NOW), (5, LONG, "en", "lecture", len(LONG), "transcript", 1, NOW), (6, "Hello there. You useless fool, go jump off a bridge.", "en", "other", 50, "notes", 1, NOW)],
    "labels": [(1, "a", 1, 1), (1, "b", 2, 0), (2, "a", None, None), (5, "a", 0, 0), (None, "a", 1, 1), (99, "a", 1, 7)],
    "mix_targets": [("podcast", 0.5, 3), ("lecture", 0.4, 1), ("nowhere", 0.1, 2), (None, None, None)],
    "events": [(1, NOW, 1, "a", 1.0, "{}"), (2, NOW, 1, "a", None, None), (3, None, None, None, None, None)],
}


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4, "tests", "3g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


def write_tables(spark, folder, rows, strangers=""):
    for name, fields in TABLES.items():
        schema = _schema(fields, strangers)
        base = len(fields.split())
        data = [(*r, *["x"] * (len(schema) - base)) for r in rows.get(name, [])]
        spark.createDataFrame(data, schema).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge_folder(spark, tmp_path_factory):
    """Small tables of nulls, blanks, repeats, ties, a long text and columns with clashing names."""
    return write_tables(spark, tmp_path_factory.mktemp("edge"), EDGE, STRANGERS)


@pytest.fixture(scope="session")
def empty_folder(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty"), {})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
