"""Reading transcripts and media listings, and writing one file for each recording."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cuelake.operators.nested import _CORE, _JSON, NUMBER, _wrapped, readable_payloads


def read_payloads(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """``path, payload``: whole files as text."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``path, text``: plain text files as they are, without a byte-order mark; they have no times."""
    return read_payloads(spark, folder, pattern).select("path", F.regexp_replace("payload", "^\\x{FEFF}", "").alias("text"))


def media_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size`` of the regular files directly in a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", F.col("length").alias("size"))


def decode_transcripts(rows: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """``key, language, duration, model_size, diarization, text, segments`` of the readable payloads, with defaults: a
    missing text is made of the segments' texts, a missing duration is the latest end."""
    good = readable_payloads(rows.select(key, payload), payload)
    p = F.get(F.from_json(_wrapped(F.col(payload)), _CORE, _JSON)["root"], F.lit(0))
    number = lambda c: F.replace(F.trim(c), F.lit('"'), F.lit("")).try_cast("double")
    word = lambda w: F.struct(number(w["start"]).alias("start_s"), number(w["end"]).alias("end_s"), F.coalesce(w["word"], F.lit("")).alias("word"))
    segment = lambda s: F.struct(
        number(s["start"]).alias("start_s"), number(s["end"]).alias("end_s"), F.coalesce(s["text"], F.lit("")).alias("text"), s["speaker"].alias("speaker"), F.transform(F.coalesce(s["words"], F.array()), word).alias("words")
    )
    out = good.select(key, p.alias("p")).select(key, "p", F.transform("p.segments", segment).alias("segments"))
    texts = F.filter(F.transform("segments", lambda s: F.trim(s["text"])), lambda t: t != "")
    last = F.array_max(F.transform("segments", lambda s: s["end_s"]))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(
        key, text("p.language").alias("language"), F.coalesce(F.nullif(number(F.col("p.duration")), F.lit(0.0)), last, F.lit(0.0)).alias("duration"), text("p.model_size").alias("model_size"),
        text("p.diarization").alias("diarization"), F.coalesce(F.nullif(text("p.text"), F.lit("")), F.array_join(texts, " ")).alias("text"), "segments",
    )


def transcript_json(segments: str = "segments") -> Column:
    """JSON text of a transcript row with columns language, duration, model_size, text, diarization and segments."""
    one = lambda s: F.struct(
        s["start_s"].alias("start"), s["end_s"].alias("end"), s["text"].alias("text"), s["speaker"].alias("speaker"), F.transform(s["words"], lambda w: F.struct(w["start_s"].alias("start"), w["end_s"].alias("end"), w["word"].alias("word"))).alias("words")
    )
    return F.to_json(F.struct("language", "duration", "model_size", "text", F.nullif("diarization", F.lit("")).alias("diarization"), F.transform(segments, one).alias("segments")))


class _FileWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyarrow.fs import FileSystem

        # A local path or an address of a file system that all executors reach (hdfs://, s3://, ...).
        system, base = FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        for row in iterator:
            path = f"{base}/{row['path']}"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(f"{path}.part") as f:
                f.write(row["content"].encode("utf-8"))
            system.move(f"{path}.part", path)  # a task that runs again writes the same file
        return WriterCommitMessage()


class RecordingFiles(DataSource):
    """``df.write.format("recording_files").option("path", folder)``: rows ``path, content``, one file each."""

    @classmethod
    def name(cls) -> str:
        return "recording_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> _FileWriter:  # noqa: ANN001
        return _FileWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Rows ``path, content`` as files below a folder that all executors share."""
    folder = folder if "://" in folder else os.path.abspath(folder)
    rows.sparkSession.dataSource.register(RecordingFiles)
    rows.select("path", "content").write.format("recording_files").option("path", folder).mode("append").save()


def payload_errors(rows: DataFrame, key: str = "path", payload: str = "payload") -> DataFrame:
    """``key, kind, message`` of payloads that aren't transcripts: broken JSON, another object, or a broken segment (the first)."""
    parsed = F.try_parse_json(F.regexp_replace(F.coalesce(payload, F.lit("")), "^\\x{FEFF}", ""))
    timed = lambda x: F.coalesce(F.try_variant_get(x, "$.start", "string").rlike(NUMBER) & F.try_variant_get(x, "$.end", "string").rlike(NUMBER), F.lit(False))
    words = lambda s: F.try_variant_get(s, "$.words", "array<variant>")
    wordless = lambda s: F.try_variant_get(s, "$.words", "string").isNull()
    good = lambda s: timed(s) & (wordless(s) | (words(s).isNotNull() & F.forall(words(s), timed)))
    segments = F.try_variant_get("_v", "$.segments", "array<variant>")
    bad = F.filter(F.transform("_s", lambda s, i: F.when(~F.coalesce(good(s), F.lit(False)), i)), lambda i: i.isNotNull())
    out = rows.select(key, parsed.alias("_v")).withColumn("_s", segments).withColumn("_bad", F.array_min(bad))
    kind = F.when(F.col("_v").isNull(), "broken").when(F.col("_s").isNull(), "foreign").when(F.col("_bad").isNotNull(), "malformed")
    message = F.when(F.col("_v").isNull(), "no JSON").when(F.col("_s").isNull(), "no list of segments").otherwise(F.concat(F.lit("segment "), F.col("_bad").cast("string")))
    return out.select(key, kind.alias("kind"), message.alias("message")).where("kind IS NOT NULL")
