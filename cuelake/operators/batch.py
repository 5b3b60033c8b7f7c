"""Runs over many recordings: folder names, resumption, manifests, reports, and row-level isolation of failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cuelake.session import arrow_batch, struct

# File name extensions of media.
AUDIO = ".mp3 .wav .m4a .flac .ogg .aac .wma .opus".split()
VIDEO = ".mp4 .mkv .mov .avi .webm .flv .wmv .m4v .mpg .mpeg".split()


def media_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``name, stem, suffix, is_video`` and keeps files with an extension of media, whatever its case."""
    name = F.element_at(F.split(path, "/"), -1)
    rows = files.withColumn("name", name).withColumn("suffix", F.regexp_extract("name", r"^.+(\.[^.]+)$", 1))
    rows = rows.withColumn("stem", F.expr("substring(name, 1, length(name) - length(suffix))"))
    return rows.where(F.lower("suffix").isin(AUDIO + VIDEO)).withColumn("is_video", F.lower("suffix").isin(VIDEO))


_NAMED = struct("path string, folder string")


def folder_names(files: DataFrame) -> DataFrame:
    """``path, folder``: the first file with a stem (by path, case aside) keeps it, others get their extension, further
    clashes a number.

    First names are unique per stem, so only names with an appended extension can clash with anything; those are few and
    settled in order within the group of names that share a base."""
    rows = files.select("path", "stem", "suffix").withColumn("key", F.lower("stem"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("path")) == 1
    rows = rows.withColumn("name", F.when(first, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), F.lower(F.ltrim(F.col("suffix"), F.lit("."))))))
    rows = rows.withColumn("k", F.lower("name"))
    n = F.row_number().over(Window.partitionBy("k").orderBy("path"))
    rows = rows.withColumn("n", n)
    plain = rows.where("n = 1").select("path", F.col("name").alias("folder"), "k")
    # The n-th use of a name takes the n-th number that no plain name has taken.
    again = rows.where("n > 1").withColumn("i", F.explode(F.sequence(F.lit(2), F.col("n") + 1)))
    numbered = again.withColumn("t", F.concat("name", F.lit("-"), F.col("i").cast("string")))
    free = numbered.join(plain.select(F.col("k").alias("taken")), F.lower("t") == F.col("taken"), "left_anti")
    choice = free.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("i"))).where("r = n - 1").select("path", F.col("t").alias("folder"))
    return plain.select("path", "folder").unionByName(choice)


def unfinished(files: DataFrame, manifests: DataFrame, present: DataFrame) -> DataFrame:
    """Files without a finished run. ``files``: path, name, size; ``manifests``: folder, source_name, source_size,
    outputs; ``present``: folder, output. A run is finished if its manifest names the same file and size and at least one
    output, and all of them are present. Options play no part."""
    listed = manifests.select("folder", "source_name", "source_size", F.explode("outputs").alias("output"))
    kept = present.select("folder", "output").distinct().withColumn("_there", F.lit(1))
    whole = listed.join(kept, ["folder", "output"], "left").groupBy("folder", "source_name", "source_size").agg(F.min(F.coalesce("_there", F.lit(0))).alias("ok")).where("ok = 1")
    return files.join(whole, (F.col("name") == F.col("source_name")) & F.col("size").eqNullSafe(F.col("source_size")) & (files["folder"] == whole["folder"]), "left_anti")


def manifest(runs: DataFrame, tool: str = "cuelake", version: str = "0.1.0") -> DataFrame:
    """Adds ``manifest``: the JSON marker of a finished run, to be written after all outputs. Of warnings only the first lines
    are kept; ``finished_at`` (UTC) and ``options`` (a struct) go in if ``runs`` has them."""
    first = lambda w: F.trim(F.element_at(F.split(F.trim(w), "\n"), 1))
    stamp = [F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finished_at")] if "finished_at" in runs.columns else []
    body = F.struct(
        F.lit(tool).alias("tool"), F.lit(version).alias("version"), *stamp, F.struct(F.col("source_name").alias("name"), F.col("source_size").alias("size")).alias("source"),
        "language", F.bround("duration", 3).alias("duration"), "outputs", F.transform(F.filter("warnings", lambda w: F.trim(w) != ""), first).alias("warnings"), "captions",
        *(["options"] if "options" in runs.columns else []),
    )
    return runs.withColumn("manifest", F.to_json(body, {"ignoreNullFields": "false"}))


def batch_report(runs: DataFrame) -> DataFrame:
    """One row ``report``: counts and a section for each run (name, ok, skipped, language, duration, n_outputs, error, and the
    first lines of ``warnings`` if there is such a column)."""
    lines = F.transform(F.filter("warnings", lambda w: F.trim(w) != ""), lambda w: F.concat(F.lit("\n- warning: "), F.substring_index(F.trim(w), "\n", 1))) if "warnings" in runs.columns else None
    warned = F.lit("") if lines is None else F.coalesce(F.array_join(lines, ""), F.lit(""))
    status = F.when(F.col("skipped"), "skipped (up to date)").when(F.col("ok"), "ok").otherwise("FAILED")
    body = F.when(F.col("skipped"), "- outputs kept").when(
        F.col("ok"), F.concat(F.lit("- language: "), F.coalesce("language", F.lit("")), F.lit("\n- duration: "), F.format_string("%.1f", "duration"), F.lit("s\n- outputs: "), F.col("n_outputs").cast("string"), warned)
    ).otherwise(F.concat(F.lit("- error: "), F.coalesce("error", F.lit(""))))
    rows = runs.select("name", "ok", "skipped", F.concat(F.lit("## "), "name", F.lit(" — "), status, F.lit("\n"), body).alias("section"))
    ok, skipped = F.count_if("ok").cast("string"), F.count_if("skipped")
    n = F.count(F.lit(1))
    head = F.concat(
        F.lit("# Batch report\n\nProcessed "), n.cast("string"), F.lit(" file(s): "), ok, F.lit(" succeeded, "), (n - F.count_if("ok")).cast("string"), F.lit(" failed."),
        F.when(skipped > 0, F.concat(F.lit(" "), skipped.cast("string"), F.lit(" already up to date (skipped)."))).otherwise(""),
    )
    return rows.agg(F.concat(head, F.lit("\n\n"), F.expr("listagg(section, '\n\n') WITHIN GROUP (ORDER BY name)"), F.lit("\n")).alias("report"))


def isolated(df: DataFrame, key: str, value: str, work: Callable[[str], str]) -> DataFrame:
    """``key, result, error``: a row that fails carries its error and leaves the others alone."""
    schema = to_arrow_schema(struct("k string, result string, error string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out.append((k, work(v), None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, f"{type(e).__name__}: {' '.join(str(e).split())[:300]}"))
            yield arrow_batch(out, schema)

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(value).alias("v")).mapInArrow(run, struct("k string, result string, error string"))
    return rows.withColumnRenamed("k", key)
