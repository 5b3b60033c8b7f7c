"""Command line: ``python -m cuelake.cli VERB INPUT --out FOLDER`` with one folder for each recording.

Verbs: ``transcribe``, ``subs``, ``summarize``, ``chapters``, ``text``, ``all``. An input is a transcript JSON file, a media file, a
plain text (``summarize`` only), or a folder of transcripts or media. Media need ``--recogniser module:function``.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from cuelake.errors import CuelakeError, InvalidTranscript, RecogniserUnavailable

# Exit codes.
OK, PARTIAL, USAGE, NO_TOOL, NOT_FOUND, SERVICE, NO_MODEL, UNDECODABLE, BAD_INPUT, INTERRUPTED = 0, 1, 2, 3, 4, 5, 6, 7, 8, 130


class UsageError(CuelakeError):
    exit_code = USAGE


class ServiceFailed(CuelakeError):
    exit_code = SERVICE


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cuelake")
    p.add_argument("verb", choices=["transcribe", "subs", "summarize", "chapters", "text", "all"])
    p.add_argument("input")
    p.add_argument("-o", "--out", default="results")
    p.add_argument("--recogniser", help="module:function that decodes a stretch of a media file")
    p.add_argument("--language", help="language of the speech; heard if not given")
    p.add_argument("--chunk-length", type=float, default=0.0)
    p.add_argument("--chunk-overlap", type=float, default=2.0)
    p.add_argument("--max-chars", type=int, default=42)
    p.add_argument("--max-lines", type=int, default=2)
    p.add_argument("--max-cps", type=float, default=17.0)
    p.add_argument("--diarize", action="store_true", help="speaker labels from pauses")
    p.add_argument("--diarize-gap", type=float, default=1.2)
    p.add_argument("--speaker-labels", action="store_true")
    p.add_argument("--translate", metavar="LANGUAGE", help="also write translated captions")
    p.add_argument("--local", "--offline", action="store_true", help="no chat service for summaries and chapters")
    p.add_argument("--skip-existing", action="store_true")
    p.add_argument("--debug", action="store_true", help="whole tracebacks")
    return p


def _recogniser(name: str | None):  # noqa: ANN202
    if not name:
        raise RecogniserUnavailable("media need --recogniser module:function")
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function or "recognise")
    except (ImportError, AttributeError) as e:
        raise RecogniserUnavailable(str(e)) from e


def _kind(args: argparse.Namespace) -> str:
    """``json``, ``txt`` or ``media``."""
    from cuelake.operators.batch import AUDIO, VIDEO

    names = os.listdir(args.input) if os.path.isdir(args.input) else [args.input]
    ends = {os.path.splitext(n)[1].lower() for n in names}
    kind = "media" if ends & {*AUDIO, *VIDEO} else "json" if ".json" in ends else "txt" if ends == {".txt"} else None
    if kind is None:
        raise UsageError("the input must be a transcript .json, a media file, or a folder of them")
    if (kind == "txt" and args.verb != "summarize") or (kind == "json" and args.verb == "transcribe"):
        raise UsageError(f"{args.verb} doesn't take .{kind}")
    return kind


def _finished(spark, out: str):  # noqa: ANN001, ANN202
    """Manifests and files below the output folder."""
    marks, there = [], []
    for d in os.listdir(out) if os.path.isdir(out) else []:
        path = os.path.join(out, d, "manifest.json")
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                m = json.load(f)
            marks.append((d, m["source"]["name"], m["source"]["size"], m["outputs"]))
            there += [(d, x) for x in os.listdir(os.path.join(out, d))]
    return spark.createDataFrame(marks, "folder string, source_name string, source_size long, outputs array<string>"), spark.createDataFrame(there, "folder string, output string")


def run(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from cuelake.operators import batch, captions, chapters, completion, recognition, segments, summary
    from cuelake.session import local_session, materialise, ship
    from cuelake.sources import files

    if not os.path.exists(args.input):
        print(f"error: no such input: {args.input}", file=sys.stderr)
        return NOT_FOUND
    kind = _kind(args)
    recognise = _recogniser(args.recogniser) if kind == "media" else None
    spark = local_session(name="cuelake-cli")
    ship(spark)
    if recognise is not None and (source := getattr(sys.modules[recognise.__module__], "__file__", None)):
        spark.sparkContext.addPyFile(source)
    folder, pattern = (args.input, f"*.{kind}") if os.path.isdir(args.input) else os.path.split(os.path.abspath(args.input))
    if kind == "media":
        listing = files.media_listing(spark, args.input).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
        raw = batch.media_files(listing)
        raw = raw.join(batch.folder_names(raw), "path")
    else:
        raw = files.read_payloads(spark, folder, pattern).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("size", F.length("payload").cast("long"))
        raw = raw.withColumn("folder", F.regexp_replace("name", r"(\.transcript)?\.\w+$", ""))
    everything = raw.count()
    if args.skip_existing:
        raw = batch.unfinished(raw, *_finished(spark, args.out))
    raw = materialise(raw.withColumn("media_id", F.xxhash64("folder")))
    wanted = raw.count()
    names = raw.select("media_id", "folder", "name", "size")
    if kind == "media":
        seg, rows = recognition.transcribe(raw.select("media_id", "path"), recognition.once_for_each_worker(args.recogniser, lambda: recognise), args.chunk_length, args.chunk_overlap)
        seg, rows = materialise(seg.withColumn("speaker", F.lit(None).cast("string"))), materialise(rows)
        errors = [r.error for r in rows.where("error IS NOT NULL").select("error").limit(20).collect()]
        rows = rows.where("error IS NULL").drop("error").withColumn("model_size", F.lit("")).withColumn("diarization", F.lit(""))
        nested = seg.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seg_ix", "start_s", "end_s", "text", "speaker", "words"))).alias("segments"))
        rows = rows.join(nested, "media_id", "left").withColumn("segments", F.coalesce("segments", F.expr("cast(array() as array<struct<seg_ix:int,start_s:double,end_s:double,text:string,speaker:string,words:array<struct<start_s:double,end_s:double,word:string>>>>)")))
    elif kind == "json":
        rows, errors = materialise(files.decode_transcripts(raw, "media_id")), []
        seg = rows.select("media_id", F.posexplode("segments").alias("seg_ix", "x")).select("media_id", "seg_ix", "x.start_s", "x.end_s", "x.text", "x.speaker", "x.words")
    else:
        rows, errors = raw.select("media_id", F.regexp_replace("payload", "^\\x{FEFF}", "").alias("text"), F.lit("").alias("language"), F.lit(0.0).alias("duration")), []
        seg = None
    good = rows.count()
    if not good and errors:
        for code, word in ((NO_TOOL, "ToolNotFound"), (NO_MODEL, "RecogniserUnavailable"), (UNDECODABLE, "UndecodableMedia")):
            if any(word in e for e in errors):
                print(f"error: {errors[0]}", file=sys.stderr)
                return code
    if not good and everything == 1 and wanted and kind == "json":
        raise InvalidTranscript(f"{args.input} is not a transcript")
    complete, warning = completion.gated(completion.ChatClient.available() and not args.local or bool(args.translate))
    if args.translate and complete is None and args.verb == "subs":
        raise (ServiceFailed if completion.ChatClient.available() else UsageError)(warning or "no chat service")
    warnings = [warning] if warning else []
    if args.diarize:
        turned = segments.speaker_turns(seg, args.diarize_gap).select("media_id", "seg_ix", F.col("speaker").alias("_s"))
        seg = seg.join(turned, ["media_id", "seg_ix"], "left").withColumn("speaker", F.coalesce("_s", "speaker")).drop("_s")
    limits = captions.Limits(max_chars=args.max_chars, max_lines=args.max_lines, max_cps=args.max_cps)
    made, checks = [], None

    def caption_files(what, suffix: str):  # noqa: ANN001, ANN202
        cues = materialise(captions.build_cues(what, limits, args.speaker_labels))
        made.append((f"captions{suffix}.srt", captions.to_srt(cues).withColumnRenamed("srt", "content")))
        made.append((f"captions{suffix}.vtt", captions.to_vtt(cues).withColumnRenamed("vtt", "content")))
        return captions.lint(cues).select("media_id", F.col("report").alias("captions"))

    if args.verb in ("transcribe", "all") and kind == "media":
        made.append(("transcript.json", rows.select("media_id", files.transcript_json().alias("content"))))
    if args.verb in ("subs", "all"):
        checks = caption_files(seg, "")
        if args.translate and complete is not None:
            turned = materialise(completion.translated(segments.spoken_segments(seg), complete, args.translate))
            if turned.where("error IS NOT NULL").head(1):
                warnings.append("some lines could not be translated")
            caption_files(seg.drop("text", "words").join(turned.select("media_id", "seg_ix", "text"), ["media_id", "seg_ix"]), f".{args.translate}")
    if args.verb in ("summarize", "all"):
        written = completion.summaries_or_extractive(rows.select("media_id", "text"), complete)
        made.append(("summary.md", summary.summary_markdown(written).withColumnRenamed("markdown", "content")))
    if args.verb in ("chapters", "all"):
        listed = chapters.chapters(seg, rows) if complete is None else completion.model_chapters(seg, complete, rows)
        made.append(("chapters.md", chapters.chapter_text(listed, "Chapters").withColumnRenamed("chapters", "content")))
    if args.verb in ("transcribe", "text", "all"):
        made.append(("transcript.txt", segments.transcript_text(seg, rows if args.diarize else None).withColumnRenamed("body", "content")))
    for name, df in made:
        files.write_files(df.join(names, "media_id").select(F.concat("folder", F.lit(f"/{name}")).alias("path"), "content"), args.out)
    options = F.struct(*[F.lit(v).alias(k) for k, v in sorted(vars(args).items()) if v is not None and k not in ("input", "out", "debug")])
    marks = rows.join(names, "media_id")
    marks = marks.join(checks, "media_id", "left") if checks is not None else marks.withColumn("captions", F.lit(None).cast("string"))
    marks = marks.select(
        "folder", F.col("name").alias("source_name"), F.col("size").alias("source_size"), "language", "duration", F.array(*[F.lit(n) for n, _ in made]).alias("outputs"), F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"),
        "captions", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).alias("finished_at"), options.alias("options"),
    )
    files.write_files(batch.manifest(marks).select(F.concat("folder", F.lit("/manifest.json")).alias("path"), F.col("manifest").alias("content")), args.out)
    for w in warnings:
        print(f"warning: {w}", file=sys.stderr)
    print(f"{good} of {wanted} recordings done, {everything - wanted} already up to date")
    return OK if good == wanted else PARTIAL


def main(argv: list[str] | None = None) -> int:
    from cuelake.settings import load_env

    load_env()
    p = parser()
    try:
        args = p.parse_args(argv)
        if args.chunk_length > 0 and not 0 <= args.chunk_overlap < args.chunk_length:
            p.error("--chunk-overlap must be at least 0 and less than --chunk-length")
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return run(args)
    except KeyboardInterrupt:
        return INTERRUPTED
    except CuelakeError as e:
        if args.debug:
            raise
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
