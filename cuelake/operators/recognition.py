"""Recognition behind plain callables: media are probed, cut into chunks, decoded apart, shifted, trimmed to what each chunk
owns, and put together by time.

The tools and the model run on the executors. A model is loaded once for each Python worker; a chunk or file that fails gives
a row with its error and leaves the others alone."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuelake.errors import RecogniserUnavailable, ToolNotFound, UndecodableMedia
from cuelake.functions.text import strip
from cuelake.operators.segments import chunk_windows, stitch
from cuelake.session import materialise

#: (path, start, end, language) -> (language, [(start, end, text, [(start, end, word)])]); times from the chunk's start.
Recogniser = Callable[[str, float, float, str | None], tuple[str, list]]

_WORDS = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("word", T.StringType())]))


def ensure_tool(name: str) -> str:
    """Path of a media tool."""
    found = shutil.which(name)
    if found is None:
        raise ToolNotFound(f"{name} is not installed or not on the PATH")
    return found


def probe_duration(path: str, run: Callable = subprocess.run) -> float | None:
    """Seconds of a media file by ``ffprobe``; null after any failure."""
    command = ["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", path]
    try:
        return float(run(command, capture_output=True, text=True, timeout=60, check=True).stdout.strip())
    except (OSError, ValueError, subprocess.SubprocessError):
        return None


def extract_audio(media: str, wav: str, rate: int = 16_000, start: float | None = None, duration: float | None = None, run: Callable = subprocess.run) -> str:
    """A mono WAV file of a stretch of a media file by ``ffmpeg``; the error carries the tool's last line."""
    cut = [*(["-ss", f"{start:.3f}"] if start else []), *(["-t", f"{duration:.3f}"] if duration else [])]
    try:
        done = run([ensure_tool("ffmpeg"), "-nostdin", "-y", *cut, "-i", media, "-vn", "-ac", "1", "-ar", str(rate), "-c:a", "pcm_s16le", wav], capture_output=True, text=True, check=False)
    except OSError as e:
        raise ToolNotFound(str(e)) from e
    if done.returncode:
        raise UndecodableMedia(next((x for x in reversed((done.stderr or "").splitlines()) if x.strip()), "ffmpeg failed"))
    return wav


_LOADED: dict = {}


def once_for_each_worker(name: str, load: Callable[[], Recogniser]) -> Recogniser:
    """A recogniser that is loaded on first use and kept for the life of the Python worker."""

    def recognise(path: str, start: float, end: float, language: str | None) -> tuple[str, list]:
        if name not in _LOADED:
            try:
                _LOADED[name] = load()
            except Exception as e:
                raise RecogniserUnavailable(f"{name}: {e}") from e
        return _LOADED[name](path, start, end, language)

    return recognise


def probed(media: DataFrame, probe: Callable[[str], float | None] = probe_duration) -> DataFrame:
    """``media_id, path, duration``: known durations above 0 stay, the others are probed where they are."""
    schema = T.StructType([media.schema["media_id"], T.StructField("path", T.StringType()), T.StructField("duration", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [d if d and d > 0 else probe(p) for p, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(known, pa.float64())], schema=arrow)

    return media.select("media_id", "path", F.col("duration").cast("double").alias("duration") if "duration" in media.columns else F.lit(None).cast("double").alias("duration")).mapInArrow(run, schema)


def decoded(chunks: DataFrame, recognise: Recogniser) -> DataFrame:
    """Segments of every chunk of ``media_id, path, chunk_ix, chunk_start, chunk_end, lo, hi, language``, with the chunk's
    start added to all times; one task may decode many chunks, a chunk that fails gives a row with ``error``."""
    out = T.StructType([
        T.StructField("media_id", T.LongType()), T.StructField("chunk_ix", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()),
        T.StructField("text", T.StringType()), T.StructField("words", _WORDS), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("language", T.StringType()), T.StructField("error", T.StringType()),
    ])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    language, found = recognise(r["path"], r["chunk_start"], r["chunk_end"], r["language"])
                    language = language or r["language"] or ""
                    at = r["chunk_start"]
                    for n, (s, e, text, words) in enumerate(found):
                        timed = [{"start_s": a + at, "end_s": z + at, "word": w} for a, z, w in words]
                        rows.append({"media_id": r["media_id"], "chunk_ix": r["chunk_ix"], "piece": n, "start_s": s + at, "end_s": e + at, "text": text.strip(), "words": timed, "lo": r["lo"], "hi": r["hi"], "language": language, "error": None})
                    if not found:
                        rows.append({"media_id": r["media_id"], "chunk_ix": r["chunk_ix"], "language": language})
                except Exception as e:  # noqa: BLE001
                    rows.append({"media_id": r["media_id"], "chunk_ix": r["chunk_ix"], "error": f"{type(e).__name__}: {' '.join(str(e).split())}"[:300]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return chunks.mapInArrow(run, out)


def transcribe(media: DataFrame, recognise: Recogniser, length: float = 30.0, overlap: float = 2.0, probe: Callable[[str], float | None] = probe_duration) -> tuple[DataFrame, DataFrame]:
    """(``media_id, seg_ix, start_s, end_s, text, words``, ``media_id, language, duration, text, error``) of ``media_id, path``
    and perhaps ``duration``. Segments of all chunks are stitched, merged by time (ties by chunk and place) and numbered. The
    language heard in the first chunk holds for the others. A recording's duration is that of the file, else its last
    segment's end; ``error`` is that of its first chunk that failed."""
    files = materialise(probed(media, probe))
    windows = chunk_windows(files, length, overlap).join(files.select("media_id", "path"), "media_id")
    fields = ["media_id", "path", "chunk_ix", "chunk_start", "chunk_end", "lo", "hi"]
    first = materialise(decoded(windows.where("chunk_ix = 0").select(*fields, F.lit(None).cast("string").alias("language")), recognise))
    heard = first.groupBy("media_id").agg(F.max("language").alias("language"))
    rest = decoded(windows.where("chunk_ix > 0").join(heard, "media_id", "left").select(*fields, "language"), recognise)
    every = materialise(first.unionByName(rest))
    by_time = Window.partitionBy("media_id").orderBy("start_s", "chunk_ix", "piece")
    merged = stitch(every.where("error IS NULL AND start_s IS NOT NULL")).withColumn("seg_ix", F.row_number().over(by_time) - 1)
    merged = materialise(merged.select("media_id", "seg_ix", "start_s", "end_s", "text", "words"))
    said = strip(F.coalesce("text", F.lit("")))
    text = F.expr("coalesce(listagg(nullif(_t, ''), ' ') WITHIN GROUP (ORDER BY seg_ix), '')")
    whole = merged.withColumn("_t", said).groupBy("media_id").agg(text.alias("text"), F.max_by("end_s", "seg_ix").alias("_end"))
    failed = every.where("error IS NOT NULL").groupBy("media_id").agg(F.min_by("error", "chunk_ix").alias("error"))
    rows = files.select("media_id", "duration").join(heard, "media_id", "left").join(whole, "media_id", "left").join(failed, "media_id", "left")
    duration = F.coalesce(F.nullif("duration", F.lit(0.0)), "_end", F.lit(0.0))
    return merged, rows.select("media_id", F.coalesce("language", F.lit("")).alias("language"), duration.alias("duration"), F.coalesce("text", F.lit("")).alias("text"), "error")
