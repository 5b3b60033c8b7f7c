"""Structured Streaming variants of the interval and turn operators.

Keyed state is one row per entity. Results of in-order input equal the batch operators; rows behind the watermark are
dropped by Spark, which the batch operators don't do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake.operators.completion import Complete
from cuelake.operators.captions import Limits, shown_between
from cuelake.operators.intervals import IntervalMap
from cuelake.session import struct

_PERIODS = struct("origin string, media_id long, kind string, from_ms long, to_ms long")
_HELD = struct("starts array<long>, ends array<long>")


def _merge(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = IntervalMap(*state.get) if state.exists else IntervalMap()
    for b in batches:
        for f, t in zip(b["f"].tolist(), b["t"].tolist(), strict=True):
            if t > f:
                held.insert(int(f), int(t))
    state.update((held.starts, held.ends))
    rows = [(*key, "period", s, e) for s, e in zip(held.starts, held.ends, strict=True)] + [(*key, "gap", s, e) for s, e in held.gaps()]
    yield pd.DataFrame(rows, columns=[f.name for f in _PERIODS])


def merge_intervals_stream(intervals: DataFrame) -> DataFrame:
    """A stream of ``origin, media_id, f, t`` (milliseconds) as periods and gaps: after each micro-batch the whole answer of
    every entity that got rows (output mode ``update``). The ordered map of an entity is its state; insertions search it
    by bisection."""
    rows = intervals.where("f IS NOT NULL AND t IS NOT NULL")
    return rows.groupBy("origin", "media_id").applyInPandasWithState(_merge, _PERIODS, _HELD, "update", GroupStateTimeout.NoTimeout)


_CUE = struct("media_id long, cue_index int, start_s double, end_s double, text string")
_CARRY = struct("number int, before double, start double, end double, text string")


def timed_cues_stream(drafts: DataFrame, least: float = 0.7, cps: float = 17.0, gap: float = 0.04) -> DataFrame:
    """A stream of cue drafts ``media_id, start_s, end_s, text`` as timed cues. A cue waits in state until the next one of
    its recording is there, as its end depends on that one's start; the last cue of a recording comes out with a row
    whose start is null (end of recording)."""

    limits = Limits(min_duration=least, max_cps=cps, min_gap=gap)

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, before, held = 0, None, None
        if state.exists:
            number, before, s, e, t = state.get
            held = None if t is None else (s, e, t)
        rows = []
        frame = pd.concat(list(batches))
        closes = bool(frame["start_s"].isna().any())
        for s, e, t in frame.dropna(subset=["start_s"]).sort_values("start_s", kind="stable")[["start_s", "end_s", "text"]].itertuples(index=False):
            if held is not None:
                a, z = shown_between(held[0], held[1], len(held[2]), 0.0 if before is None else before + gap, float(s) - gap, limits)
                number, before = number + 1, z
                rows.append((key[0], number, a, z, held[2]))
            held = (float(s), float(e), t)
        if closes and held is not None:
            a, z = shown_between(held[0], held[1], len(held[2]), 0.0 if before is None else before + gap, float("inf"), limits)
            rows.append((key[0], number + 1, a, z, held[2]))
            state.remove()
        else:
            state.update((number, before, *(held or (None, None, None))))
        yield pd.DataFrame(rows, columns=[f.name for f in _CUE])

    return drafts.groupBy("media_id").applyInPandasWithState(run, _CUE, _CARRY, "append", GroupStateTimeout.NoTimeout)


def silence_turns_stream(segments: DataFrame, gap_seconds: float = 1.2, lateness: str = "1 minute") -> DataFrame:
    """A stream of ``media_id, start_ts, end_ts`` (wall clock) as turns: segments whose silence is at most the gap."""
    gap = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, cast(greatest(unix_micros(end_ts) - unix_micros(start_ts), 0) / 1000000.0 + {gap_seconds} as decimal(18, 6)))")
    turns = segments.withWatermark("start_ts", lateness).groupBy("media_id", F.session_window("start_ts", gap).alias("w"))
    return turns.agg(F.min("start_ts").alias("turn_start"), F.max("end_ts").alias("turn_end"), F.count(F.lit(1)).alias("n_segments")).drop("w")


def hop_windows_stream(segments: DataFrame, length: str = "30 seconds", hop: str = "28 seconds", lateness: str = "1 minute") -> DataFrame:
    """Overlapping windows over a stream of ``media_id, start_ts``: number of segments by window."""
    return segments.withWatermark("start_ts", lateness).groupBy("media_id", F.window("start_ts", length, hop).alias("w")).agg(F.count(F.lit(1)).alias("n_segments"))


class Progress(StreamingQueryListener):
    """Rows seen and micro-batches done of the streams of a session; ``tell`` gets both after each micro-batch."""

    def __init__(self, tell: Callable[[int, int], None] | None = None) -> None:
        self.rows = self.batches = 0
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.rows += event.progress.numInputRows
        self.batches += 1
        if self.tell:
            self.tell(self.rows, self.batches)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def resume(stream: DataFrame, out: str, checkpoint: str, seconds: int | None = None) -> bool:
    """Writes what a stream has new since the last run to Parquet files and ends; the checkpoint folder holds how far it came, so
    a run after an interruption goes on there. False if it didn't end within ``seconds``."""
    return bool(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination(seconds))


def completed_stream(rows: DataFrame, key: str, prompt: str, complete: Complete, system: str, sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Replies of a model to a stream of prompts, micro-batch by micro-batch. A fatal error of one opens the breaker for all
    later ones, whose rows carry the error without a call."""
    from cuelake.operators.completion import completed
    from cuelake.session import materialise

    state = {"off": None}

    def each(batch: DataFrame, _: int) -> None:
        if state["off"]:
            sink(batch.select(key, F.lit(None).cast("string").alias("reply"), F.lit(state["off"]).alias("error")))
            return
        done = materialise(completed(batch, [key], prompt, complete, system))
        fatal = done.where("error LIKE 'fatal:%'").select("error").head(1)
        if fatal:
            state["off"] = f"switched off: {fatal[0].error}"
        sink(done)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
