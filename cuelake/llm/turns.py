"""Speech transcripts into clean speaker turns (problem 6).

1. Repair of the clock, in list order: blocks of ``BLOCK`` segments of a recording (with margins of its neighbours)
   form bounded groups. A clock reset begins a new file segment; within file segments the starts are fitted by isotonic
   regression (pool adjacent violators), which gives lost times a place and the turns monotone times.
2. Utterances are cleaned and speakers made canonical, row by row.
3. Turns are runs of one speaker by start. Rows are range-partitioned by (recording, file, start), so one long recording
   spreads over many tasks; every task folds its sorted rows into runs, and only the runs at a task's edges
   (at most three for each recording and task) are tied together afterwards.

Defined results: repeated rows count once; segments with nothing spoken drop out; equal starts keep list order; a lost
start is placed by the regression; a recording without any speech has no turn; an empty table has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cuelake.llm.noise import canonical_speaker, cleaned, speech
from cuelake.session import arrow_batch, materialise, partitions_for, struct

BLOCK = 4096
MARGIN = 16
#: Segments from which a reset is judged; so many of the next block go with each.
AHEAD = 8
#: A reset: the clock falls by more than so many seconds to less than RESET_TO and stays below.
RESET_BY, RESET_TO = 60.0, 10.0


def isotonic(values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The non-decreasing sequence nearest to the values (least squares), by pooling adjacent violators."""
    n = len(values)
    w = np.ones(n) if weights is None else weights
    level, weight, count = [], [], []
    for v, x in zip(values.tolist(), w.tolist(), strict=True):
        level.append(v)
        weight.append(x)
        count.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            b, wb, cb = level.pop(), weight.pop(), count.pop()
            total = weight[-1] + wb
            level[-1] = (level[-1] * weight[-1] + b * wb) / total
            weight[-1] = total
            count[-1] += cb
    return np.repeat(level, count)


def file_numbers(starts: np.ndarray) -> np.ndarray:
    """0 for the first file; one more after every clock reset. NaN starts go with the file they stand in."""
    out = np.zeros(len(starts), dtype=np.int64)
    top, file = -np.inf, 0
    for i, s in enumerate(starts.tolist()):
        if s == s:
            if s < RESET_TO and top - s > RESET_BY:
                later = starts[i : i + AHEAD]  # fewer at the end of a recording
                later = later[~np.isnan(later)]
                if (later < top - RESET_BY).all() and (np.diff(later) > -5).all():
                    file, top = file + 1, s
            top = max(top, s)
        out[i] = file
    return out


def repair_clock(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """File numbers, order times and fitted times of segments in list order. The order time is the start as it is; where
    it is lost, the latest end before it in the list, at most its own end."""
    files = file_numbers(starts)
    order = starts.copy()
    for i in np.flatnonzero(np.isnan(starts)):
        before = ends[max(0, i - MARGIN) : i]
        known = before[~np.isnan(before)]
        near = known[-1] if len(known) else np.nan
        own = ends[i]
        guess = np.nanmin([near, own]) if not (np.isnan(near) and np.isnan(own)) else np.nan
        if np.isnan(guess):
            later = starts[i + 1 : i + 1 + MARGIN]
            later = later[~np.isnan(later)]
            guess = later[0] if len(later) else 0.0
        order[i] = guess
    fitted = order.copy()
    for f in np.unique(files):
        at = np.flatnonzero(files == f)
        fitted[at] = isotonic(order[at], np.where(np.isnan(starts[at]), 0.1, 1.0))
    return files, order, fitted


_REPAIRED = struct("media_id long, seg_ix int, _block int, _file int, _resets int, _at double, _fitted double, end_s double, speaker string, said string")


def _repaired(key: tuple, rows: list[tuple]) -> list[tuple]:
    """One block in list order: (seg_ix, own, start, end, text, speaker) as rows of what is spoken."""
    nan = float("nan")
    starts = np.array([nan if r[2] is None else r[2] for r in rows])
    ends = np.array([nan if r[3] is None else r[3] for r in rows])
    if np.isnan(starts).any() or (np.diff(starts) < 0).any():
        files, order, fitted = repair_clock(starts, ends)
    else:  # in order as it stands
        files, order, fitted = np.zeros(len(rows), np.int64), starts, starts
    own = [i for i, r in enumerate(rows) if r[1]]
    if not own:
        return []
    before = [int(x) for x in files[: own[0]]]
    base = max(before) if before else int(files[own[0]])
    resets = int(files[own[-1]]) - base
    out = []
    for i in own:
        seg, _, _, end, text, speaker = rows[i]
        if text is None or not text.strip():
            continue
        label, said = speech(text)
        if said:
            out.append((*key, int(files[i]) - base, resets, float(order[i]), float(fitted[i]), end, canonical_speaker(speaker) or label, cleaned(said), seg))
    return [(m, seg, block, file, n, at, fit, end, who, said) for m, block, file, n, at, fit, end, who, said, seg in out]


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; one block is held at a time."""
    schema = to_arrow_schema(_REPAIRED)
    current, held, out = None, [], []
    for b in batches:
        for m, block, seg, own, start, end, text, speaker in zip(*(b.column(c).to_pylist() for c in ("media_id", "_block", "seg_ix", "_own", "start_s", "end_s", "text", "speaker")), strict=True):
            if (m, block) != current:
                if held:
                    out += _repaired(current, held)
                    if len(out) > 5000:
                        yield arrow_batch(out, schema)
                        out = []
                current, held = (m, block), []
            if not held or held[-1][0] != seg:  # repeated rows count once
                held.append((seg, own, start, end, text, speaker))
    if held:
        out += _repaired(current, held)
    yield arrow_batch(out, schema)


def utterances(segments: DataFrame) -> DataFrame:
    """Spoken segments with canonical speaker, clean text, file number, order time and repaired time; one exchange."""
    rows = segments.select("media_id", "seg_ix", "start_s", "end_s", "text", "speaker").where("media_id IS NOT NULL AND seg_ix IS NOT NULL")
    home = F.floor(F.col("seg_ix") / BLOCK).cast("int")
    place = F.pmod("seg_ix", F.lit(BLOCK))
    also = F.when(place >= BLOCK - MARGIN, F.array(home, home + 1)).when((place < AHEAD) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    rows = rows.withColumn("_home", home).withColumn("_block", F.explode(also)).withColumn("_own", F.col("_home") == F.col("_block")).drop("_home")
    keys = ["media_id", "_block"]
    fixed = materialise(rows.repartition(partitions_for(rows), *keys).sortWithinPartitions(*keys, "seg_ix").mapInArrow(_repair, _REPAIRED))
    # File numbers go on from block to block; only recordings with a reset have anything to add.
    resets = fixed.where("_resets > 0").groupBy(*keys).agg(F.max("_resets").alias("n"))
    blocks = fixed.select(*keys).distinct().join(resets.select("media_id").distinct(), "media_id", "left_semi").join(resets, keys, "left")
    earlier = blocks.withColumn("_shift", F.sum("n").over(Window.partitionBy("media_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    earlier = earlier.where("_shift > 0").select(*keys, "_shift")
    return fixed.join(earlier, keys, "left").withColumn("_file", F.col("_file") + F.coalesce("_shift", F.lit(0)).cast("int")).drop("_shift", "_block", "_resets")


_RUN = struct("media_id long, _pid int, _run int, _edge boolean, speaker string, first_seg_ix int, last_seg_ix int, start_s double, end_s double, n_segments int, text string")


class _Run:
    __slots__ = ("end", "first", "last", "n", "said", "speaker", "start")

    def __init__(self, speaker, seg, start, end, said, last=None, n=1):
        self.speaker, self.first, self.last, self.start, self.end, self.said, self.n = speaker, seg, seg if last is None else last, start, end, said, n

    def add(self, o: _Run) -> None:
        self.last, self.end, self.n = o.last, max(self.end, o.end), self.n + o.n
        self.said += o.said


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order into runs of one partition; those at its edges are marked."""
    from pyspark import TaskContext

    schema = to_arrow_schema(_RUN)
    pid = TaskContext.get().partitionId()
    out: list[tuple] = []
    media, runs, first_media = None, [], True
    number = 0

    def emit(edge_first: bool, edge_last: bool) -> None:
        nonlocal number
        known = next((i for i, r in enumerate(runs) if r.speaker is not None), len(runs))
        for i, r in enumerate(runs):
            edge = (edge_first and i <= known) or (edge_last and i == len(runs) - 1)
            out.append((media, pid, number, edge, r.speaker, r.first, r.last, r.start, r.end, r.n, " ".join(r.said)))
            number += 1

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        out.clear()
        return made

    for b in batches:
        for m, seg, start, end, speaker, said in zip(*(b.column(c).to_pylist() for c in ("media_id", "seg_ix", "_fitted", "end_s", "speaker", "said")), strict=True):
            if m != media:
                if runs:
                    emit(first_media, False)
                    first_media = False
                media, runs = m, []
            end = start if end is None or end != end or end < start else end
            run = _Run(speaker, seg, start, end, [said])
            if runs and (speaker is None or speaker == runs[-1].speaker):
                runs[-1].add(run)
            else:
                runs.append(run)
                if len(runs) > 4000 and runs[1].speaker is not None:  # pass on the middle of a long recording
                    keep = runs[-1]
                    runs.pop()
                    emit(first_media, False)
                    first_media, runs = False, [keep]
        if len(out) > 4000:
            yield batch()
    if runs:
        emit(first_media, True)
    if out:
        yield batch()


def _tie(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["_pid", "_run"], kind="stable")
    done: list[list] = []
    prior = None
    for r in rows.itertuples(index=False):
        speaker = None if r.speaker is None or r.speaker != r.speaker else r.speaker
        adjacent = prior is not None and (prior[0] != r[1] or r[2] == prior[1] + 1)
        if adjacent and (speaker is None or speaker == done[-1][4]):
            last = done[-1]
            last[6], last[8], last[9], last[10] = r.last_seg_ix, max(last[8], r.end_s), last[9] + r.n_segments, f"{last[10]} {r.text}"
        else:
            done.append([*r[:4], speaker, *r[5:]])
        prior = (r[1], r[2])
    return pd.DataFrame(done, columns=rows.columns)


def speaker_turns(segments: DataFrame) -> DataFrame:
    """Rows ``media_id, speaker, first_seg_ix, last_seg_ix, start_s, end_s, n_segments, text``; one for each turn."""
    said = utterances(segments)
    order = ["media_id", "_file", "_at", "seg_ix"]
    runs = materialise(said.repartitionByRange(partitions_for(said), *order).sortWithinPartitions(*order).mapInArrow(_fold, _RUN))
    tied = runs.where("_edge").groupBy("media_id").applyInPandas(_tie, _RUN)
    return runs.where("NOT _edge").unionByName(tied).select("media_id", "speaker", "first_seg_ix", "last_seg_ix", "start_s", "end_s", "n_segments", "text")
