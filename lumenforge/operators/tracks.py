"""Tracks of boxes across frames: each frame's boxes go one to one to the tracks that overlap them most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COLUMNS = ["clip", "frame", "box", "x0", "y0", "x1", "y1"]
SCHEMA = "clip long, frame long, box long, x0 double, y0 double, x1 double, y1 double, track long"


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of a with each of b (x0, y0, x1, y1); 0 for empty ones."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    whole = size(a)[:, None] + size(b)[None, :] - both
    return np.divide(both, whole, out=np.zeros_like(both), where=whole > 0)


class _Clip:
    """What a clip's frames leave behind: the last box of each track."""

    def __init__(self) -> None:
        self.last = np.zeros((0, 4))

    def frame(self, boxes: np.ndarray, least: float) -> np.ndarray:
        """The tracks of a frame's boxes."""
        track = np.full(len(boxes), -1)
        shared = overlaps(self.last, boxes)
        t, i = np.nonzero(shared >= least)
        used = np.zeros(len(self.last), bool)
        for k in np.lexsort((i, t, shared[t, i]))[::-1]:  # the largest overlap first, then the later track and box
            if not used[t[k]] and track[i[k]] < 0:
                track[i[k]], used[t[k]] = t[k], True
        fresh = np.flatnonzero(track < 0)
        track[fresh] = len(self.last) + np.arange(len(fresh))
        self.last = np.concatenate((self.last, np.zeros((len(fresh), 4))))
        self.last[track] = boxes
        return track


def link(boxes: DataFrame, least: float = 0.15) -> DataFrame:
    """boxes: clip, frame, box (a number within the frame), x0, y0, x1, y1. Adds track. In each frame pairs of a track's last box and a
    box are taken from the largest overlap down, each track and box once; a box without a pair begins a track.

    Clips are dealt to tasks and come as a stream sorted by clip and frame; what is held is a frame and the last box of each track, so a
    clip with a third of all rows costs one long task, not memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, state, waiting = None, _Clip(), None
        for b in batches:
            t = pa.Table.from_batches([b])
            if waiting is not None:
                t = pa.concat_tables([waiting, t])
            key = np.stack([t.column(c).to_numpy() for c in ("clip", "frame")])
            new = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
            cut = int(new[-1])  # the last frame may go on in the next batch
            waiting = t.slice(cut)
            if cut:
                clip, out = _frames(t.slice(0, cut), new[:-1], clip, state)
                yield out
        if waiting is not None and waiting.num_rows:
            yield _frames(waiting, np.array([0]), clip, state)[1]

    def _frames(t: pa.Table, starts: np.ndarray, clip, state: _Clip) -> tuple:
        held = np.stack([t.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1)
        names = t.column("clip").to_numpy()
        track = np.zeros(len(held), np.int64)
        for lo, hi in zip(starts, [*starts[1:], len(held)], strict=True):
            if clip is None or names[lo] != clip:
                clip = names[lo]
                state.last = np.zeros((0, 4))
            track[lo:hi] = state.frame(held[lo:hi], least)
        out = pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in COLUMNS), pa.array(track)], [*COLUMNS, "track"])
        return clip, out

    rows = boxes.selectExpr(*[f"cast({c} as {'long' if c in COLUMNS[:3] else 'double'}) as {c}" for c in COLUMNS])
    whole = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in COLUMNS))
    return whole.repartition("clip").sortWithinPartitions("clip", "frame", "box").mapInArrow(run, SCHEMA)
