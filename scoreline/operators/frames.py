"""Frames of videos: which to keep, which frame stands for a second, and results brought back to seconds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.sources.scratch import written

#: Least mean brightness of a frame worth reading, and least mean change from the last kept one.
DARK, CHANGE = 15.0, 3.0


def dark_frame_skip(frames: DataFrame, vector: str = "vec", least: float = DARK) -> DataFrame:
    mean = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x) / F.size(vector)
    return frames.filter(mean >= least)


#: Frames that are compared with an anchor at once.
AHEAD = 16


def fold(vectors: np.ndarray, anchor: np.ndarray | None, change: float) -> tuple[np.ndarray, np.ndarray]:
    """Which frames are kept, starting from an anchor or from the first frame, and the anchor at the end."""
    kept = np.zeros(len(vectors), bool)
    k = 0
    while k < len(vectors):
        if anchor is None:
            at = 0
        else:
            far = np.abs(vectors[k : k + AHEAD] - anchor).mean(axis=1) > change
            if not far.any():
                k += AHEAD
                continue
            at = int(far.argmax())
        k += at
        kept[k], anchor = True, vectors[k]
        k += 1
    return kept, anchor


#: What is known of a chunk of frames: its seconds, which are kept if assumed was the anchor before it (null: if its first frame is
#: kept), its first frame, the anchor after it, and how far its frames are from the first.
CHUNK = "video_id string, chunk long, secs array<long>, kept array<boolean>, assumed array<double>, first array<double>, last array<double>, radius double"


def fold_chunk(rows: pd.DataFrame, change: float) -> pd.DataFrame:
    rows = rows.sort_values("sec", kind="stable")
    vectors, assumed = np.stack(rows["vec"].to_list()).astype(float), rows["anchor"].iloc[0]
    kept, last = fold(vectors, None if assumed is None else np.asarray(assumed, float), change)
    radius = float(np.abs(vectors - vectors[0]).mean(axis=1).max())
    return pd.DataFrame([(rows["video_id"].iloc[0], int(rows["chunk"].iloc[0]), rows["sec"].to_numpy(), kept, assumed, vectors[0], last, radius)], columns=[c.split()[0] for c in CHUNK.split(", ")])


def anchor_dedup(frames: DataFrame, change: float = CHANGE, span: int = 600) -> DataFrame:
    """(video_id, sec, kept): a frame is kept if it differs enough from the last kept one; the first always is.

    Chunks of `span` seconds are folded at once, each as if its first frame were kept. One walk over what is known of a video's
    chunks then finds the anchor before each: a chunk whose first frame it keeps was folded rightly; one whose frames all
    are near it, by the triangle inequality, keeps none; others are folded again from that anchor, all at once, and for the time being
    count as ending where they ended before. This goes on until no chunk is left to fold, two or three times as a rule.
    """
    shape = CHUNK + ", none boolean, open boolean, anchor array<double>"
    names = [c.split()[0] for c in shape.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, anchor = None, None
        for rows in batches:
            out = []
            for r in rows[names[:8]].itertuples(index=False):
                first, none, again = np.asarray(r.first), False, False
                if r.video_id != video:
                    video, anchor = r.video_id, None
                if anchor is None:
                    after = np.asarray(r.last)
                else:
                    away = float(np.abs(first - anchor).mean())
                    right = away > change if r.assumed is None else np.array_equal(np.asarray(r.assumed), anchor)
                    none = not right and away + r.radius <= change - 1e-9
                    again = not right and not none
                    after = anchor if none else np.asarray(r.last)
                out.append((*r[:8], none, again, anchor if again else None))
                anchor = after
            yield pd.DataFrame(out, columns=names)

    def folded(rows: DataFrame) -> DataFrame:
        return rows.groupBy("video_id", "chunk").applyInPandas(lambda pdf: fold_chunk(pdf, change), CHUNK)

    chunked = frames.select("video_id", F.col("sec").cast("long").alias("sec"), F.col("vec").cast("array<double>").alias("vec"), F.floor(F.col("sec") / span).alias("chunk"))
    known = written(folded(chunked.withColumn("anchor", F.lit(None).cast("array<double>"))), "chunks")
    while True:
        # Only what is known of chunks passes by in order, not their frames; one anchor is held at a time.
        seen = written(known.repartition("video_id").sortWithinPartitions("video_id", "chunk").mapInPandas(walk, shape), "walk")
        again = seen.filter("open").select("video_id", "chunk", "anchor")
        if again.isEmpty():
            break
        known = written(seen.filter("NOT open").select(*names[:8]).union(folded(chunked.join(again, ["video_id", "chunk"]))), "chunks")
    return seen.select("video_id", "none", F.explode(F.arrays_zip("secs", "kept")).alias("_s")).select("video_id", F.col("_s.secs").alias("sec"), (F.col("_s.kept") & ~F.col("none")).alias("kept"))


def forward_fill_frame(kept: DataFrame) -> DataFrame:
    """(video_id, sec, frame): each second's last kept frame."""
    upto = Window.partitionBy("video_id").orderBy("sec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return kept.select("video_id", "sec", F.last(F.when(F.col("kept"), F.col("sec")), ignorenulls=True).over(upto).alias("frame"))


def unique_frames(mapping: DataFrame) -> DataFrame:
    return mapping.select("video_id", "frame").distinct()


def pending_frames(mapping: DataFrame, results: DataFrame) -> DataFrame:
    """Frames that have no result yet."""
    return unique_frames(mapping).join(results, ["video_id", "frame"], "left_anti")


def frame_result_join(mapping: DataFrame, results: DataFrame) -> DataFrame:
    """Seconds with their frame's result; seconds without one are dropped."""
    return mapping.join(results, ["video_id", "frame"])


def frames_to_scoreboard(frames: DataFrame, enrich: Callable[[Column], Column], cache: DataFrame | None = None) -> DataFrame:
    """(video_id, sec, frame, text): enrich reads only distinct frames that cache (video_id, frame, text) lacks."""
    mapping = written(forward_fill_frame(anchor_dedup(frames)), "mapping")  # it is read twice
    todo = pending_frames(mapping, cache) if cache is not None else unique_frames(mapping)
    read = todo.join(frames.select("video_id", F.col("sec").alias("frame"), "vec"), ["video_id", "frame"]).select("video_id", "frame", enrich(F.col("vec")).alias("text"))
    results = read if cache is None else read.unionByName(cache.select("video_id", "frame", "text"))
    return frame_result_join(mapping, results)
