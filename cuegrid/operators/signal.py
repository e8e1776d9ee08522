"""Sound as arrays of samples: small NumPy rules that Spark runs in batches of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of pitch tracking: range in Hz, threshold of the normalised difference, margin for an octave, least level.
LOWEST, HIGHEST, THRESHOLD, OCTAVE, QUIET = 75, 400, 0.15, 0.05, 0.01


def high_pass(x: np.ndarray, rate: int, cutoff: float = 80.0) -> np.ndarray:
    """Two passes of a one-pole filter, each the sum of past differences that fade."""
    a = 1 / (1 + 2 * np.pi * cutoff / rate)
    for _ in range(2):
        d, y = np.diff(x, prepend=x[:1]), np.zeros(len(x))
        for i in range(1, len(x)):
            y[i] = a * (y[i - 1] + d[i])
        x = y
    return x


def pitch(x: np.ndarray, rate: int) -> float | None:
    """Fundamental frequency by the cumulative mean normalised difference; None without voice."""
    half = len(x) // 2
    if not half or np.sqrt(np.mean(x[:half] ** 2)) < QUIET:
        return None
    low, high = rate // HIGHEST, min(half, rate // LOWEST)
    shifted = np.lib.stride_tricks.sliding_window_view(x, half)[: high + 1]
    diff = ((shifted - x[:half]) ** 2).sum(axis=1)
    total = np.cumsum(diff[1:])
    norm = np.concatenate(([1.0], np.where(total > 0, diff[1:] * np.arange(1, len(diff)) / np.maximum(total, 1e-30), 1.0)))
    dips = np.flatnonzero(norm[low:] < THRESHOLD)
    if not len(dips):
        return None

    def descend(t: int) -> int:
        while t + 1 < len(norm) and norm[t + 1] < norm[t]:
            t += 1
        return t

    best = descend(low + int(dips[0]))
    if 2 * best < len(norm) and norm[2 * best] < norm[best] - OCTAVE:
        best = descend(2 * best)
    bend = norm[best - 1] - 2 * norm[best] + norm[best + 1] if 0 < best < len(norm) - 1 else 0.0
    return rate / (best + (norm[best - 1] - norm[best + 1]) / (2 * bend) if bend else best)


def pauses(x: np.ndarray, rate: int, *, least: float = 0.25, share: float = 0.06, frame: float = 0.02) -> list[tuple[float, float]]:
    """(start, end) of quiet stretches strictly inside the sound: frames below a share of the loudest."""
    n = int(rate * frame)
    level = np.sqrt(np.mean(x[: len(x) // n * n].reshape(-1, n) ** 2, axis=1)) if len(x) >= n else np.zeros(0)
    loud = np.flatnonzero(level >= share * level.max()) if len(level) and level.max() > 0 else np.zeros(0, int)
    gaps = np.flatnonzero((np.diff(loud) - 1) * frame >= least - 1e-9)
    return [(float((loud[g] + 1) * frame), float(loud[g + 1] * frame)) for g in gaps]


def with_silence(x: np.ndarray, rate: int, at: list[float], seconds: list[float]) -> np.ndarray:
    """x with zeros put in at each place."""
    cuts = [min(len(x), round(a * rate)) for a, _ in sorted(zip(at, seconds, strict=True))]
    rests = [np.zeros(round(s * rate), x.dtype) for _, s in sorted(zip(at, seconds, strict=True))]
    parts = np.split(x, cuts)
    return np.concatenate([p for pair in zip(parts, [*rests, np.zeros(0, x.dtype)], strict=True) for p in pair])


def stft(x: np.ndarray, size: int = 6144, hop: int = 1024) -> np.ndarray:
    """(bins, frames) of a periodic Hann window over the sound mirrored at its ends."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    padded = np.pad(x, size // 2, mode="reflect")
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, size)[::hop] * window, axis=1).T


def istft(spec: np.ndarray, length: int, hop: int = 1024) -> np.ndarray:
    """The sound that stft() was made of."""
    frames = np.fft.irfft(spec.T, axis=1)
    size = frames.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    out, norm = np.zeros(hop * (len(frames) - 1) + size), np.zeros(hop * (len(frames) - 1) + size)
    for i, f in enumerate(frames):
        out[i * hop : i * hop + size] += f * window
        norm[i * hop : i * hop + size] += window**2
    return (out / np.maximum(norm, 1e-12))[size // 2 : size // 2 + length]


def pitches(samples: Column, rate: Column, frame: int = 1024, hop: int = 320) -> Column:
    """array<double> of the pitch of each frame of a clip, null where there is none."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, rates in batches:
            yield pd.Series([[pitch(high_pass(np.asarray(x[i : i + frame], dtype=np.float64), int(r)), int(r)) for i in range(0, len(x) - frame + 1, hop)] for x, r in zip(xs, rates, strict=True)])

    return run(samples, rate)


def clip_pauses(clips: DataFrame) -> DataFrame:
    """(path, start_s, end_s) of the pauses of clips (path, samples, rate)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, s, e) for p, x, r in zip(b["path"], b["samples"], b["rate"], strict=True) if x is not None for s, e in pauses(np.asarray(x, dtype=np.float64), int(r))]
            yield pd.DataFrame(rows, columns=["path", "start_s", "end_s"])

    return clips.select("path", "samples", "rate").mapInPandas(run, "path string, start_s double, end_s double")


#: How far from exactly an octave a pitch may lie, and the passes that settle the centre.
OCTAVE_REACH, PASSES = 2 / 12, 3


def octaves_folded(samples: DataFrame) -> DataFrame:
    """samples (recording_id, speaker, hz) with frames that lie about an octave off the voice moved by that octave.

    The voice's centre is the commonest semitone, neighbours counted in (the lowest of equals), then three times the upper
    median of what has been moved so far. A pitch that is not within two semitones of exactly an octave off is real and
    stays. Equal pitches are counted first, so a speaker with most samples is a histogram.
    """
    who = ["recording_id", "speaker"]
    counts = samples.groupBy(*who, "hz").agg(F.count(F.lit(1)).alias("k")).withColumn("x", F.log2("hz"))
    tones = counts.groupBy(*who, F.floor(F.col("x") * 12 + F.lit(0.5)).alias("tone")).agg(F.sum("k").alias("k"))
    near = tones.select(*who, F.explode(F.array(*[F.struct((F.col("tone") + d).alias("tone"), (F.col("k") * w).alias("k"), F.lit(d == 0).alias("own")) for d, w in ((-1, 1), (0, 2), (1, 1))])).alias("s"))
    smooth = near.groupBy(*who, "s.tone").agg(F.sum("s.k").alias("mass"), F.bool_or("s.own").alias("held")).where("held")
    centre = smooth.groupBy(*who).agg(F.min(F.struct((-F.col("mass")).alias("m"), "tone")).alias("b")).select(*who, (F.col("b.tone") / 12).alias("centre"))

    def moved(x: Column) -> Column:
        off = x - F.col("centre")
        return F.when(F.abs(off - 1) <= OCTAVE_REACH, x - 1).when(F.abs(off + 1) <= OCTAVE_REACH, x + 1).otherwise(x)

    for _ in range(PASSES):
        folded = counts.join(centre, who).withColumn("y", moved(F.col("x")))
        group = Window.partitionBy(*who)
        ranked = folded.withColumn("n", F.sum("k").over(group)).withColumn("upto", F.sum("k").over(group.orderBy("y")))
        centre = ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*who).agg(F.min("y").alias("centre"))
    return samples.join(centre, who).select(*who, F.pow(F.lit(2.0), moved(F.log2("hz"))).alias("hz"))


def profile_speech(clips: DataFrame, *, frame: int = 1024, hop: int = 320) -> DataFrame:
    """Profiles of speakers from clips (recording_id, speaker, id, samples, rate): pitch frames, steady runs of each clip, octaves folded, quantiles."""
    from cuegrid.operators.sequence import pitch_runs
    from cuegrid.operators.speech import profiles

    frames = clips.select("recording_id", "speaker", F.col("id").alias("clip"), "rate", F.posexplode(pitches(F.col("samples"), F.col("rate"), frame, hop)).alias("pos", "pitch"))
    # One clip's frames are one sequence, so its number goes in the place of the recording.
    sequence = frames.select(F.struct("recording_id", "speaker", "clip").alias("recording_id"), F.col("pos").alias("id"), "pitch")
    steady = pitch_runs(sequence).select("recording_id.recording_id", "recording_id.speaker", F.col("pitch").alias("hz"))
    return profiles(octaves_folded(steady), frame=hop / 16_000)
