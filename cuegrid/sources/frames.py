"""Frames of 16-bit PCM files as a data source whose partitions are ranges of bytes, so a long file is many tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, frame_id long, samples array<float>"
#: Frames handed on at once.
BATCH = 1024


@dataclass
class Pcm:
    """Where a file's samples lie."""

    channels: int
    rate: int
    bits: int
    offset: int
    length: int


def pcm_header(file: BinaryIO, size: int) -> Pcm:
    """The header of a RIFF file of ``size`` bytes, read chunk by chunk; a data chunk that says more than there is, or nothing yet, ends with the file."""
    lead = file.read(12)
    if lead[:4] != b"RIFF" or lead[8:12] != b"WAVE":
        raise ValueError("no RIFF file of waves")
    at, shape = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, n = struct.unpack("<4sI", file.read(8))
        if name == b"fmt " and n >= 16:
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            shape = (channels, rate, bits)
        elif name == b"data" and shape:
            return Pcm(*shape, at + 8, min(n, size - at - 8) if n not in (0, 0xFFFFFFFF) else size - at - 8)
        at += 8 + n + n % 2
    raise ValueError("no data chunk after a format")


@dataclass
class Range(InputPartition):
    path: str
    pcm: Pcm
    first: int
    end: int

    def __init__(self, path: str, pcm: Pcm, first: int, end: int):
        self.path, self.pcm, self.first, self.end = path, pcm, first, end


class FramesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.frame = options["path"], int(options.get("framesize", "512"))
        self.per_task, self.skip = int(options.get("bytespertask", str(64 << 20))), options.get("badfiles", "fail") == "skip"

    def _store(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def partitions(self) -> list[Range]:
        store, path = self._store()
        info = store.get_file_info(path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.lower().endswith(".wav")]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            try:
                with store.open_input_file(f.path) as file:
                    pcm = pcm_header(file, f.size)
                if pcm.bits != 16 or not pcm.channels:
                    raise ValueError("only 16-bit samples can be read")
            except ValueError as e:
                if self.skip:
                    continue
                raise ValueError(f"{f.path}: {e}") from None
            total = -(-(pcm.length // (2 * pcm.channels)) // self.frame)
            step = max(1, self.per_task // (2 * pcm.channels * self.frame))
            out += [Range(f.path, pcm, k, min(total, k + step)) for k in range(0, total, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        pcm = partition.pcm
        width = 2 * pcm.channels
        with store.open_input_file(partition.path) as file:
            for k in range(partition.first, partition.end, BATCH):
                n = min(BATCH, partition.end - k)
                file.seek(pcm.offset + k * self.frame * width)
                whole = pcm.length // width - k * self.frame
                data = np.frombuffer(file.read(min(n * self.frame, whole) * width), "<i2").reshape(-1, pcm.channels)
                samples = np.zeros(n * self.frame, np.float32)
                samples[: len(data)] = data.sum(axis=1, dtype=np.int64) / pcm.channels / 32768
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.frame), pa.array(samples))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.arange(k, k + n)), lists], ["path", "frame_id", "samples"])


class WaveFrames(DataSource):
    """Options: path (a file, or a folder of .wav files), frameSize (samples), bytesPerTask, badFiles (fail or skip)."""

    @classmethod
    def name(cls) -> str:
        return "wave_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramesReader:
        return FramesReader({k.lower(): v for k, v in self.options.items()})


def frames(spark: SparkSession, path: str, frame_size: int, *, bytes_per_task: int = 64 << 20, bad_files: str = "fail") -> DataFrame:
    """(path, frame_id, samples): the files' samples in frames of one size, the mean of the channels within -1 and 1; the last frame is filled up with zeros. A file without samples has no frames; one that cannot be read fails the query, or is left out.

    A task reads so many bytes of one file, whatever the file's length, and holds BATCH frames at once. path is local to all
    executors or a URI that Arrow's file systems open.
    """
    spark.dataSource.register(WaveFrames)
    return spark.read.format("wave_frames").option("frameSize", frame_size).option("bytesPerTask", bytes_per_task).option("badFiles", bad_files).load(path)


def clip(files: DataFrame) -> DataFrame:
    """(path, rate, samples) of short files (path, content) as binaryFile gives them: the first channel, within -1 and 1. Nulls for what is no 16-bit file."""
    import pandas as pd

    from cuegrid.sources.readers import _wav

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                shape = _wav(bytes(content))
                if shape is None or shape[2] != 16 or not shape[0]:
                    rows.append((path, None, None))
                    continue
                channels, rate, _, offset, n = shape
                rows.append((path, rate, (np.frombuffer(content, "<i2", n // 2 // channels * channels, offset).reshape(-1, channels)[:, 0] / 32768).astype(np.float32)))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples"])

    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<float>")
