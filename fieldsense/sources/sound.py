"""PCM sound in RIFF WAVE files, from the content column that Spark's binaryFile reader gives.

Defined cases: null or empty content, content that isn't RIFF WAVE, other encodings than PCM of 8 to 32 bits, missing parts and
data that end early give a decode error and no sound; a file is held by one task, its windows one after the other; rows that
repeat a path are files of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings of the format part.
PCM, EXTENSIBLE = 1, 0xFFFE


def parts(content: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the file's parts; sizes are as written, parts begin at even places."""
    at = 12
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        yield name, at + 8, size
        at += 8 + size + size % 2


def decoded(content: bytes | None) -> tuple[int, np.ndarray]:
    """Rate and samples by channel (frames, channels), from -1 to 1; ValueError says what is wrong with a file."""
    if not content or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    layout, rate = None, 0
    for name, start, size in parts(content):
        if name == b"fmt ":
            if size < 16 or start + size > len(content):
                raise ValueError("format ends early")
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, start)
            if kind == EXTENSIBLE and size >= 26:
                kind = struct.unpack_from("<H", content, start + 24)[0]
            if kind != PCM or bits not in (8, 16, 24, 32) or not channels or not rate:
                raise ValueError(f"encoding {kind} of {bits} bits")
            layout = channels, bits // 8
        elif name == b"data":
            if layout is None:
                raise ValueError("data before format")
            if start + size > len(content):
                raise ValueError("data end early")
            channels, width = layout
            raw = np.frombuffer(content, np.uint8, size // (channels * width) * channels * width, start).reshape(-1, width)
            if width == 1:  # the one unsigned size
                values = (raw[:, 0].astype(np.float64) - 128) / 128
            else:
                wide = np.zeros((len(raw), 4), np.uint8)
                wide[:, 4 - width :] = raw
                values = wide.view("<i4")[:, 0] / 2.0**31
            return rate, values.reshape(-1, channels)
    raise ValueError("no data")


def _each(batches: Iterator[pa.RecordBatch]):
    """(row as a slice of one, rate, samples, error) of each file, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            try:
                yield row, *decoded(row.column(1)[0].as_py()), None
            except ValueError as e:
                yield row, None, None, str(e)


def probe(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, md5, rate, channels, duration_s, decode_error) of files (key, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, rate, samples, error in _each(batches):
            found = (None,) * 3 if error else (rate, samples.shape[1], len(samples) / rate)
            columns = [pa.array([v], t) for v, t in zip((*found, error), (pa.int32(), pa.int32(), pa.float64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([row.column(0), row.column(2), *columns], names=[key, "md5", "rate", "channels", "duration_s", "decode_error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content", F.md5("content").alias("md5")).mapInArrow(run, f"`{key}` {kind}, md5 string, rate int, channels int, duration_s double, decode_error string")


def cut(files: DataFrame, width: float, key: str = "path") -> DataFrame:
    """(key, start_s, rate, samples): of files (key, content, starts array of seconds) one row a window of `width` seconds,
    channels averaged, zeros where the sound has ended. Files that can't be read have no windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, rate, samples, error in _each(batches):
            for start in () if error else row.column(2)[0].as_py() or ():
                at, n = round(start * rate), round(width * rate)
                own = samples[max(at, 0) : max(at + n, 0)].mean(axis=1)
                padded = np.concatenate([own, np.zeros(n - len(own))])
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([float(start)]), pa.array([rate], pa.int32()), pa.array([padded], pa.list_(pa.float64()))], names=[key, "start_s", "rate", "samples"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content", F.col("starts").cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, start_s double, rate int, samples array<double>")
