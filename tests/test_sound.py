"""PCM files: round trips through the standard library's writer, windows, and files that can't be read."""

import io
import struct
import wave
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsense.sources import sound


def wav(samples, rate, width=2):
    """samples: integers (frames, channels)."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        raw = (samples + (128 if width == 1 else 0)).astype("<i4").view(np.uint8).reshape(*samples.shape, 4)
        w.writeframes(raw[..., :width].tobytes())
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_round_trip(width):
    top = 2 ** (8 * width - 1)
    samples = np.random.default_rng(width).integers(-top, top, (101, 2))
    content = wav(samples, 8000, width)
    # An odd part before the data, padded to an even place.
    content = content[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + content[12:]
    rate, got = sound.decoded(content)
    assert rate == 8000 and np.array_equal(got * top, samples)


def test_probe_and_windows(spark, tmp_path):
    tone = np.arange(1, 2501)[:, None]
    good = wav(tone, 1000)
    files = {"good": good, "early": good[:-10], "text": b"hello", "head": good[:20], "float": good[:20] + struct.pack("<H", 3) + good[22:], "bare": good[:36]}
    for name, content in files.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    df = spark.read.format("binaryFile").load(f"{tmp_path}/*.wav").withColumn("name", F.regexp_extract("path", r"(\w+)\.wav$", 1))
    got = {r["name"]: r for r in sound.probe(df, "name").collect()}
    assert {n: r["decode_error"] for n, r in got.items()} == {"good": None, "early": "data end early", "text": "not a RIFF WAVE file", "head": "format ends early", "float": "encoding 3 of 16 bits", "bare": "no data"}
    assert got["good"]["duration_s"] == 2.5 and got["good"]["rate"] == 1000 and got["good"]["md5"] == md5(good).hexdigest()
    cut = sound.cut(df.withColumn("starts", F.array(F.lit(0.0), F.lit(2.0), F.lit(9.0))), 1.0, "name").orderBy("start_s").collect()
    assert [(r["name"], r["start_s"], len(r["samples"])) for r in cut] == [("good", 0.0, 1000), ("good", 2.0, 1000), ("good", 9.0, 1000)]
    assert np.allclose(np.array(cut[1]["samples"]) * 2**15, [*range(2001, 2501), *[0] * 500]) and not any(cut[2]["samples"])
    assert sound.probe(df.limit(0), "name").collect() == []
    # Spark's reader leaves files of length 0 out, so these come as rows.
    nulls = spark.createDataFrame([("x", None, [0.0]), ("y", b"", [0.0])], "name string, content binary, starts array<double>")
    assert {r["decode_error"] for r in sound.probe(nulls, "name").collect()} == {"not a RIFF WAVE file"} and sound.cut(nulls, 1.0, "name").collect() == []
