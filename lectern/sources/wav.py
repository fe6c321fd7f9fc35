"""WAV bytes: what they last, and PCM samples written as such."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_of(data: bytes | None) -> int | None:
    """Milliseconds of a WAV file; None if it is none."""
    if not data or data[:4] != b"RIFF" or len(data) < 36:
        return None
    (channels, rate), (bits,) = struct.unpack_from("<HI", data, 22), struct.unpack_from("<H", data, 34)
    per_second, at = rate * channels * (bits // 8), 36
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            return size * 1000 // per_second if per_second else None
        at += 8 + size + size % 2
    return None


def wav(samples: list[float] | None, rate: int, channels: int = 1) -> bytes:
    """16-bit PCM of samples clipped at one."""
    pcm = (np.clip(np.array(samples if samples is not None else [], float), -1, 1) * 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(pcm))
    return head + pcm


def duration_ms(content: Column) -> Column:
    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([duration_of(x) for x in part], dtype="Int64")

    return run(content)


def encoded(samples: Column, rate: int) -> Column:
    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([wav(x, rate) for x in part])

    return run(samples)
