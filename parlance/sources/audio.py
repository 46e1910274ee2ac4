"""Wave files as frame tables: 16-bit mono PCM through the standard library, energy as root mean square."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def frames_of(data: bytes, rate: int | None, hop: int, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Start times and energies of the frames (every `hop` samples, `width` long, zeros after the end), and the length in seconds."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 2 or (rate and w.getframerate() != rate):
            raise ValueError("not 16-bit mono audio of the wanted rate")
        own, samples = w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), "<i2") / 32768
    n = 1 + len(samples) // hop
    padded = np.concatenate([samples, np.zeros(n * hop + width - len(samples))])
    energy = np.sqrt(np.lib.stride_tricks.sliding_window_view(padded**2, width)[:: hop][:n].mean(axis=1))
    return np.arange(n) * hop / own, energy, len(samples) / own


def energy_frames(spark: SparkSession, path: str, rate: int | None = 16_000, hop: int = 160, width: int = 400) -> DataFrame:
    """path, i, t, energy, total for each frame of the wave files under path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                t, energy, total = frames_of(data, rate, hop, width)
                yield pd.DataFrame({"path": name, "i": np.arange(len(t), dtype="int32"), "t": t, "energy": energy, "total": total})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, i int, t double, energy double, total double")


def vad_frames(total: float, duration: float = 0.03) -> list[float]:
    """Start times of whole frames; the last frame is left out where it would fit exactly."""
    out, k = [], 0
    while (k + 1) * duration < total:
        out.append(k * duration)
        k += 1
    return out
