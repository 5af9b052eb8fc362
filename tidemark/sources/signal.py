"""Recordings: WAV validation, frames, pitch by autocorrelation, MIDI notes.

Samples stay binary columns; kernels read them in Arrow batches and return long
rows, one a frame or a note, which the relational operators take on from there.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import ready

#: Limits of a recording.
RATES, SECONDS, PEAK = (8_000, 48_000), (0.4, 300.0), 0.005
#: Seconds of a frame's window and of a step, and keys that are looked for.
WINDOW, HOP, LOW, HIGH = 0.093, 0.012, 36, 96
BLOCK = 128


def read_wav(data: bytes) -> tuple[np.ndarray | None, int | None, str | None]:
    """(samples from -1 to 1, rate, fault): mono, 16 bits, within the limits."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getnchannels() != 1 or w.getsampwidth() != 2:
                return None, None, "format"
            rate, raw = w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError, struct.error):
        return None, None, "not_wav"
    x = np.frombuffer(raw, dtype="<i2").astype(np.float32) / 32768
    if not RATES[0] <= rate <= RATES[1]:
        return None, None, "rate"
    if not SECONDS[0] <= len(x) / rate <= SECONDS[1]:
        return None, None, "length"
    return (None, None, "silent") if np.abs(x).max(initial=0) < PEAK else (x, rate, None)


def high_pass(x: np.ndarray, rate: int, cutoff: float = 60.0) -> np.ndarray:
    """Without what is below the cutoff, and without delay."""
    spectrum = np.fft.rfft(x)
    f = np.fft.rfftfreq(len(x), 1 / rate)
    return np.fft.irfft(spectrum * (f / np.hypot(f, cutoff)) ** 2, len(x)).astype(np.float32)


def track(x: np.ndarray, rate: int) -> pd.DataFrame:
    """Frames (t, midi, energy, conf): normalised autocorrelation of each window, its peak refined by a parabola."""
    size, hop = int(WINDOW * rate), max(1, int(HOP * rate))
    starts = np.arange(0, max(1, len(x) - size + 1), hop)
    lo, hi = int(rate / (440 * 2 ** ((HIGH + 1 - 69) / 12))), int(rate / (440 * 2 ** ((LOW - 1 - 69) / 12))) + 1
    lo, hi = max(2, lo), min(hi, size - 2)
    fft = 1 << (2 * size - 1).bit_length()
    out = []
    for b in range(0, len(starts), BLOCK):
        at = starts[b : b + BLOCK]
        frames = np.stack([np.pad(x[s : s + size], (0, max(0, size - len(x[s : s + size])))) for s in at]).astype(np.float64)
        energy = np.sqrt((frames**2).mean(1))
        frames -= frames.mean(1, keepdims=True)
        auto = np.fft.irfft(np.abs(np.fft.rfft(frames, fft)) ** 2, fft)[:, :size]
        power = np.cumsum(frames**2, axis=1)
        lag = np.arange(size)
        both = power[:, ::-1] + (power[:, -1:] - np.concatenate((np.zeros((len(at), 1)), power[:, :-1]), axis=1))
        norm = 2 * auto / np.maximum(both, 1e-12)
        span = norm[:, lo:hi]
        best = span.max(1, keepdims=True)
        peak = (span >= 0.9 * best) & (span >= np.roll(span, 1, 1)) & (span >= np.roll(span, -1, 1))
        k = lo + np.where(peak.any(1), peak.argmax(1), span.argmax(1))
        rows = np.arange(len(at))
        a, m, c = norm[rows, k - 1], norm[rows, k], norm[rows, k + 1]
        bend = a - 2 * m + c
        period = lag[k] + np.where(np.abs(bend) > 1e-12, 0.5 * (a - c) / np.where(np.abs(bend) > 1e-12, bend, 1), 0)
        midi = 69 + 12 * np.log2(rate / period / 440)
        sure = (m >= 0.5) & (energy > 1e-4)
        out.append(pd.DataFrame({"t": (at + size / 2) / rate, "midi": np.where(sure, midi, np.nan), "energy": energy, "conf": np.clip(m, 0, 1)}))
    return pd.concat(out, ignore_index=True)


def recordings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def frames(takes: DataFrame, key: str, content: str) -> DataFrame:
    """(key, t, midi, energy, conf, fault) of each recording; one row with a fault if it can't be used. No pitch is null."""
    ready(takes.sparkSession)
    kind = takes.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b[key], b[content], strict=True):
                x, rate, bad = read_wav(bytes(data)) if data is not None else (None, None, "missing")
                got = pd.DataFrame({"t": [np.nan], "midi": [np.nan], "energy": [np.nan], "conf": [np.nan]}) if bad else track(high_pass(x, rate), rate)
                got.insert(0, key, k)
                got["fault"] = pd.Series([bad] * len(got), dtype=object)
                yield got

    made = takes.select(key, content).mapInPandas(run, f"{key} {kind}, t double, midi double, energy double, conf double, fault string")
    return made.select(key, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("t", "midi", "energy", "conf")), "fault")


def onsets(f: DataFrame, key: str, jump: float = 0.8, attack: float = 1.85) -> DataFrame:
    """Candidate onsets: the median pitch of three frames moves against that before, or energy rises by a ratio."""
    w = Window.partitionBy(key).orderBy("t")
    before = F.percentile("midi", F.lit(0.5)).over(w.rowsBetween(-6, -3))
    after = F.percentile("midi", F.lit(0.5)).over(w.rowsBetween(0, 2))
    rise = F.col("energy") / F.greatest(F.avg("energy").over(w.rowsBetween(-4, -1)), F.lit(1e-4))
    marked = f.withColumns({"_b": before, "_a": after, "_r": rise})
    return marked.where((F.abs(F.col("_a") - F.col("_b")) >= jump) | (F.col("_r") >= attack)).select(key, "t")


def fused(f: DataFrame, sensed: DataFrame, key: str) -> DataFrame:
    """Frames whose pitch is their own if confident, else that of the sensor's note around them, else null."""
    from tidemark.operators.matching import asof

    notes = sensed.select(key, F.col("start").alias("_s"), F.struct("stop", "pitch").alias("_n"))
    near = asof(f, notes, [key], "t", "_s", "_n", "_n")
    inside = F.when(F.col("t") < F.col("_n.stop"), F.col("_n.pitch"))
    return near.withColumn("midi", F.when(F.col("conf") >= 0.7, F.col("midi")).otherwise(inside)).drop("_n")


def midi_events(data: bytes) -> list[tuple[float, int, int, int, bool]]:
    """(second, channel, key, velocity, on) of a standard MIDI file, in order of time."""
    if data[:4] != b"MThd":
        return []
    _, _, tracks, division = struct.unpack(">IHHH", data[4:14])
    at, raw = 14, []
    for _ in range(tracks):
        size = struct.unpack(">I", data[at + 4 : at + 8])[0]
        at, end, tick, status = at + 8, at + 8 + size, 0, 0
        while at < end:
            delta, at = _variable(data, at)
            tick += delta
            if data[at] & 0x80:
                status, at = data[at], at + 1
            if status == 0xFF:
                kind = data[at]
                length, at = _variable(data, at + 1)
                if kind == 0x51:
                    raw.append((tick, 0, None, int.from_bytes(data[at : at + length], "big"), 0))
                at += length
            elif status in (0xF0, 0xF7):
                length, at = _variable(data, at)
                at += length
            else:
                a, b = data[at], data[at + 1] if status & 0xE0 != 0xC0 else 0
                at += 1 if status & 0xE0 == 0xC0 else 2
                if status & 0xE0 == 0x80:
                    raw.append((tick, 1, status & 15, a, b if status & 0xF0 == 0x90 else 0))
    out, tempo, second, last = [], 500_000, 0.0, 0
    for tick, _, channel, a, b in sorted(raw, key=lambda e: e[:2]):
        second += (tick - last) * tempo / 1e6 / division
        last = tick
        if channel is None:
            tempo = a
        else:
            out.append((second, channel, a, b, b > 0))
    return out


def _variable(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        value = value << 7 | data[at] & 0x7F
        at += 1
        if not data[at - 1] & 0x80:
            return value, at


def midi_notes(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, onset, offset, midi, velocity): of each channel and key the n-th start ends with the n-th end."""
    ready(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *e) for k, data in zip(b[key], b[content], strict=True) for e in midi_events(bytes(data))]
            yield pd.DataFrame(rows, columns=[key, "at", "channel", "midi", "velocity", "on"])

    e = files.select(key, content).mapInPandas(run, f"{key} {kind}, at double, channel int, midi int, velocity int, on boolean")
    rank = F.row_number().over(Window.partitionBy(key, "channel", "midi", "on").orderBy("at"))
    e = e.withColumn("n", rank)
    # Both sides are dealt out by the same keys, so a start and its end meet without another exchange of their own.
    pair = e.groupBy(key, "channel", "midi", "n").agg(F.max(F.when(F.col("on"), F.col("at"))).alias("onset"), F.max(F.when(~F.col("on"), F.col("at"))).alias("offset"), F.max("velocity").alias("velocity"))
    return pair.where("onset IS NOT NULL AND offset >= onset").select(key, "onset", "offset", "midi", "velocity")


def spans(length: Column, most: float) -> Column:
    """Number of equal windows of at most so many seconds."""
    return F.greatest(F.lit(1), F.ceil(length / most)).cast("int")
