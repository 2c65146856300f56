"""Mel-frequency cepstral coefficients of sounds, in numpy."""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np

#: Samples of a window and between windows, mel bands, and decibels below the loudest that are told apart.
WINDOW, HOP, MELS, RANGE_DB = 2048, 512, 128, 80.0


def _mel(hz: np.ndarray) -> np.ndarray:
    """Mels, linear up to 1000 Hz (15 mels) and logarithmic above, 27 mels for a factor of 6.4."""
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1) / 1000) / np.log(6.4))


def _hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=4)
def mel_filters(rate: int) -> np.ndarray:
    """Triangles of equal area over the frequencies of a window's spectrum, a row for each band."""
    edges = _hz(np.linspace(0, _mel(np.float64(rate / 2)), MELS + 2))
    at = np.linspace(0, rate / 2, WINDOW // 2 + 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((at - low) / (mid - low), (high - at) / (high - mid))) * 2 / (high - low)


@lru_cache(maxsize=4)
def _cosines(coefficients: int) -> np.ndarray:
    """The first rows of the orthonormal discrete cosine transform (type II) over the bands."""
    k, n = np.arange(coefficients)[:, None], np.arange(MELS)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * MELS)) * np.where(k == 0, np.sqrt(1 / MELS), np.sqrt(2 / MELS))


def mfcc(samples: np.ndarray, rate: int, coefficients: int = 13) -> np.ndarray:
    """Frames by coefficients. Windows stand around every HOP-th sample, with silence before the first and after the last."""
    if not len(samples):
        return np.empty((0, coefficients))
    padded = np.pad(samples.astype(np.float64), WINDOW // 2)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    power = np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2
    db = 10 * np.log10(np.maximum(power @ mel_filters(rate).T, 1e-10))
    return np.maximum(db, db.max() - RANGE_DB) @ _cosines(coefficients).T


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """The same sound at another rate, by its spectrum."""
    if rate == to or not len(samples):
        return samples
    n = round(len(samples) * to / rate)
    spectrum = np.fft.rfft(samples)
    out = np.zeros(n // 2 + 1, complex)
    m = min(len(out), len(spectrum))
    out[:m] = spectrum[:m]
    return np.fft.irfft(out, n) * (n / len(samples))


def read_wave(content: bytes, seconds: float) -> tuple[np.ndarray, int]:
    """The first seconds of a PCM WAVE file as samples from -1 to 1, channels averaged, and their rate; ValueError for other files."""
    try:
        with wave.open(io.BytesIO(content)) as f:
            rate, width, channels = f.getframerate(), f.getsampwidth(), f.getnchannels()
            raw = np.frombuffer(f.readframes(int(rate * seconds)), np.uint8)
    except (wave.Error, EOFError) as e:
        raise ValueError(str(e)) from None
    raw = raw[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        values = raw[:, 0].astype(np.float64) - 128
    else:
        values = np.zeros((len(raw), 4), np.uint8)
        values[:, 4 - width :] = raw  # into the upper bytes, so that the sign is in its place
        values = values.view("<i4")[:, 0].astype(np.float64) / 2 ** (8 * (4 - width))
    return (values / 2 ** (8 * width - 1)).reshape(-1, channels).mean(axis=1), rate
