"""Numeric image arrays: Fourier amplitude mixing in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def mix_amplitude(own: np.ndarray, other: np.ndarray, weight: float = 1.0, share: float = 0.1) -> np.ndarray:
    """The images ``own`` (last two axes) with the amplitudes of their lowest frequencies replaced by those of ``other``; the phase stays.

    The replaced rectangle lies in the middle of the shifted spectrum, max(1, round(side * share)) by side, its first index (side - size) // 2.
    With a ``weight`` below 1 the amplitudes are replaced in part.
    """
    shifted = lambda x: np.fft.fftshift(np.fft.fft2(x), axes=(-2, -1))
    spectrum, amplitude = shifted(own), np.abs(shifted(other))
    mask = np.ones(())
    for n in own.shape[-2:]:
        size = max(1, round(n * share))
        mask = np.multiply.outer(mask, (np.arange(n) - (n - size) // 2 >= 0) & (np.arange(n) - (n - size) // 2 < size))
    moved = np.abs(spectrum) + weight * mask * (amplitude - np.abs(spectrum))
    return np.real(np.fft.ifft2(np.fft.ifftshift(moved * np.exp(1j * np.angle(spectrum)), axes=(-2, -1))))


def amplitude_mixer(rows: int, columns: int, weight: float = 1.0, share: float = 0.1):
    """A column function of two flattened images of one shape; a batch goes through one transform."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def mixed(own: pd.Series, other: pd.Series) -> pd.Series:
        stack = lambda x: np.stack(x.to_numpy()).astype(float).reshape(len(x), rows, columns)
        return pd.Series(list(mix_amplitude(stack(own), stack(other), weight, share).reshape(len(own), -1))) if len(own) else pd.Series([], dtype=object)

    return mixed
