"""Oversampled polyphase channels, and convolution with a long response (coherent dedispersion, de-ripple) by overlap-save.

Both work by blocks of output, each block with the samples its filters reach into, so no task holds a series and
results do not depend on the block: filters have a fixed length, and times without samples are zeros.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value of dispersion: MHz^2 s per pc cm^-3, inverted.
DISPERSION = 2.41e-4


def prototype(paths: int, taps: int) -> np.ndarray:
    """A low-pass of paths * taps coefficients, one channel wide: a sinc under a raised cosine."""
    i = np.arange(paths * taps) - (paths * taps - 1) / 2
    return np.sinc(i / paths) * (0.5 + 0.5 * np.cos(2 * np.pi * i / (paths * taps)))


def frames(x: np.ndarray, coeffs: np.ndarray, paths: int, stride: int, first: int) -> np.ndarray:
    """x: samples from 1 + first * stride on. Frame by channel: each frame is a weighted sum over len(coeffs) samples folded to ``paths`` and turned.

    The fold is turned by (paths - stride) more places each frame, which undoes the phase that a stride short of
    ``paths`` gives each channel.
    """
    k = len(coeffs)
    held = np.lib.stride_tricks.sliding_window_view(x, k)[::stride]  # oldest first
    folded = (held * coeffs).reshape(len(held), k // paths, paths).sum(axis=1)
    turn = (np.arange(first, first + len(held)) * (paths - stride)) % paths
    places = (np.arange(paths) + turn[:, None]) % paths
    return np.fft.fft(np.take_along_axis(folded, places, axis=1), axis=1)


def polyphase(x: DataFrame, key: list[str], coeffs: np.ndarray, paths: int, num: int, den: int, block: int = 1024) -> DataFrame:
    """x: key, t (from 0), re, im. Key, frame, chan (below paths), re, im, at num / den samples a channel width.

    paths * den must be a multiple of num. Frame f takes samples 1 + f stride to len(coeffs) + f stride; of n samples
    there are (n - len(coeffs)) div stride frames. A group is ``block`` frames.
    """
    if paths * den % num or len(coeffs) % paths:
        raise ValueError("paths * den must be a multiple of num, and the coefficients one of paths")
    stride, k = paths * den // num, len(coeffs)
    last = x.groupBy(*key).agg(F.max("t").alias("_last"))
    rows = x.join(last, key).withColumn("_frames", F.expr(f"(_last + 1 - {k}) div {stride}"))
    lo, hi = F.greatest(F.ceil((F.col("t") - k) / stride), F.lit(0)), F.least(F.floor((F.col("t") - 1) / stride), F.col("_frames") - 1)
    rows = rows.filter(lo <= hi).withColumn("_blk", F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block))))
    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in key)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        first = int(part["_blk"].iloc[0]) * block
        n = min(block, int(part["_frames"].iloc[0]) - first)
        start = 1 + first * stride
        held = np.zeros((n - 1) * stride + k, complex)
        at = part["t"].to_numpy() - start
        fit = at < len(held)
        np.add.at(held, at[fit], (part["re"].to_numpy() + 1j * part["im"].to_numpy())[fit])
        out = frames(held, coeffs, paths, stride, first)
        f, c = np.divmod(np.arange(out.size), paths)
        return pd.DataFrame({**{name: part[name].iloc[0] for name in key}, "frame": first + f, "chan": c.astype(np.int32), "re": out.real.ravel(), "im": out.imag.ravel()})

    return rows.groupBy(*key, "_blk").applyInPandas(run, f"{kinds}, frame long, chan int, re double, im double")


def dispersion(n: int, dm: float, f_mid: float, bw: float, inverted: bool = False) -> np.ndarray:
    """What undoes dispersion over a band of complex samples (MHz), in the order of an n-point transform; inverted: the band runs from high to low frequency."""
    f = f_mid + np.fft.fftfreq(n) * bw * (-1 if inverted else 1)
    return np.exp(2j * np.pi * dm / DISPERSION * (f - f_mid) ** 2 / f_mid**2 / f * 1e6)


def ripple(coeffs: np.ndarray, paths: int, num: int, den: int, n: int) -> np.ndarray:
    """The magnitude of an oversampled channel's filter, 1 in its middle, in the order of an n-point transform of that channel's samples.

    Beyond the part of the band that the channel has to itself (den / num) it is held at its value there.
    """
    offset = np.fft.fftfreq(n) * num / den  # in channel widths
    offset = np.clip(offset, -0.5, 0.5)
    i = np.arange(len(coeffs))
    gain = np.abs(np.exp(-2j * np.pi * np.multiply.outer(offset, i) / paths) @ coeffs)
    return gain / np.abs(coeffs.sum())


def response(spectrum: np.ndarray, half: int) -> np.ndarray:
    """The 2 half + 1 places around 0 of the response whose transform is given."""
    h = np.fft.ifft(spectrum)
    return np.concatenate([h[len(h) - half :], h[: half + 1]])


def convolve(x: DataFrame, key: list[str], taps: np.ndarray, block: int = 65_536) -> DataFrame:
    """x: key, t, re, im. The same rows with re and im convolved: y(t) is the sum of taps[k + half] x(t - k) for |k| <= half."""
    half, kinds = len(taps) // 2, ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in [*key, "t"])
    own = F.expr(f"t div {block}")
    rows = x.select(*key, "t", "re", "im").withColumn("_blk", F.explode(F.sequence(F.floor((F.col("t") - half) / block), F.floor((F.col("t") + half) / block)))).withColumn("_own", F.col("_blk") == own)
    size = 1 << (block + 4 * half).bit_length()
    spectrum = np.fft.fft(taps, size)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        start = int(part["_blk"].iloc[0]) * block - half
        held = np.zeros(size, complex)
        np.add.at(held, part["t"].to_numpy() - start, part["re"].to_numpy() + 1j * part["im"].to_numpy())
        y = np.fft.ifft(np.fft.fft(held) * spectrum)
        mine = part[part["_own"]]
        at = mine["t"].to_numpy() - start + half
        return mine[[*key, "t"]].assign(re=y[at].real, im=y[at].imag)

    return rows.groupBy(*key, "_blk").applyInPandas(run, f"{kinds}, re double, im double")


def dedisperse_coherently(x: DataFrame, key: list[str], dm: float, f_mid: float, bw: float, half: int, n: int, gain: np.ndarray | None = None, inverted: bool = False, block: int = 65_536) -> DataFrame:
    """Complex samples of a band (MHz, sampled at bw) without dispersion, and without the ripple of gain (in the order of an n-point transform) if given.

    n points describe the response, of which 2 half + 1 are kept: half should exceed the band's sweep in samples.
    """
    spectrum = dispersion(n, dm, f_mid, bw, inverted)
    return convolve(x, key, response(spectrum if gain is None else spectrum / gain, half), block)


def sweep(dm: float, f_mid: float, bw: float) -> int:
    """Samples between the middle of a band and the edge that is furthest from it."""
    low = f_mid - bw / 2
    return int(np.ceil(dm / DISPERSION * abs(1 / low**2 - 1 / f_mid**2) * bw * 1e6))

