"""Antenna voltages (ant, chan, t, re, im): power, sums and products over antennas, fine channels, aligned files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detected_power(volts: DataFrame, n: int) -> DataFrame:
    """Per antenna, channel and n samples: the sum of squared magnitudes, and how many samples it has."""
    return volts.groupBy("ant", "chan", F.expr(f"t div {n}").alias("integ")).agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"), F.count(F.lit(1)).alias("n"))


def tied_sum(volts: DataFrame) -> DataFrame:
    """The coherent sum over antennas."""
    return volts.groupBy("chan", "t").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def voltage_levels(volts: DataFrame) -> DataFrame:
    return volts.groupBy("ant", "chan").agg(*[f(c).alias(f"{n}_{c}") for c in ("re", "im") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def cross_products(volts: DataFrame, n: int, autos: bool = False, together: int = 4096) -> DataFrame:
    """Per baseline a < b (a <= b with autos), channel and n samples: the mean of a times the conjugate of b, over the samples that both have.

    All antennas of a channel and of up to ``together`` samples meet in one group and are multiplied there as a matrix; only
    sums by baseline leave it. Repeated samples of an antenna add up.
    """
    kinds = {c: volts.schema[c].dataType.simpleString() for c in ("ant", "chan")}
    some = min(n, together)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(rows["ant"].to_numpy(), return_inverse=True)
        t = rows["t"].to_numpy() % n % together
        x, has = np.zeros((len(names), some), complex), np.zeros((len(names), some))
        np.add.at(x, (at, t), rows["re"].to_numpy() + 1j * rows["im"].to_numpy())
        has[at, t] = 1
        a, b = np.triu_indices(len(names), 0 if autos else 1)
        product, count = (x @ x.conj().T)[a, b], (has @ has.T)[a, b]
        met = count > 0
        a, b = a[met], b[met]
        return pd.DataFrame({"a": names[a], "b": names[b], "chan": key[0], "integ": key[1], "re": product[met].real, "im": product[met].imag, "n": count[met].astype(np.int64)})

    parts = volts.withColumns({"_integ": F.expr(f"t div {n}"), "_part": F.expr(f"t % {n} div {together}")}).groupBy("chan", "_integ", "_part")
    sums = parts.applyInPandas(run, f"a {kinds['ant']}, b {kinds['ant']}, chan {kinds['chan']}, integ long, re double, im double, n long")
    by = sums.groupBy("a", "b", "chan", "integ").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("n").alias("n"))
    return by.withColumns({"re": F.col("re") / F.col("n"), "im": F.col("im") / F.col("n")})


def phase_slope(vis: DataFrame, key: list[str], chan: str = "chan") -> DataFrame:
    """Slope and intercept, by least squares, of the phase of re + i im along channels, unwrapped so that no step exceeds half a turn."""
    order = Window.partitionBy(*key).orderBy(chan)
    rows = vis.withColumn("_p", F.atan2("im", "re")).withColumn("_turn", F.coalesce(F.bround((F.col("_p") - F.lag("_p").over(order)) / (2 * np.pi)), F.lit(0.0)))
    rows = rows.withColumn("_p", F.col("_p") - 2 * np.pi * F.sum("_turn").over(order))
    return rows.groupBy(*key).agg(F.regr_slope("_p", chan).alias("slope"), F.regr_intercept("_p", chan).alias("intercept"))


def fine_channels(volts: DataFrame, nfft: int, guard: int) -> DataFrame:
    """Each antenna's channel by blocks of nfft samples: their Fourier transform, lowest frequency first, without `guard` channels at either end.

    Missing samples are 0. A group is one block.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(nfft, complex)
        x[rows["t"].to_numpy() % nfft] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        y = np.fft.fftshift(np.fft.fft(x))[guard : nfft - guard]
        return pd.DataFrame({"ant": key[0], "chan": key[1], "blk": key[2], "fine": np.arange(len(y)), "re": y.real, "im": y.imag})

    kinds = [volts.schema[c].dataType.simpleString() for c in ("ant", "chan")]
    return volts.withColumn("blk", F.expr(f"t div {nfft}")).groupBy("ant", "chan", "blk").applyInPandas(run, f"ant {kinds[0]}, chan {kinds[1]}, blk long, fine int, re double, im double")


def delayed(fine: DataFrame, delays: DataFrame, centre: float, width: float, first: float) -> DataFrame:
    """fine (ant, chan, fine, re, im) turned by each antenna's delay: delays has ant, us; frequencies in MHz, coarse channels of `centre` spacing, fine ones of `width` from `first` off the middle."""
    phase = 2 * np.pi * F.col("us") * (F.col("chan") * centre + first + F.col("fine") * width)
    met = fine.join(delays.select("ant", "us"), "ant").withColumns({"_c": F.cos(phase), "_s": F.sin(phase)})
    return met.withColumns({"re": F.expr("re * _c - im * _s"), "im": F.expr("re * _s + im * _c")}).drop("_c", "_s", "us")


def _aligned(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows: file, t; starts: file, start (the whole sample at which it begins). Times counted from the latest start; what is before it goes."""
    last = starts.agg(F.max("start")).first()[0] or 0
    return rows.join(starts.select("file", "start"), "file").withColumn("t", F.col("t") + F.col("start") - last).filter("t >= 0").drop("start")


def aligned_merge(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows: file, t, v. The times that all files have, and the files' values in order of file."""
    files = starts.count()
    by = _aligned(rows, starts).groupBy("t").agg(F.sort_array(F.collect_list(F.struct("file", "v"))).alias("m"))  # a row for each file
    return by.filter(F.size("m") == files).select("t", F.transform("m", lambda x: x["v"]).alias("vals"))


def aligned_mean(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows: file, t, chan, v. The mean over files at each time and channel, counted from the latest start."""
    return _aligned(rows, starts).groupBy("t", "chan").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))


def row_difference(a: DataFrame, b: DataFrame, row: str, key: str, value: str) -> DataFrame:
    """a's value less b's by row; rows whose keys differ, or that one side lacks, raise an error."""
    other = b.select(F.col(row), F.col(key).alias("_key"), F.col(value).alias("_v"), F.lit(True).alias("_b"))
    met = a.select(row, key, value, F.lit(True).alias("_a")).join(other, row, "full")
    same = F.col("_a") & F.col("_b") & F.col(key).eqNullSafe(F.col("_key"))
    wrong = F.raise_error(F.concat(F.lit("keys differ in row "), F.col(row).cast("string")))
    return met.select(row, F.when(F.coalesce(same, F.lit(False)), F.col(key)).otherwise(wrong.cast(a.schema[key].dataType)).alias(key), (F.col(value) - F.col("_v")).alias(value))
