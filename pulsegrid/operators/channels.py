"""The frequency axis: sky frequencies, slices, order, masks by weight, scrunching with masks, spectra in numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sky_frequency(chan: Column, fch1: float, foff: float) -> Column:
    return F.lit(fch1) + chan * foff


def channel_at(freq: Column, fch1: float, foff: float, n: int) -> Column:
    """The channel whose centre is nearest to a frequency; null beyond the band's edges."""
    c = F.bround((freq - fch1) / foff).cast("int")
    return F.when((c >= 0) & (c < n), c)


def sliced(x: DataFrame, first: int, last: int) -> DataFrame:
    """Channels first to last, counted from first."""
    return x.filter(F.col("chan").between(first, last)).withColumn("chan", F.col("chan") - first)


def inverted(x: DataFrame, n: int) -> DataFrame:
    """Channels in the other order."""
    return x.withColumn("chan", F.lit(n - 1) - F.col("chan"))


def masked(x: DataFrame, weight: str, values: list[str]) -> DataFrame:
    """Values of samples without weight (or null weight) become null."""
    return x.withColumns({v: F.when(F.col(weight) > 0, F.col(v)) for v in values})


def scrunched_axis(axis: DataFrame, factor: int) -> DataFrame:
    """axis: chan, freq, mask. Groups of ``factor`` channels (a short last one goes): mean frequency, masked if any of its channels is."""
    by = axis.groupBy(F.expr(f"chan div {factor}").alias("chan")).agg(F.avg("freq").alias("freq"), F.bool_or("mask").alias("mask"), F.count(F.lit(1)).alias("_n"))
    return by.filter(F.col("_n") == factor).drop("_n")


def scrunched_mean(x: DataFrame, factor: int) -> DataFrame:
    """The sum of each group of channels over ``factor``, whatever the group has."""
    return x.groupBy("beam", "t", F.expr(f"chan div {factor}").alias("chan")).agg((F.sum("v") / factor).alias("v"))


def spectrum_summary(x: DataFrame, fch1: float, foff: float) -> DataFrame:
    """By beam: mean, largest and smallest of the mean spectrum, and the frequencies where these are (ties: the lower channel)."""
    mean = x.groupBy("beam", "chan").agg(F.avg("v").alias("m"))
    low, high = F.min(F.struct("m", "chan")).alias("low"), F.max(F.struct("m", (-F.col("chan")).alias("c"))).alias("high")
    by = mean.groupBy("beam").agg(F.avg("m").alias("mean"), low, high)
    return by.select("beam", "mean", F.col("high.m").alias("top"), F.col("low.m").alias("bottom"), sky_frequency(-F.col("high.c"), fch1, foff).alias("top_freq"), sky_frequency(F.col("low.chan"), fch1, foff).alias("bottom_freq"))


def summed_polarisations(x: DataFrame, first: str, second: str) -> DataFrame:
    """x: beam, pol, t, chan, v. Half the sum of two polarisations; where one is missing the other stands alone."""
    return x.filter(F.col("pol").isin(first, second)).groupBy("beam", "t", "chan").agg(F.avg("v").alias("v"))


def widest_baseline(vis: DataFrame, top_freq: float) -> DataFrame:
    """vis: uu, vv (seconds). The largest |u| and |v| in wavelengths at the top frequency."""
    return vis.agg((F.max(F.abs("uu")) * top_freq).alias("u"), (F.max(F.abs("vv")) * top_freq).alias("v"))


def valid_antennas(vis: DataFrame, flagged: list[int]) -> DataFrame:
    """vis: a1, a2. Antennas that occur on either side and are not flagged."""
    ants = vis.select(F.explode(F.array("a1", "a2")).alias("ant")).distinct()
    return ants.filter(~F.col("ant").isin(flagged)) if flagged else ants
