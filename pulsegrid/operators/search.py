"""What turns dedispersed sums into detections: noise of tree and boxcar, thresholds, the kernel's edge rules, refreshed scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dedisperse import trace, tree
from .spectra import islands, mean_var, moments, scale_offset


def spread_variance(spread: int, width: int) -> int:
    """The variance of a sum over ``width`` times of sums over ``spread`` times, of independent samples of variance 1."""
    low, high = sorted((spread, width))
    return (high - low + 1) * low * low + (2 * low - 1) * low * (low - 1) // 3


def noise_table(spark: SparkSession, nf: int, f0: float, df: float, nd: int, widths: tuple[int, ...]) -> DataFrame:
    """idt, width, hits (samples in the tree's sum) and sigma (of tree and boxcar together, for samples of variance 1): delays times widths."""
    levels, rows = tree(nf, f0, df, nd), []
    for d in range(nd):
        spreads = [depth + 1 for _, depth, _ in trace(levels, d)]
        rows += [(d, w, sum(spreads), float(sum(spread_variance(s, w) for s in spreads)) ** 0.5) for w in widths]
    return spark.createDataFrame(rows, "idt long, width int, hits long, sigma double")


def in_units_of_noise(sums: DataFrame, noise: DataFrame) -> DataFrame:
    """sums: beam, idt, t, width, s. sn is s over the noise of its delay and width."""
    return sums.join(F.broadcast(noise.select("idt", "width", "sigma")), ["idt", "width"]).withColumn("sn", F.col("s") / F.col("sigma")).drop("sigma")


def above_threshold(sums: DataFrame, least: float, min_idt: int, most: int, block: int) -> DataFrame:
    """sums: beam, idt, t, v. Every value above least from min_idt on, not grouped; of each block of times the first `most` by beam, idt and t (a limit that the operator has)."""
    high = sums.filter((F.col("v") > least) & (F.col("idt") >= min_idt)).withColumn("blk", F.expr(f"t div {block}"))
    order = Window.partitionBy("blk").orderBy("beam", "idt", "t")  # Spark keeps `most` of each task before the shuffle
    return high.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k", "blk")


def kernel_islands(best: DataFrame, threshold: float, block: int, most_width: int, lanes: int = 32) -> DataFrame:
    """As islands, with what the search kernel does at the edges of a block of times.

    A block is worked on in whole groups of ``lanes`` times, the rest of it is left out; a run that begins with the last
    time is lost; one whose strongest width is above most_width counts as discarded.
    """
    usable = block // lanes * lanes
    runs = islands(best.filter(F.pmod("t", F.lit(block)) < usable), threshold, block)
    return runs.filter(F.pmod("start", F.lit(block)) != usable - 1).withColumn("discarded", F.col("width") > most_width)


def refreshed_scaling(x: DataFrame, block: int, every: int) -> DataFrame:
    """Samples scaled by the statistics of the ``every`` blocks before theirs (mean 128, std 18), refreshed after as many blocks; the first ones have none and go."""
    table = scale_offset(mean_var(moments(x, block * every))).withColumn("blk", F.col("blk") + 1)
    rows = x.withColumn("blk", F.expr(f"t div {block * every}")).join(table, ["beam", "chan", "blk"])
    return rows.select("beam", "t", "chan", ((F.col("v") + F.col("offset")) * F.col("scale")).alias("v"))
