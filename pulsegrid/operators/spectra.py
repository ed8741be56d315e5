"""Statistics, flags, scaling, dedispersion, boxcars and islands over long-form spectra (beam, t, chan, v)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(x: DataFrame, block: int, ok: Column | None = None) -> DataFrame:
    """Raw moments by beam, channel and block, of the samples that are ok (if given); partial sums are made before the shuffle."""
    v = F.col("v")
    x = x if ok is None else x.filter(ok)
    return x.groupBy("beam", "chan", F.expr(f"t div {block}").alias("blk")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.sum(v * v * v).alias("s3"), F.sum(v * v * v * v).alias("s4")
    )


def mean_var(m: DataFrame) -> DataFrame:
    n, mean = F.col("n"), F.col("s1") / F.col("n")
    return m.select("beam", "chan", "blk", "n", mean.alias("mean"), (F.col("s2") / n - mean * mean).alias("var"))


def scale_offset(stats: DataFrame, target_mean: float = 128.0, target_std: float = 18.0) -> DataFrame:
    scale = F.when(F.col("var") > 0, F.lit(target_std) / F.sqrt("var")).otherwise(F.lit(1.0))
    return stats.select("beam", "chan", "blk", scale.alias("scale"), (F.lit(target_mean) / scale - F.col("mean")).alias("offset"))


def dm0(x: DataFrame) -> DataFrame:
    """The sum over channels at each time."""
    return x.groupBy("beam", "t").agg(F.sum("v").alias("dm0"), F.count(F.lit(1)).alias("n"))


def dm0_subtract(x: DataFrame) -> DataFrame:
    return x.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("beam", "t")))


def block_change(stats: DataFrame) -> DataFrame:
    """mean over the block before's, less one; 0 for the first block."""
    before = F.lag("mean").over(Window.partitionBy("beam", "chan").orderBy("blk"))
    return stats.select("beam", "chan", "blk", F.coalesce(F.when(before != 0, F.col("mean") / before - 1), F.lit(0.0)).alias("change"))


def block_changes(stats: DataFrame) -> DataFrame:
    """stats: mean, std. mean_change and std_change: each over the block before's, less one; 0 for the first block and where that was 0."""
    order = Window.partitionBy("beam", "chan").orderBy("blk")  # a row per block
    change = lambda c: F.coalesce(F.when(F.lag(c).over(order) != 0, F.col(c) / F.lag(c).over(order) - 1), F.lit(0.0)).alias(f"{c}_change")
    return stats.select("beam", "chan", "blk", change("mean"), change("std"))


def grow_time_flags(x: DataFrame, ok: Column, block: int) -> DataFrame:
    """A sample is good if it is and the sample at the time before is not bad; a block's first, and one behind a missing sample, looks at itself only."""
    order = Window.partitionBy("beam", "chan", F.expr(f"t div {block}")).orderBy("t").rangeBetween(-1, 0)
    return x.withColumn("ok", ok).withColumn("good", F.min("ok").over(order))


def grow_channel_flags(flags: DataFrame, grow: int) -> DataFrame:
    """flags: beam, chan, flag (0 or 1). Spread over [chan - grow, chan + grow), half-open; none for grow = 0."""
    if grow == 0:
        return flags.withColumn("grown", F.lit(0))
    order = Window.partitionBy("beam").orderBy("chan").rowsBetween(-grow, grow - 1)
    return flags.withColumn("grown", F.max("flag").over(order))


def crunch_time(x: DataFrame, factor: int, mask_zero: bool = False) -> DataFrame:
    """Sums over full groups of `factor` samples by time, over the root of factor; the tail goes. With mask_zero sums of 0 become null."""
    by = x.groupBy("beam", "chan", F.expr(f"t div {factor}").alias("t")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    s = F.when(F.col("s") != 0, F.col("s")) if mask_zero else F.col("s")
    return by.filter(F.col("n") == factor).select("beam", "chan", "t", (s / F.sqrt(F.lit(float(factor)))).alias("v"))


def crunch_channels(x: DataFrame, factor: int) -> DataFrame:
    return x.groupBy("beam", "t", F.expr(f"chan div {factor}").alias("chan")).agg((F.sum("v") / F.sqrt(F.lit(float(factor)))).alias("v"))


def fold(x: DataFrame, bins: int) -> DataFrame:
    return x.groupBy("beam", "chan", F.pmod("t", F.lit(bins)).alias("bin")).agg(F.sum("v").alias("v"))


def roll_dedisperse(x: DataFrame, shift: Column, n: int) -> DataFrame:
    """Each channel rolled by its shift around n samples, then summed over channels."""
    return x.groupBy("beam", F.pmod(F.col("t") + shift, F.lit(n)).alias("t")).agg(F.sum("v").alias("v"))


def in_blocks(x: DataFrame, block: int, before: int) -> DataFrame:
    """x by block of time (blk), each block with the samples of the last `before` times ahead of it (halo), so that no task needs a whole history."""
    own = F.expr(f"t div {block}")
    reach = F.floor((F.col("t") + before) / block)
    return x.withColumn("blk", F.explode(F.sequence(own, reach))).withColumn("halo", F.col("blk") != own)


def _window_sums(x: DataFrame, key: list[str], widths: tuple[int, ...], block: int) -> DataFrame:
    """x with s, an array: per width the sum over the last `width` times; missing samples count as 0, and sums start anew in each frame, so errors do not add up."""
    order = Window.partitionBy(*key, "blk").orderBy("t")
    parts = in_blocks(x, block, max(widths) - 1)
    return parts.withColumn("s", F.array(*[F.sum("v").over(order.rangeBetween(1 - w, 0)) for w in widths])).filter("not halo")


def spread_initial(x: DataFrame, delays: int, block: int = 4096) -> DataFrame:
    """The first state of the shift-and-add tree: for d below `delays`, the sum of the last d + 1 times; one running sum a block and its differences."""
    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in ("beam", "chan", "t", "v"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["chan", "t"])
        v, own = rows["v"].to_numpy(), ~rows["halo"].to_numpy()
        # channels one after the other, further apart than a window reaches
        place = np.unique(rows["chan"].to_numpy(), return_inverse=True)[1] * (block + 3 * delays) + rows["t"].to_numpy() - rows["t"].min()
        total = np.concatenate([[0], np.cumsum(v)])
        first = np.searchsorted(place, place[own][:, None] - np.arange(delays))  # the first sample of each window
        last = np.searchsorted(place, place[own], "right")
        out = rows[own].loc[:, ["beam", "chan", "t"]]
        out = out.iloc[np.repeat(np.arange(len(out)), delays)]
        return out.assign(v=(total[last][:, None] - total[first]).ravel(), d=np.tile(np.arange(delays), int(own.sum())))[["beam", "chan", "t", "v", "d"]]

    parts = in_blocks(x.select("beam", "chan", "t", "v"), block, delays - 1).groupBy("beam", "blk").applyInPandas(run, f"{kinds}, d int")
    return parts.select("beam", "chan", "t", "d", "v")


def boxcars(series: DataFrame, widths: tuple[int, ...], block: int = 4096) -> DataFrame:
    """series: beam, t, v. Per width the sum over the last `width` times."""
    states = [F.struct(F.lit(w).alias("width"), F.col("s")[k].alias("s")) for k, w in enumerate(widths)]
    return _window_sums(series, ["beam"], widths, block).select("beam", "t", F.inline(F.array(*states)))


def best_width(series: DataFrame, widths: tuple[int, ...], block: int = 4096) -> DataFrame:
    """At each time the width with the largest sum over the root of the width; ties go to the smaller width. Chosen within the row."""
    sn = [F.struct((F.col("s")[k] / F.sqrt(F.lit(float(w)))).alias("sn"), F.lit(-w).alias("w")) for k, w in enumerate(widths)]
    best = _window_sums(series, ["beam"], widths, block).withColumn("m", F.array_max(F.array(*sn)))
    return best.select("beam", "t", (-F.col("m.w")).alias("width"), F.col("m.sn").alias("sn"))


def islands(best: DataFrame, threshold: float, block: int) -> DataFrame:
    """Runs of samples at or above threshold within a block: start, end, and the strongest sample (ties: smaller width, then earlier)."""
    part = ["beam", "blk"]
    high = best.withColumn("blk", F.expr(f"t div {block}")).filter(F.col("sn") >= threshold)
    high = high.withColumn("run", F.col("t") - F.row_number().over(Window.partitionBy(*part).orderBy("t")))  # a missing time ends a run
    top = F.max(F.struct("sn", (-F.col("width")).alias("w"), (-F.col("t")).alias("u"))).alias("m")
    out = high.groupBy(*part, "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), top)
    return out.select("beam", "start", "end", F.col("m.sn").alias("sn"), (-F.col("m.w")).alias("width"), (-F.col("m.u")).alias("t"))


def kurtosis(m: DataFrame) -> DataFrame:
    """mean, population std and excess kurtosis from raw moments; null where the variance is 0."""
    n = F.col("n").cast("double")
    mean, m2, m3, m4 = (F.col(f"s{k}") / n for k in (1, 2, 3, 4))
    var = m2 - mean * mean
    kurt = F.when(var > 0, (m4 - 4 * mean * m3 + 6 * m2 * mean * mean - 3 * mean * mean * mean * mean) / (var * var) - 3)
    return m.select("beam", "chan", "blk", "n", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), kurt.alias("kurt"))


def flag_channels(stats: DataFrame, mean_off: float, std_off: float, kurt_off: float, grow: int, mean: float = 128.0, std: float = 18.0) -> DataFrame:
    """stats with flag: a channel in [chan - grow, chan + grow) of the block is off in mean, std or kurtosis; none for grow = 0, as the range is empty."""
    bad = (F.col("n") > 0) & ((F.abs(F.col("mean") - mean) > mean_off) | (F.abs(F.col("std") - std) > std_off) | (F.abs("kurt") > kurt_off))
    bad = F.coalesce(bad, F.lit(False)).cast("int")
    if grow == 0:
        return stats.withColumn("flag", F.lit(0))
    near = Window.partitionBy("beam", "blk").orderBy("chan").rangeBetween(-grow, grow - 1)
    return stats.withColumn("_bad", bad).withColumn("flag", F.max("_bad").over(near)).drop("_bad")


def rescale_table(flagged: DataFrame, mean: float = 128.0, std: float = 18.0) -> DataFrame:
    """Scale and offset by beam, channel and block: 0, 0 where flagged, the block before's where it has no samples, scale 1 without variance."""
    scale = F.when(F.col("flag") == 1, 0.0).when(F.col("n") > 0, F.when(F.col("std") > 0, F.lit(std) / F.col("std")).otherwise(1.0))
    offset = F.when(F.col("flag") == 1, 0.0).when(F.col("n") > 0, F.lit(mean) / scale - F.col("mean"))
    before = Window.partitionBy("beam", "chan").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)  # a row per block
    return flagged.select("beam", "chan", "blk", *[F.last(c, ignorenulls=True).over(before).alias(n) for c, n in ((scale, "scale"), (offset, "offset"))])


def rescale(x: DataFrame, table: DataFrame, block: int) -> DataFrame:
    """(v + offset) * scale by the block's table; samples without one go."""
    rows = x.withColumn("blk", F.expr(f"t div {block}")).join(table, ["beam", "chan", "blk"])
    return rows.select("beam", "t", "chan", ((F.col("v") + F.col("offset")) * F.col("scale")).alias("v"), "scale")


def dm0_where(x: DataFrame, cell_thresh: float) -> DataFrame:
    """Of rescaled samples (v, scale): by time the sum and count of unflagged cells below the threshold."""
    fit = (F.abs("v") < cell_thresh) & (F.col("scale") != 0)
    return x.groupBy("beam", "t").agg(F.coalesce(F.sum(F.when(fit, F.col("v"))), F.lit(0.0)).alias("dm0"), F.count_if(fit).alias("n"))


def dm0_stats(series: DataFrame, block: int) -> DataFrame:
    """series: beam, t, dm0, n. By beam and block: max, min, mean and variance of dm0 over the root of its count; times without cells go."""
    z = series.filter("n > 0").select("beam", F.expr(f"t div {block}").alias("blk"), (F.col("dm0") / F.sqrt(F.col("n").cast("double"))).alias("z"))
    return z.groupBy("beam", "blk").agg(F.max("z").alias("top"), F.min("z").alias("low"), F.avg("z").alias("mean"), F.var_pop("z").alias("var"))


def _decayed(v: np.ndarray, start: np.ndarray, k: float, size: int = 64) -> np.ndarray:
    """d = (v + k d) / (1 + k) along axis 0 from d = start, `size` steps at once: powers of the decay times inputs, as one product of matrices."""
    decay = k / (1 + k)
    step = np.arange(size)
    weights = np.where(step[:, None] >= step, decay ** np.maximum(step[:, None] - step, 0), 0.0) / (1 + k)
    fade = decay ** (step + 1)
    out, d = np.empty(v.shape), start
    for at in range(0, len(v), size):
        n = min(size, len(v) - at)
        out[at : at + n] = weights[:n, :n] @ v[at : at + n] + np.multiply.outer(fade[:n], d)
        d = out[at + n - 1]
    return out


def high_pass(x: DataFrame, k: float, block: int) -> DataFrame:
    """Exponential decay high-pass by beam and channel in order of time: d = (v + k d) / (1 + k) from d = 0, out = v - d; k = 0 leaves v as it is.

    The recursion is linear, so each block of times runs from 0 in its own task, channels side by side where they
    have the same times. What the blocks before leave over is carried at two levels, from block to block within
    a stretch of blocks and from stretch to stretch: a row per block, then per stretch, no sample.
    """
    if k == 0:
        return x.select("beam", "chan", "t", F.col("v").cast("double").alias("v"))
    decay, stretch = k / (1 + k), 1024
    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in ("beam", "chan", "t"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["chan", "t"], ignore_index=True)
        n = rows.groupby("chan").size().to_numpy()
        v = rows["v"].to_numpy(float)
        if (n == n[0]).all():
            d = _decayed(v.reshape(len(n), -1).T, np.zeros(len(n)), k).T.ravel()
        else:
            d = np.concatenate([_decayed(part, np.zeros(()), k) for part in np.split(v, np.cumsum(n)[:-1])])
        i = np.arange(1, len(v) + 1) - np.repeat(np.cumsum(n) - n, n)
        return rows[["beam", "chan", "t", "blk"]].assign(v=v, d=d, i=i)

    def chained(by: list[str], order: str, d: str, n: str) -> Column:
        """What is left before each row of rows that each leave d and fade what came before by decay^n."""
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        past = F.collect_list(F.struct(F.col(d).alias("d"), F.col(n).alias("n"))).over(before)
        return F.aggregate(past, F.lit(0.0), lambda s, e: e["d"] + s * F.pow(F.lit(decay), e["n"]))

    parts = x.withColumn("blk", F.expr(f"t div {block}")).groupBy("beam", "blk").applyInPandas(run, f"{kinds}, blk long, v double, d double, i long")
    ends = parts.groupBy("beam", "chan", "blk").agg(F.max_by("d", "t").alias("d"), F.max("i").alias("n")).withColumn("far", F.expr(f"blk div {stretch}"))
    ends = ends.withColumn("inner", chained(["beam", "chan", "far"], "blk", "d", "n")).withColumn("reach", F.sum("n").over(Window.partitionBy("beam", "chan", "far").orderBy("blk")))
    whole = F.col("d") + F.col("inner") * F.pow(F.lit(decay), F.col("n"))
    far = ends.groupBy("beam", "chan", "far").agg(F.max_by(whole, "blk").alias("d"), F.max("reach").alias("n"))
    far = far.select("beam", "chan", "far", chained(["beam", "chan"], "far", "d", "n").alias("outer"))
    left = F.col("inner") + F.col("outer") * F.pow(F.lit(decay), F.col("reach") - F.col("n"))
    carry = ends.join(far, ["beam", "chan", "far"]).select("beam", "chan", "blk", left.alias("left"))
    return parts.join(carry, ["beam", "chan", "blk"]).select("beam", "chan", "t", (F.col("v") - F.col("d") - F.col("left") * F.pow(F.lit(decay), F.col("i"))).alias("v"))


def runs_of_equal(x: DataFrame, key: list[str], order: str, value: str, block: int = 65_536) -> DataFrame:
    """Stretches of equal values in order (a whole number): key, first and last place, value, length.

    Runs are found by blocks of `order`; runs that meet at the ends of blocks are joined up then, a row for each
    run of a block, not for each sample.
    """

    def runs(rows: DataFrame, by: list[str], ends: bool = False) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("first")
        new = ~F.col("value").eqNullSafe(F.lag("value").over(w))
        if ends:  # two ends of one block have a run of another value between them
            new |= F.col("_blk") == F.lag("_blk").over(w)
        new = F.when(F.row_number().over(w) == 1, 1).otherwise(new.cast("int"))
        return rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))

    rows = x.select(*key, F.col(order).alias("first"), F.col(value).alias("value"), F.expr(f"{order} div {block}").alias("_blk"))
    own = runs(rows, [*key, "_blk"]).groupBy(*key, "_blk", "_run").agg(F.min("first").alias("first"), F.max("first").alias("last"), F.first("value").alias("value"), F.count(F.lit(1)).alias("n"))
    ends = Window.partitionBy(*key, "_blk")
    edge = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(ends))
    marked = own.withColumn("_edge", edge)
    # of each block its first and last run: at most two rows
    edges = runs(marked.filter("_edge"), key, ends=True)
    whole = edges.groupBy(*key, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("value").alias("value"), F.sum("n").alias("n"))
    return marked.filter("not _edge").select(*key, "first", "last", "value", "n").unionByName(whole.select(*key, "first", "last", "value", "n"))


def z_scores(x: DataFrame, block: int) -> DataFrame:
    """(v - mean) / std by beam, channel and block; 0 where that is not finite."""
    by = Window.partitionBy("beam", "chan", F.expr(f"t div {block}"))
    std = F.stddev_pop("v").over(by)
    return x.withColumn("v", F.when(std > 0, (F.col("v") - F.avg("v").over(by)) / std).otherwise(0.0))


def covariance(x: DataFrame, block: int, reach: int) -> DataFrame:
    """Covariance (over n - 1) of channels a <= b, b - a at most `reach`, by beam and block over their common times; null of one time."""
    cells = x.select("beam", "t", F.col("chan").alias("a"), F.col("v").cast("double").alias("va"))
    other = x.select("beam", "t", F.col("chan").alias("b"), F.col("v").cast("double").alias("vb"))
    near = cells.withColumn("b", F.explode(F.sequence(F.col("a"), F.col("a") + reach))).join(other, ["beam", "t", "b"])
    return near.groupBy("beam", F.expr(f"t div {block}").alias("blk"), "a", "b").agg(F.covar_samp("va", "vb").alias("cov"))


def beam_covariance(x: DataFrame, block: int) -> DataFrame:
    """Covariance (over n - 1) of beams a <= b by channel and block over their common times; null of one time."""
    cells = x.select("chan", "t", F.struct("beam", F.col("v").cast("double").alias("v")).alias("m"))
    at = cells.groupBy("chan", "t").agg(F.array_sort(F.collect_list("m")).alias("ms"))  # at most one for each beam
    pairs = F.flatten(F.transform("ms", lambda a: F.transform(F.filter("ms", lambda b: b["beam"] >= a["beam"]), lambda b: F.struct(a["beam"].alias("a"), b["beam"].alias("b"), a["v"].alias("va"), b["v"].alias("vb")))))
    near = at.select("chan", F.expr(f"t div {block}").alias("blk"), F.inline(pairs))
    return near.groupBy("chan", "blk", "a", "b").agg(F.covar_samp("va", "vb").alias("cov"))


def gain_test(stats: DataFrame, per_sample: float) -> DataFrame:
    """stats: mean, std. g = |mean^2 / std^2 / per_sample - 1|, which is near 0 for detected noise; null without variance."""
    return stats.withColumn("g", F.when(F.col("std") > 0, F.abs(F.pow("mean", 2) / F.pow("std", 2) / per_sample - 1)))


def flag_counts(table: DataFrame, x: DataFrame, block: int) -> DataFrame:
    """Per beam and block: channels with scale 0, and samples in them."""
    flagged = table.filter("scale = 0").select("beam", "chan", "blk")
    cells = x.groupBy("beam", "chan", F.expr(f"t div {block}").alias("blk")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(flagged, ["beam", "chan", "blk"], "left_semi").groupBy("beam", "blk").agg(F.count(F.lit(1)).alias("channels"), F.sum("n").alias("samples"))


def local_maxima(series: DataFrame) -> DataFrame:
    """series: beam, t, v. Samples above both neighbours in time (those at t - 1 and t + 1; a missing one does not count)."""
    sides = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = series.select("beam", "t", "v", F.explode(sides).alias("_k"))
    by = near.groupBy("beam", (F.col("t") + F.col("_k")).alias("t")).agg(F.max(F.when(F.col("_k") == 0, F.col("v"))).alias("v"), F.max(F.when(F.col("_k") != 0, F.col("v"))).alias("_other"))
    return by.filter(F.col("v").isNotNull() & (F.col("_other").isNull() | (F.col("v") > F.col("_other")))).select("beam", "t", "v")
