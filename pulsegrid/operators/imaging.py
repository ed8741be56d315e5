"""Cells of the uv plane, and image pixels over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import shifted, triangular_index
from .dedisperse import SampleTree, depths, tree
from .spectra import in_blocks

WEIGHTS = {"sum": lambda w: 1.0, "avg": lambda w: 1.0 / w, "sqrt": lambda w: w**-0.5}


def upper(u: Column, v: Column, npix: int) -> tuple[Column, Column]:
    """The one of a pixel and its conjugate that has u >= v."""
    flip = lambda c: F.when(u >= v, c).otherwise(F.when(c == 0, 0).otherwise(npix - c))
    return flip(u), flip(v)


def uv_cells(baselines: DataFrame, freqs: list[float], ucell: float, vcell: float, npix: int) -> DataFrame:
    """baselines: blid, uu, vv (seconds); freqs (Hz) by channel. A row for each run of channels that a baseline spends in one pixel.

    Columns: blid, u, v (centre moved to 0), first, last, upper_u, upper_v, upper_idx. Halves round to even; a pixel outside the grid is an
    error, runs with u = 0 or v = 0 are left out. A baseline's channels are the only rows that one group gathers.
    """
    at = lambda lam: F.bround(lam + npix / 2.0).cast("int")
    rows = baselines.select("blid", "uu", "vv", F.posexplode(F.array(*[F.lit(float(f)) for f in freqs])).alias("chan", "freq"))
    rows = rows.withColumns({"u": at(-F.col("uu") * F.col("freq") / ucell), "v": at(F.col("vv") * F.col("freq") / vcell)})
    inside = F.col("u").between(0, npix - 1) & F.col("v").between(0, npix - 1)
    wrong = F.raise_error(F.concat(F.lit("pixel out of range for baseline "), F.col("blid").cast("string"))).cast("int")
    rows = rows.withColumns({"u": F.when(inside, shifted(F.col("u"), npix)).otherwise(wrong), "v": F.when(inside, shifted(F.col("v"), npix)).otherwise(wrong)})
    order = Window.partitionBy("blid").orderBy("chan")
    before = F.lag(F.struct("u", "v")).over(order)
    rows = rows.withColumn("_new", (before.isNull() | (before != F.struct("u", "v"))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    runs = rows.groupBy("blid", "_run").agg(F.first("u").alias("u"), F.first("v").alias("v"), F.min("chan").alias("first"), F.max("chan").alias("last"))
    x, y = upper(F.col("u"), F.col("v"), npix)
    cells = runs.filter("u <> 0 and v <> 0").select("blid", "u", "v", "first", "last", x.alias("upper_u"), y.alias("upper_v"))
    return cells.withColumn("upper_idx", triangular_index(F.col("upper_u"), F.col("upper_v"), npix).cast("long"))


def find_cells(cells: DataFrame, wanted: DataFrame, npix: int) -> DataFrame:
    """wanted: name, u, v. The cells at each wanted pixel or its conjugate."""
    x, y = upper(F.col("u"), F.col("v"), npix)
    keys = wanted.select("name", x.alias("upper_u"), y.alias("upper_v"))
    return keys.join(cells, ["upper_u", "upper_v"]).select("name", "blid", "first", "last")


def image_boxcars(images: DataFrame, nbox: int, weight: str = "sqrt", block: int = 4096) -> DataFrame:
    """images: idm, x, y, t, v. Per pixel and width 1 .. nbox the weighted sum over the last `width` times, as an array s by width; missing images count as 0."""
    order = Window.partitionBy("idm", "x", "y", "blk").orderBy("t")
    sums = [F.sum("v").over(order.rangeBetween(1 - w, 0)) * WEIGHTS[weight](w) for w in range(1, nbox + 1)]
    return in_blocks(images, block, nbox - 1).withColumn("s", F.array(*sums)).filter("not halo").select("idm", "x", "y", "t", "s")


def image_candidates(boxed: DataFrame, nbox: int, threshold: float) -> DataFrame:
    """Per pixel and time the width with the largest value (ties: the smaller), where that is at or above threshold: idm, t, x, y, width, sn. Chosen within the row."""
    best = boxed.withColumn("m", F.array_max(F.array(*[F.struct(F.col("s")[k].alias("sn"), F.lit(-1 - k).alias("w")) for k in range(nbox)])))
    return best.select("idm", "t", "x", "y", (-F.col("m.w")).alias("width"), F.col("m.sn").alias("sn")).filter(F.col("sn") >= threshold)


def cell_delays(x: DataFrame, sub: int, f0: float, df: float, nd: int, block: int) -> DataFrame:
    """First stage of two: a small dispersion tree for each uv cell over its own sub-band, on complex values.

    x: cell, start (first channel of the sub-band, from 0), t, chan (start <= chan < start + sub), re, im. Channel c
    is [f0 + c df, f0 + (c + 1) df]. Per cell and block of times: cell, start, blk, d (delay within the sub-band, below nd),
    re and im as arrays over the block's times. Blocks keep no history. A group is a cell's block: sub x block values.
    """
    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in ("cell", "start"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cell, start, blk = rows["cell"].iloc[0], int(rows["start"].iloc[0]), int(rows["blk"].iloc[0])
        cube = np.zeros((sub, block), complex)
        np.add.at(cube, (rows["chan"].to_numpy() - start, rows["t"].to_numpy() - blk * block), rows["re"].to_numpy() + 1j * rows["im"].to_numpy())
        at = (sub, f0 + start * df, df, nd)
        out = SampleTree(tree(*at), depths(*at), complex).push(cube)
        return pd.DataFrame({"cell": cell, "start": start, "blk": blk, "d": np.arange(len(out)), "re": list(out.real), "im": list(out.imag)})

    parts = x.withColumn("blk", F.expr(f"t div {block}")).groupBy("cell", "start", "blk")
    return parts.applyInPandas(run, f"{kinds}, blk long, d long, re array<double>, im array<double>")


def sub_band_plan(starts: DataFrame, nf: int, sub: int, f0: float, df: float, nd: int) -> DataFrame:
    """Second stage: for each overall delay idm (below nd) the delay d within the sub-band that begins at channel start, and how much later the sub-band comes.

    starts: start. Frequencies are those of channel edges: fmin = f0, fmax = f0 + nf df, a sub-band from f0 + start df on.
    Half a sample over nd is added to the shift, halves round to even.
    """
    low = F.lit(f0) + F.col("start") * df
    share = lambda a, b: (F.pow(a, F.lit(-2.0)) - F.pow(b, F.lit(-2.0))) / ((f0**-2) - (f0 + nf * df) ** -2)
    plan = starts.select("start").distinct().withColumn("idm", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
    within, before = share(low, low + sub * df), share(F.lit(f0), low) + 0.5 / nd
    return plan.select("start", "idm", F.bround(F.col("idm") * within).cast("long").alias("d"), F.bround(F.col("idm") * before).cast("int").alias("shift"))


def grid_delays(parts: DataFrame, cells: DataFrame, plan: DataFrame, npix: int, block: int) -> DataFrame:
    """parts: see cell_delays. cells: cell, u, v. Per blk, idm, t, u, v: the complex grid of two images, times 2 t and 2 t + 1, the second one times i.

    A cell adds its value at its pixel and the conjugate at the opposite one (v1 + i v2, conj(v1) - conj(v2)); times before
    the block are 0. Cells of one pixel add up before the shuffle; zeros are left out.
    """
    met = parts.join(F.broadcast(plan), ["start", "d"]).join(cells, "cell")  # the plan: sub-bands times idm
    pair = F.transform(F.sequence(F.lit(0), F.lit(block // 2 - 1)), lambda t: F.struct(t.alias("t"), (2 * t - F.col("shift")).alias("at")))
    rows = met.select("blk", "idm", "u", "v", "re", "im", F.inline(pair))
    take = lambda c, k: F.when(F.col("at") + k >= 0, F.get(c, F.col("at") + k)).otherwise(F.lit(0.0))
    rows = rows.select("blk", "idm", "t", "u", "v", take("re", 0).alias("r1"), take("im", 0).alias("i1"), take("re", 1).alias("r2"), take("im", 1).alias("i2"))
    opposite = lambda c: F.pmod(-F.col(c), F.lit(npix))
    here = F.struct(F.col("u").alias("u"), F.col("v").alias("v"), (F.col("r1") - F.col("i2")).alias("re"), (F.col("i1") + F.col("r2")).alias("im"))
    there = F.struct(opposite("u").alias("u"), opposite("v").alias("v"), (F.col("r1") + F.col("i2")).alias("re"), (F.col("r2") - F.col("i1")).alias("im"))
    both = rows.select("blk", "idm", "t", F.inline(F.array(here, there)))
    return both.groupBy("blk", "idm", "t", "u", "v").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).filter("re <> 0 or im <> 0")


def fill_cells(vis: DataFrame, cells: DataFrame, conjugate_lower: bool = False, scale: float | None = None) -> DataFrame:
    """vis: blid, t, chan, re, im. cells: cell, blid, first, last, start (first channel of the cell's run), lower. Each cell's samples: cell, start, t, chan, re, im, as cell_delays takes them.

    With conjugate_lower those of lower cells are conjugated; with scale values are multiplied and rounded (halves to even).
    A channel of a baseline may be in several cells or none.
    """
    met = vis.join(cells.select("cell", "blid", "first", "last", "start", "lower"), "blid").filter(F.col("chan").between(F.col("first"), F.col("last")))
    im = F.when(F.col("lower"), -F.col("im")).otherwise(F.col("im")) if conjugate_lower else F.col("im")
    sized = (lambda c: c) if scale is None else (lambda c: F.bround(c * scale) + 0.0)  # no negative zero
    return met.select("cell", "start", "t", "chan", sized(F.col("re")).alias("re"), sized(im).alias("im"))


def grid_pairs(x: DataFrame, npix: int) -> DataFrame:
    """x: t, u, v, re, im. Two images in one complex grid: times 2 t and 2 t + 1, the second one times i, with conjugates opposite. Per t, u, v: re, im; zeros are left out."""
    odd = F.pmod("t", F.lit(2)) == 1
    re, im = F.when(odd, -F.col("im")).otherwise(F.col("re")), F.when(odd, F.col("re")).otherwise(F.col("im"))
    # conj(v1) - conj(i v2) = conj(v1) + i conj(v2)
    re2, im2 = F.when(odd, F.col("im")).otherwise(F.col("re")), F.when(odd, F.col("re")).otherwise(-F.col("im"))
    opposite = lambda c: F.pmod(-F.col(c), F.lit(npix))
    both = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v"), re.alias("re"), im.alias("im")), F.struct(opposite("u").alias("u"), opposite("v").alias("v"), re2.alias("re"), im2.alias("im")))
    rows = x.select(F.expr("t div 2").alias("t"), F.inline(both))
    return rows.groupBy("t", "u", "v").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).filter("re <> 0 or im <> 0")
