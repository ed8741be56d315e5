"""Transforms over bounded groups: block power spectra, singular-vector cleaning, gridding and images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def power_spectrum(series: DataFrame, block: int) -> DataFrame:
    """series: beam, t, v. Per beam and block of time: power at k = 0 .. block / 2; missing samples count as 0."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(block)
        np.add.at(x, rows["t"].to_numpy() % block, rows["v"].to_numpy())
        power = np.abs(np.fft.rfft(x)) ** 2
        return pd.DataFrame({"beam": key[0], "blk": key[1], "k": np.arange(len(power)), "power": power})

    kind = series.schema["beam"].dataType.simpleString()
    return series.withColumn("blk", F.expr(f"t div {block}")).groupBy("beam", "blk").applyInPandas(run, f"beam {kind}, blk long, k long, power double")


def remove_strongest(x: DataFrame, block: int, gone: int = 1) -> DataFrame:
    """x: beam, t, chan, v. Each block of time without its `gone` strongest singular components; a group is one block, channels x block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cube = rows.pivot_table(index="chan", columns="t", values="v", aggfunc="sum", fill_value=0.0)
        u, s, vt = np.linalg.svd(cube.to_numpy(float), full_matrices=False)
        s[:gone] = 0
        clean = (u * s) @ vt
        c, t = np.indices(clean.shape).reshape(2, -1)
        return pd.DataFrame({"beam": rows["beam"].iloc[0], "t": cube.columns.to_numpy()[t], "chan": cube.index.to_numpy()[c], "v": clean.ravel()})

    kinds = {c: x.schema[c].dataType.simpleString() for c in ("beam", "t", "chan")}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", v double"
    return x.withColumn("blk", F.expr(f"t div {block}")).groupBy("beam", "blk").applyInPandas(run, schema)


def uv_grid(vis: DataFrame, npix: int, cell: float) -> DataFrame:
    """vis: t, u, v, re, im. Sums by t and cell, each visibility with its conjugate at (-u, -v); u = 0 = v goes; halves round to even."""
    conj = vis.select("t", (-F.col("u")).alias("u"), (-F.col("v")).alias("v"), "re", (-F.col("im")).alias("im"))
    both = vis.select("t", "u", "v", "re", "im").unionByName(conj).filter("u <> 0 or v <> 0")
    at = lambda c: F.bround(F.col(c) / cell + npix / 2).cast("int")
    cells = both.select("t", at("u").alias("upix"), at("v").alias("vpix"), "re", "im").filter((F.col("upix").between(0, npix - 1)) & (F.col("vpix").between(0, npix - 1)))
    return cells.groupBy("t", "upix", "vpix").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def image(grid: DataFrame, npix: int) -> DataFrame:
    """grid as of uv_grid. Per t the real image by pixel; a group is one grid of npix x npix cells at most."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((npix, npix), complex)
        g[rows["vpix"].to_numpy(), rows["upix"].to_numpy()] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        sky = np.fft.fftshift(np.fft.fft2(np.fft.fftshift(g))).real
        y, x = np.indices(sky.shape).reshape(2, -1)
        return pd.DataFrame({"t": key[0], "x": x, "y": y, "v": sky.ravel()})

    return grid.groupBy("t").applyInPandas(run, f"t {grid.schema['t'].dataType.simpleString()}, x int, y int, v double")
