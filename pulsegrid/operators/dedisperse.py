"""Tree dedispersion: the shift-and-add tree, by blocks of time with the samples before them or with memory."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .spectra import in_blocks


def share(a: float, b: float, c: float, d: float) -> float:
    """The part of the dispersion delay between c and d that falls between a and b."""
    return (a**-2 - b**-2) / (c**-2 - d**-2)


def _delays(lo: float, hi: float, top: tuple[float, float], nd: int) -> int:
    return ceil((nd - 1) * share(lo, hi, *top)) + 1


def tree(nf: int, f0: float, df: float, nd: int) -> list:
    """Levels of nodes (left, right or None, [(left delay, right delay, shift of the right)] by the node's delay); channel c is [f0 + c df, f0 + (c + 1) df]."""
    top, bands, levels = (f0, f0 + nf * df), [(f0 + c * df, f0 + (c + 1) * df) for c in range(nf)], []
    while len(bands) > 1:
        size, level, wider = [_delays(*b, top, nd) for b in bands], [], []
        for k in range(0, len(bands) - 1, 2):
            (lo, mid), (_, hi) = bands[k], bands[k + 1]
            rows = []
            for d in range(min(nd, _delays(lo, hi, top, nd))):
                # half a channel below the middle for the lower half's own delay, half a channel above it for the shift
                shift = round(d * share(mid + df / 2, lo, hi, lo))
                rows.append((round(d * share(mid - df / 2, lo, hi, lo)), d - shift, shift))
            level.append((k, k + 1, rows))
            wider.append((lo, hi))
        if len(bands) % 2:
            level.append((len(bands) - 1, None, [(d, 0, 0) for d in range(size[-1])]))
            wider.append(bands[-1])
        levels.append(level)
        bands = wider
    return levels


def trace(levels: list, d: int, node: int = 0) -> list[tuple[int, int, int]]:
    """The channels that make up delay d: (channel, its own delay, shift)."""
    if not levels:
        return [(node, d, 0)]
    left, right, rows = levels[-1][node]
    d1, d2, shift = rows[d]
    out = trace(levels[:-1], d1, left)
    return out if right is None else out + [(c, e, s + shift) for c, e, s in trace(levels[:-1], d2, right)]


def depths(nf: int, f0: float, df: float, nd: int) -> list[int]:
    """How many delays each channel's first state has."""
    return [_delays(f0 + c * df, f0 + (c + 1) * df, (f0, f0 + nf * df), nd) for c in range(nf)]


class SampleTree:
    """Levels of a tree (see dedisperse.tree) with memory: push() takes channel by time and returns delay by time."""

    def __init__(self, levels: list, depth: list[int], kind: type = np.int64):
        self.levels, self.depth = levels, depth
        self.past = [np.zeros(n, kind) for n in depth]  # of each channel, one more than its widest sum needs
        self.fifo = []
        sizes = depth
        for level in levels:
            self.fifo.append([np.zeros((0 if right is None else sizes[right], max((r[2] for r in rows), default=0)), kind) for _, right, rows in level])
            sizes = [len(rows) for _, _, rows in level]
        self.reach = sum(max((f.shape[1] for f in fs), default=0) for fs in self.fifo) + max(depth)

    def push(self, x: np.ndarray) -> np.ndarray:
        n, state = x.shape[1], []
        for c, (row, depth) in enumerate(zip(x, self.depth, strict=True)):
            every = np.concatenate([self.past[c], row])
            total = np.concatenate([[0], np.cumsum(every)])
            at = np.arange(depth, depth + n)
            state.append(np.stack([total[at + 1] - total[at - d] for d in range(depth)]))
            self.past[c] = every[n:]
        for level, fifos in zip(self.levels, self.fifo, strict=True):
            after = []
            for k, (left, right, rows) in enumerate(level):
                out = state[left][[r[0] for r in rows]]
                if right is not None:
                    held = fifos[k].shape[1]
                    every = np.concatenate([fifos[k], state[right]], axis=1)
                    for d, (_, d2, shift) in enumerate(rows):
                        out[d] += every[d2, held - shift : held - shift + n]
                    fifos[k] = every[:, n:]
                after.append(out)
            state = after
        return state[0]


def dedisperse_tree(x: DataFrame, nf: int, f0: float, df: float, nd: int, block: int) -> DataFrame:
    """x: beam, t, chan, v. Per beam, idt, t: the sum along the delay curve, where not 0.

    Samples are shuffled once, by beam and block, each block with the samples that its sums reach back to; a task
    holds one block of nf x (reach + block) samples and puts out that block's sums, whole.
    """
    levels, depth = tree(nf, f0, df, nd), depths(nf, f0, df, nd)
    reach = SampleTree(levels, depth).reach

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        beam, blk = key
        cube, first = np.zeros((nf, reach + block), np.int64), blk * block - reach
        np.add.at(cube, (rows["chan"].to_numpy(), rows["t"].to_numpy() - first), rows["v"].to_numpy())
        out = SampleTree(levels, depth).push(cube)[:, reach:]
        idt, t = np.nonzero(out)
        return pd.DataFrame({"beam": beam, "idt": idt, "t": t + blk * block, "v": out[idt, t]})

    kind = x.schema["beam"].dataType.simpleString()
    return in_blocks(x, block, reach).groupBy("beam", "blk").applyInPandas(run, f"beam {kind}, idt long, t long, v long")
