"""Packed voltage files: a text header beside (or ahead of) words of 32 bits, each word several complex samples of one channel.

    mode  word                                   complex samples a word
    0     16 + 16 bits                           1
    2     4 x (4 + 4 bits), two's complement     4
    3     16 x (1 + 1 bits), 0 is +1 and 1 is -1 16

Words follow each other channel by channel, then in time; within a word the earliest sample is in the lowest bits,
the real part below the imaginary one. A partition is a range of words, so a range of samples may begin and end
within a word. Files must be on storage that all executors mount.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .dada import read_header

#: Fixed values of the format: bits of a part, and complex samples a word, by mode.
BITS, PER_WORD = {0: 16, 2: 4, 3: 1}, {0: 1, 2: 4, 3: 16}


def unpack(words: np.ndarray, mode: int) -> np.ndarray:
    """words: (n, channels) of unsigned 32 bits. Samples: (n * PER_WORD, channels, 2) of signed 16 bits."""
    bits, per = BITS[mode], PER_WORD[mode]
    places = np.arange(2 * per, dtype=np.uint32) * bits
    codes = (words[:, :, None] >> places) & np.uint32((1 << bits) - 1)
    if mode == 3:
        values = 1 - 2 * codes.astype(np.int16)
    else:
        values = codes.astype(np.int32)
        values -= (values >> (bits - 1)) << bits
    n, channels = words.shape
    return values.astype(np.int16).reshape(n, channels, per, 2).transpose(0, 2, 1, 3).reshape(n * per, channels, 2)


def pack(samples: np.ndarray, mode: int) -> np.ndarray:
    """The inverse of unpack, for a whole number of words; mode 3 keeps signs only (0 as +1)."""
    bits, per = BITS[mode], PER_WORD[mode]
    n, channels, _ = samples.shape
    codes = (samples < 0) if mode == 3 else samples
    codes = codes.astype(np.int64) & ((1 << bits) - 1)
    codes = codes.reshape(n // per, per, channels, 2).transpose(0, 2, 1, 3).reshape(n // per, channels, 2 * per)
    return (codes << (np.arange(2 * per) * bits)).sum(axis=2).astype("<u4")


class _Words(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first))
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.mode = options["path"].split(","), options.get("mode")
        self.start, self.count = int(options.get("start", 0)), options.get("samples")
        self.together = int(options.get("words", 1 << 16))

    def about(self, path: str) -> tuple[dict[str, str], int, int, list[float], int]:
        """Header, mode, bytes ahead of the words, frequencies by channel, complex samples."""
        head = read_header(f"{path}.hdr" if os.path.exists(f"{path}.hdr") else path)
        mode = int(head["CRAFT_MODE"]) & 3 if self.mode is None else int(self.mode)
        if mode not in BITS:
            raise ValueError(f"{path}: mode {mode} cannot be unpacked")
        ahead, freqs = int(head["HDR_SIZE"]), [float(f) for f in head["FREQS"].split(",")]
        return head, mode, ahead, freqs, (os.path.getsize(path) - ahead) // 4 // len(freqs) * PER_WORD[mode]

    def partitions(self) -> list[_Words]:
        out = []
        for path in self.paths:
            _, mode, _, _, n = self.about(path)
            end = n if self.count is None else min(n, self.start + int(self.count))
            if self.start < 0 or self.start > n:
                raise ValueError(f"{path}: has {n} samples, not {self.start}")
            first, last = self.start // PER_WORD[mode], -(-end // PER_WORD[mode])
            out += [_Words(path, k, min(k + self.together, last)) for k in range(first, last, self.together)]
        return out or [_Words("", 0, 0)]

    def read(self, part: _Words):
        if not part.path:
            return
        head, mode, ahead, freqs, n = self.about(part.path)
        end = n if self.count is None else min(n, self.start + int(self.count))
        channels, per = len(freqs), PER_WORD[mode]
        with open(part.path, "rb") as f:
            for at in range(part.first, part.last, step := max(1, (1 << 20) // (channels * per))):
                f.seek(ahead + at * channels * 4)
                words = np.frombuffer(f.read(min(step, part.last - at) * channels * 4), "<u4").reshape(-1, channels)
                t = np.arange(at * per, (at + len(words)) * per)
                keep = (t >= self.start) & (t < end)
                x, t = unpack(words, mode)[keep], t[keep]
                m = len(t) * channels
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path] * m), pa.array([head.get("ANT")] * m, pa.string()), pa.array(np.repeat(t, channels)), pa.array(np.tile(np.arange(channels, dtype=np.int32), len(t))),
                     pa.array(np.tile(freqs, len(t))), pa.array(x[:, :, 0].ravel()), pa.array(x[:, :, 1].ravel())],
                    names=["file", "ant", "t", "chan", "freq", "re", "im"],
                )


class Voltages(DataSource):
    """spark.read.format("voltages").load(paths, comma-separated): file, ant, t (complex sample), chan, freq, re, im.

    Options: start and samples (a range, from any sample), mode (instead of the header's), words (of each channel in a
    partition). A last sample set without all its channels is left out. Mode 1 is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "voltages"

    def schema(self) -> str:
        return "file string, ant string, t long, chan int, freq double, re short, im short"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_voltages(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Voltages)
    return spark.read.format("voltages").options(**options).load(path)
