"""The search as a stream: high-pass, dispersion tree and boxcars by beam, with what they remember held as state.

Each beam's samples come in order of time, any number in a micro-batch. The tree remembers, for each place where
two bands are added with a shift, the last values of the shifted band (FIFOs); the boxcars remember the last sums
of each delay; the high-pass one value a channel. So a sample is worked on once, and the state's size depends on
channels, delays and widths alone. A beam's state is one value of Spark's state store, checkpointed with the
stream, so a restarted stream goes on where it was.

A time without samples counts as zeros. Samples older than the newest already worked on are late: they are left
out and counted in the state. Repeated samples of one time and channel add up.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedisperse import SampleTree, depths, tree
from .blocks import shared_folder

STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memory:
    """What a beam remembers."""

    def __init__(self, levels: list, depth: list[int], widths: tuple[int, ...], decay: float):
        kind = float if decay else np.int64
        self.tree, self.widths, self.decay = SampleTree(levels, depth, kind), widths, decay
        self.low = np.zeros(len(depth))
        self.boxes = np.zeros((len(levels[-1][0][2]), max(widths)), kind)
        self.reach = self.tree.reach + max(widths)
        self.clock, self.late = None, 0

    def push(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x: channel by time. Delay by time, and width by delay by time."""
        if self.decay:
            x = x.astype(float)
            for i in range(x.shape[1]):  # over times; channels at once
                self.low = (x[:, i] + self.decay * self.low) / (1 + self.decay)
                x[:, i] -= self.low
        out = self.tree.push(x)
        every = np.concatenate([self.boxes, out], axis=1)
        total = np.concatenate([np.zeros((len(every), 1), every.dtype), np.cumsum(every, axis=1)], axis=1)
        at = np.arange(self.boxes.shape[1], every.shape[1])
        self.boxes = every[:, out.shape[1] :]
        return out, np.stack([total[:, at + 1] - total[:, at + 1 - w] for w in self.widths])


class _Search(StatefulProcessor):
    def __init__(self, make, nf: int, block: int):
        self.make, self.nf, self.block = make, nf, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", "memory binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        memory: Memory = pickle.loads(self.state.get()[0]) if self.state.exists() else self.make()
        x = pd.concat(rows)
        if memory.clock is not None:
            late = x["t"] < memory.clock
            memory.late += int(late.sum())
            x = x[~late]
        x = x.sort_values("t")
        t, chan, v = x["t"].to_numpy(), x["chan"].to_numpy(), x["v"].to_numpy()
        at = 0
        while at < len(t):
            if memory.clock is None or t[at] - memory.clock > memory.reach + self.block:
                start = t[at] if memory.clock is None or memory.decay == 0 else memory.clock
                if memory.clock is not None and memory.decay == 0:  # nothing is left of what came before; its tail first
                    yield from self.put(key, memory, memory.clock, np.zeros((self.nf, memory.reach), np.int64), np.zeros(memory.reach, bool))
                memory.clock = start
            stop = memory.clock + self.block
            upto = np.searchsorted(t, stop)
            size = self.block if upto < len(t) else int(t[-1]) + 1 - memory.clock
            cube, seen = np.zeros((self.nf, size), v.dtype), np.zeros(size, bool)
            np.add.at(cube, (chan[at:upto], t[at:upto] - memory.clock), v[at:upto])
            seen[t[at:upto] - memory.clock] = True
            yield from self.put(key, memory, memory.clock, cube, seen)
            at = upto
        self.state.update((pickle.dumps(memory),))

    def put(self, key: tuple, memory: Memory, start: int, cube: np.ndarray, seen: np.ndarray) -> Iterator[pd.DataFrame]:
        out, sums = memory.push(cube)
        memory.clock = start + cube.shape[1]
        keep = (sums != 0).any(axis=0)
        keep[0] |= seen
        idt, at = np.nonzero(keep)
        yield pd.DataFrame({"beam": key[0], "idt": idt, "t": at + start, "seen": seen[at], "v": out[idt, at], "s": list(sums[:, idt, at].T)})


def search(stream: DataFrame, nf: int, f0: float, df: float, nd: int, widths: tuple[int, ...] = (1,), decay: float = 0.0, block: int = 256) -> DataFrame:
    """stream: beam, t, chan, v, in order of time by beam. Per beam, idt, t: v, the sum along the delay curve, s, by width its sum over the last times, and seen, whether the beam has a sample at t.

    Rows whose sums are all 0 are left out, but for those of idt 0 with a sample. With decay the samples pass
    the exponential high-pass first (see spectra.high_pass) and sums are doubles.
    """
    levels, depth = tree(nf, f0, df, nd), depths(nf, f0, df, nd)
    value = "double" if decay else "long"
    kind = stream.schema["beam"].dataType.simpleString()
    processor = _Search(lambda: Memory(levels, depth, tuple(widths), decay), nf, block)
    return stream.groupBy("beam").transformWithStateInPandas(processor, f"beam {kind}, idt long, t long, seen boolean, v {value}, s array<{value}>", "Append", "None")


def candidates(searched: DataFrame, widths: tuple[int, ...], least: float) -> DataFrame:
    """Of each beam, idt and t the width with the largest sum over its root (ties: the smaller), where that reaches ``least``."""
    sn = [F.struct((F.col("s")[k] / F.sqrt(F.lit(float(w)))).alias("sn"), F.lit(-w).alias("w")) for k, w in enumerate(widths)]
    best = searched.withColumn("m", F.array_max(F.array(*sn))).filter(F.col("m.sn") >= least)
    return best.select("beam", "idt", "t", (-F.col("m.w")).alias("width"), F.col("m.sn").alias("sn"))


def run_with_state(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an append stream with Python state over all there is, or goes on with it; state and results are in the (shared) folder.

    A new stream's state has no more partitions than the session has cores: each costs a Python worker and a commit a micro-batch, whether it has rows or not.
    """
    spark = stream.sparkSession
    few = min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism)
    settings = {STORE: ROCKS, PARTITIONS: str(few)}
    was = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def lay_out(table: DataFrame, time: str, span: int, folder: str, rows: int | None = None) -> list[int]:
    """Writes the table to the folder in one pass, a part of `span` times each, and returns the parts' numbers in order of time.

    With ``rows`` neighbouring parts are one, as long as they have about that many rows, and a quarter of the table at most.
    """
    spark = table.sparkSession
    keyed = table.filter(F.col(time).isNotNull()).withColumn("_part", F.expr(f"cast({time} div {span} as bigint)"))
    if rows is not None:
        order = Window.orderBy("_part")  # a row for each span
        spans = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_before": F.sum("_n").over(order) - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy())})
        joint = spans.select("_part", F.floor(F.col("_before") / F.least(F.lit(rows), F.ceil(F.col("_all") / 4))).cast("bigint").alias("_joint"))
        keyed = keyed.join(joint, "_part").withColumn("_part", F.col("_joint")).drop("_joint")
    keyed.repartition("_part").write.partitionBy("_part").parquet(folder)
    laid = spark.read.schema(keyed.schema).parquet(folder)
    return sorted(r._part for r in laid.select("_part").distinct().collect())


def arrive(spark: SparkSession, laid: str, parts: list[int], schema, folder: str) -> None:
    """Copies parts that lay_out has written to the folder, a file each, one after the other, as an instrument would write them."""
    for k in parts:
        spark.read.schema(schema).parquet(f"{laid}/_part={k}").coalesce(1).write.mode("append").parquet(folder)
    if not parts:
        spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(folder)  # so that there is something to stream


def replay(table: DataFrame, time: str, span: int, folder: str, skip: int = 0, most: int | None = None, rows: int | None = None) -> None:
    """Writes the table to the folder as files of `span` times each (of several spans, see lay_out, with ``rows``), one after the other. The table is read once, however many files it makes."""
    laid = f"{folder}-{uuid.uuid4().hex}"
    parts = [k for k in lay_out(table, time, span, laid, rows) if k >= skip]
    arrive(table.sparkSession, laid, parts if most is None else [k for k in parts if k < skip + most], table.schema, folder)


def as_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The folder's files as a stream, a file a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def replayed(table: DataFrame, time: str, span: int, rows: int = 1 << 20) -> tuple[DataFrame, str]:
    """A table as a stream in micro-batches of whole spans of `span` times, about ``rows`` rows each, four micro-batches at least, and a folder for its state and results."""
    root = shared_folder(table.sparkSession)
    replay(table, time, span, f"{root}/in", rows=rows)
    return as_stream(table.sparkSession, f"{root}/in", table.schema), root
