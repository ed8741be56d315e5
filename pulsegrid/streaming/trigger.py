"""The real-time trigger: each micro-batch of candidates is clustered, and the first one with a strong enough cluster gives one row.

A batch writes its match, if it has one, to a folder of its own number and overwrites what is there, so a batch that
is run again (after a lost executor or driver) leaves one row. A batch after the first match does nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.clusters import density_clusters, strongest_of_clusters
from .blocks import shared_folder
from .search import arrive, as_stream, lay_out

CANDIDATE = ["rid", "sn", "sampno", "secs", "boxcar", "idt", "dm", "beam", "mjd"]


@dataclass(frozen=True)
class Rules:
    """Clusters (eps, least rows), and what a cluster's strongest candidate must be like."""

    eps: int = 6
    least: int = 3
    min_sn: float = 10.0
    max_width: int = 6
    min_dm: float = 3.0
    min_secs: float = 10.0
    skip_beam: int = 35


def strongest(cand: DataFrame, rules: Rules, now_mjd: Column | None = None) -> DataFrame:
    """cand: CANDIDATE, rid unique. The strongest cluster head that passes (ties: smaller rid), if any, with latency_ms: from mjd to now."""
    now = F.unix_micros(F.current_timestamp()) / 86_400e6 + 40_587 if now_mjd is None else now_mjd
    heads = strongest_of_clusters(cand, density_clusters(cand, rules.eps, rules.least)).select("rid")
    fit = (F.col("sn") > rules.min_sn) & (F.col("boxcar") < rules.max_width) & (F.col("dm") > rules.min_dm) & (F.col("beam") != rules.skip_beam) & (F.col("secs") > rules.min_secs)
    best = cand.join(heads, "rid", "left_semi").filter(fit).orderBy(F.desc("sn"), "rid").limit(1)
    return best.select(*CANDIDATE, ((now - F.col("mjd")) * 86_400e3).alias("latency_ms"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """The matches in the folder; batch is the number of the micro-batch."""
    return spark.read.parquet(f"{folder}/found").filter("batch >= 0")


def on_batch(folder: str, rules: Rules, now_mjd: Column | None = None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls; batches may come more than once."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = found(spark, folder).agg(F.min("batch")).first()[0]
        if first is not None and first < number:
            return
        strongest(batch, rules, now_mjd).write.mode("overwrite").parquet(f"{folder}/found/batch={number}")

    return run


def trigger(stream: DataFrame, folder: str, rules: Rules = Rules(), now_mjd: Column | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the trigger over a stream of candidates; state and matches are in the (shared) folder."""
    spark = stream.sparkSession
    empty = strongest(spark.createDataFrame([], stream.schema), rules, now_mjd)
    empty.write.mode("overwrite").parquet(f"{folder}/found/batch=-1")  # so that the folder has a schema
    writer = stream.writeStream.foreachBatch(on_batch(folder, rules, now_mjd)).option("checkpointLocation", f"{folder}/state")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_match(spark: SparkSession, query: StreamingQuery, folder: str, poll_secs: float = 1.0) -> DataFrame:
    """Waits for the first match and stops the stream then (or when the stream ends): one row or none."""
    while not query.awaitTermination(poll_secs):
        if not found(spark, folder).isEmpty():
            query.stop()
            break
    matches = found(spark, folder)
    first = matches.agg(F.min("batch").alias("batch"))
    return matches.join(first, "batch", "left_semi").drop("batch")


def first_replayed(cand: DataFrame, time: str, span: int, rules: Rules, now_mjd: Column | None = None, few: int = 8) -> DataFrame:
    """The first match of a table that arrives in micro-batches of ``span`` times, ``few`` of them before the trigger looks again: one row or none.

    The table is read and laid out once; what comes after the first match is not sent any more.
    """
    spark, root = cand.sparkSession, shared_folder(cand.sparkSession)
    parts = lay_out(cand, time, span, f"{root}/laid")
    for at in range(0, max(len(parts), 1), few):
        arrive(spark, f"{root}/laid", parts[at : at + few], cand.schema, f"{root}/in")
        match = first_match(spark, trigger(as_stream(spark, f"{root}/in", cand.schema), root, rules, now_mjd), root)
        if not match.isEmpty():
            break
    return match
