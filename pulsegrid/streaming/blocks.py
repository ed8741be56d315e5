"""Structured Streaming forms: tumbling blocks under a watermark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def tumbling(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """stream: ts, event_type, value. Per type and window: start, n, top; late rows are dropped by the watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    blocks = timed.groupBy("event_type", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return blocks.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "top")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one on a local master, an error elsewhere."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame) -> DataFrame:
    """Runs an append stream over all there is and reads what it wrote; state and results are in the shared folder."""
    spark, root = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def in_time(stream: DataFrame, time: str, key: list[str], delay: str) -> DataFrame:
    """A packet stream without repeats of a key; packets later than `delay` behind the newest are dropped (and counted by Spark)."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(key)


def fill_gaps(series: DataFrame, key: str, t: str, value: str, block: int) -> DataFrame:
    """series with a row, value null, for each time missing between a key's first and last; times are laid out block by block."""
    ends = series.groupBy(key).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    blocks = ends.select(key, "_a", "_b", F.explode(F.expr(f"sequence(_a div {block}, _b div {block})")).alias("_k"))
    times = blocks.select(key, F.explode(F.expr(f"sequence(greatest(_a, _k * {block}), least(_b, _k * {block} + {block - 1}))")).alias(t))
    return times.join(series.select(key, t, value), [key, t], "left")


def reassemble(packets: DataFrame) -> DataFrame:
    """packets: src, frame, fragment (from 1), n_fragments, payload. Per complete frame its payload, repeats counted once; incomplete frames go."""
    once = packets.groupBy("src", "frame", "fragment").agg(F.max("n_fragments").alias("n"), F.min("payload").alias("payload"))
    whole = once.groupBy("src", "frame").agg(F.count(F.lit(1)).alias("have"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("fragment", "payload"))).alias("parts"))
    return whole.filter("have = n").select("src", "frame", F.array_join(F.transform("parts", lambda p: p["payload"].cast("string")), "").alias("payload"))


def tumbling_hours(events: DataFrame) -> DataFrame:
    """The batch form of tumbling, without late rows: per type and hour n and top."""
    return events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


def reordered(stream: DataFrame, slots: int, size: int, step_secs: float) -> DataFrame:
    """A reorder buffer. stream: integ (whole number), idx (below size), v, in any order. Per integration, once the newest is `slots` ahead: integ, vals by idx, NaN where none came.

    Integrations are dated step_secs apart, so that the watermark holds `slots` of them; packets that come later are dropped, and Spark's
    progress reports count them. Of repeated packets the largest value counts. State is bounded by slots * size values.
    """
    at = F.timestamp_micros((F.col("integ") * int(step_secs * 1e6)).cast("long"))
    timed = stream.withColumn("_at", at).withWatermark("_at", f"{int(slots * step_secs * 1000)} milliseconds")
    by = timed.groupBy(F.window("_at", f"{int(step_secs * 1000)} milliseconds"), "integ")
    none = F.lit(float("nan"))
    return by.agg(*[F.coalesce(F.max(F.when(F.col("idx") == k, F.col("v"))), none).alias(f"_{k}") for k in range(size)]).select("integ", F.array(*[f"_{k}" for k in range(size)]).alias("vals"))


def with_gaps(integrations: DataFrame, most: int) -> DataFrame:
    """integ with `new`, how many integrations lie between it and the one before; a jump beyond `most` is an error, as no buffer of that size could bridge it."""
    width = 1 << 16
    rows = integrations.withColumn("_b", F.floor(F.col("integ") / width))
    ends = rows.groupBy("_b").agg(F.max("integ").alias("_end"))
    carry = ends.select("_b", F.lag("_end").over(Window.orderBy("_b")).alias("_before"))  # a row for each 65,536 integrations
    met = rows.join(carry, "_b").withColumn("_last", F.coalesce(F.lag("integ").over(Window.partitionBy("_b").orderBy("integ")), F.col("_before")))
    gap = F.coalesce(F.col("integ") - F.col("_last") - 1, F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("jump before integration "), F.col("integ").cast("string"))).cast("long")
    return met.select("integ", F.when(gap >= most, wrong).otherwise(gap).alias("new"))
