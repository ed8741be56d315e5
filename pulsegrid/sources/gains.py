"""Gain and bandpass listings: text tables whose records go on over several lines.

A line with something in its first ``X_WIDTH`` columns begins a record (a time or frequency), one with blanks there
goes on with it; values run antenna by antenna, polarisation by polarisation. `#` lines are the header. Files are read
in splits: a line knows its split and its place there, each split's last record is carried on to the next splits
of its file, a row for each split, so a record may lie across splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

X_WIDTH = 14


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, split (its first byte), n (rising within the split), value."""
    meta = F.col("_metadata")
    return spark.read.text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("n"), "value")


def records(lines: DataFrame, x_width: int = X_WIDTH) -> DataFrame:
    """lines: path, split, n, value. path, split, n (of the record's first line), x, values. Values before a file's first record go."""
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#|$)")).withColumn("x", F.trim(F.substring("value", 1, x_width)))
    starts = F.when(F.col("x") != "", F.struct("split", "n", "x"))
    within = Window.partitionBy("path", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.last(starts, ignorenulls=True).over(within))
    ends = rows.groupBy("path", "split").agg(F.max_by("_own", "n").alias("_end"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("path", "split", F.last("_end", ignorenulls=True).over(before).alias("_carry"))  # a row for each split
    rows = rows.join(F.broadcast(carry), ["path", "split"]).withColumn("_record", F.coalesce("_own", "_carry")).filter("_record is not null")
    numbers = F.split(F.trim(F.expr(f"substring(value, {x_width + 1})")), r"\s+")
    parts = F.array_sort(F.collect_list(F.struct("split", "n", F.when(F.trim(F.expr(f"substring(value, {x_width + 1})")) != "", numbers).otherwise(F.array().cast("array<string>")).alias("v"))))
    by = rows.groupBy("path", "_record").agg(parts.alias("parts"))
    values = F.transform(F.flatten(F.transform("parts", lambda p: p["v"])), lambda v: v.cast("double"))
    return by.select("path", "_record.split", "_record.n", "_record.x", values.alias("values"))


def listing_headers(lines: DataFrame) -> DataFrame:
    """path, source, quantity, pols, nant of each listing."""
    head = lines.filter(F.col("value").startswith("#"))
    pick = lambda pattern: F.max(F.when(F.regexp_extract("value", pattern, 1) != "", F.regexp_extract("value", pattern, 1)))
    found = head.groupBy("path").agg(
        pick(r"^# Gain/Polarization listing for\s+(\S+)").alias("source"), pick(r"^# Listing of the (\S+)").alias("quantity"), pick(r"^# Listing of the .* for (\S+)").alias("pols"), pick(r"^# Number of antennas:\s*(\d+)").alias("nant")
    )
    return found.select("path", "source", "quantity", F.split("pols", ",").alias("pols"), F.col("nant").cast("int").alias("nant"))


def read_gains(spark: SparkSession, path: str) -> DataFrame:
    """path, source, quantity, record (its place in the file, from 0), x, ant (from 1), pol, v. A record with too few or too many values is an error when it is read."""
    lines = ordered_lines(spark, path)
    rows = records(lines).join(F.broadcast(listing_headers(lines)), "path")  # a row for each file
    rows = rows.withColumn("record", F.row_number().over(Window.partitionBy("path").orderBy("split", "n")) - 1)
    wrong = F.raise_error(F.concat(F.lit("record "), F.col("x"), F.lit(" has "), F.size("values").cast("string"), F.lit(" values"))).cast("array<double>")
    whole = F.when(F.size("values") == F.col("nant") * F.size("pols"), F.col("values")).otherwise(wrong)
    each = rows.select("path", "source", "quantity", "record", "x", "pols", F.posexplode(whole).alias("_k", "v"))
    return each.select("path", "source", "quantity", "record", "x", (F.floor(F.col("_k") / F.size("pols")) + 1).cast("int").alias("ant"), F.get("pols", F.pmod("_k", F.size("pols"))).alias("pol"), "v")


def inverse_gains(real: DataFrame, imag: DataFrame) -> DataFrame:
    """Gains (record, x, ant, pol, v) as what corrects data: 1 / conj(g), 0 where g is 0. Listings must have the same records."""
    on = ["record", "ant", "pol"]
    both = real.select(*on, "x", F.col("v").alias("re")).join(imag.select(*on, F.col("x").alias("_x"), F.col("v").alias("im")), on, "full")
    same = F.col("x").eqNullSafe(F.col("_x"))
    x = F.when(same, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("listings differ in record "), F.col("record").cast("string"))).cast("string"))
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    part = lambda c: F.when(power > 0, F.col(c) / power).otherwise(0.0)
    return both.select(*on, x.alias("x"), part("re").alias("re"), part("im").alias("im"))
