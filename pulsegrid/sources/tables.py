"""The driver's tables in the roles of samples and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 64
#: The same roles in SQL: spectra(beam, t, chan, v), cand(rid, sn, sampno, boxcar, idt, dm, beam).
SPECTRA_SQL = "spectra as (select label % 4 as beam, vec_id as t, c - 1 as chan, cast(round(cast(embedding[c] as double) * 128) as bigint) as v from embeddings, (select unnest(generate_series(1, 64)) as c))"
CAND_SQL = "cand as (select l_orderkey * 8 + l_linenumber as rid, l_extendedprice / 1000 as sn, l_orderkey as sampno, l_linenumber as boxcar, cast(l_quantity as int) as idt, cast(round(l_discount * 100) as bigint) as dm, l_suppkey % 36 as beam from lineitem)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long-form dynamic spectrum: beam, t, chan, v (in whole steps, so that sums are exact)."""
    rows = read(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("beam"), F.col("vec_id").alias("t"), F.posexplode("embedding").alias("chan", "x"))
    return rows.select("beam", "t", "chan", F.round(F.col("x").cast("double") * 128).cast("long").alias("v"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate list: rid, sn, sampno, boxcar, idt, dm, beam."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rid"), (F.col("l_extendedprice") / 1000).alias("sn"), F.col("l_orderkey").alias("sampno"), F.col("l_linenumber").alias("boxcar"),
        F.col("l_quantity").cast("int").alias("idt"), F.round(F.col("l_discount") * 100).cast("long").alias("dm"), (F.col("l_suppkey") % 36).alias("beam"),
    )
