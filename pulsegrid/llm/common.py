"""Helpers that the text operators share: scratch tables, settings for one job, slices of batches, keys, hot groups, ASCII folding."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
_OWN_DIR: list[str] = []
_MADE: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one on a local master, an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-"))
        root = _OWN_DIR[0]
    name = f"pulsegrid-{uuid.uuid4().hex}"
    _MADE.add(name)
    return f"{root.rstrip('/')}/{name}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: cuts lineage, computed once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() made and no later step reads; other tables stay."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1] in _MADE:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs that run inside, put back afterwards; dots are written as two underscores."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: For a join that few rows of its left side pass: Spark's own Bloom filter leaves the others out before the shuffle.
BLOOM = {
    "spark__sql__optimizer__runtime__bloomFilter__enabled": "true",
    "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "1",
    "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "1g",
}


#: What empties the caches that tasks leave in a Python worker for later ones; tasks that need the room call drop_caches().
CACHES: list[Callable[[], None]] = []


def drop_caches() -> None:
    for clear in CACHES:
        clear()


#: For jobs whose tasks hold much besides a batch.
SMALL_BATCHES = {"spark__sql__execution__arrow__maxRecordsPerBatch": "1000"}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as Python objects of texts take several times their bytes; Spark bounds the bytes of a batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def row_key(*cols: Column | str) -> Column:
    """128 bits that stand for a row's values; null differs from empty."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in (F.col(c) if isinstance(c, str) else c for c in cols)]
    return F.unhex(F.md5(F.concat(*parts)))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, spread: Column | str, most: int = 1000) -> DataFrame:
    """rows left-joined to groups (one row per key; n: how many rows have the key).

    Keys with over a ``most``-th of all grouped rows, of which there are fewer than ``most``, are broadcast; their
    rows take part in the other join under a key of their own that matches nothing, made of ``spread``.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    is_hot, others = F.col(n) * most > total, [c for c in groups.columns if c != key]
    hot, rest = groups.filter(is_hot).withColumns({f"_hot_{c}": F.col(c) for c in others}).drop(*others), groups.filter(~is_hot)
    met = rows.join(F.broadcast(hot), key, "left")
    alone = F.concat(F.lit("alone:"), F.sha2(F.coalesce(F.col(spread) if isinstance(spread, str) else spread, F.lit(0)).cast("string"), 512))  # longer than any digest
    alone = alone.cast(rows.schema[key].dataType)
    met = met.withColumn("_join", F.when(F.col(f"_hot_{n}").isNull(), F.col(key)).otherwise(alone))
    met = met.join(rest.withColumnRenamed(key, "_join"), "_join", "left")
    return met.select(*rows.columns, *[F.coalesce(c, f"_hot_{c}").alias(c) for c in others])


def without(rows: DataFrame, gone: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """rows whose key is not in gone (a written table of keys); only rows that may be in it are shuffled.

    gone's hashes are broadcast as a bitmap of 2 ** bits, a row per 64 of them, so of bounded size; as it fills
    up, more rows take part in the join, which decides.
    """
    h = F.xxhash64(key)
    at = {"_word": F.pmod(h, F.lit(1 << (bits - 6))), "_bit": F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))}
    marks = F.broadcast(materialize(gone.select(key).withColumns(at).groupBy("_word").agg(F.bit_or("_bit").alias("_marks"))))
    met = rows.withColumns(at).join(marks, "_word", "left").withColumn("_may", F.coalesce(F.col("_marks").bitwiseAND(F.col("_bit")) != 0, F.lit(False)))
    sure, others = met.filter(~F.col("_may")).select(rows.columns), met.filter("_may").select(rows.columns)
    return sure.unionByName(others.join(gone.select(key), key, "left_anti").select(rows.columns))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; the fast path is for pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def ascii_lower_sql(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
