"""Exact deduplication, DataFrame functions only.

Equal texts have equal SHA-256 digests of the folded text, so a text whose digest occurs once has no
partner. Digests are counted first (32 bytes a row, combined map-side); only texts with a digest that
recurs go on, and are merged on (digest, full text) at every stage: within each task (the map-side
combine of the salted aggregate), per salt, then over the salts' winners. Rows find their group again by
digest alone; where one digest stands for several texts (tests force this) those rows are matched on the
full text instead. Digests of very many rows are joined by a broadcast of bounded size (join_groups).

Null text counts as empty. Null ids rank below every other id; if a group has only null ids its rows
all stay. Rows repeated with the same id and text are the same document: each is marked kept in the
report, while ``drop_exact_duplicates`` returns one of them. An empty table gives an empty result. Other
columns, whatever their names, are ignored by the report and kept by ``drop_exact_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOOM, ascii_lower, ascii_lower_sql, join_groups, materialize, row_key, settings, table, without


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    merged = salted.groupBy("_dig", "_salt", "_t").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return merged.groupBy("_dig", "_t").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))


def _recurring(rows: DataFrame, digests: DataFrame, most: int = 1000) -> DataFrame:
    """rows (_id, _t, _dig) whose digest occurs more than once. digests: _id, _dig of the same rows."""
    counts = digests.groupBy("_dig").agg(F.count(F.lit(1)).alias("_n"))
    again = materialize(counts.filter("_n > 1"))
    total = again.agg(F.sum("_n")).first()[0] or 0
    hot, rest = again.filter(F.col("_n") * most > total).select("_dig"), again.filter(F.col("_n") * most <= total).select("_dig")
    # fewer than `most` hot digests, so these rows stay where they are
    return rows.join(F.broadcast(hot), "_dig", "left_semi").unionByName(rows.join(rest, "_dig", "left_semi"))


def _groups(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """All rows (_id, _t, _dig), their digests (_id, _dig), the groups of several rows by digest alone (_dig, _keep, _n), and those by digest and text where a digest has several texts."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).withColumn("_dig", digest(F.col("_t")))
    digests = materialize(rows.select("_id", "_dig"))
    with settings(docs.sparkSession, **BLOOM):
        winners = materialize(_winners(_recurring(rows, digests), salts).withColumn("_t", F.sha2("_t", 512)))  # by now the text's name is enough
    shared = winners.groupBy("_dig").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("_dig")
    if shared.isEmpty():
        return rows, digests, winners.filter("_n > 1").drop("_t"), None
    shared = materialize(shared)
    return rows, digests, winners.join(shared, "_dig", "left_anti").filter("_n > 1").drop("_t"), winners.join(shared, "_dig", "left_semi")


def _named(df: DataFrame) -> DataFrame:
    """df: _id, _keep, _n (null for rows alone), _sha."""
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return df.select(
        F.col("_id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, digests, many, mixed = _groups(docs, id_col, text_col, salts, digest or _sha)
    if mixed is None and digest is None:
        return _named(join_groups(digests, many, "_dig", "_n", "_id").withColumn("_sha", F.col("_dig")))
    rows = rows.withColumns({"_sha": _sha(F.col("_t")), "_t": F.sha2("_t", 512)})
    if mixed is None:
        return _named(join_groups(rows, many, "_dig", "_n", "_id"))
    shared = materialize(mixed.select("_dig").distinct())
    alone = _named(join_groups(rows.join(shared, "_dig", "left_anti"), many, "_dig", "_n", "_id"))
    return alone.unionByName(_named(rows.join(shared, "_dig", "left_semi").join(mixed, ["_dig", "_t"], "left")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of docs, which stay where they are unless they may have to go."""
    report = exact_groups(docs, id_col, text_col).filter("group_size > 1").select(row_key("doc_id", "text_sha256").alias("_key"), F.col("kept").alias("_kept"))
    marks = materialize(report.groupBy("_key").agg(F.max("_kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")))
    digest = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_key(docs[id_col], digest).alias("_key"))
    once = without(rows, materialize(marks.filter("not _kept or _rows > 1").select("_key")), "_key").select("_row.*")
    again = marks.filter("_kept and _rows > 1").select("_key")
    if again.isEmpty():
        return once
    # of rows repeated with one id and text the first of each task, then the first of all
    with settings(docs.sparkSession, **BLOOM):
        repeated = materialize(rows.join(again, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row"))
    return once.unionByName(repeated.select("_row.*"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, {ascii_lower_sql("coalesce(text, '')")} as t from documents)
"""
