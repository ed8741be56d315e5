"""Mixing sources to target weights by pivotal dependent rounding, DataFrame functions only.

Sources in code-point order (null last) get the weights in turn and share all words by weight; a target
stops at ``most`` times its source's words, and what is over is shared again by weight among the others.
A document of a source with target t and S words is wanted t / S times: its whole part is taken, its
fraction p is rounded. Rounding is pivotal: two documents of a source trade words, the one gains what the
other loses (p1 * s1 + p2 * s2 stays), by a random step that leaves each p unchanged on average, until one
of them is 0 or 1. Units are dealt by hash into blocks of about ``block``; each block is folded to at most
one document that is still open, those are dealt into blocks again, and so on: a tree whose levels shrink
by ``block``. One open document per source remains and is drawn. This is done for one class of sizes after
the other, large documents first; what the last draw of a class takes too much or too little is shared out over
the fractions of the next class. So the words taken from a source miss its target by about one of its small
documents.

No task sees a source: a hot one has more blocks. All draws are hashes of ids, so reruns agree whatever
the partitions. Rows equal in id, source and size are one unit of n rows that is wanted n * t / S times;
its copies are spread over the n rows as evenly as they go. Null text is empty; a document without words
takes part in no rounding. Null ids are ids. An empty table gives an empty result. Other columns, whatever
their names, are ignored by the report and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, shuffle_partitions, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of a source table up to which it is broadcast (some 10 MB); a larger one is joined by a shuffle.
FEW = 100_000
_EPS = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def with_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """rows joined to sources (one row per _source, null among them)."""
    right = sources.withColumnRenamed("_source", "_source_of")
    return rows.join(F.broadcast(right) if n_sources <= FEW else right, F.col("_source").eqNullSafe(F.col("_source_of"))).drop("_source_of")


def ranked(keys: DataFrame, *order: Column) -> DataFrame:
    """keys with _rank (long, from 0) in the given order, without a task that sees all of them."""
    dealt = materialize(keys.repartitionByRange(shuffle_partitions(keys.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row per partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_i", within).join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_start") + F.col("_i") - 1).drop("_part", "_i", "_start")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> tuple[DataFrame, int]:
    """sizes: _source, _words, a row per source. Adds _target; also returns the number of sources."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    weighed = materialize(ranked(sizes, F.col("_source").isNull(), F.col("_source")).select("_source", "_words", weight.alias("_weight")))
    limit, level = most * F.col("_words"), 0.0
    while True:  # each turn but the last finds another source that stops at its limit
        stopped = F.col("_weight") * level > limit
        total, held, free, n = weighed.agg(F.sum("_words"), F.sum(F.when(stopped, limit)), F.sum(F.when(~stopped, F.col("_weight"))), F.count(F.lit(1))).first()
        new = ((total or 0) - (held or 0.0)) / free if free else level
        if new <= level:
            break
        level = new
    return weighed.select("_source", "_words", F.least(F.col("_weight") * level, limit).alias("_target")), n


def _draw(seed: int, *cols: Column) -> Column:
    """A number of [0, 1) made of the values' hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / float(1 << 53)


def _fold(members: Column, unit_type: str, seed: int) -> Column:
    """members: array of structs (h, p, unit) in a fixed order. Returns (open: struct or null, done: array of (unit, up))."""
    state = f"struct<open:struct<h:bigint,p:double,unit:{unit_type}>,done:array<struct<unit:{unit_type},up:int>>>"
    size = lambda m: m["unit"]["size"].cast("double")

    def done(m: Column, up: int) -> Column:
        return F.struct(m["unit"].alias("unit"), F.lit(up).cast("int").alias("up"))

    def still(m: Column, p: Column) -> Column:
        return F.when((p > _EPS) & (p < 1 - _EPS), F.struct(m["h"].alias("h"), p.alias("p"), m["unit"].alias("unit")))

    def ended(m: Column, p: Column) -> Column:
        return F.when(p <= _EPS, F.array(done(m, 0))).when(p >= 1 - _EPS, F.array(done(m, 1))).otherwise(F.array().cast(f"array<struct<unit:{unit_type},up:int>>"))

    def step(s: Column, m: Column) -> Column:
        a = s["open"]
        ups, downs = F.least((1 - a["p"]) * size(a), m["p"] * size(m)), F.least(a["p"] * size(a), (1 - m["p"]) * size(m))
        words = F.when(_draw(seed, a["h"], m["h"]) * (ups + downs) < downs, ups).otherwise(-downs)  # that a gains
        pa, pm = a["p"] + words / size(a), m["p"] - words / size(m)
        met = F.struct(F.coalesce(still(a, pa), still(m, pm)).alias("open"), F.concat(s["done"], ended(a, pa), ended(m, pm)).alias("done"))
        return F.when(a.isNull(), F.struct(m.alias("open"), s["done"].alias("done"))).otherwise(met).cast(state)

    start = F.struct(F.lit(None).alias("open"), F.array().alias("done")).cast(state)
    return F.aggregate(members, start, step)


def _tree(rows: DataFrame, most: int, block: int, seed: int) -> list[DataFrame]:
    """rows: _source, _m (rows of the source, at most ``most``), h, p in (0, 1), unit. Returns tables of _source, unit, up (0 or 1), together one row per unit."""
    kind, out, level, blocks = rows.schema["unit"].dataType.simpleString(), [], 0, most
    while blocks > 1:
        blocks = -(-blocks // block)
        dealt = rows.withColumn("_m", F.ceil(F.col("_m") / block)).withColumn("_block", F.pmod(F.xxhash64("h", F.lit(seed + level)), F.col("_m")))
        grouped = dealt.groupBy("_source", "_m", "_block").agg(F.array_sort(F.collect_list(F.struct("h", "p", "unit"))).alias("_members"))
        folded = materialize(grouped.select("_source", "_m", _fold(F.col("_members"), kind, seed).alias("_f")).select("_source", "_m", "_f.open", "_f.done"))
        out.append(folded.select("_source", F.inline("done")))
        rows, level = folded.filter("open is not null").select("_source", "_m", "open.*"), level + 1
    return [*out, rows.select("_source", "unit", (_draw(seed, F.col("h"), F.lit(-1)) < F.col("p")).cast("int").alias("up"))]


def _rounded(units: DataFrame, sources: DataFrame, n_sources: int, block: int, seed: int) -> DataFrame:
    """units: _source, _class (by size), p in (0, 1), unit (struct with size > 0). Returns _source, unit, up (0 or 1), a row per unit.

    Classes go from large to small documents. What a source has taken above (or below) its fractions so far is
    taken off (or put on) the fractions of its next class, evenly by words, as far as these stay in [0, 1].
    """
    over = materialize(sources.select("_source", F.lit(0.0).alias("_over")))
    size, empty = F.col("unit.size").cast("double"), units.limit(0).select("_source", "unit", F.lit(0).alias("up"))
    decided = [empty]
    for (of,) in sorted(units.select("_class").distinct().collect(), reverse=True):  # at most a class per three bits of a size
        rows = units.filter(F.col("_class") == of)
        sums = materialize(rows.groupBy("_source").agg(F.sum(size).alias("_s"), F.sum(F.col("p") * size).alias("_wanted"), F.count(F.lit(1)).alias("_m")).withColumnRenamed("_source", "_of"))
        state = materialize(over.join(sums, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of"))
        moved = with_source(rows, state, n_sources).withColumn("p", F.col("p") - F.col("_over") / F.col("_s"))
        moved = materialize(moved.select("_source", "_m", F.xxhash64("_source", "unit").alias("h"), "p", "unit"))
        is_open = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
        parts = [moved.filter(~is_open).select("_source", "unit", (F.col("p") > 0.5).cast("int").alias("up")), *_tree(moved.filter(is_open), state.agg(F.max("_m")).first()[0], block, seed)]
        done = parts[0]
        for part in parts[1:]:
            done = done.unionByName(part)
        decided.append(done := materialize(done))
        taken = done.groupBy("_source").agg(F.sum(F.col("up") * size).alias("_taken")).withColumnRenamed("_source", "_of")
        now = F.col("_over") + F.coalesce("_taken", F.lit(0.0)) - F.coalesce("_wanted", F.lit(0.0))
        over = materialize(state.join(taken, F.col("_source").eqNullSafe(F.col("_of")), "left").select("_source", now.alias("_over")))
    every = decided[0]
    for part in decided[1:]:
        every = every.unionByName(part)
    return every


def plan_mix(docs: DataFrame, id_col: Column | str, source_col: Column | str, size: Column, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, block: int = 32, seed: int = 11) -> DataFrame:
    """A row per distinct (id, source, size): _id, _source, _size, _n (its rows), _copies (taken of all n), _words and _target of its source."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    units = materialize(docs.select(of(id_col).alias("_id"), of(source_col).alias("_source"), size.alias("_size")).groupBy("_id", "_source", "_size").agg(F.count(F.lit(1)).alias("_n")))
    sizes = units.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_words"))
    sources, n_sources = source_targets(sizes, weights, most)
    sources = materialize(sources)
    rate = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(F.lit(0.0))
    wanted = F.least(rate * F.col("_n"), most * F.col("_n"))
    whole = F.floor(wanted + _EPS)
    p = F.greatest(wanted - whole, F.lit(0.0))
    open_ = (p > _EPS) & (F.col("_size") > 0)
    unit = F.struct(F.col("_size").alias("size"), F.col("_id").alias("id"), F.col("_n").alias("n"), whole.alias("whole"))
    rows = materialize(with_source(units, sources, n_sources).select("_source", unit.alias("unit"), p.alias("p"), F.when(open_, F.floor(F.log2("_size") / 3)).alias("_class")))
    every = rows.filter("_class is null").select("_source", "unit", F.lit(0).alias("up")).unionByName(_rounded(rows.filter("_class is not null"), sources, n_sources, block, seed))
    return with_source(every, sources, n_sources).select(F.col("unit.id").alias("_id"), "_source", F.col("unit.size").alias("_size"), F.col("unit.n").alias("_n"), (F.col("unit.whole") + F.col("up")).alias("_copies"), "_words", "_target")


def _one_by_one(rows: DataFrame, n: str, chunk: int = 4096) -> DataFrame:
    """Each row n times, with _i from 0; rows of many are dealt out in chunks first."""
    one = rows.filter(F.col(n) <= chunk).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("_i"))
    chunks = rows.filter(F.col(n) > chunk).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / chunk))).alias("_c")).repartition(F.col("_c"))
    last = F.least((F.col("_c") + 1) * chunk, F.col(n)) - 1
    return one.unionByName(chunks.select("*", F.explode(F.sequence(F.col("_c") * chunk, last)).alias("_i")).drop("_c"))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: its id, source, size, source_size, target, taken; how: see plan_mix."""
    plan = _one_by_one(plan_mix(docs, id_col, source_col, n_words(F.col(text_col)), **how), "_n")
    copies = F.floor(F.col("_copies") / F.col("_n")) + (F.col("_i") < F.col("_copies") % F.col("_n")).cast("long")
    return plan.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), (copies * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mixed documents, with all columns of docs: each row as often as it is taken."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_key(*[docs[c] for c in docs.columns]).alias("_key"), docs[source_col].alias("_source"), n_words(docs[text_col]).alias("_size"))
    plan = materialize(plan_mix(rows, "_key", "_source", F.col("_size"), **how).select(F.col("_id").alias("_key"), "_n", "_copies").filter("_copies > 0"))
    taken = rows.select("_row", "_key").join(plan, "_key")
    again = taken.filter("_n > 1").groupBy("_key", "_n", "_copies").agg(F.first("_row").alias("_row"))  # equal rows: one stands for all
    every = taken.filter("_n = 1").unionByName(again.select("_row", "_key", "_n", "_copies"))
    return _one_by_one(every, "_copies").select("_row.*")


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("source")
