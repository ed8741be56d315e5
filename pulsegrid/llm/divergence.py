"""Source divergence audit: terms sharded by language and term, counted and compared by DuckDB, merged by Spark.

Tasks count terms by (language, source) and the documents that hold them before the shuffle; (language, term)
then decides the shard, so a shard has all sources of its terms and a common term is a row per task and source,
not per place. A shard's SQL sums the counts, keeps the terms of enough documents, and later compares sources.

Pair sums over all kept terms need no table of all terms by all sources. A source gives a term that it lacks
its level z, so with f as the difference of two levels and V kept terms

    sum f = V f(z1, z2) + sum over terms of 1 (f(p1, z2) - f(z1, z2)) + sum over terms of 2 (f(z1, p2) - f(z1, z2))
            + sum over terms of both (f(p1, p2) - f(p1, z2) - f(z1, p2) + f(z1, z2)).

The last sum is a join within the shard, the middle ones go over the distinct levels p of a source with their
numbers of terms. All arithmetic is in integers. The rows of the result are the pairs of sources of a language
and the ``first`` terms of each source.

Null text, language and source are ''. Every (language, source) takes part, without terms too. Repeated rows
count again. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower_sql, discard, materialize, slices, table
from .mixing import FEW

#: ASCII letters, folded, and all bytes of characters beyond ASCII; everything else parts terms.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_KEPT = "lang string, source string, term string, n long, lang_n long, one long"
_SUMS = "part string, lang string, source string, item string, p long, z long, value long"


def _count_terms(batches: Iterable[pa.RecordBatch], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    by: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in by.items():
            if n:
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.record_batch(
                    [pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(source), len(n)), terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
        by.clear()

    for part in slices(batches):
        for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            n, docs = by.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(_FOLD).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in by.values()) > most:
            yield from out()
    yield from out()


class _Shard:
    """A DuckDB table in memory that a task fills batch by batch."""

    def __init__(self, create: str):
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "preserve_insertion_order": False})
        self.con.execute(create)

    def add(self, batch: pa.RecordBatch, insert: str) -> None:
        self.con.register("batch", pa.Table.from_batches([batch]))
        self.con.execute(insert)
        self.con.unregister("batch")

    def rows(self, query: str, schema: pa.Schema, size: int = 50_000) -> Iterator[pa.RecordBatch]:
        got = self.con.execute(query)
        while rows := got.fetchmany(size):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _kept(least: int, most: int = 1_000_000):
    """A shard's terms that ``least`` documents of their language hold: a row per source, ``one`` is 1 on one of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, floor = _Shard("create table t (lang varchar, source varchar, term varchar, n bigint, docs bigint)"), 0, most
        sums = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from t group by all"
        for batch in batches:
            shard.add(batch, "insert into t select lang, source, term, n, docs from batch")
            rows += batch.num_rows
            if rows > floor:  # memory follows distinct rows, not parts
                shard.con.execute(f"create or replace table t as {sums}")
                rows = shard.con.execute("select count(*) from t").fetchall()[0][0]
                floor = max(most, 2 * rows)
        yield from shard.rows(
            f"""select lang, source, term, n, sum(n) over w, (row_number() over (partition by lang, term order by source) = 1)::bigint
                from ({sums}) window w as (partition by lang, term) qualify sum(docs) over w >= {least}""",
            _arrow(_KEPT),
        )

    return run


def _compared(first: int):
    """From kept terms with their groups' totals: sums of both-sided terms, numbers of terms by level, best terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard("create table k (lang varchar, source varchar, term varchar, p bigint, z bigint, q bigint)")
        level = "1 + (1000000000::hugeint * ({} + 2)) // ({} + 2 * v)"
        for batch in batches:
            shard.add(batch, f"insert into k select lang, source, term, {level.format('n', 'total')}, {level.format('0', 'total')}, {level.format('lang_n', 'lang_total')} from batch")
        shard.con.execute("create macro f(a, b) as ((a - b) * (a - b)) // (a + b)")
        schema = _arrow(_SUMS)
        yield from shard.rows(
            """select 'both', a.lang, a.source, b.source, null, null, sum(f(a.p, b.p) - f(a.p, b.z) - f(a.z, b.p) + f(a.z, b.z))::bigint
               from k a join k b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all""",
            schema,
        )
        yield from shard.rows("select 'level', lang, source, null, p, z, count(*) from k group by all", schema)
        yield from shard.rows(f"select 'term', lang, source, term, null, null, f(p, q) as x from k where p > q qualify row_number() over (partition by lang, source order by x desc, term) <= {first}", schema)

    return run


def _f(a: Column, b: Column) -> Column:
    return F.call_function("div", (a - b) * (a - b), a + b)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 10, first: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: see the module."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = rows.mapInArrow(lambda batches: _count_terms(batches), _COUNTS)
    kept = materialize(counts.repartition("lang", "term").mapInArrow(_kept(least), _KEPT))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("one").alias("ones"))
    seen = rows.select("lang", "source").distinct()
    by_source = materialize(seen.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "ones"]))
    by_lang = by_source.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("ones").alias("v"))
    z = F.when(F.col("v") > 0, 1 + F.call_function("div", F.lit(2_000_000_000), F.col("total") + 2 * F.col("v")))
    groups = materialize(by_source.drop("ones").join(by_lang, "lang").withColumn("z", z))
    few = groups.count() <= FEW
    small = F.broadcast if few else (lambda df: df)
    # compared anew by term, now that all totals are known
    whole = kept.drop("one").join(small(groups.drop("z")), ["lang", "source"]).repartition("lang", "term")
    sums = materialize(whole.mapInArrow(_compared(first), _SUMS))
    discard(kept, by_source)
    a, b = groups.select("lang", F.col("source").alias("s"), F.col("z").alias("z1"), "v"), groups.select("lang", F.col("source").alias("t"), F.col("z").alias("z2"))
    pair = (F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"))
    base = a.join(small(b), "lang").filter("s < t").select("lang", "s", "t", F.when(F.col("v") > 0, F.col("v") * _f(F.col("z1"), F.col("z2"))).otherwise(0).alias("value"))
    levels = sums.filter("part = 'level'").groupBy("lang", F.col("source").alias("s"), "p", "z").agg(F.sum("value").alias("m"))
    apart = F.col("m") * (_f(F.col("p"), F.col("z2")) - _f(F.col("z"), F.col("z2")))
    one_sided = levels.join(small(b), "lang").filter("s != t").select("lang", *pair, apart.alias("value"))
    both = sums.filter("part = 'both'").select("lang", F.col("source").alias("s"), F.col("item").alias("t"), "value")
    pairs = materialize(base.unionByName(one_sided).unionByName(both).groupBy("lang", "s", "t").agg(F.sum("value").alias("value")))
    two_way = pairs.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), "value").unionByName(pairs.select("lang", F.col("t").alias("source"), F.col("s").alias("item"), "value"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    terms = sums.filter("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", order).filter(F.col("rank") <= first)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return two_way.withColumn("rank", order).withColumn("part", F.lit("pair")).select(out).unionByName(terms.withColumn("part", F.lit("term")).select(out))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, {ascii_lower_sql("coalesce(text, '')")} as text from documents),
w as (select i, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term from w group by all having count(distinct i) >= 10),
g as (select distinct lang, source from d),
v as (select lang, count(k.term) as v from (select distinct lang from d) left join k using (lang) group by lang),
c as (select w.lang, source, w.term, count(*) as n from w join k on k.lang = w.lang and k.term = w.term group by all),
t as (select g.lang, g.source, coalesce(sum(n), 0) as total from g left join c on c.lang = g.lang and c.source = g.source group by all),
l as (select lang, sum(total) as total from t group by lang),
p as (select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v.v) as p
      from t join v on v.lang = t.lang join k on k.lang = t.lang left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
q as (select x.lang, x.term, 1 + (1000000000::hugeint * (sum(x.n) + 2)) // (max(l.total) + 2 * max(v.v)) as q from p x join l on l.lang = x.lang join v on v.lang = x.lang group by all),
s as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source != b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
      union all select p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // (p + q) from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, value::bigint as value, rank::int as rank from o where part = 'pair' or rank <= 10
"""
