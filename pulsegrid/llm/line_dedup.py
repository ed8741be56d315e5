"""Line deduplication by a fixed-depth log-template tree.

A line's words with digits become ``<*>``. The tree has fixed depth: its first level is the number of
words, the next ``DEPTH`` levels the leading words (all of them in a shorter line); a leaf is one path. All lines of a leaf with lines from
``min_docs`` texts (counted per distinct line) are compared. A word is constant at its place if lines of the leaf
with it there come from ``min_docs`` texts, counted likewise, else a variable field. A line's template is its leaf,
its constants and the places of its masked words. Templates depend on no order of the lines, so leaves need not be
walked by one task each: all steps are aggregates and joins.

``min_docs`` holds for lines of fewer than ``long`` words; as a leaf is of one length, longer ones need two texts
at every step, so that a passage of over 50 words goes from its second text on.

A template recurs if ``min_docs`` distinct texts hold it, two words at least are constant (in a line of one
word, that one), and constants make ``least_constant`` of the words without digits; lines of recurring templates are dropped, first
ones too. Copies of one text count once. Lines are known by two 64-bit hashes, their texts by SHA-256.

Null text counts as empty; empty and blank lines reach no leaf and stay. Repeated rows are reported one by one; null ids are kept. Very long texts or lines take no
special path. An empty table gives an empty result. Other columns, whatever their names, are kept by
``drop_lines`` and ignored by ``line_report``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from .common import materialize, slices, table

DEPTH, MIN_DOCS, LEAST_CONSTANT = 3, 3, 0.8
#: Lines of so many words recur from two texts on.
LONG = 50
_LEAF_LINE = ["leaf", "line"]
_PLACE, _WORDS = "dig binary, at int, leaf long, line long, size int", "leaf long, line long, fixed int, leading int, mask long, text string"
_DIGIT = re.compile(rb"[0-9]")


def parse(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, words) of each line that reaches a leaf, words with digits masked."""
    for at, raw in enumerate(text.split(b"\n")):
        words = raw.split()
        if words:
            yield at, [b"<*>" if _DIGIT.search(w) else w for w in words] if _DIGIT.search(raw) else words


def _hash(data: bytes, seed: int = 0) -> int:
    return ((xxh3_64_intdigest(data, seed) + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def _leaf_line(words: list[bytes]) -> tuple[int, int]:
    return _hash(b" ".join(words[:DEPTH]), len(words)), _hash(b" ".join(words))


def _lines(texts: DataFrame, schema: str) -> DataFrame:
    """texts: _dig, _t. Per line that reaches a leaf, _PLACE or _WORDS."""
    places = schema is _PLACE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in wanted])
        for batch in slices(batches):
            rows = []
            for dig, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for at, words in parse(text):
                    leaf, line = _leaf_line(words)
                    if places:
                        rows.append((dig, at, leaf, line, len(words)))
                    else:
                        masked = [k for k, w in enumerate(words) if w == b"<*>"]
                        mask = _hash(",".join(map(str, masked)).encode())
                        rows.append((leaf, line, len(words) - len(masked), min(DEPTH, len(words)) - sum(k < DEPTH for k in masked), mask, b" ".join(words).decode()))
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, types, strict=True)], schema=types)

    wanted = StructType.fromDDL(schema)
    return texts.select("_dig", "_t").mapInArrow(run, schema)


def _busy(lines: DataFrame, need) -> DataFrame:
    """lines: leaf, line, n, size. Those of leaves with lines from as many texts as their length needs."""
    leaves = lines.groupBy("leaf", "size").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= need).select("leaf")
    return materialize(lines.join(materialize(leaves), "leaf", "left_semi"))


def _templates(texts: DataFrame, lines: DataFrame, need, least_constant: float) -> DataFrame:
    """Per line whose template has enough constants: leaf, line, n, size, and the template as t1, t2, mask."""
    busy = _busy(lines, need)
    # copies of a line meet map-side, and the join keeps the partitioning
    words = materialize(_lines(texts, _WORDS).dropDuplicates(_LEAF_LINE).join(busy, _LEAF_LINE))
    rest = words.select(*_LEAF_LINE, "n", "size", F.posexplode(F.split("text", " ")).alias("at", "word")).filter((F.col("at") >= DEPTH) & (F.col("word") != "<*>"))
    rest = rest.select(*_LEAF_LINE, "n", "size", F.xxhash64("at", "word").alias("h1"), F.xxhash64("word", "at").alias("h2"))
    constant = materialize(rest.groupBy("leaf", "size", "h1", "h2").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= need).drop("docs", "size"))
    # all words of a line that recurs by itself are constant
    own = rest.filter(F.col("n") >= need)
    kept = own.unionByName(rest.filter(F.col("n") < need).join(constant, ["leaf", "h1", "h2"]).select(*own.columns))
    kept = kept.groupBy(*_LEAF_LINE).agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"), F.count(F.lit(1)).alias("more"))
    out = words.drop("text").join(kept, _LEAF_LINE, "left")
    constants = F.col("leading") + F.coalesce("more", F.lit(0))
    out = out.filter((constants >= F.least(F.col("size"), F.lit(2))) & (constants >= least_constant * F.col("fixed")))
    return materialize(out.select(*_LEAF_LINE, "n", "size", F.coalesce("t1", F.lit(0)).alias("t1"), F.coalesce("t2", F.lit(0)).alias("t2"), "mask"))


def _recurring(texts: DataFrame, min_docs: int, least_constant: float, long: int) -> DataFrame:
    """texts: _dig, _t. Per text with lines to drop: _dig, _drop (their places)."""
    need = F.when(F.col("size") < long, min_docs).otherwise(min(2, min_docs))
    places = materialize(_lines(texts, _PLACE).dropDuplicates(["dig", "at"]))
    lines = materialize(places.groupBy(*_LEAF_LINE, "size").agg(F.count_distinct("dig").alias("n")))
    template = ["leaf", "size", "t1", "t2", "mask"]
    found = _templates(texts, lines, need, least_constant)
    sums = materialize(found.groupBy(*template).agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("lines")).filter(F.col("docs") >= need))
    # a text may hold several lines of a template, so sums over more than one line are counted again
    several = found.join(sums.filter("lines > 1"), template).select(*_LEAF_LINE, *template[1:])
    exact = places.select("dig", *_LEAF_LINE).join(several, _LEAF_LINE).groupBy(*template).agg(F.count_distinct("dig").alias("docs")).filter(F.col("docs") >= need)
    good = materialize(sums.filter("lines = 1").select(*template).unionByName(exact.select(*template)))
    drop = materialize(found.join(good, template, "left_semi").select(*_LEAF_LINE))
    return materialize(places.select("dig", "at", *_LEAF_LINE).join(drop, _LEAF_LINE).groupBy("dig").agg(F.collect_set("at").alias("_drop")).withColumnRenamed("dig", "_dig"))


def _digest(c):
    return F.unhex(F.sha2(c, 256))


def _cleaned(docs: DataFrame, text_col: str, min_docs: int, least_constant: float, long: int) -> DataFrame:
    """docs with _split (the text's lines) and _drop (places to drop, null if none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    drops = _recurring(docs.select(text.alias("_t")).withColumn("_dig", _digest(F.col("_t"))), min_docs, least_constant, long)
    return docs.withColumn("_dig", _digest(text)).join(drops, "_dig", "left").withColumn("_split", F.split(text, "\n", -1))


_KEPT = "array_join(filter(_split, (l, i) -> not array_contains(coalesce(_drop, array()), i)), '\n')"


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, least_constant: float = LEAST_CONSTANT, long: int = LONG) -> DataFrame:
    """Per row of docs: doc_id, n_lines (all, blank ones too), n_dropped, dropped_at (places from 0, comma-joined), clean_sha256."""
    rows = _cleaned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", min_docs, least_constant, long)
    drop = F.coalesce("_drop", F.array().cast("array<int>"))
    return rows.select(
        "doc_id", F.size("_split").cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"),
        F.array_join(F.sort_array(drop), ",").alias("dropped_at"), F.sha2(F.expr(_KEPT), 256).alias("clean_sha256"),
    )


def drop_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, least_constant: float = LEAST_CONSTANT, long: int = LONG) -> DataFrame:
    """docs, same columns, without the lines of recurring templates; texts that lose none, nulls too, are as they were."""
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    rows = _cleaned(inner, "_text", min_docs, least_constant, long)
    text = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.expr(_KEPT))
    return rows.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


OP7_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as x from documents),
u as (select distinct t from d),
r as (select t, generate_subscripts(x, 1) as pos, unnest(x) as raw
      from (select t, string_split(regexp_replace(t, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), chr(10)) as x from u)),
p as (select t, pos, w, array_to_string(w[1:{DEPTH}], ' ') as head, len(w) as k, array_to_string(w, ' ') as line
      from (select t, pos, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') as w from r) where len(w) > 0),
l as (select k, head, line, any_value(w) as w, count(distinct t) as n from p group by all),
b as (select *, case when k < {LONG} then {MIN_DOCS} else 2 end as need from l where (k, head) in (select (k, head) from l group by k, head having sum(n) >= case when k < {LONG} then {MIN_DOCS} else 2 end)),
o as (select k, head, line, n, need, generate_subscripts(w, 1) as i, unnest(w) as word from b),
c as (select k, head, i, word from o where word <> '<*>' group by all having sum(n) >= any_value(need)),
m as (select o.k, o.head, o.line, string_agg(case when o.word <> '<*>' and o.i > {DEPTH} and c.word is null then '<?>' else o.word end, ' ' order by o.i) as template,
             count(*) filter (where o.word <> '<*>' and (o.i <= {DEPTH} or c.word is not null)) as constants, count(*) filter (where o.word <> '<*>') as fixed
      from o left join c on o.k = c.k and o.head = c.head and o.i = c.i and o.word = c.word group by all),
f as (select k, head, line, template from m where constants >= least(k, 2) and constants >= {LEAST_CONSTANT} * fixed),
q as (select distinct p.t, p.pos, f.k, f.head, f.template from p join f on p.k = f.k and p.head = f.head and p.line = f.line),
g as (select k, head, template from q group by all having count(distinct t) >= case when k < {LONG} then {MIN_DOCS} else 2 end),
a as (select t, list(pos - 1 order by pos) as gone from q join g using (k, head, template) group by t),
kept as (select t, string_agg(l, chr(10) order by i) as clean from (select t, generate_subscripts(x, 1) as i, unnest(x) as l from (select t, string_split(t, chr(10)) as x from u)) z
         left join a using (t) where not coalesce(list_contains(gone, i - 1), false) group by t)
select doc_id, cast(len(x) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_dropped, coalesce(array_to_string(gone, ','), '') as dropped_at,
       sha256(coalesce(clean, '')) as clean_sha256
from d left join a using (t) left join kept using (t)
"""
