"""MinHash near-deduplication: one-permutation hashing, banded buckets, star-shaped candidates.

One pass over the texts hashes each document's distinct word shingles and cuts the hash range into
bins; a bin's smallest hash is its minimum, and an empty bin copies a full one found by a fixed random
probe (optimal densification). Bands of rows make bucket keys. Documents with equal sets are merged
first, so a group of copies has one representative.

A bucket gives a star: every member is paired with the bucket's hub only (the member that shares most
buckets with others, which is the middle of its group), which bounds pairs by rows times bands.
Candidates are confirmed on full shingle sets. Only components matter, so each document's most
frequent hub is confirmed first, then its other hubs where they lie in another component.

A star can miss a link between two of its rays, so buckets that still hold several components are
looked at again: their members outside the bucket's largest component meet all members of other
components. The join that brings them together confirms pairs as it goes, each only in the first bucket
that both share, so what it puts out are links, once each. There is no cap on partners and no estimate
decides: every pair that shares a bucket and lies in two components is compared on its full sets. A bucket's
members outside its largest component are dealt to slots of at most ``_WORK`` comparisons. Round r takes the next
2^r slots, each a key of its own in the join, so rounds grow with the log of the work, and what earlier rounds
have joined up (buckets that became one component, too) is left out of later ones.

With 40 bands of 6 rows a pair at similarity 0.85 shares no bucket with probability 6e-9, at 0.8 5e-6.
Sets are known by 128-bit digests, and rows by 128-bit keys of their id and text.

Null, empty and wordless texts have empty sets and are linked with nothing; with fewer words than a
shingle the whole sequence is one shingle. A row with a null id gets the smallest id of its group, null if
none has one. Repeated rows are reported one by one; rows with one id and different texts stand for
themselves. Empty tables give empty results; other columns are ignored, and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOOM, SMALL_BATCHES, drop_caches, join_groups, materialize, row_key, settings, slices, table, without
from .components import contract

ROWS, BANDS = 6, 40
BINS = ROWS * BANDS
_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PROBE = _RNG.integers(0, BINS, (4096, BINS))
_EDGES = np.array([(k << 64) // BINS for k in range(BINS)], np.uint64)
_WORK = 1 << 24


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashed shingles, sorted."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64) + np.uint64(width)
    for k in range(width):
        total = _mix(total * _ODD[0] + h[k : k + n])
    return np.unique(total)


def signature(u: np.ndarray) -> np.ndarray:
    """The densified minima of a sorted, non-empty set of hashes."""
    at = np.append(np.searchsorted(u, _EDGES), len(u))
    full = at[1:] > at[:-1]
    v = u[np.minimum(at[:-1], len(u) - 1)]
    empty = np.flatnonzero(~full)
    for probe in _PROBE:
        if not len(empty):
            break
        donor = probe[empty]
        ok = full[donor]
        v[empty[ok]] = v[donor[ok]]
        empty = empty[~ok]
    else:
        v[empty] = u[0]
    return v


def band_keys(v: np.ndarray) -> np.ndarray:
    rows = v.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        key = _mix(key * _ODD[1 + r] + rows[:, r])
    return key.view(np.int64)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """docs: id, text. Per row: id, row (its key), n, same (digest of the set), bands."""
    from hashlib import blake2b

    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in slices(batches):
            n, same, bands = [], [], []
            for text in batch.column(1).to_pylist():
                u = shingles(text, width)
                n.append(len(u))
                if len(u):
                    same.append(blake2b(u.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(signature(u)))
                else:
                    same.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "row", "n", "same", "bands"],
            )

    return docs.select("id", "text", row_key("id", "text").alias("row")).mapInArrow(run, f"id {kind}, row binary, n long, same binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted: id (a set's digest), row (of a document with it). Per id: n, set. Texts of other rows stay where they are, but for false hits of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in slices(batches):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64()))], names=["id", "n", "set"])

    texts = docs.select(row_key("id", "text").alias("row"), "text").join(wanted.select("id", "row"), "row").dropDuplicates(["row"]).select("id", "text")
    with settings(docs.sparkSession, **BLOOM, **SMALL_BATCHES):
        return materialize(texts.mapInArrow(run, "id binary, n long, set array<long>"))


class _Confirm:
    """Confirms pairs (a, b) on their full sets, which are made in one pass for all that share a bucket."""

    def __init__(self, docs: DataFrame, rows: DataFrame, width: int, least: int):
        self.docs, self.rows, self.width, self.least, self.sets = docs.select("id", "text"), rows, width, least, None

    def prepare(self, ids: DataFrame) -> None:
        # a filter over a table is what makes Spark build its Bloom filter
        wanted = materialize(self.rows.join(ids.select("id", "times"), "id")).filter("times > 0")
        self.sets = _sets(self.docs, wanted, self.width)

    def sizes_fit(self) -> Column:
        return 100 * F.least("na", "nb") >= self.least * F.greatest("na", "nb")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        size = lambda end: self.sets.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"))
        fit = materialize(pairs.join(size("a"), "a").join(size("b"), "b").filter(self.sizes_fit()).select("a", "b"))
        one = fit.join(self.sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        two = one.join(self.sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        return materialize(two.filter(self.close()).select("a", "b"))

    def close(self) -> Column:
        both = F.size(F.array_intersect("sa", "sb"))
        return 100 * both >= self.least * (F.size("sa") + F.size("sb") - both)


def _labelled(rows: DataFrame, labels: DataFrame, end: str = "id", name: str = "label") -> DataFrame:
    return rows.join(labels.select(F.col("node").alias(end), F.col("label").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return _labelled(_labelled(pairs, labels, "a", "la"), labels, "b", "lb").filter("la != lb").select("a", "b")


def _stars(members: DataFrame, confirm: _Confirm, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """members: id (a set's digest), key. Confirms the stars of all buckets; returns the labels, and the members (id, key, minor, turns) of buckets that still need a look."""
    buckets = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    with settings(members.sparkSession, **BLOOM):
        shared = materialize(members.join(buckets.filter("size > 1"), "key"))
    ids = materialize(shared.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.sum("size").alias("company")))
    if confirm.sets is None:
        confirm.prepare(ids)
    rank = F.col("company") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    hubs = materialize(shared.join(ids, "id").groupBy("key").agg(F.max_by("id", rank).alias("hub")))
    stars = materialize(shared.join(hubs, "key").filter("id != hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("times")))
    first = stars.groupBy("id").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub")).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    labels = contract(labels, confirm(first if labels is None else _apart(first, labels)))
    labels = contract(labels, confirm(_apart(stars.select(F.col("id").alias("a"), F.col("hub").alias("b")), labels)))
    wide = materialize(_labelled(shared.filter("size > 2").select("id", "key"), labels))
    parts = materialize(wide.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k")))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
    mixed = mixed.filter("labels > 1").select("key", "main", F.ceil((F.col("all") - F.col("most")) * F.col("all") / _WORK).alias("turns"))
    again = wide.join(materialize(mixed), "key").select("id", "key", (F.col("label") != F.col("main")).alias("minor"), "turns")
    return labels, materialize(again)


def _still_mixed(members: DataFrame, labels: DataFrame, first: int) -> DataFrame:
    """The members of buckets that have slots from ``first`` on and still hold several components."""
    named = _labelled(members.filter(F.col("turns") > first), labels)
    mixed = named.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("key")
    return materialize(named.drop("label").join(mixed, "key"))


def _rays(members: DataFrame, lead: DataFrame, confirm: _Confirm, labels: DataFrame) -> DataFrame:
    """Links of each bucket's lead with its members in other components, slot by slot."""
    keys = materialize(members.select("id", "key").distinct().groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys")))  # at most BANDS of them
    about = materialize(_labelled(keys, labels).join(confirm.sets, "id"))
    end = lambda rows, e: rows.select("key", "slot", "id").join(about, "id").select("key", "slot", F.col("id").alias(e), F.col("n").alias(f"n{e}"), F.col("label").alias(f"l{e}"), F.col("keys").alias(f"k{e}"), F.col("set").alias(f"s{e}"))
    once = F.element_at(F.array_intersect("ka", "kb"), 1)
    left, right = end(members, "b").alias("x"), end(lead, "a").alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.slot") == F.col("y.slot")) & (F.col("la") != F.col("lb")) & confirm.sizes_fit() & (once == F.col("x.key")) & confirm.close()
    return materialize(left.join(right, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, least_percent: int) -> DataFrame:
    """Per row of docs: id, row, n, component."""
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    with settings(docs.sparkSession, **SMALL_BATCHES):
        seen = materialize(_signatures(docs, width))
    # equal sets meet map-side
    sets = materialize(seen.filter("n > 0").groupBy("same").agg(F.min("id").alias("least"), F.max("row").alias("row"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands")))
    confirm = _Confirm(docs, sets.select(F.col("same").alias("id"), "row"), width, least_percent)
    labels, again = _stars(sets.select(F.col("same").alias("id"), F.explode("bands").alias("key")), confirm, None)
    slot = F.pmod(F.xxhash64("id", "key"), "turns")
    for n in range(int(again.agg(F.max("turns")).first()[0] or 0).bit_length()):
        first, last = (1 << n) - 1, (2 << n) - 2  # this round's slots
        if n:
            again = _still_mixed(again, labels, first)
        lead = again.filter("minor").withColumn("slot", slot).filter(F.col("slot").between(first, last))
        slots = F.sequence(F.lit(first).cast("long"), F.least(F.lit(last), F.col("turns") - 1))
        labels = contract(labels, _rays(again.withColumn("slot", F.explode(slots)), lead, confirm, labels))

    linked = labels.select(F.col("node").alias("same"), "label")
    groups = materialize(sets.select("same", "least", "rows").join(linked, "same", "left").filter("rows > 1 or label is not null").withColumn("label", F.coalesce("label", "same")))
    first = groups.groupBy("label").agg(F.min("least").alias("component"))
    groups = materialize(groups.join(first, "label").select("same", "rows", "component"))
    alone = F.concat(F.lit("alone:").cast("binary"), "row")  # empty sets meet no group, and not each other either
    seen = seen.select("id", "row", "n", F.coalesce("same", alone).alias("same"))
    met = join_groups(seen, groups, "same", "rows", F.xxhash64("row"))
    return met.select("id", "row", "n", F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    least_percent: int = 80,
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept. Links: 100 * intersection >= least_percent * union."""
    rows = _groups(docs, id_col, text_col, width, least_percent)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least_percent: int = 80) -> DataFrame:
    """docs without the rows that are not kept; rows repeated with one id and text all stay or go together."""
    gone = _groups(docs, id_col, text_col, width, least_percent).filter(~F.col("id").eqNullSafe(F.col("component"))).select("row").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_key(docs[id_col], docs[text_col]).alias("row"))
    return without(rows, materialize(gone), "row").select("_row.*")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=3, least_percent=85)


OP6_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[p:p + 2], ' ') as g from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as p from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(a, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on r.a = e.a where r.c <= e.b),
m as (select a as doc_id, min(c) as c from r group by a)
select doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, doc_id = m.c as kept from m left join n using (doc_id)
"""
