"""Benchmark decontamination with a generalised suffix automaton over test items.

Texts are folded (A-Z) and read as words of letters, digits and non-ASCII characters. All items go
into one word-level suffix automaton; each document streams through it, and at every word the state
gives the longest stretch ending there that some item contains. A stretch of ``window`` words (or a
whole shorter item) marks its words as hit; the state's item list says which items.

Items are the stated query set. An automaton holds at most ``shard_words`` item words, so what is
broadcast is bounded; a larger benchmark is dealt to several automata, each run over the documents in
its own pass, and their hits are united per document. ``decontaminate`` cuts united hits only, and looks through
what was cut again with all automata until none hits.

Null or wordless texts have no words and no hits; null or wordless items match nothing; equal items
all count. Rows with one item id are one item; null is an id of its own, which counts but has no name in a list. Repeated rows are reported one by one. Empty tables give empty results. Other columns are
kept by ``decontaminate`` and ignored by ``contamination``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_sql, materialize, row_key, slices, table

WINDOW = 10
#: Of the folded text's bytes: words keep digits, letters and everything outside ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RUN = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Automaton:
    """next: per state word -> state; link, length: as usual; items: at the states of windows; short: at those of whole short items.

    top: of a state of at least ``window`` words the state of its last ``window``; near: the longest short item that
    ends there, as its state (0: none). Both are set once all words are in, so that no walk climbs chains of links.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.items: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        self.near = array("l", bytes(8 * len(self.next)))
        self.top = array("l", range(len(self.next)))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in order:
            if self.length[self.link[s]] >= window:
                self.top[s] = self.top[self.link[s]]
        for name, ws in items:
            if len(ws) >= window:
                for _, state, size in self.walk(ws):
                    if size >= window:
                        self.items.setdefault(self.top[state], set()).add(name)
            elif ws:
                *_, (_, state, _) = self.walk(ws)
                self.short.setdefault(state, []).append((len(ws), name))
        for s in order:
            self.near[s] = s if s in self.short else self.near[self.link[s]]

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: bytes, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def walk(self, ws: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length of the longest match that ends there), where a window or short item can end."""
        nxt, link, length, near, window = self.next, self.link, self.length, self.near, self.window
        state = size = 0
        for i, w in enumerate(ws):
            q = nxt[state].get(w)
            if q is None:
                while state and q is None:
                    state = link[state]
                    q = nxt[state].get(w)
                if q is None:
                    size = 0
                    continue
                size = length[state]
            state = q
            size += 1
            if size >= window or near[state] or i == len(ws) - 1:
                yield i, state, size

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint hit ranges of words, end exclusive, and the items they come from."""
        spans: list[list[int]] = []
        names: set[str | None] = set()
        for i, state, size in self.walk(ws):
            n = 0
            if size >= self.window:
                n = self.window
                names |= self.items.get(self.top[state], set())
            s = self.near[state]
            while s:  # fewer than `window` of them
                for k, name in self.short[s]:
                    if k <= size:
                        n = max(n, k)
                        names.add(name)
                s = self.near[self.link[s]]
            if n:
                a = i + 1 - n
                while spans and a <= spans[-1][1]:
                    a = min(a, spans.pop()[0])
                spans.append([a, i + 1])
        return [(a, b) for a, b in spans], names


def shards(benchmark: DataFrame, item_col: str, text_col: str, window: int, shard_words: int) -> Iterator[Automaton]:
    """Automata over at most shard_words words each, from a stream of items; long items are dealt out in parts that share all windows but none twice."""
    held, n, most = [], 0, max(shard_words, window)
    for name, text in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        ws = words(text)
        for at in range(0, max(1, len(ws) - window + 1), most - window + 1):
            part = ws[at : at + most]
            if held and n + len(part) > most:
                yield Automaton(held, window)
                held, n = [], 0
            held.append((name, part))
            n += len(part)
    yield Automaton(held, window)


def _scan(docs: DataFrame, automaton, known: bool = False) -> DataFrame:
    """docs: _id, _text. Per row (known: per row with hits) the row's hash, words, hit ranges, items."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton.value
        for batch in slices(batches):
            rows, at = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ws = words(text)
                spans, names = found.hits(ws)
                if spans or not known:
                    at.append(k)
                    rows.append((len(ws), [{"a": a, "b": b} for a, b in spans], sorted(names, key=lambda n: (n is None, n or ""))))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(cols[0], pa.int64()), pa.array(cols[1], span), pa.array(cols[2], pa.list_(pa.string()))],
                names=["_id", "_row", "_n", "_spans", "_items"],
            )

    rows = docs.select("_id", "_text", row_key("_id", "_text").alias("_row"))
    return rows.mapInArrow(run, f"_id {kind}, _row binary, _n long, _spans array<struct<a:int,b:int>>, _items array<string>")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = 1_000_000,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    parts = []
    for automaton in shards(benchmark, item_col, item_text_col, window, shard_words):
        parts.append(_scan(rows, spark.sparkContext.broadcast(automaton), known=bool(parts)))
    found = parts[0]
    if len(parts) > 1:
        more = parts[1]
        for p in parts[2:]:
            more = more.unionByName(p)
        # rows with the same id and text have the same hits, so one of them stands for all
        more = more.dropDuplicates(["_row", "_spans", "_items"]).groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_s2"), F.flatten(F.collect_list("_items")).alias("_i2"))
        found = found.join(materialize(more), "_row", "left").withColumns(
            {"_spans": F.concat("_spans", F.coalesce("_s2", F.array())), "_items": F.array_distinct(F.concat("_items", F.coalesce("_i2", F.array())))}
        )
        hit = "size(array_distinct(flatten(transform(_spans, s -> sequence(s.a, s.b - 1)))))"
    else:
        hit = "aggregate(_spans, 0, (n, s) -> n + s.b - s.a)"
    hit, items = F.expr(hit).cast("long"), F.array_join(F.array_sort("_items"), ",")
    return found.select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the words of the spans (sorted, perhaps overlapping), how many these are, and how many there were."""
    raw = text.encode()
    places = [m.span() for m in _RUN.finditer(raw.translate(FOLD))]
    out, at, end, gone = [], 0, 0, 0
    for a, b in spans:
        gone += max(0, b - max(a, end))
        end = max(end, b)
        if places[a][0] > at:
            out.append(raw[at : places[a][0]])
        at = max(at, places[b - 1][1])
    return b"".join([*out, raw[at:]]).decode(), gone, len(places)


def cut_text(text: str, automaton: Automaton, most: float) -> str | None:
    """The text without hit spans, again until none is left; None if more than `most` of its words were hit."""
    total, gone = None, 0
    while spans := automaton.hits(words(text))[0]:
        text, cut, had = cut_spans(text, spans)
        total, gone = had if total is None else total, gone + cut
        if gone > most * total:
            return None
    return text


def _cut_shards(docs: DataFrame, automata: list, text_col: str, most: float) -> DataFrame:
    """Per distinct text that an automaton hits: _text, _new (as cut_text gives it with one automaton over all items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for first, text, total, gone, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, cut, had = cut_spans(text, sorted((s["a"], s["b"]) for s in spans))
                total, gone = had if total is None else total, gone + cut
                rows.append((first, None if gone > most * total else text, total, gone))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["_first", "_id", "_total", "_gone"])

    out = "_first string, _id string, _total long, _gone long"
    # _first: the text as it came; _id: as cut so far
    left = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_first"), F.col(text_col).alias("_id")).withColumns({"_total": F.lit(None).cast("long"), "_gone": F.lit(0).cast("long")})
    done, first = None, True
    while True:
        rows = left.select("_id", F.col("_id").alias("_text"))
        found = None
        for automaton in automata:
            part = _scan(rows, automaton, known=True).select("_id", "_spans")
            found = part if found is None else found.unionByName(part)
        # a text stands for all its copies, so one row of each automaton's hits is enough
        spans = materialize(found.distinct().groupBy("_id").agg(F.flatten(F.collect_list("_spans")).alias("_spans")))
        hit = left.join(spans, "_id").select("_first", "_id", "_total", "_gone", "_spans")
        hit = materialize((hit.dropDuplicates(["_first"]) if first else hit).mapInArrow(run, out))
        first = False
        if hit.isEmpty():
            return done if done is not None else hit.select(F.col("_first").alias("_text"), F.col("_id").alias("_new"))
        new = hit.select(F.col("_first").alias("_text"), F.col("_id").alias("_new"))
        done = new if done is None else materialize(done.join(new, "_text", "left_anti").unionByName(new))
        left = hit.filter("_id is not null")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_coverage: float = 0.5,
    shard_words: int = 1_000_000,
    length_col: str | None = "n_chars",
) -> DataFrame:
    """docs without hit spans; rows hit on more than max_coverage of their words go. Same columns; length_col, if there, follows the text."""
    spark = docs.sparkSession
    held = [spark.sparkContext.broadcast(a) for a in shards(benchmark, item_col, item_text_col, window, shard_words)]
    if len(held) > 1:
        cut = _cut_shards(docs, held, text_col, max_coverage)
        rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
        rows = rows.join(cut.withColumn("_hit", F.lit(True)), "_text", "left").filter("_hit is null or _new is not null")
        new = {text_col: F.coalesce("_new", "_text")}
        if length_col in docs.columns:
            new[length_col] = F.when(F.col("_hit"), F.length("_new")).otherwise(F.col("_row")[length_col])
        return rows.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            i = batch.schema.get_field_index(text_col)
            old = batch.column(i).to_pylist()
            new = [cut_text(t, held[0].value, max_coverage) if t else t for t in old]
            keep = pa.array([n is not None or o is None for n, o in zip(new, old, strict=True)])
            cols = list(batch.columns)
            cols[i] = pa.array(new, batch.column(i).type)
            k = batch.schema.get_field_index(length_col) if length_col else -1
            if k >= 0:
                was = batch.column(k).to_pylist()
                cols[k] = pa.array([c if n == o else len(n or "") for c, n, o in zip(was, new, old, strict=True)], batch.column(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(c: str) -> str:
    return f"regexp_extract_all({ascii_lower_sql(f'coalesce({c}, {chr(39) * 2})')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP3_SQL = f"""
with i as (select cast(item_id as varchar) as item, {_sql_words("text")} as w from benchmark),
win as (select distinct item, least(len(w), {WINDOW}) as n, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') as g
        from (select item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) as p from i where len(w) > 0)),
d as (select row_number() over () as r, doc_id, {_sql_words("text")} as w from documents),
g as (select r, p, n, array_to_string(w[p:p + n - 1], ' ') as g
      from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as p from d, (select distinct n from win) where len(w) >= n)),
h as (select r, p, n, item from g join win using (n, g)),
x as (select r, count(*) as n_hit from (select distinct r, unnest(generate_series(p, p + n - 1)) as at from h) group by r),
y as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join x using (r) left join y using (r)
"""
