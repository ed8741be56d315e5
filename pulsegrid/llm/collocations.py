"""Phrase collocations: frequent words as ids, id n-grams as fixed-width keys, range-partitioned sort, run lengths.

1. Tasks count words by language; words in at least ``least`` places get dense ids, the commonest first.
2. Texts become runs of ids, written once. A separator or a rarer word is id 0 and breaks a piece: a phrase
   that holds a rare word is rare itself.
3. Each place gives one key: the ids of the ``longest`` words from there on, zeros behind the piece's end, as
   big-endian bytes. Tasks sort keys (radix sort, 16 bits a pass) and count runs before the shuffle; keys are
   then range-partitioned and sorted by Spark, and one scan counts the runs of every prefix length at once.
   A range's first and last runs may go on in its neighbours, so they are kept whatever their count and summed.
   As ranges are of whole keys, a hot word pair is cut into many ranges.
4. Step 3 is done for pairs first. A bitmap of fixed size (``bits``) that holds the hashes of frequent pairs
   then breaks pieces between words that are no frequent pair; a false hit costs time, never a result.

The ``head`` commonest words are broadcast; where the dictionary is longer, the other words of each document
are looked up by a join and travel with its text. Any longer phrase around another occurs no more often, so
a candidate falls to a longer one exactly if it falls to one that is one word longer.

Null text is empty and null language is ``und``. Repeated rows count again. Empty tables give empty results.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower_sql, discard, materialize, row_key, shuffle_partitions, slices, table
from .mixing import ranked

#: Fixed separators: . , ; : ! ? and line ends end a piece; tab is a space.
_ENDS, _BREAK = b".,;:!?\n\x0b\x0c\r", b"\xff"  # the latter is in no UTF-8 text
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_ENDS))
_BATCH = 1 << 19


def pieces(text: bytes) -> list[bytes]:
    """Words in order, with a word of its own where a piece ends."""
    return text.translate(_FOLD).replace(b"\n", b" \xff ").split()


def _count_words(batches: Iterable[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Counts of words by language, put out whenever there are ``most`` of them."""
    by: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in by.items():
            counts.pop(_BREAK, None)
            if counts:
                yield pa.record_batch([pa.repeat(pa.scalar(lang), len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])
        by.clear()

    for part in slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(pieces(text))
        if sum(map(len, by.values())) > most:
            yield from out()
    yield from out()


def _encode(ids: dict[str, dict[bytes, int]], reach: int, kind: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of ids as bytes; the first ``starts`` places of a run start phrases, the rest is what they reach into."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            every, at = np.concatenate(held) if held else np.empty(0, kind), 0
            while len(every) - at >= _BATCH + reach or (final and at < len(every)):
                part = every[at : at + _BATCH + reach]
                starts = min(_BATCH, len(part))
                yield pa.record_batch([pa.array([part.tobytes()], pa.binary()), pa.array([starts], pa.int64())], names=["ids", "starts"])
                at += starts
            held = [every[at:]]
            size = len(held[0])

        for batch in batches:
            own = batch.column("own") if "own" in batch.schema.names else None
            for k, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True)):
                known = ids.get(lang, {})
                if own is not None and own[k].is_valid:
                    known = known | {e["word"].encode(): e["id"] for e in own[k].as_py()}
                words = pieces(text.as_py())
                held.append(np.fromiter((known.get(w, 0) for w in words), kind, len(words)))
                held.append(np.zeros(1, kind))
                size += len(words) + 1
                if size > _BATCH + reach:
                    yield from out(False)
        yield from out(True)

    return run


def _pair_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def radix_order(cols: list[np.ndarray]) -> np.ndarray:
    """The order of rows by all columns, the first one leading: least significant 16 bits first, each pass stable."""
    order = np.arange(len(cols[0]))
    for col in reversed(cols):
        for shift in range(0, 8 * col.dtype.itemsize, 16):
            digit = (col >> np.array(shift, col.dtype)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _keys(cols: list[np.ndarray]) -> pa.Array:
    kind = cols[0].dtype.newbyteorder(">")
    rows = np.ascontiguousarray(np.stack(cols, axis=1).astype(kind))
    width = rows.shape[1] * kind.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _columns(keys: pa.Array, width: int, kind: str) -> np.ndarray:
    """Keys of ``width`` ids as an array of ids, a row per key."""
    raw = b"".join(keys.to_pylist())
    return np.frombuffer(raw, np.dtype(kind).newbyteorder(">")).reshape(-1, width).astype(kind)


def _phrases(width: int, kind: str, pairs, bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From runs of ids: the keys of ``width`` ids that start with a pair, each with its count in a few runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(pairs.value, np.uint8) if pairs is not None else None
        held: list[list[np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            order = radix_order(cols)
            cols = [c[order] for c in cols]
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            at = np.flatnonzero(new)
            counts = np.diff(np.append(at, len(order)))
            for k in range(0, len(at), 100_000):
                some = at[k : k + 100_000]
                yield pa.record_batch([_keys([c[some] for c in cols]), pa.array(counts[k : k + 100_000], pa.int64())], names=["key", "n"])

        for batch in batches:
            for blob, starts in zip(batch.column("ids"), batch.column("starts").to_pylist(), strict=True):
                ids = np.frombuffer(blob.as_buffer(), kind)
                ids = np.concatenate([ids, np.zeros(width, kind)])
                cols, alive = [ids[:starts]], ids[:starts] != 0
                for j in range(1, width):
                    nxt = ids[j : j + starts]
                    alive = alive & (nxt != 0)
                    if frequent is not None:
                        at = np.flatnonzero(alive)
                        bit = _pair_bits(ids[j - 1 : j - 1 + starts][at], nxt[at], bits)
                        alive[at] = frequent[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
                    cols.append(np.where(alive, nxt, 0).astype(kind))
                some = np.flatnonzero(cols[1])
                if len(some):
                    held.append([c[some] for c in cols])
                if sum(len(h[0]) for h in held) * width >= 20 * _BATCH:
                    yield from out()
        if held:
            yield from out()

    return run


def _run_lengths(width: int, kind: str, least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From sorted keys with counts: prefixes of two ids and more with their sums, if these reach ``least`` or the run touches an end of the range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None  # the row before
        open_: dict[int, tuple[np.ndarray, int, bool]] = {}  # by length: prefix, count so far, whether it is the range's first run

        def batch_of(rows: list[np.ndarray], sums: list[int]) -> pa.RecordBatch:
            cols = list(np.array(rows, dtype=kind).T)
            return pa.record_batch([_keys(cols), pa.array(sums, pa.int64())], names=["key", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = _columns(batch.column("key"), width, kind), batch.column("n").to_numpy()
            before = np.vstack([ids[:1] if last is None else last, ids[:-1]])
            differ = ids != before
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)  # the first id that changes
            rows, sums = [], []
            for k in range(2, width + 1):
                at = np.flatnonzero(first < k)
                fresh = last is None or first[0] < k
                starts = at if len(at) and at[0] == 0 else np.concatenate([[0], at])
                total = np.add.reduceat(n, starts)
                is_first = last is None  # of the run at starts[0]
                if not fresh or last is None:
                    if last is not None:  # goes on with the open run
                        total[0] += open_[k][1]
                        is_first = open_[k][2]
                elif k in open_:
                    prefix, count, edge = open_[k]
                    if prefix[k - 1] and (edge or count >= least):
                        rows.append(prefix)
                        sums.append(count)
                prefixes = ids[starts].copy()
                prefixes[:, k:] = 0
                keep = (total[:-1] >= least) & (prefixes[:-1, k - 1] != 0)
                if len(keep) and is_first and prefixes[0, k - 1]:
                    keep[0] = True
                rows += list(prefixes[:-1][keep])
                sums += total[:-1][keep].tolist()
                open_[k] = (prefixes[-1], int(total[-1]), is_first and len(starts) == 1)
            last = ids[-1:]
            if rows:
                yield batch_of(rows, sums)
        ends = [(p, c) for k, (p, c, _) in open_.items() if p[k - 1]]
        if ends:
            yield batch_of([p for p, _ in ends], [c for _, c in ends])

    return run


def _counted(encoded: DataFrame, width: int, kind: str, least: int, pairs, bits: int) -> DataFrame:
    """key, n: every phrase of 2 to ``width`` ids that occurs ``least`` times."""
    partial = materialize(encoded.mapInArrow(_phrases(width, kind, pairs, bits), "key binary, n long"))
    ranges = partial.repartitionByRange(shuffle_partitions(encoded.sparkSession), "key").sortWithinPartitions("key")
    runs = ranges.mapInArrow(_run_lengths(width, kind, least), "key binary, n long")
    out = materialize(runs.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    discard(partial)
    return out


def _bitmap(pairs: DataFrame, kind: str, bits: int, slices_: int = 64) -> bytes:
    """The pairs' hashes as a bitmap of 2 ** bits, put together in slices by tasks."""
    size = (1 << bits) // slices_

    def hashed(batches):
        for batch in batches:
            ids = _columns(batch.column("key"), 2, kind)
            yield pa.record_batch([pa.array(_pair_bits(ids[:, 0], ids[:, 1], bits).astype(np.int64))], names=["bit"])

    def filled(batches):
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("bit").to_numpy()
            for s in np.unique(at // size):
                marks.setdefault(int(s), np.zeros(size, bool))[at[at // size == s] % size] = True
        for s, m in marks.items():
            yield pa.record_batch([pa.array([s], pa.int64()), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())], names=["slice", "marks"])

    bit = pairs.mapInArrow(hashed, "bit long").distinct().withColumn("slice", F.floor(F.col("bit") / size))
    whole = np.zeros(((1 << bits) + 7) // 8, np.uint8)
    for r in bit.repartition("slice").select("bit").mapInArrow(filled, "slice long, marks binary").collect():  # a row per slice, of fixed size
        whole[r.slice * size // 8 : (r.slice + 1) * size // 8] = np.frombuffer(r.marks, np.uint8)
    return whole.tobytes()


def _with_rare_ids(texts: DataFrame, rare: DataFrame, head: dict[str, dict[bytes, int]]) -> DataFrame:
    """texts with ``own``: the ids of the document's words outside the head, looked up by a join."""
    heads = texts.sparkSession.sparkContext.broadcast(head)

    def words(batches):
        for part in slices(batches):
            keys, langs, found = [], [], []
            for key, lang, text in zip(part.column("_key").to_pylist(), part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                known = heads.value.get(lang, {})
                new = [w.decode() for w in set(pieces(text)) - {_BREAK} if w not in known]
                keys += [key] * len(new)
                langs += [lang] * len(new)
                found += new
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(langs, pa.string()), pa.array(found, pa.string())], names=["_key", "lang", "word"])

    keyed = texts.withColumn("_key", row_key("lang", "text"))
    wanted = keyed.select("_key", "lang", "text").mapInArrow(words, "_key binary, lang string, word string").distinct()
    own = wanted.join(rare.select("lang", "word", "id"), ["lang", "word"]).groupBy("_key").agg(F.collect_list(F.struct("word", "id")).alias("own"))
    return keyed.join(own, "_key", "left").select("lang", "text", "own")


def _key_of(id_: Column, width: int, nbytes: int) -> Column:
    return F.unhex(F.rpad(F.lpad(F.hex(id_), 2 * nbytes, "0"), 2 * nbytes * width, "0"))


def _scored(phrases: DataFrame, words: DataFrame, width: int, nbytes: int, head: int, every: DataFrame) -> DataFrame:
    """phrases: key, k, n, some of every. words: key, n, id, lang, total. Adds lang, score and the counts l, r of the cut that scores least."""
    zeros = lambda n: F.substring(F.lit(bytes(nbytes * width)), 1, n)
    cut = phrases.select("key", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    left = F.concat(F.substring("key", F.lit(1), F.col("cut") * nbytes), zeros((F.lit(width) - F.col("cut")) * nbytes))
    right = F.concat(F.substring("key", F.col("cut") * nbytes + 1, F.lit(width * nbytes)), zeros(F.col("cut") * nbytes))
    sides = F.array(F.struct(left.alias("part"), F.lit("l").alias("side"), F.col("cut").alias("len")), F.struct(right.alias("part"), F.lit("r").alias("side"), (F.col("k") - F.col("cut")).alias("len")))
    parts = cut.select("key", "k", "a", "cut", F.inline(sides))
    common = F.broadcast(words.filter(F.col("id") <= head).select(F.col("key").alias("part"), F.col("n").alias("c"), "lang", "total"))
    rest = words.filter(F.col("id") > head).select(F.col("key").alias("part"), F.col("n").alias("c"), "lang", "total")
    none = every.select(F.col("key").alias("part"), F.col("n").alias("c"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("total"))
    single = F.col("len") == 1
    met = parts.filter(single).join(common, "part", "left")
    found = met.filter("c is not null").unionByName(met.filter("c is null").drop("c", "lang", "total").join(rest, "part")).unionByName(parts.filter(~single).join(none, "part"))
    both = F.struct("cut", "side", "c")
    grouped = found.groupBy("key", "k", "a").agg(F.max("lang").alias("lang"), F.max("total").alias("total"), F.collect_list(both).alias("_cuts"))
    exact = lambda c, digits: c.cast(f"decimal({digits},0)")

    def at_cut(j: Column) -> Column:
        of = lambda side: F.element_at(F.filter("_cuts", lambda x: (x["cut"] == j) & (x["side"] == side)), 1)["c"]
        l, r = of("l"), of("r")  # noqa: E741
        # numerators stay below 10 ** 38 for 10 ** 17 words; the quotient is at most 10 times the number of words
        score = F.call_function("div", exact(F.lit(1000), 4) * exact(F.col("a"), 17) * exact(F.col("total"), 17), exact(l, 18) * exact(r, 18))
        return F.struct(score.alias("score"), j.alias("cut"), l.alias("l"), r.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.col("k") - 1), at_cut))
    return grouped.withColumn("_best", best).select("key", "k", "a", "lang", "total", "_best.score", "_best.l", "_best.r")


def _outlived(phrases: DataFrame, width: int, nbytes: int) -> DataFrame:
    """phrases without those that a phrase of one more word around them equals in count."""
    shorter = (F.col("k") - 1) * nbytes
    zeros = lambda n: F.substring(F.lit(bytes(nbytes * width)), 1, n)
    pad = zeros((F.lit(width + 1) - F.col("k")) * nbytes)
    within = F.array(F.concat(F.substring("key", F.lit(1), shorter), pad), F.concat(F.substring("key", F.lit(nbytes + 1), shorter), pad))
    around = phrases.filter("k > 2").select(F.explode(within).alias("key"), F.col("n").alias("_n")).groupBy("key").agg(F.max("_n").alias("_around"))
    return phrases.join(around, "key", "left").filter("_around is null or 100 * _around < 100 * n").drop("_around")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 100,
    longest: int = 5,
    first: int = 2000,
    head: int = 300_000,
    bits: int = 27,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases by score."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = materialize(texts.mapInArrow(lambda batches: _count_words(batches), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = materialize(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    often = ranked(counts.filter(F.col("n") >= least), F.col("n").desc(), F.col("lang"), F.col("word")).select("lang", "word", "n", (F.col("_rank") + 1).alias("id"))
    words = materialize(often.join(totals, "lang"))
    discard(counts)
    n_words = words.count()
    kind = "uint32" if n_words < 1 << 32 else "uint64"
    nbytes = np.dtype(kind).itemsize
    by: dict[str, dict[bytes, int]] = {}
    for r in words.filter(F.col("id") <= head).select("lang", "word", "id").toLocalIterator():  # at most ``head`` rows
        by.setdefault(r.lang, {})[r.word.encode()] = r.id
    ids = spark.sparkContext.broadcast(by)
    source = texts if n_words <= head else _with_rare_ids(texts, words.filter(F.col("id") > head), by)
    encoded = materialize(source.mapInArrow(lambda batches: _encode(ids.value, longest - 1, kind)(batches), "ids binary, starts long"))
    pairs = _counted(encoded, 2, kind, least, None, bits)
    frequent = spark.sparkContext.broadcast(_bitmap(pairs, kind, bits))
    phrases = _counted(encoded, longest, kind, least, frequent, bits)
    discard(encoded, pairs)
    length = sum((F.substring("key", j * nbytes + 1, nbytes) != F.lit(bytes(nbytes))).cast("int") for j in range(longest))
    phrases = phrases.withColumn("k", length)
    keyed = words.withColumn("key", _key_of(F.col("id"), longest, nbytes))
    scored = materialize(_scored(_outlived(phrases, longest, nbytes), keyed, longest, nbytes, head, phrases))
    # the score and count of each language's last place, then all that reach it (ties too), in words
    place = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    last = scored.select("lang", "score", "a", F.row_number().over(place).alias("_place")).filter(F.col("_place") <= first)
    last = last.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("_last"))
    near = scored.join(last, "lang").filter(F.struct("score", "a") >= F.col("_last")).drop("_last")
    spelled = near.select("key", F.posexplode(F.array(*[F.substring("key", j * nbytes + 1, nbytes) for j in range(longest)])).alias("_at", "_id")).filter(F.col("_id") != F.lit(bytes(nbytes)))
    spelled = spelled.withColumn("id", F.conv(F.hex("_id"), 16, 10).cast("long")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    out = near.join(spelled, "key").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _op12_sql(least: int = 100) -> str:
    pairs = ", ".join(f"({k})" for k in (1, 2, 3, 4, 5))
    return f"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({ascii_lower_sql("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
tot as (select lang, sum(len(ws)) as n from w group by lang),
g as (select lang, k, ws[i : i + k - 1] as ph from (select lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) as i from w, (values {pairs}) v(k) where len(ws) >= k)),
f as (select lang, k, ph, count(*) as c from g group by all having count(*) >= {least}),
d as (select lang, k, ph, c from f where k > 1),
gone as (select distinct d.lang, d.ph from d join (select lang, ph[1 : k - 1] as s, c from d where k > 2 union all select lang, ph[2 : k] as s, c from d where k > 2) o on o.lang = d.lang and o.s = d.ph and 100 * o.c >= 100 * d.c),
s as (select d.lang, d.ph, d.c as a, fl.c as l, fr.c as r, tot.n, cut,
             (1000::hugeint * d.c::hugeint * tot.n::hugeint) // (fl.c::hugeint * fr.c::hugeint) as score
      from (select *, unnest(generate_series(1, k - 1)) as cut from d) d join tot using (lang)
      join f fl on fl.lang = d.lang and fl.ph = d.ph[1 : cut] join f fr on fr.lang = d.lang and fr.ph = d.ph[cut + 1 : d.k]),
b as (select lang, ph, a, n, arg_min(struct_pack(score := score, l := l, r := r), struct_pack(score := score, cut := cut)) as x from s group by all),
e as (select lang, array_to_string(ph, ' ') as phrase, a, x.l as l, x.r as r, n, x.score as score from b where not exists (select 1 from gone where gone.lang = b.lang and gone.ph = b.ph)),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from e)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from o where rank <= 2000
"""


OP12_SQL = _op12_sql()
