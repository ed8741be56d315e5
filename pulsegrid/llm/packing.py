"""Packing documents into training sequences by large-item matching, then best fit.

Every document is tokenised in full, ended with id 0 and, only when longer than a sequence, cut into
sequence-long pieces. Packing needs only how many pieces have each length, a table of at most
``capacity`` rows whatever the corpus, so the plan is made once from that histogram:

* pieces above a third of the capacity fit at most twice in a sequence; from the longest down each is
  matched with the longest other one that still fits;
* the shorter ones, longest first, go to the fullest sequence that has room (best fit); a new
  sequence opens only where none has.

Sequences in the same state are one range of numbers, and a step moves a whole range or ends a length,
so the plan's size depends on the capacity alone (``max_steps`` is checked). A piece then looks up its
sequence by its length and its rank among the pieces of that length. Ranks are a count within the task
plus an offset by task, so no length, however frequent, is gathered in one place.

Null text is empty: one piece holding id 0. Equal and repeated rows are packed one by one. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Collection, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, materialize, slices, table

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Byte-level tokenizers write a byte as its own character where that can be seen, else as one from 256 on; here a space stays.
_UNSEEN = [*range(33), *range(127, 161), 173]
_AS_BYTES = "".join(" " if c == 32 else chr(256 + _UNSEEN.index(c)) if c in _UNSEEN else chr(c) for c in range(256))


def word_ends(tokenizer) -> np.ndarray:
    """By id, whether it ends a word."""
    by_token = tokenizer.get_vocab()
    final = np.zeros(max(by_token.values()) + 1, bool)
    final[[i for t, i in by_token.items() if t.endswith("</w>")]] = True
    return final


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between white space of all texts in a row, A-Z lower-cased, and each text's number of them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, stops = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
    full = pc.not_equal(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(upto[stops], prepend=0)


def as_bytes(words: pa.Array) -> list[bytes]:
    """Several times as fast as to_pylist."""
    words = words.cast(pa.binary())
    if not len(words):
        return []
    _, offsets, data = words.buffers()
    at, raw = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist(), data.to_pybytes() if data else b""
    return [raw[i:j] for i, j in pairwise(at)]


class WordEncoder:
    """Ids of a text, little-endian uint32, through a bounded cache of its white-space separated words.

    The tokenizer drops white space, lower-cases and never joins across white space, so words can be
    lower-cased and encoded one by one. It also parts letters from the punctuation behind them, so a new word of
    letters that no normalisation changes and of punctuation is put together from the ids of both. Letters are
    encoded many at a time by the tokenizer's own model between white space. Other new words are encoded many at a
    time, with a mark between them that is one id of its own; words holding the mark, and special tokens, are encoded alone.
    """

    MARK = "|"
    #: Neither the mark nor an apostrophe, which may begin a contraction.
    BEHIND = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "|'")
    #: Letters that every normalisation leaves as they are: a-z and Latin-1's.
    PLAIN = re.compile(b"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.cache = Tokenizer.from_file(path), most, {}
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.final = word_ends(self.tokenizer)

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: Collection[bytes]) -> list[bytes]:
        """The ids of different words that the cache lacks, which are put there."""
        # few looks into large tables, and no tuples, which the collector would walk
        whole, known, place, stems, rests, others = self.PLAIN.fullmatch, self.cache.get, {}, [], [], set()
        for w in words:
            stem = w.rstrip(self.BEHIND)
            if not (stem.isalpha() or whole(stem)):
                others.add(w)
                stems.append(b"")
                rests.append(w)
            elif len(stem) == len(w):
                stems.append(place.setdefault(w, len(place)))
                rests.append(b"")
            else:
                stems.append(known(stem) or place.setdefault(stem, len(place)))
                rests.append(w[len(stem) :])
        behind = others.union(rests) - {b""}
        self._learn_others(behind.difference(self.cache))
        more = {w: self.cache[w] for w in behind} | {b"": b""}
        found = self._letters([*place])  # only words stay in the cache
        out = [(found[stem] if type(stem) is int else stem) + more[rest] for stem, rest in zip(stems, rests, strict=True)]
        self.cache.update(zip(words, out, strict=True))
        return out

    def _letters(self, stems: list[bytes], together: int = 200) -> list[bytes]:
        found = []
        groups = [stems[k : k + together] for k in range(0, len(stems), together)]
        as_text = [codecs.charmap_decode(b" ".join(g), "strict", _AS_BYTES)[0] for g in groups]
        for group, text, e in zip(groups, as_text, self.letters.encode_batch_fast(as_text, add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            stops = np.flatnonzero(self.final[ids]) + 1
            if len(stops) != len(group):  # not every word ends in an id of its own kind
                e = self.letters.encode(text, add_special_tokens=False)
                ids, stops = np.asarray(e.ids, "<u4"), np.bincount(e.word_ids, minlength=len(group)).cumsum()
            raw, at = ids.tobytes(), [0, *(stops * 4).tolist()]
            found += [raw[i:j] for i, j in pairwise(at)]
        return found

    def _learn_others(self, words: set[bytes], together: int = 200) -> None:
        put, mark = self.cache.__setitem__, self.MARK.encode()
        alone = [w for w in words if mark in w]
        for w, ids in zip(alone, self._raw([w.decode() for w in alone]), strict=True):
            put(w, ids)
        rest = [w for w in words if mark not in w]
        groups = [rest[k : k + together] for k in range(0, len(rest), together)]
        glue = b" " + mark + b" "
        for group, raw in zip(groups, self._raw([(glue.join(g) + glue).decode() for g in groups]), strict=True):
            at = 0
            for w, stop in zip(group, (np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark) * 4).tolist(), strict=True):
                put(w, raw[at:stop])
                at = stop + 4

    def words_and_ids(self, texts: list[str | None], together: int = 64) -> Iterator[tuple[list[bytes], bytes]]:
        """Of each text its words, A-Z lower-cased, and its ids."""
        get = self.cache.__getitem__
        for k in range(0, len(texts), together):
            raw = [(t or "").encode() for t in texts[k : k + together]]
            split = [r.lower().split() for r in raw]
            if len(self.cache) > self.most:
                self.cache.clear()
            done: list[bytes | None] = []
            for words, r in zip(split, raw, strict=True):
                try:
                    done.append(b"".join(map(get, words)) if b"<|" not in r else self._raw([r.decode()])[0])
                except KeyError:
                    done.append(None)
            if None in done:
                self._learn(set().union(*(w for w, d in zip(split, done, strict=True) if d is None)).difference(self.cache))
            for words, ids in zip(split, done, strict=True):
                yield words, b"".join(map(get, words)) if ids is None else ids

    def together(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of many texts at once: their different words, A-Z lower-cased; of all words in a row the place there; each text's number of words; all ids in a row; each text's number of ids."""
        words, sizes = split_words(texts)
        words = words.dictionary_encode()
        if len(self.cache) > self.most:
            self.cache.clear()
        kinds = as_bytes(words.dictionary)
        found = [*map(self.cache.get, kinds)]
        if None in found:
            new = iter(self._learn([w for w, ids in zip(kinds, found, strict=True) if ids is None]))
            found = [next(new) if ids is None else ids for ids in found]
        flat, n_ids = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) >> 2
        start, at = np.cumsum(n_ids) - n_ids, words.indices.to_numpy()
        n = n_ids[at]
        stops = np.cumsum(n)
        ids = flat[np.repeat(start[at] - (stops - n), n) + np.arange(len(n) and stops[-1])]
        by_text = np.diff(np.concatenate([[0], stops])[np.cumsum(sizes)], prepend=0)
        special = np.flatnonzero(pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False))
        if len(special):  # may hold special tokens, so encoded whole
            parts = np.split(ids, np.cumsum(by_text)[:-1])
            for k, raw in zip(special.tolist(), self._raw(texts.take(pa.array(special)).to_pylist()), strict=True):
                parts[k] = np.frombuffer(raw, "<u4")
            ids, by_text = np.concatenate(parts), np.array([*map(len, parts)])
        return words.dictionary, at, sizes, ids, by_text

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        return (ids for _, ids in self.words_and_ids(texts))


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, whose later tasks find the words of earlier ones."""
    return WordEncoder(path)


CACHES.append(encoder.cache_clear)


_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, _part long, _local long"


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches):
            source, rows = [], []
            for k, ids in enumerate(words.encode(batch.column(1).to_pylist())):
                ids += b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    cut = ids[start * 4 : (start + capacity) * 4]
                    n = len(cut) // 4
                    source.append(k)
                    rows.append((piece, start, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_local"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _PIECES.format(id=rows.schema[0].dataType.simpleString()))


class Plan:
    """Steps (length, first rank, sequences, first sequence, first offset): ranks fill the sequences in turn, then the next layer.

    Steps depend on capacity alone, whatever the counts: pairing uses up a length a step; then each small length
    turns a group of equal gaps into one with smaller gaps, and leaves at most two groups more than there were.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.steps, self.bins = capacity, [], 0
        self.rank = dict.fromkeys(counts, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        left = dict(counts)
        large = sorted((s for s in left if 3 * s > capacity), reverse=True)
        for a in large:
            for b in large:
                if not left[a]:
                    break
                if b <= a and a + b <= capacity and left[b]:
                    m = left[a] // 2 if a == b else min(left[a], left[b])
                    if m:
                        first = self.open(m)
                        self.put(a, first, m, 0)
                        self.put(b, first, m, a)
                        left[a] -= m
                        left[b] -= m
                        self.free(first, m, capacity - a - b)
            if left[a]:
                first = self.open(left[a])
                self.put(a, first, left[a], 0)
                self.free(first, left[a], capacity - a)
                left[a] = 0
        for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
            gap, n = s, left[s]
            while n:
                while gap < capacity and not self.gaps.get(gap):
                    gap += 1
                layers = gap // s
                if gap >= capacity:
                    gap = capacity
                    size = -(-n // layers)
                    first = self.open(size)
                else:
                    first, size = self.gaps[gap].pop()
                full = min(size, n // layers)
                if full:
                    self.put(s, first, full, capacity - gap, layers)
                    self.free(first, full, gap - layers * s)
                    n -= full * layers
                if full < size and n:
                    self.put(s, first + full, 1, capacity - gap, n)
                    self.free(first + full, 1, gap - n * s)
                    full, n = full + 1, 0
                if full < size:
                    self.free(first + full, size - full, gap)

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def free(self, first: int, n: int, gap: int) -> None:
        if gap:
            self.gaps.setdefault(gap, []).append((first, n))

    def put(self, length: int, first: int, n: int, offset: int, layers: int = 1) -> None:
        self.steps.append((length, self.rank[length], n, first, offset))
        self.rank[length] += n * layers

    def table(self) -> np.ndarray:
        return np.array(sorted(self.steps), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    path: str | None = None,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, id_col, text_col, path or tokenizer_path(), capacity))
    by_task = materialize(cut.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")))
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(Plan(counts, capacity).table())
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = cut.join(materialize(offsets), ["_part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_local")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = plan.value
        keys = (steps[:, 0] << 48) + steps[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            step = steps[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            over = rank - step[:, 1]
            sequence, offset = step[:, 3] + over % step[:, 2], step[:, 4] + over // step[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema[0].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
