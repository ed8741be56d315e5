"""Language-model scores: a causal self-attention model over subword ids, in numpy inside Spark tasks.

The model predicts the next subword's class by one head of attention over the last ``CONTEXT`` subwords
and a hidden layer, then the subword within its class from the same hidden layer (a two-level softmax). The
commonest subwords have a place of their own in a class; the rest share one place in each class, by the
counts of all training subwords. Subwords that end a word have classes of their own.

1. One pass over the documents makes subwords (kept with the text) and, of the training documents, counts of
   words and subwords (per task, then by key).
2. Every window of the training documents is in a gradient step. There are ``rounds`` rounds and as many passes over
   the windows as make ``least_windows`` of them (one pass from there on). The texts are dealt to ``rounds`` equal parts; a
   round takes one part for each pass, all parts at most, and these again if passes are left over. Within a round texts
   are dealt to shards, one per ``shard_bytes`` of text, which train side by side from the same weights; these are then
   averaged (in a first sum by tasks, then of at most ``SUMS`` vectors by the driver).
3. One pass scores all documents in windows that overlap by the context, so every subword is scored
   once, by batched masked attention: a position sees the CONTEXT inputs up to its own, and no padding.

The unigram base needs each word's count. The commonest ``head`` words are broadcast (a bound on their
number); the others go by a join on the word, so the vocabulary may be of any size.

Null text is empty: one end token. Equal and repeated rows are scored one by one; null ids count as the text "".
Very long texts are cut into windows like any other. With no training documents every subword is equally likely.
An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, drop_caches, materialize, settings, slices, table
from .packing import encoder, split_words, tokenizer_path, word_ends
from .quality import crc_mod

CONTEXT, STEP, DIM, HIDDEN, CLASSES, PLACES, ROWS = 8, 64, 8, 16, 32, 32, 2048
WIDE = CONTEXT - 1 + STEP
PAD, END, IDS = 49406, 49407, 49408
#: Windows of one gradient step, and of one call to the scorer (which changes no score), so that a class has many positions in one product.
BATCH, CHUNK, SUMS = 64, 256, 64


def windows(ids: bytes) -> np.ndarray:
    """Of one text's ids (unsigned 16-bit): per window, CONTEXT - 1 ids before its first input, then STEP inputs and the target of the last; PAD where there is none."""
    seq = np.frombuffer(ids, "<u2")
    n = len(seq) + 1
    k = -(-n // STEP)
    flat = np.full(CONTEXT + k * STEP, PAD, np.uint16)
    flat[CONTEXT - 1], flat[CONTEXT : CONTEXT + n - 1], flat[CONTEXT + n - 1] = END, seq, END
    return np.lib.stride_tricks.sliding_window_view(flat, WIDE + 1)[::STEP][:k]


def halves(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (n, WIDE) and targets (n, STEP) of windows."""
    return both[:, :WIDE], both[:, CONTEXT:]


class Tables:
    """What the counts of subwords fix: each id's class, place there, log share of the place, and column of the embedding."""

    def __init__(self, counts: np.ndarray, final: np.ndarray):
        smooth = counts + 0.1
        order = np.argsort(-smooth, kind="stable")
        self.classes, self.place = np.zeros(IDS, np.uint8), np.zeros(IDS, np.int64)
        half = CLASSES // 2
        for k, part in enumerate((order[final[order]], order[~final[order]])):
            at = np.arange(len(part))
            self.classes[part], self.place[part] = k * half + at % half, np.minimum(at // half, PLACES - 1)
        cell = self.classes.astype(np.int64) * PLACES + self.place
        mass = np.bincount(cell, smooth, CLASSES * PLACES)
        self.share = (np.log(smooth) - np.log(mass[cell])).astype(np.float32)
        mass = np.maximum(mass.reshape(CLASSES, PLACES), 1e-9)
        self.prior = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
        self.inner = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
        self.row = (ROWS + self.classes.astype(np.int64)).astype(np.int16)
        self.row[order[:ROWS]] = np.arange(ROWS)


SHAPES = {"e": (DIM, ROWS + CLASSES), "q": (DIM, DIM), "k": (DIM, DIM), "v": (HIDDEN, DIM), "pos": (CONTEXT,), "own": (HIDDEN, DIM), "b1": (HIDDEN,), "out": (CLASSES, HIDDEN + 1), "in": (CLASSES, PLACES, HIDDEN + 1)}


def start_weights(tables: Tables, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {n: (rng.normal(size=s) * (0.5 if n == "e" else 0.05 if n in ("out", "in") else 0.25)).astype(np.float32) for n, s in SHAPES.items()}
    w["pos"][:], w["b1"][:], w["out"][..., -1], w["in"][..., -1] = -0.1 * np.arange(CONTEXT), 0.0, tables.prior, tables.inner
    return w


def flatten(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in SHAPES])


def unflatten(flat: np.ndarray, copy: bool = True) -> dict[str, np.ndarray]:
    """Without copy parts of flat itself, of float32."""
    out, at = {}, 0
    for n, s in SHAPES.items():
        size = int(np.prod(s))
        out[n] = flat[at : at + size].reshape(s).astype(np.float32, copy=copy)
        at += size
    return out


class Room:
    """Arrays that steps use again, by name: fresh memory costs a step more than the sums in it."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: int, n: int, kind: np.dtype) -> np.ndarray:
        """An array of rows x n, whose values are left over."""
        a = self.kept.get(name)
        if a is None or a.size < rows * n or a.dtype != kind:
            a = self.kept[name] = np.empty(rows * n, kind)
        return a[: rows * n].reshape(rows, n)

    def spaced(self, name: str, rows: int, n: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """An array as ahead() takes it, and its STEP positions of n windows each."""
        side = (CONTEXT - 1) * n
        a = self(name, rows, STEP * n + 2 * side, kind)
        a[:, :side], a[:, -side:] = 0, 0
        return a, a[:, side:-side]


def back(a: np.ndarray, n: int) -> np.ndarray:
    """a: features, then WIDE positions of n windows each. A view [..., r, m]: what stands r places before the m-th of the STEP positions."""
    size, at = a.itemsize, a[..., (CONTEXT - 1) * n :]
    return np.lib.stride_tricks.as_strided(at, (*a.shape[:-1], CONTEXT, STEP * n), (*a.strides[:-1], -n * size, size), writeable=False)


def ahead(a: np.ndarray, n: int, paired: bool = False) -> np.ndarray:
    """a: features, then STEP positions with CONTEXT - 1 empty ones on either side. A view [..., r, j]: the position that sees the j-th of WIDE ones r places back; paired: a's rows are the r."""
    lead = a.shape[:-1], a.strides[:-1]
    shape, strides = ((), ()) if paired else lead
    return np.lib.stride_tricks.as_strided(a, (*shape, CONTEXT, WIDE * n), (*strides, n * a.itemsize + paired * a.strides[0], a.itemsize), writeable=False)


class Pass:
    """A forward pass. Up to the hidden layer arrays are by feature, then position, then window: what stands r places back is a shift by whole rows of windows.

    A position's weight of the input r places back is p[r]; what a window lacks (PAD) gets none. From the hidden layer on
    a row is a position, and positions whose targets share a class stand together, in `order`.
    """

    def __init__(self, w: dict[str, np.ndarray], t: Tables, x: np.ndarray, y: np.ndarray, room: Room):
        n, kind = len(x), w["e"].dtype
        wide, step = WIDE * n, STEP * n
        seen, self.y = np.ascontiguousarray(x.T).ravel(), np.ascontiguousarray(y.T).ravel()
        self.row = t.row[seen].astype(np.intp)
        self.e = np.take(w["e"], self.row, axis=1, out=room("e", DIM, wide, kind), mode="clip")
        self.near = back(self.e, n)
        # of a position: what it takes from those behind it (below), its own embedding, and 1
        self.inputs = room("inputs", 2 * DIM + 1, step, kind)
        self.inputs[DIM:-1], self.inputs[-1] = self.e[:, (CONTEXT - 1) * n :], 1
        # (q a)(k b) is (k'q a) b, and the sum of p v e is v times that of p e: so both need embeddings only
        self.meet = w["k"].T @ w["q"]
        self.wide_ask, ask = room.spaced("ask", DIM, n, kind)
        np.matmul(self.meet, self.inputs[DIM:-1], out=ask)
        self.wide_p, self.p = room.spaced("p", CONTEXT, n, kind)
        p = np.einsum("dm,drm->rm", ask, self.near, out=room("scores", CONTEXT, step, kind))
        p += w["pos"][:, None]
        gone = seen == PAD
        if gone.any():
            p[1:] += back(np.where(gone, kind.type(-1e9), kind.type(0)), n)[1:]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        np.divide(p, p.sum(axis=0), out=self.p)
        np.einsum("rm,drm->dm", self.p, self.near, out=self.inputs[:DIM])
        self.hidden = np.zeros((HIDDEN + 1, 2 * DIM + 1), kind)
        self.hidden[:HIDDEN], self.hidden[HIDDEN, -1] = np.concatenate([w["v"], w["own"], w["b1"][:, None]], axis=1), 1
        rows = np.matmul(self.inputs.T, self.hidden.T, out=room("rows", step, HIDDEN + 1, kind))
        np.maximum(rows, 0, out=rows)
        classes = t.classes[self.y]
        self.order = np.argsort(classes, kind="stable")
        sizes = np.bincount(classes, minlength=CLASSES)
        stops = np.cumsum(sizes)
        self.parts = [(c, a, b) for c, (a, b) in enumerate(zip((stops - sizes).tolist(), stops.tolist(), strict=True)) if a < b]
        self.h = np.take(rows, self.order, axis=0, out=room("sorted", step, HIDDEN + 1, kind), mode="clip")
        self.target = self.y[self.order]
        # in the flat scores of its class (by place, then position) where a target's place is
        self.at = (CLASSES + t.place[self.target]) * np.repeat(sizes, sizes) + np.arange(step) - np.repeat(stops - sizes, sizes)
        self.w = np.concatenate([np.broadcast_to(w["out"], (CLASSES, *w["out"].shape)), w["in"]], axis=1)
        self.room, self.kind = room("outputs", CLASSES + PLACES, sizes.max(), kind).ravel(), kind

    def outputs(self, less: bool) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """By class with targets: the class, its range, and the scores of all classes, then of its places; less: by the largest of either kind."""
        for c, a, b in self.parts:
            z = np.matmul(self.w[c], self.h[a:b].T, out=self.room[: (CLASSES + PLACES) * (b - a)].reshape(-1, b - a))
            if less:
                z[:CLASSES] -= z[:CLASSES].max(axis=0)
                z[CLASSES:] -= z[CLASSES:].max(axis=0)
            yield c, a, b, z


def held(sums: np.ndarray) -> bool:
    """Whether float32 holds the sums of exponentials, as it does unless scores are very large."""
    return bool(1e-30 < sums.min() and sums.max() < 1e30)


def log10_scores(w: dict[str, np.ndarray], t: Tables, x: np.ndarray, y: np.ndarray, room: Room | None = None) -> np.ndarray:
    """The log10 probability of each window's targets."""
    m = Pass(w, t, x, y, room or Room())
    own, sums = np.empty(len(m.y), m.kind), np.empty((2, len(m.y)), m.kind)
    for less in (False, True):
        with np.errstate(over="ignore"):
            for c, a, b, z in m.outputs(less):
                np.add(z[c], z.ravel()[m.at[a:b]], out=own[a:b])
                np.add.reduce(np.exp(z, out=z).reshape(2, -1, b - a), axis=1, out=sums[:, a:b])
        if held(sums):
            break
    own += t.share[m.target]
    own -= np.log(sums).sum(axis=0)
    got = np.empty_like(own)
    got[m.order] = own
    got[m.y == PAD] = 0
    return got.reshape(y.shape[::-1]).sum(axis=0, dtype=np.float64) / np.log(10)


def gradient(w: dict[str, np.ndarray], t: Tables, x: np.ndarray, y: np.ndarray, room: Room | None = None) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood of the targets."""
    room, n = room or Room(), len(x)
    m = Pass(w, t, x, y, room)
    kind, step = m.kind, STEP * n
    weight = (m.target != PAD).astype(kind)
    weight /= max(1, np.count_nonzero(weight))
    by_class, dh, place, sums = np.zeros_like(m.w), room("dh", step, HIDDEN + 1, kind), np.empty_like(m.order), np.empty((2, step), kind)
    for less in (False, True):
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for c, a, b, z in m.outputs(less):
                np.add.reduce(np.exp(z, out=z).reshape(2, -1, b - a), axis=1, out=sums[:, a:b])
                by_kind = z.reshape(2, -1, b - a)
                by_kind *= (weight[a:b] / sums[:, a:b])[:, None]
                z[c] -= weight[a:b]
                z.ravel()[m.at[a:b]] -= weight[a:b]
                np.matmul(z, m.h[a:b], out=by_class[c])
                np.matmul(z.T, m.w[c], out=dh[a:b])
        if held(sums):
            break
    g = {"out": by_class[:, :CLASSES].sum(axis=0), "in": by_class[:, CLASSES:]}
    dh *= m.h > 0
    place[m.order] = np.arange(step)
    rows = np.take(dh, place, axis=0, out=room("rows", step, HIDDEN + 1, kind), mode="clip")[:, :HIDDEN]
    gh = (m.inputs @ rows).T
    g["v"], g["own"], g["b1"] = gh[:, :DIM], gh[:, DIM:-1], gh[:, -1]
    wide_d, d = room.spaced("inputs back", 2 * DIM, n, kind)
    np.matmul(m.hidden[:HIDDEN, :-1].T, rows.T, out=d)
    wide_s, dp = room.spaced("dp", CONTEXT, n, kind)
    np.einsum("dm,drm->rm", d[:DIM], m.near, out=dp)
    dp -= np.einsum("rm,rm->m", dp, m.p)
    dp *= m.p
    g["pos"] = dp.sum(axis=1)
    own = np.einsum("drm,rm->dm", m.near, dp, out=room("own", DIM, step, kind))
    meet = own @ m.inputs[DIM:-1].T
    g["q"], g["k"] = w["k"] @ meet, w["q"] @ meet.T
    de, taken = room("de", DIM, WIDE * n, kind), room("taken", DIM, WIDE * n, kind)
    np.einsum("drm,rm->dm", ahead(m.wide_ask, n), ahead(wide_s, n, True), out=de)
    de += np.einsum("drm,rm->dm", ahead(wide_d[:DIM], n), ahead(m.wide_p, n, True), out=taken)
    at_own = de[:, (CONTEXT - 1) * n :]
    at_own += d[DIM:]
    at_own += m.meet.T @ own
    g["e"] = np.stack([np.bincount(m.row, of, w["e"].shape[1]) for of in de]).astype(kind)
    return g


def train(w: dict[str, np.ndarray], tables: Tables, batches: Iterator[np.ndarray], rate: float) -> dict[str, np.ndarray]:
    """Adam over a stream of batches of windows; the first steps are shorter."""
    flat, room = flatten(w).astype(np.float32), Room()
    w, mean, square, move = unflatten(flat, copy=False), np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    for step, both in enumerate(batches, 1):
        now = rate * min(1.0, step / 10)
        g = flatten(gradient(w, tables, *halves(both), room)).astype(np.float32, copy=False)
        mean += np.multiply(np.subtract(g, mean, out=move), np.float32(0.1), out=move)
        g *= g
        square += np.multiply(np.subtract(g, square, out=g), np.float32(0.02), out=g)
        np.sqrt(np.multiply(square, np.float32(1 / (1 - 0.98**step)), out=g), out=g)
        g += np.float32(1e-6)
        flat -= np.multiply(np.divide(mean, g, out=move), np.float32(now / (1 - 0.9**step)), out=move)
    return w


_TYPES = {"row": pa.int64(), "held": pa.bool_(), "text": pa.string(), "ids": pa.binary(), "tag": pa.string(), "word": pa.string(), "n": pa.int64()}


class Counts:
    """Counts by word, as Arrow columns: added up once twice `most` rows wait, and given out once `most` words are left then."""

    def __init__(self, most: int):
        self.most, self.waiting, self.rows = most, [], 0
        self.none = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

    def add(self, words: pa.Array, n: np.ndarray) -> pa.Table:
        """What is given out."""
        some = np.flatnonzero(n)
        self.waiting.append(pa.table({"word": words.take(pa.array(some)), "n": n[some]}))
        self.rows += len(some)
        if self.rows < 2 * self.most:
            return self.none
        total = self.rest()
        if total.num_rows >= self.most:
            return total
        self.waiting, self.rows = [total], total.num_rows
        return self.none

    def rest(self) -> pa.Table:
        every = pa.concat_tables([self.none, *self.waiting])
        self.waiting, self.rows = [], 0
        return every.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _gather(docs: DataFrame, path: str, most_words: int) -> DataFrame:
    """docs: _id, _text, _held. A row "text" for each (id, row number, held, text, ids), and of the training documents "word" and "piece" counts by task."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pieces, row, id_type = Counts(most_words), np.zeros(IDS, np.int64), TaskContext.get().partitionId() << 40, None

        def put(rows: int, key: pa.Array | None = None, **columns) -> pa.RecordBatch:
            cols = [pa.nulls(rows, t) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t) for c, t in _TYPES.items()]
            return pa.RecordBatch.from_arrays([pa.nulls(rows, id_type) if key is None else key, *cols], names=["id", *_TYPES])

        def counted(of: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in of.to_batches(1 << 16):
                yield put(len(part), tag=pa.repeat("word", len(part)), word=part.column("word"), n=part.column("n"))

        for batch in slices(batches, 1000):
            id_type, kept = batch.column(0).type, ~batch.column(2).to_numpy(zero_copy_only=False)
            kinds, at, sizes, ids, n_ids = encoder(path).together(batch.column(1))
            yield from counted(words.add(kinds, np.bincount(at[np.repeat(kept, sizes)], minlength=len(kinds))))
            pieces += np.bincount(ids[np.repeat(kept, n_ids)], minlength=IDS)
            pieces[END] += np.count_nonzero(kept)
            n, at = batch.num_rows, np.concatenate([[0], np.cumsum(2 * n_ids)]).astype(np.int32)
            cut = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(ids.astype("<u2"))])
            yield put(n, batch.column(0), row=np.arange(row, row + n), held=batch.column(2), text=batch.column(1), ids=cut, tag=pa.repeat("text", n))
            row += n
        if id_type is not None:
            yield from counted(words.rest())
            at = np.flatnonzero(pieces)
            yield put(len(at), tag=["piece"] * len(at), word=[str(i) for i in at], n=pieces[at])

    return docs.select("_id", "_text", "_held").mapInArrow(run, f"id {kind}, row long, held boolean, text string, ids binary, tag string, word string, n long")


def _round(texts: DataFrame, w: dict[str, np.ndarray], tables: Tables, shards: int, rate: float, times: int = 1) -> DataFrame:
    """texts: row, ids. Per shard: its weights after every window of its texts, `times` times over, and n, the number of windows in steps."""
    held = texts.sparkSession.sparkContext.broadcast((w, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, about = held.value
        seen, rng = [0], np.random.default_rng(12)
        drop_caches()

        def stream() -> Iterator[np.ndarray]:
            wait, size = [], 0
            if times > 1:  # so there are fewer than least_windows of them
                every = np.concatenate([np.empty((0, WIDE + 1), np.uint16), *(windows(ids) for batch in batches for ids in batch.column(0).to_pylist())])
                for _ in range(times):
                    both = rng.permutation(every)
                    yield from (counted(both[k : k + BATCH]) for k in range(0, len(both), BATCH))
                return
            for batch in batches:
                for ids in batch.column(0).to_pylist():
                    wait.append(windows(ids))
                    size += len(wait[-1])
                    if size >= 1 << 13:
                        both = rng.permutation(np.concatenate(wait))  # a step's windows come from many texts
                        whole = len(both) // BATCH * BATCH
                        yield from map(counted, np.split(both[:whole], whole // BATCH))
                        wait, size = [both[whole:]], len(both) - whole
            both = rng.permutation(np.concatenate([np.empty((0, WIDE + 1), np.uint16), *wait]))
            yield from (counted(both[k : k + BATCH]) for k in range(0, len(both), BATCH))

        def counted(both: np.ndarray) -> np.ndarray:
            seen[0] += len(both)
            return both

        now = train(now, about, stream(), rate)
        yield pa.RecordBatch.from_arrays([pa.array([flatten(now).tobytes()], pa.binary()), pa.array([seen[0]], pa.int64())], names=["w", "n"])

    # row numbers spread evenly, whatever the texts; written by all shards at once
    return materialize(texts.repartition(shards, F.xxhash64("row")).select("ids").mapInArrow(run, "w binary, n long"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = 0.0, 0
    for batch in batches:
        for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total, n = total + np.frombuffer(w, np.float32).astype(np.float64) * k, n + k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "n"])


def _fit(texts: DataFrame, tables: Tables, shards: int, rounds: int, rate: float, passes: int = 1) -> dict[str, np.ndarray]:
    w = start_weights(tables)
    for k in range(rounds):
        part = texts.filter(F.pmod(F.col("row") - k, F.lit(rounds)) < passes)
        sums = _round(part, w, tables, shards, rate, -(-passes // rounds)).coalesce(SUMS).mapInArrow(_sums, "w binary, n long").collect()  # at most SUMS vectors of one size
        if sums:
            w = unflatten(sum(np.frombuffer(r.w) for r in sums) / sum(r.n for r in sums))
        rate *= 0.6
    return w


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hold_out: int = 10,
    head: int = 300_000,
    shard_bytes: int = 32_000_000,
    rounds: int = 4,
    learning_rate: float = 0.02,
    least_windows: int = 200_000,
    most_words: int = 400_000,
    path: str | None = None,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).withColumn("_held", crc_mod("_id", hold_out) == 0)
    with settings(spark, **SMALL_BATCHES):
        seen = materialize(_gather(rows, path, most_words))
    texts = seen.filter("tag = 'text'")
    chars = texts.filter("not held").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_bytes))
    words = materialize(seen.filter("tag = 'word'").groupBy("word").agg(F.sum("n").alias("n")))
    pieces = np.zeros(IDS)
    for r in seen.filter("tag = 'piece'").groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most IDS rows
        pieces[int(r.word)] = r.n
    ends = int(pieces[END])
    total, kinds = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, kinds = (total or 0) + ends, kinds + (ends > 0)
    bottom = total + 0.1 * (kinds + 1)
    enough, left = 1 << 62, head
    for r in words.groupBy(F.least("n", F.lit(10_000)).alias("c")).count().orderBy(F.desc("c")).collect():  # at most 10,000 rows
        left -= r["count"]
        if left < 0:
            break
        enough = r.c
    common = words.filter(F.col("n") >= enough).toArrow()  # at most `head` rows
    known = common["word"].combine_chunks(), np.append(np.log10((common["n"].to_numpy() + 0.1) / bottom), 0.0)
    from tokenizers import Tokenizer

    tables = Tables(pieces, np.append(word_ends(Tokenizer.from_file(path)), np.zeros(IDS, bool))[:IDS])
    n_windows = texts.filter("not held").agg(F.sum(F.ceil((F.octet_length("ids") / 2 + 1) / STEP))).first()[0] or 1
    passes = max(1, -(-least_windows // n_windows))
    model = _fit(texts.filter("not held").select("row", "ids"), tables, shards, rounds, learning_rate, passes)
    held = spark.sparkContext.broadcast((known, model, tables))
    end_score = float(np.log10((ends + 0.1) / bottom))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        room, (known, values) = Room(), held.value[0]
        rare_type = pa.list_(pa.struct([("w", pa.string()), ("k", pa.int64())]))
        for batch in slices(batches, 1000):
            words, sizes = split_words(batch.column(3))
            stops = np.cumsum(sizes)
            at = pc.fill_null(pc.index_in(words, value_set=known), len(known)).to_numpy()
            v = np.concatenate([[0.0], np.cumsum(values[at])])[stops]
            others = np.flatnonzero(at == len(known))
            n_rare = np.diff(np.searchsorted(others, stops), prepend=0)
            met = pa.table({"t": np.repeat(np.arange(len(sizes)), n_rare), "w": words.take(pa.array(others))}).group_by(["t", "w"], use_threads=False).aggregate([([], "count_all")]).sort_by("t")
            ends = np.concatenate([[0], np.cumsum(np.bincount(met["t"].to_numpy(), minlength=len(sizes)))]).astype(np.int32)
            rare = pa.StructArray.from_arrays([met["w"].combine_chunks(), met["count_all"].combine_chunks()], fields=[*rare_type.value_type])
            parts = [windows(ids) for ids in batch.column(4).to_pylist()]
            both = np.concatenate(parts)
            got = np.concatenate([log10_scores(*held.value[1:], *halves(both[k : k + CHUNK]), room) for k in range(0, len(both), CHUNK)])
            score = np.add.reduceat(got, np.cumsum([0, *map(len, parts[:-1])]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes + 1, pa.int64()), pa.array(sizes - n_rare, pa.int64()), pa.array(np.diff(v, prepend=0) + end_score), pa.ListArray.from_arrays(ends, rare, rare_type), pa.array(score)],
                names=["doc_id", "row", "held_out", "n_tokens", "n_known", "base", "rare", "score"],
            )

    scored = texts.select("id", "row", "held", "text", "ids").mapInArrow(run, f"doc_id {kind}, row long, held_out boolean, n_tokens long, n_known long, base double, rare array<struct<w:string,k:long>>, score double")
    with settings(spark, **SMALL_BATCHES):
        scored = materialize(scored)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.w").alias("word"), F.col("r.k").alias("k"))
    met = rare.join(words.filter(F.col("n") < enough), "word", "left")
    value = F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(float(bottom)))
    by_row = met.groupBy("row").agg(F.sum(value).alias("_more"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("_known"))
    joined = scored.drop("rare").join(by_row, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), "score",
    )


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
