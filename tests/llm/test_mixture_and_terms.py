import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import collocations, common, divergence, mixing

FOLDER = "/root/testdata/sf0.001"
HARD = [(1, "A b c d e f", "en", "s"), (2, "a B c d e f", None, None), (3, None, "en", "s"), (4, "", "", "t"), (5, "x " * 30_000, "en", "t"), (None, "a b c d e f", "en", "s"), (3, None, "en", "s"), (6, "é É ſ a\x0bb", "en", "s")]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    return spark.createDataFrame([(*r, "k", 7, 1, "o") for r in HARD], "doc_id long, text string, lang string, source string, key string, n int, _source int, unit string")


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """A plain loop of the stated rule."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    free, left, out = set(order), float(sum(sizes.values())), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: most * sizes[s] for s in over}
        free, left = free - over, left - sum(most * sizes[s] for s in over)
    return out


def check_mix(docs, got):
    size = {}
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        size[r.source] = size.get(r.source, 0) + n
    want = targets(size)
    by = {}
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken in (math.floor(rate + 1e-9) * r.size, (math.floor(rate + 1e-9) + 1) * r.size) and r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    assert Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs) == Counter((r.doc_id, r.size) for r in got)
    for rows in by.values():
        yield abs(sum(r.taken for r in rows) - rows[0].target), sorted(r.size for r in rows)


def test_mix_is_near_its_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, "b").otherwise("a"))
    first = mixing.mixture(docs).collect()
    for miss, sizes in check_mix(docs.collect(), first):
        assert miss < 0.02 * sum(sizes)
    again = mixing.mixture(docs.repartition(3, "text")).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_mix_hard_rows(spark, hard):
    list(check_mix(hard.collect(), mixing.mixture(hard).collect()))
    assert mixing.mixture(hard.limit(0)).count() == 0 and mixing.mix(hard.limit(0)).count() == 0
    mixed = mixing.mix(hard)
    assert mixed.columns == hard.columns
    plan = {(r.doc_id, r.size): r.taken for r in mixing.mixture(hard).collect() if r.size and r.doc_id == 5}
    assert mixed.filter("doc_id = 5").count() * 30_000 == plan[5, 30_000]


def test_mix_of_one_row_repeated(spark):
    # more rows than a chunk with one id and size: copies are spread evenly, and a capped source is taken three times
    docs = spark.range(10_000).selectExpr("1L as doc_id", "'a b c' as text", "'s' as source").unionByName(spark.createDataFrame([(2, "w " * 90_000, "t")], "doc_id long, text string, source string"))
    got = mixing.mixture(docs).collect()
    ours = [r for r in got if r.source == "s"]
    assert len(ours) == 10_000 and abs(sum(r.taken for r in ours) - ours[0].target) <= 3
    assert max(r.taken for r in ours) - min(r.taken for r in ours) <= 3
    assert mixing.mix(docs).filter("source = 's'").count() * 3 == sum(r.taken for r in ours)


def test_mix_draws_without_bias(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "repeat('w ', int(1 + id * 3)) as text", "if(id < 30, 'a', 'b') as source")
    sums = Counter()
    rate = {}
    for seed in range(5):
        for r in mixing.mixture(docs, seed=seed).collect():
            sums[r.source] += r.taken / r.target / 5
            sums[r.doc_id] += r.taken / r.size / 5
            rate[r.source] = r.target / r.source_size
    assert all(abs(sums[s] - 1) < 0.02 for s in "ab")
    assert abs(np.mean([sums[i] for i in range(30)]) - rate["a"]) < 0.15
    assert len({sums[i] for i in range(30)}) > 2  # draws differ by seed


def test_ranked_and_without(spark):
    keys = spark.range(100).selectExpr("concat('k', id % 37) as k", "id")
    got = mixing.ranked(keys, F.col("k"), F.col("id")).collect()
    assert [r._rank for r in sorted(got, key=lambda r: (r.k, r.id))] == list(range(100))
    rows = spark.range(1000).selectExpr("cast(id % 500 as string) as key", "id")
    gone = common.materialize(spark.range(0, 500, 3).selectExpr("cast(id as string) as key"))
    for bits in (26, 6):  # a full bitmap sends all rows through the join
        assert sorted(r.id for r in common.without(rows, gone, "key", bits).collect()) == [i for i in range(1000) if i % 500 % 3]
    assert common.without(rows, gone.limit(0), "key").count() == 1000


def test_discard_takes_scratch_tables_only(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/pulsegrid-mine")
    mine, made = spark.read.parquet(f"{tmp_path}/pulsegrid-mine"), common.materialize(spark.range(3))
    files = made.inputFiles()
    common.discard(mine, made)
    assert mine.count() == 3 and files
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(files[0]).count()


def brute_collocations(docs, least, first):
    f, n, pieces = {}, Counter(), lambda t: re.split(r"[.,;:!?\x0A-\x0D]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in pieces(text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for p in range(len(ws) - k + 1):
                    f[lang, tuple(ws[p : p + k])] = f.get((lang, tuple(ws[p : p + k])), 0) + 1
    out = {}
    cands = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    for (lang, ph), a in cands.items():
        if any(o == lang and len(q) > len(ph) and 100 * c >= 100 * a and any(q[p : p + len(ph)] == ph for p in range(len(q))) for (o, q), c in cands.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, ph[:k]] * f[lang, ph[k:]]), k) for k in range(1, len(ph))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ph).encode(), f[lang, ph[:k]], f[lang, ph[k:]]))
    return sorted((lang, rank, ph.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for rank, (s, a, ph, l, r) in enumerate(sorted(rows)[:first], 1))


@pytest.mark.parametrize("head", [300_000, 3])
def test_collocations_by_brute_force(spark, hard, head):
    rng = np.random.default_rng(3)
    texts = [(" ".join(rng.choice(["a", "b", "Été", "c.", "d", "e;f", "\tg"], 80)), ("en", None, "und", "")[int(rng.integers(4))]) for _ in range(60)]
    docs = spark.createDataFrame([(t, g, "x", 1) for t, g in texts], "text string, lang string, key string, n int")
    for least, first in ((8, 2000), (4, 5)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, first=first, head=head, bits=10).collect())
        assert got == brute_collocations(texts, least, first) and len(got) > 3
    rows = [(t, g) for _, t, g, _ in HARD]
    assert sorted(tuple(r) for r in collocations.collocations(hard, least=2, head=head).collect()) == brute_collocations(rows, 2, 2000)
    assert collocations.collocations(hard.limit(0)).count() == 0


def test_collocation_arithmetic_passes_64_bits(spark):
    words = spark.createDataFrame([(1, b"\0\0\0\1" + bytes(16), "en", 10**15, 10**16), (2, b"\0\0\0\2" + bytes(16), "en", 3 * 10**14, 10**16)], "id long, key binary, lang string, n long, total long")
    pair = spark.createDataFrame([(b"\0\0\0\1\0\0\0\2" + bytes(12), 2, 10**14)], "key binary, k int, n long")
    got = collocations._scored(pair, words, 5, 4, 10, pair).first()
    assert got.score == 1000 * 10**14 * 10**16 // (10**15 * 3 * 10**14) and (got.l, got.r) == (10**15, 3 * 10**14)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2)), max_size=60), st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_radix_order_and_run_lengths(rows, cut):
    cols = [np.array([r[k] for r in rows], np.uint32) for k in range(3)]
    assert [rows[i] for i in collocations.radix_order(cols)] == sorted(rows)
    # runs of prefixes over ranges and batches: sums of what reaches the bound are whole
    import pyarrow as pa

    keys = sorted(tuple(v + 1 if k < 2 else v for k, v in enumerate(r)) for r in rows)
    sums, ranges = Counter(), [keys[k::1][: len(keys) // 2 + 1] if not k else keys[len(keys) // 2 + 1 :] for k in (0, 1)]
    for part in ranges:
        batches = [pa.record_batch([collocations._keys([np.array(c, np.uint32) for c in zip(*part[k : k + cut], strict=True)]), pa.array([1] * len(part[k : k + cut]))], names=["key", "n"]) for k in range(0, len(part), cut)]
        for b in collocations._run_lengths(3, "uint32", 3)(iter(batches)):
            for key, n in zip(map(tuple, collocations._columns(b.column("key"), 3, "uint32").tolist()), b.column("n").to_pylist(), strict=True):
                sums[key] += n
    want = Counter((*k[:2], 0) for k in keys) + Counter(k for k in keys if k[2])
    assert {k: n for k, n in sums.items() if n >= 3} == {k: n for k, n in want.items() if n >= 3}


def brute_divergence(docs, least):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(t))) for t, lang, source in docs]
    out = []
    for lang in {g for g, _, _ in terms}:
        held = Counter(t for g, _, ws in terms if g == lang for t in set(ws))
        kept = sorted(t for t, n in held.items() if n >= least)
        count = {s: Counter() for g, s, _ in terms if g == lang}
        for g, s, ws in terms:
            if g == lang:
                count[s].update(w for w in ws if w in set(kept))
        count_all = sum(count.values(), Counter())
        level = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = [(o, sum(f(level(c, t), level(d, t)) for t in kept)) for o, d in count.items() if o != s]
            best = [(t, f(level(c, t), level(count_all, t))) for t in kept if c[t] and level(c, t) > level(count_all, t)]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", best, 10)):
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0].encode()))[:most], 1)]
    return sorted(out)


def test_divergence_by_brute_force(spark, hard):
    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice(["Ab", "b1c", "Été", "straße", "d", "e-f", "x"], 12)), ("en", None, "de")[int(rng.integers(3))], ("s", "t", None, "é")[int(rng.integers(4))]) for _ in range(90)]
    rows += [(None, "en", "empty"), ("", "xx", "s"), (None, "xx", "t"), ("123", "alone", "s")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, source string, term string, n int, docs int")
    for least in (10, 1, 10**6):
        assert sorted(tuple(r) for r in divergence.divergence(docs, least=least).collect()) == brute_divergence(rows, least)
    assert sorted(tuple(r) for r in divergence.divergence(hard, least=1).collect()) == brute_divergence([(t, g, s) for _, t, g, s in HARD], 1)
    assert divergence.divergence(hard.limit(0)).count() == 0


def test_shard_sums_hold_through_compaction():
    import pyarrow as pa

    batches = [pa.record_batch([["en"] * 4, ["s", "t", "s", "t"], ["a", "a", "b", "b"], [1, 2, 3, 4], [5, 6, 1, 1]], names=["lang", "source", "term", "n", "docs"])] * 7
    got = [r for b in divergence._kept(20, most=5)(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["term"], r["source"], r["n"], r["lang_n"], r["one"]) for r in got) == [("a", "s", 7, 21, 1), ("a", "t", 14, 21, 0)]
