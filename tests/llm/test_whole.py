import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import packing, pii, quality, registry, url_filter, warc

FOLDER = "/root/testdata/sf0.001"
HARD = [(1, "A b c"), (1, "A b c"), (2, None), (3, ""), (4, "x " * 30_000), (None, "a b c"), (2, None)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, "k", 7.0) for i, t in HARD], "doc_id long, text string, _id string, score double")


CONTRACT = {
    "op2_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op4_quality": {"doc_id", "held_out", "score", "predicted"},
    "op5_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op10_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op11_mixing": {"doc_id", "size", "source_size", "target", "taken"},
}


@pytest.mark.parametrize("name", CONTRACT)
def test_registered_queries_without_sql(spark, name):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = registry.queries()[name](spark, FOLDER).collect()
    assert CONTRACT[name] <= set(rows[0].asDict())
    assert {r.doc_id for r in rows} == set(docs) and (name == "op2_packing" or len(rows) == len(docs))
    if name == "op10_pii":
        for r in rows:
            spans = sorted(pii.base_spans(docs[r.doc_id]), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
            text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in text.split(",") if s]
            assert [getattr(r, f"n_{k}") for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
    if name == "op4_quality":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    if name == "op5_lm_scoring":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.score < 0 and r.base_score < 0 for r in rows)
    if name == "op2_packing":
        whole = Counter()
        for r in rows:
            whole[r.sequence_id] += r.length
        assert max(whole.values()) <= 2048 and len(whole) >= -(-sum(whole.values()) // 2048)


def brute_terms(rows, radius, min_pmi, min_share, support):
    """Terms by document, from plain counts over all documents."""
    n_t, windows, n_te, n_e, seen = Counter(), {}, Counter(), Counter(), set()
    for i, text in rows:
        for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            n_t[pii.fold(w)] += 1
        for term, s, e, entity, window in pii.contexts(text or "", pii.base_spans(text or ""), radius):
            if (i, text, s, e, entity) not in seen:
                seen.add((i, text, s, e, entity))
                windows.setdefault((term, entity), set()).add(window)
                n_te[term, entity] += 1
                n_e[entity] += 1
    total = sum(n_t.values())
    strong = {}
    for (term, entity), ws in windows.items():
        share = n_te[term, entity] / max(n_t[term], n_te[term, entity])
        if len(ws) >= support and share >= min_share and math.log2(n_te[term, entity] * total / (max(n_t[term], n_te[term, entity]) * n_e[entity])) >= min_pmi:
            strong.setdefault(entity, set()).add(term)
    out = {}
    for i, text in rows:
        base = pii.base_spans(text or "")
        terms = set().union(*(strong.get(f"{k}:{text[a:b].casefold()}", set()) for k, a, b in base)) if base else set()
        out[i] = sorted(
            (m.start() + m[0].find(core), m.start() + m[0].find(core) + len(core)) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "") if pii.fold(m[0]) in terms and (core := m[0].strip(pii._EDGE))
            and not any(a < m.start() + m[0].find(core) + len(core) and m.start() + m[0].find(core) < b for _, a, b in base)
        )
    return out


def test_pii_terms_by_brute_force(spark):
    rng = np.random.default_rng(1)
    names = ["Ann", "Bob,", "(Cyd)", "Dee"]
    rows = []
    for i in range(60):
        k = int(rng.integers(4))
        words = list(rng.choice([f"w{j}" for j in range(60)], 25))
        words[5], words[7] = names[k], f"{names[k][:3].strip('(').lower()}@ex{k}.org"
        if i % 3:
            words[20] = names[int(rng.integers(4))]
        rows.append((i, " ".join(words)))
    rows += [(90, None), (91, ""), (92, "no data here")]
    got = {r.doc_id: sorted((t.s, t.e) for t in r.terms or []) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), min_pmi=1.5, min_share=0.2).collect()}
    want = brute_terms(rows, 5, 1.5, 0.2, 3)
    assert got == want and sum(map(len, want.values())) > 20


def plain_kept(spark, docs, labels):
    """The quality stage with all sums in one place and calibration by its min-max formula."""
    known = {}
    for r in labels.collect():
        if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            known.setdefault(r.doc_id, []).append(float(r.quality))
    rows = [(r.doc_id, quality.statistics(r.text)) for r in docs.collect()]
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(quality.FOLDS)).cast("int").alias("f")).collect()}
    sample = [(i, s) for i, s in rows if i in known]
    x = np.array([s for _, s in sample])
    y, f = np.array([np.mean(known[i]) for i, _ in sample]), np.array([fold[i] for i, _ in sample])
    std = x.std(0)
    model = quality.Model(x.mean(0), np.where(std > 1e-9, std, 1.0))
    z = model.lift(x)
    fit = lambda on: quality.ridge(z[on].T @ z[on], z[on].T @ y[on], on.sum(), 0.02)
    model.coef = fit(np.ones(len(y), bool))
    raw = np.array([z[k] @ fit(f != f[k]) for k in range(len(y))])
    at = np.clip(np.round((raw + 0.5) / 2 * quality.GRID), 0, quality.GRID)
    places = np.unique(at)
    mean, n = np.array([y[at == a].mean() for a in places]), np.array([(at == a).sum() for a in places], float)
    pooled = [max(min(np.average(mean[a : b + 1], weights=n[a : b + 1]) for b in range(k, len(mean))) for a in range(k + 1)) for k in range(len(mean))]
    model.x, model.y = places / quality.GRID * 2 - 0.5, np.array(pooled)
    return {i: float(model.score(s[None])[0]) for i, s in rows}


def test_quality_stage_against_a_plain_version(spark):
    import corpus_pipeline

    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = plain_kept(spark, docs, labels)
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, FOLDER).collect()}
    assert all((s >= 0.3) == (i in got) for i, s in scores.items() if abs(s - 0.3) > 1e-6) and 0 < len(got) < len(scores)


def test_quality_hard_rows(spark, hard):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality.score_quality(hard, labels)
    assert scored.count() == len(HARD) and scored.filter("doc_id = 1").select("score").distinct().count() == 1
    assert quality.score_quality(hard.limit(0), labels).count() == 0
    kept = quality.keep_good(hard, labels.limit(0))  # nothing learned: all score 0.5 and stay
    assert kept.columns == hard.columns and kept.count() == len(HARD)
    assert quality.keep_good(hard.limit(0), labels).count() == 0


def test_pipeline_run(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
    want = docs.collect()
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in want}
    from tokenizers import Tokenizer

    tokenizer, texts, used = Tokenizer.from_file(packing.tokenizer_path()), {r.doc_id: r.text or "" for r in want}, {}
    for r in got:  # packing: every piece of every text, none overlapping, from 0 without gaps
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0][r.start : r.start + r.length]
        assert len(ids) == r.length and r.start == 2048 * r.piece and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) == r.ids_crc32
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert sum(r.length for r in got) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    lengths = Counter(r.length for r in got)
    assert len(used) <= first_fit(lengths, 2048)


def first_fit(counts, capacity):
    """Sequences that a plain first-fit over falling lengths takes."""
    left = []
    for length in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        at = next((k for k, g in enumerate(left) if g >= length), None)
        if at is None:
            left.append(capacity)
            at = len(left) - 1
        left[at] -= length
    return len(left)


def fewest(items, capacity):
    """The least number of sequences, by trying all ways."""
    best = [len(items)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[k] <= capacity and bins[j] not in bins[:j]:
                put(k + 1, [*bins[:j], bins[j] + items[k], *bins[j + 1 :]])
        put(k + 1, [*bins, items[k]])

    put(0, [])
    return best[0]


@given(st.lists(st.integers(1, 30), max_size=11))
@settings(max_examples=200, deadline=None)
def test_plan_against_the_fewest_sequences(items):
    items.sort(reverse=True)
    least = fewest(items, 30)
    assert least <= packing.Plan(dict(Counter(items)), 30).bins <= max(least, math.ceil(1.25 * least))


def test_urls_of_empty_tables_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 1), (1, "http://a.net/x", 1), (2, None, 2)], "page_id long, url string, host int")
    rules = url_filter.rule_table(spark)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert sorted((r.page_id, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()) == [(1, "block"), (1, "block"), (2, "allow")]
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_archive_of_repeated_rows_with_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(7, "u", "h" * 200, "z", 1)] * 3 + [(8, None, None, "z", 1)], "page_id long, url string, html string, _digest string, _id int")
    warc.write_archive(pages, f"{tmp_path}/a")
    got = warc.assemble(warc.read_records(spark, f"{tmp_path}/a")).collect()
    assert sorted(r.metadata.page_id for r in got) == ["7", "7", "7", "8"] and {r.response.record_type for r in got} == {"response"}
