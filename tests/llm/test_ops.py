import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, exact_dedup, line_dedup, lm_score, near_dedup, packing, pii, quality, registry, url_filter, warc

FOLDER = "/root/testdata/sf0.001"
HARD = [(1, "A b c d e f"), (2, "a B c d e f"), (3, None), (4, ""), (5, "x " * 30_000), (None, "a b c d e f"), (3, None), (6, "a b c d e f")]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated rows, a clashing extra column."""
    return spark.createDataFrame([(i, t, "k", 7) for i, t in HARD], "doc_id long, text string, key string, n int")


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_matches_sql(spark, compare, name):
    compare(registry.queries()[name](spark, FOLDER), registry.oracle_sql()[name], FOLDER)


def test_exact_dedup_hard_rows_and_collisions(spark, hard):
    for digest in (None, lambda c: F.lit("same")):
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(hard, digest=digest).collect()}
        assert got == {(1, 6, 4, False), (2, 6, 4, False), (6, 6, 4, True), (None, 6, 4, False), (3, 4, 3, False), (4, 4, 3, True), (5, 5, 1, True)}
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(hard).collect()) == [4, 5, 6]
    assert exact_dedup.exact_groups(hard.limit(0)).count() == 0


def test_clashing_columns_and_repeats(spark):
    names = ("_id", "_dig", "_row", "_text", "row", "id", "same", "_sha0", "_key")
    rows = [(i, t, *("z" for _ in names)) for i, t in HARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    more = docs.unionByName(docs.filter("doc_id in (5, 6)"))
    for out, ids in (
        (exact_dedup.drop_exact_duplicates(more), [4, 5, 6]), (near_dedup.drop_near_duplicates(docs.filter("doc_id is not null")), [1, 3, 3, 4, 5]),
        (pii.sanitise(docs), None), (decontaminate.decontaminate(docs, spark.createDataFrame([("a", None)], "item_id string, text string")), None),
    ):
        assert out.columns == docs.columns
        got = out.collect()
        assert all(r[n] == "z" for r in got for n in names)
        assert len(got) == len(HARD) if ids is None else sorted(r.doc_id for r in got) == ids
    empty = docs.limit(0)
    assert exact_dedup.drop_exact_duplicates(empty).count() == near_dedup.drop_near_duplicates(empty).count() == pii.sanitise(empty).count() == 0


def test_near_dedup_finds_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(60):
        ws = [f"w{k}x{j}" for j in range(int(rng.integers(60, 400)))]
        other = list(ws)
        for j in rng.choice(len(ws), max(1, len(ws) // 60), replace=False):
            other[j] = f"v{k}x{j}"
        a, b = ({tuple(x[p : p + 3]) for p in range(len(x) - 2)} for x in (ws, other))
        rows += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(other))]
        want[2 * k + 1] = 2 * k if 100 * len(a & b) >= 85 * len(a | b) else 2 * k + 1
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=3, least_percent=85).collect()}
    assert {i: got[i] for i in want} == want and sum(v < i for i, v in want.items()) > 20


def test_long_items_in_parts(spark):
    long = " ".join(f"i{k}" for k in range(95))
    items = spark.createDataFrame([("a", long), ("b", "x y z")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "o " + " ".join(f"i{k}" for k in range(p, p + 11)) + " o") for p in range(80)] + [(99, "x y z i0 i1")], "doc_id long, text string")
    one, many = (sorted(map(str, decontaminate.contamination(docs, items, shard_words=n).collect())) for n in (1_000_000, 30))
    assert one == many


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as c

    kept = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = kept.columns
    for name, stage in c.STAGES:
        before = kept.collect()
        kept = stage(spark, kept, FOLDER)
        after = kept.collect()
        if name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            continue
        assert kept.columns == columns and 0 < len(after) <= len(before)
        if name == "exact_dedup":
            best = {}
            for r in before:
                best[_lower(r.text)] = max(best.get(_lower(r.text), -1), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(best.values())
        if name == "near_dedup":
            sets = {}
            for r in before:
                ws = _lower(r.text).split()
                sets[r.doc_id] = {tuple(ws[p : p + 5]) for p in range(max(1, len(ws) - 4))} if ws else set()
            label = {i: i for i in sets}
            pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            for _ in sets:
                for a, b in pairs:
                    label[a] = label[b] = min(label[a], label[b])
            assert sorted(r.doc_id for r in after) == sorted(i for i in sets if label[i] == i)
        if name == "decontamination":
            assert not decontaminate.contamination(kept, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).filter("contaminated").count()
        kept = spark.createDataFrame(after, kept.schema)


def test_isotonic_and_ridge_against_plain_versions():
    rng = np.random.default_rng(6)
    y, n = rng.random(9), rng.integers(1, 5, 9).astype(float)
    want = [max(min(np.average(y[a : b + 1], weights=n[a : b + 1]) for b in range(k, 9)) for a in range(k + 1)) for k in range(9)]
    assert np.allclose(quality.isotonic(y, n), want)
    x, t = np.hstack([rng.random((50, 4)), np.ones((50, 1))]), rng.random(50)
    w = quality.ridge(x.T @ x, x.T @ t, 50, 0.1)
    grad = 2 * x.T @ (x @ w - t) + 2 * np.array([*[0.1 * 50**0.5] * 4, 1e-9]) * w
    assert np.allclose(grad, 0, atol=1e-9)


def test_near_dedup_hard_rows(hard):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(hard, width=3, least_percent=85).collect()}
    assert got == {(1, 4, 1), (2, 4, 1), (6, 4, 1), (None, 4, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5)}
    assert near_dedup.near_groups(hard.limit(0)).count() == 0


def test_packing_is_exact_and_tight(spark, hard):
    from tokenizers import Tokenizer

    rows = packing.pack(hard).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = dict(HARD)
    for r in rows:
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) == r.ids_crc32
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= packing.CAPACITY
    assert len(rows) == 7 + -(-(len(tokenizer.encode(texts[5], add_special_tokens=False).ids) + 1) // packing.CAPACITY)
    assert packing.pack(hard.limit(0)).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_rank_once(counts):
    plan, used, total = packing.Plan(counts, 60), {}, sum(k * n for k, n in counts.items())
    steps = {}
    for length, lo, m, first, offset in plan.steps:
        steps.setdefault(length, []).append((lo, m, first, offset))
    for length, n in counts.items():
        mine = sorted(steps[length])
        for rank in range(n):
            lo, m, first, offset = max(s for s in mine if s[0] <= rank)
            over = rank - lo
            used.setdefault(first + over % m, []).append((offset + over // m * length, length))
    assert len(used) == plan.bins >= -(-total // 60)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 60


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@given(st.lists(words, max_size=5), words)
@settings(max_examples=300, deadline=None)
def test_automaton_matches_brute_force(items, doc):
    found = decontaminate.Automaton([(str(k), w) for k, w in enumerate(items)], 4)
    hit, names = set(), set()
    for k, w in enumerate(items):
        n = min(4, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            for at in range(len(doc) - n + 1):
                if doc[at : at + n] == w[p : p + n]:
                    hit |= set(range(at, at + n))
                    names.add(str(k))
    spans, got = found.hits(doc)
    assert {i for a, b in spans for i in range(a, b)} == hit and got == names


def test_contamination_in_shards(spark, hard):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    one, many = (sorted(map(str, decontaminate.contamination(docs, items, shard_words=n).collect())) for n in (1_000_000, 300))
    assert one == many
    assert decontaminate.contamination(hard, items).filter("contaminated").count() == 0
    clean = decontaminate.decontaminate(docs, items)
    assert decontaminate.contamination(clean, items).filter("contaminated").count() == 0
    assert clean.columns == docs.columns


def test_quality_held_out(spark, hard):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    held = scored.filter("held_out").join(labels, "doc_id").filter("predicted = quality").count() / scored.filter("held_out").join(labels, "doc_id").count()
    assert held > 0.9
    assert quality.score_quality(hard, labels.limit(0)).count() == len(HARD)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x", "WARC/1.1\r\n\r\n" * 20), (2, None, None), (3, "u\r\nv", "é" * 60), (4, "w", "é" * 60), (None, "n", ""), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    got = warc.assemble(warc.read_records(spark, f"{tmp_path}/a", with_payload=True)).collect()
    assert len(got) == len(rows)
    by = {r.metadata.page_id: r for r in got}
    assert by["1"].response.payload == rows[0][2] and by["4"].response.record_type == "revisit" and by["4"].metadata.refers_to == "3"
    assert by["3"].response.payload_digest == by["4"].response.payload_digest == hashlib.sha256(("é" * 60).encode()).hexdigest()
    assert by["2"].response.payload_bytes == 0 and by["2"].request is not None


def test_pii_spans(spark, hard):
    text = "mail a.b@c.de, ip 1.2.3.4 card 4111 1111 1111 1111 tel +49 (30) 1234567."
    assert [k for k, _, _ in pii.base_spans(text)] == ["email", "ip", "card", "phone"]
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "@" not in clean[1] and "4111" not in clean[1] and clean[2] is None
    assert pii.find_pii(hard).count() == len(HARD)


def test_url_hard_rows(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://NET/"), (4, "x://a.net"), (5, "http://example.net/en/x?q"), (6, "http://xnet/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()}
    assert got == {1: (None, "allow"), 2: (None, "allow"), 3: ("net/", "block"), 4: (None, "allow"), 5: ("example.net/en/", "allow"), 6: (None, "allow")}


def test_line_dedup_drops_templates(spark, hard):
    footer, other = "Page {} of the report by {} at all times", "Here no line is like any other {}"
    texts = [f"{other.format(chr(97 + k) * 9)} {'w ' * k}\n{footer.format(k, n)}\nof it\n" for k, n in enumerate(("ann", "bob", "cy", "dee"))]
    docs = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate([*texts, texts[0], None])], "doc_id long, text string, dig string, n int")
    got = {r.doc_id: (r.n_lines, r.dropped_at) for r in line_dedup.line_report(docs).collect()}
    assert got == {**dict.fromkeys(range(5), (4, "1,2")), 5: (1, "")}
    clean = line_dedup.drop_lines(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {5: None, **{k: t.split("\n")[0] + "\n" for k, t in enumerate([*texts, texts[0]])}}
    assert {r.n_dropped for r in line_dedup.line_report(hard).collect()} == {0} and line_dedup.line_report(hard).count() == len(HARD)
    assert line_dedup.line_report(hard.limit(0)).count() == 0 and line_dedup.drop_lines(hard.limit(0)).count() == 0
    # two distinct texts with a line are not enough, nor is one text that repeats it
    few = spark.createDataFrame([(1, "a b c d\n" * 5), (2, "a b c d"), (3, "e")], "doc_id long, text string")
    assert line_dedup.line_report(few).filter("n_dropped > 0").count() == 0


def test_line_dedup_drops_long_passages_of_two_texts(spark):
    passage = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    docs = spark.createDataFrame([(1, f"one\n{passage}\nother"), (2, passage), (3, passage[:100]), (4, passage[:100] + "\nx")], "doc_id long, text string")
    assert {r.doc_id: r.dropped_at for r in line_dedup.line_report(docs).collect()} == {1: "1", 2: "0", 3: "", 4: ""}


def test_line_dedup_finds_templates_without_a_recurring_segment(spark):
    # 23 of 28 words are constant, but each fifth of the words behind the leading three has one that changes
    line = "all of the " + " ".join(f"{w} {w}b {w}c {w}d {{{k}}}" for k, w in enumerate(("ka", "le", "mi", "no", "pu")))
    word = lambda d, k: "".join(chr(97 + int(c)) for c in f"{7 * d + k:03}")
    docs = spark.createDataFrame([(d, f"own {word(d, 9)}\n" + line.format(*(word(d, k) for k in range(5)))) for d in range(4)], "doc_id long, text string")
    assert {r.doc_id: r.dropped_at for r in line_dedup.line_report(docs).collect()} == dict.fromkeys(range(4), "1")


def test_language_model_trains_on_every_window_once(spark, monkeypatch):
    docs = spark.range(130).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('ab ', id, ' cd '), 600)").alias("text"))
    sums, real = [], lm_score._round

    def counted(texts, *how):
        out = real(texts, *how)
        sums.append((texts.count(), sum(len(lm_score.windows(r.ids)) for r in texts.collect()), out.agg(F.sum("n")).first()[0], how[2]))
        return out

    monkeypatch.setattr(lm_score, "_round", counted)
    train = lm_score.score_texts(docs, shard_bytes=100_000, least_windows=1).filter("not held_out").count()
    assert sum(n for n, *_ in sums) == train and all(want == got for _, want, got, _ in sums)
    assert len(sums) == 4 and sums[0][3] > 3


def test_language_model_passes_follow_from_the_number_of_windows(spark, monkeypatch):
    docs = spark.range(130).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('ab ', id, ' cd '), 600)").alias("text"))
    sums, real = [], lm_score._round

    def counted(texts, *how):
        out = real(texts, *how)
        sums.append((sum(len(lm_score.windows(r.ids)) for r in texts.collect()), out.agg(F.sum("n")).first()[0], how[-1]))
        return out

    monkeypatch.setattr(lm_score, "_round", counted)
    for passes, times in ((2, 1), (6, 2)):
        sums.clear()
        train = docs.count() - sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(130))
        total = sum(len(lm_score.windows(r.ids)) for r in real_texts(spark, docs))
        lm_score.score_texts(docs, shard_bytes=10**9, least_windows=passes * total).count()
        assert train and len(sums) == 4 and all(n * times == got and how == times for n, got, how in sums)
        assert sum(n for n, _, _ in sums) == min(passes, 4) * total


def real_texts(spark, docs):
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).withColumn("_held", quality.crc_mod("_id", 10) == 0)
    return lm_score._gather(rows, packing.tokenizer_path(), 400_000).filter("tag = 'text' and not held").collect()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_language_model_beats_its_base_on_held_out_documents(spark, sf):
    got = lm_score.score_texts(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).filter("held_out")
    score, base, n = got.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert score / n > base / n + 0.03


def test_language_model_base_by_brute_force(spark):
    clash = spark.createDataFrame([(i, t, "x", 1, None, "y") for i, t in HARD], "doc_id long, text string, _text string, n int, row long, ids string")
    for docs, head in ((clash, 300_000), (clash, 2), (spark.read.parquet(f"{FOLDER}/documents.parquet"), 50)):
        rows, by = docs.select("doc_id", "text").collect(), {}
        out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
        toks = [[*re.findall(r"[^\x20\x09-\x0D]+", _lower(r.text)), 0] for r in rows]
        for r, ts in zip(rows, toks, strict=True):
            for t in ts if not out(r.doc_id) else ():
                by[t] = by.get(t, 0) + 1
        total = sum(by.values())
        want = sorted((r.doc_id or -1, out(r.doc_id), len(ts), sum(t in by for t in ts), total, round(sum(np.log10((by.get(t, 0) + 0.1) / (total + 0.1 * (len(by) + 1))) for t in ts), 4)) for r, ts in zip(rows, toks, strict=True))
        got = lm_score.score_texts(docs, head=head).collect()
        assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    same = {r.n_tokens: r.score for r in got}
    assert len(same) > 1 and lm_score.score_texts(docs.limit(0)).count() == 0
    # with no training documents every subword is as likely as any other
    none = lm_score.score_texts(docs.limit(5), hold_out=1).collect()
    assert all(r.held_out and r.n_known == r.train_tokens == 0 for r in none)


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_decontaminate_in_shards(spark):
    w = [f"w{k}" for k in range(40)]
    part = lambda a, b: " ".join(w[a:b])
    # items of different shards overlap; a cut joins up an item of an earlier shard; coverage is judged on all hits
    items = spark.createDataFrame([("a", part(0, 10)), ("b", part(5, 15)), ("c", part(20, 30))], "item_id string, text string")
    free = " ".join(f"x{k}" for k in range(40))
    rows = [(1, f"{free} {part(0, 15)} end"), (2, f"{free} {part(0, 5)} {part(20, 30)} {part(5, 10)} end"), (3, f"u v w x y z {part(0, 10)} and {part(20, 30)} {free[:79]}"), (4, free), (5, None), (6, "")]
    rows += [(7, " ".join(f"x{k}" for k in range(10)) + f" {part(0, 15)}"), rows[0], (None, rows[1][1])]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    one, many = (sorted(map(str, decontaminate.decontaminate(docs, items, shard_words=n).collect())) for n in (1_000_000, 10))
    assert one == many
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, shard_words=10).collect()}
    assert got[1].split() == got[2].split() == [*free.split(), "end"] and 7 not in got and got[5] is None and got[6] == ""


def test_pii_terms_are_marked_wherever_they_stand(spark):
    far = " ".join(f"f{k}" for k in range(9))
    rows = [(d, f"v{d} u{d} Straßer, at a.b@c.de t{d} s{d} {far} {{straßer}} {far} x{d}") for d in range(4)] + [(9, "strasser alone"), (10, " ".join(f"z{k}" for k in range(9000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.terms for r in pii.find_pii(docs, min_pmi=2.0, min_share=0.4).collect()}
    for d, text in rows[:4]:
        assert {text[t.s : t.e] for t in found[d]} >= {"Straßer", "straßer"}
    assert not found[9] and not found[10]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, min_pmi=2.0, min_share=0.4).collect()}
    assert all("stra" not in clean[d].lower() for d in range(4)) and clean[9] == "strasser alone"
    assert pii.marked("ab cd x@y.z ab", [(3, 8)], {"ab": True, "cd": True, "x@y.z": False}) == [{"s": 0, "e": 2, "remove": True}, {"s": 12, "e": 14, "remove": True}]
