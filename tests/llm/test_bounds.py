import gzip
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, line_dedup, near_dedup, registry, warc

FOLDER = "/root/testdata/sf0.001"


def test_archive_files_are_bounded_by_bytes(spark, tmp_path):
    bound = 16 << 20
    pages = spark.range(14).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.expr("if(id < 5, repeat(concat('é', id, 'x'), 1000000), repeat('s', int(id) * 100))").alias("html"))
    warc.write_archive(pages, f"{tmp_path}/a", file_bytes=bound)
    sizes = [p.stat().st_size for p in Path(f"{tmp_path}/a").rglob("part-*")]
    assert max(sizes) <= bound and sum(sizes) > 20_000_000 and len(sizes) > 2
    got = warc.assemble(warc.read_records(spark, f"{tmp_path}/a")).select("metadata.page_id", "response.payload_bytes", "response.payload_digest").collect()
    want = pages.select(F.col("page_id").cast("string"), F.octet_length("html").cast("long"), F.sha2("html", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    warc.write_archive(pages.limit(0), f"{tmp_path}/none")
    assert warc.assemble(warc.read_records(spark, f"{tmp_path}/none")).count() == 0


def test_foreign_archives_are_read(spark, tmp_path):
    def record(kind, name, block, *more):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name + b">", *more, b"Content-Length: " + str(len(block)).encode()]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"WARC/1.0\r\n\r\n" * 3 + np.random.default_rng(1).bytes(3 << 20)
    rs = [
        record(b"warcinfo", b"i", b"software: x\r\n"), record(b"request", b"q", b"GET / HTTP/1.1\r\n\r\n", b"WARC-Concurrent-To: <r>"),
        record(b"response", b"r", b"HTTP/1.1 200 OK\r\n\r\n" + body, b"WARC-Target-URI: http://a/"), record(b"revisit", b"v", b"HTTP/1.1 200 OK\r\n\r\n", b"WARC-Payload-Digest: sha1:AAA"),
    ]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, rs)))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(rs)) + b"\0" * 9)
    (tmp_path / "plain.warc").write_bytes(b"".join(rs))
    (tmp_path / "cut.warc").write_bytes(b"".join(rs)[:-60])
    (tmp_path / "other.txt").write_bytes(rs[0])
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted(r.record_type for r in got) == sorted(["warcinfo", "request", "response", "revisit"] * 3 + ["warcinfo", "request", "response"])
    assert {r.payload_bytes for r in got if r.record_type == "response"} == {len(body)}
    assert [(r.payload_digest, r.payload_bytes) for r in got if r.record_type == "revisit"] == [("sha1:AAA", None)] * 3
    # chunks of any size give the same records
    data = b"".join(rs)
    for n in (1, 7, 5000):
        assert [h["warc-record-id"] for h, _ in warc.parse(data[k : k + n] for k in range(0, 2000, n))] == ["<i>", "<q>"]


def test_short_lines_go_too(spark):
    footers = ("Read more", "Share", "Cookie policy", "12", "Page 3")
    docs = spark.createDataFrame([(d, f"own text {chr(97 + d % 26) * (d + 1)}\n" + "\n".join(footers)) for d in range(30)], "doc_id long, text string")
    assert {r.dropped_at for r in line_dedup.line_report(docs).collect()} == {"1,2,3"}


def test_items_without_names_and_items_that_repeat(spark):
    items = spark.createDataFrame([(None, "a b c d e f g h i j"), ("None", "k l m n o p q r s t"), (None, "u v")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v")], "doc_id long, text string")
    for shard_words in (1_000_000, 10):
        r = decontaminate.contamination(docs, items, shard_words=shard_words).first()
        assert (r.n_items, r.n_hit) == (2, 22)
        assert decontaminate.contamination(docs, items.filter("item_id is not null"), shard_words=shard_words).first().items_sha256 == r.items_sha256
    times = []
    for n in (20_000, 80_000):
        began = time.time()
        found = decontaminate.Automaton([("x", [b"a"] * n), ("y", [b"a", b"a"])], 10)
        assert found.hits([b"a"] * n) == ([(0, n)], {"x", "y"})
        times.append(time.time() - began)
    assert times[1] < 10 * times[0]


def test_mixed_buckets_in_rounds(spark, monkeypatch):
    # chains of texts, each close to the next only, and texts that share buckets without a link
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for chain in range(3):
        ws = [f"c{chain}w{k}" for k in range(120)]
        for _ in range(25):
            rows.append((n, " ".join(ws)))
            n += 1
            for j in rng.choice(120, 2, replace=False):
                ws[j] = f"n{n}x{j}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[p : p + 3]) for p in range(118)} for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in range(30):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    for work in (1 << 24, 40):
        monkeypatch.setattr(near_dedup, "_WORK", work)
        assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, width=3, least_percent=85).collect()} == label


def test_recall_of_near_links(spark):
    """Links of every document whose id is divisible by 50 with all others, on full sets: all in one component."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in docs:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "").split()
        sets[r.doc_id] = {tuple(ws[p : p + 3]) for p in range(max(1, len(ws) - 2))} if ws else set()
    got = {r.doc_id: r.component_id for r in registry.queries()["op6_near_dedup"](spark, folder).collect()}
    links = [(a, b) for a in sets if a % 50 == 0 and sets[a] for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert links and all(got[a] == got[b] for a, b in links)
