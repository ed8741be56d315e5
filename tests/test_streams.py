import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import clusters, dedisperse, spectra
from pulsegrid.streaming import search

NF, F0, DF, ND = 16, 0.976, 0.001, 16


def samples(spark, n=300, beams=2):
    x = spark.range(n * NF * beams).selectExpr(f"int(id % {beams}) as beam", f"int(id div {beams} % {NF}) as chan", f"id div {beams * NF} as t")
    return x.withColumn("v", F.pmod(F.xxhash64("beam", "chan", "t"), F.lit(41)) - 20)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_memory_gives_the_same_as_one_block():
    rng = np.random.default_rng(1)
    levels, depth = dedisperse.tree(NF, F0, DF, ND), dedisperse.depths(NF, F0, DF, ND)
    x = rng.integers(-50, 50, (NF, 97))
    whole = dedisperse.SampleTree(levels, depth).push(x)
    parts, at = dedisperse.SampleTree(levels, depth), 0
    for n in (1, 1, 5, 40, 50):
        assert np.array_equal(parts.push(x[:, at : at + n]), whole[:, at : at + n])
        at += n
    for d in range(ND):  # the curve itself
        for t in (20, 60):
            assert whole[d, t] == sum(x[c, t - s - k] for c, e, s in dedisperse.trace(levels, d) for k in range(e + 1))


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    x, folder = samples(spark), str(tmp_path)
    whole = dedisperse.dedisperse_tree(x, NF, F0, DF, ND, 64).filter("t < 300")
    for skip, most in ((0, 2), (2, 1), (3, None)):  # each time a new query over the same state
        search.replay(x, "t", 70, f"{folder}/in", skip, most)
        out = search.run_with_state(search.search(search.as_stream(spark, f"{folder}/in", x.schema), NF, F0, DF, ND, (1, 3, 20), block=32), folder)
    assert rows(out.filter("v <> 0").select("beam", "idt", "t", "v")) == rows(whole)
    box = spectra.boxcars(spectra.dm0(x).select("beam", "t", F.col("dm0").alias("v")), (1, 3, 20))
    got = out.filter("idt = 0 and seen").select("beam", "t", F.posexplode("s").alias("k", "s")).select("beam", "t", F.element_at(F.array(*map(F.lit, (1, 3, 20))), F.col("k") + 1), "s")
    assert rows(got) == rows(box.select("beam", "t", "width", "s"))


def test_gaps_late_samples_and_decay(spark, tmp_path):
    x = samples(spark, 120, 1).filter("t < 40 or t > 80").withColumn("t", F.when(F.col("t") > 80, F.col("t") + 5000).otherwise(F.col("t")))
    late = x.filter("t = 10").withColumn("v", F.lit(1000).cast("long"))
    search.replay(x, "t", 50, f"{tmp_path}/in")
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = search.run_with_state(search.search(search.as_stream(spark, f"{tmp_path}/in", x.schema), NF, F0, DF, ND, block=32), str(tmp_path))
    last = x.agg(F.max("t")).first()[0]
    want = dedisperse.dedisperse_tree(x, NF, F0, DF, ND, 64).filter(F.col("t") <= last)
    assert rows(out.filter("v <> 0").select("beam", "idt", "t", "v")) == rows(want)
    # the decay of the stream is that of the batch
    y = samples(spark, 90, 1)
    search.replay(y, "t", 40, f"{tmp_path}/in2")
    out = search.run_with_state(search.search(search.as_stream(spark, f"{tmp_path}/in2", y.schema), NF, F0, DF, ND, decay=7.0), f"{tmp_path}/two")
    want = spectra.dm0(spectra.high_pass(y, 7.0, 16)).select("t", "dm0").collect()
    got = {r.t: r.v for r in out.filter("idt = 0").collect()}
    assert len(got) == 90 and all(abs(got[r.t] - r.dm0) < 1e-9 for r in want)


def test_runs_and_decay_over_blocks(spark):
    x = spark.range(500).selectExpr("id % 2 as beam", "id as t", "if(id % 97 < 50, 1, if(id % 5 = 0, null, 2)) as v")
    want = []
    for b in (0, 1):
        for t in range(b, 500, 2):
            v = 1 if t % 97 < 50 else None if t % 5 == 0 else 2
            if want and want[-1][0] == b and want[-1][3] == v:
                want[-1] = (b, want[-1][1], t, v, want[-1][4] + 1)
            else:
                want.append((b, t, t, v, 1))
    for block in (7, 64, 1000):
        got = spectra.runs_of_equal(x, ["beam"], "t", "v", block).select("beam", "first", "last", "value", "n").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    y = spark.range(4000).selectExpr("0 as beam", "int(id % 2) as chan", "id div 2 as t", "double(id % 13) as v").filter("t % 11 <> 3 or chan = 0")
    by = {(r.chan, r.t): r.v for r in spectra.high_pass(y, 7.0, 1).collect()}  # 2000 blocks: two stretches
    d = {0: 0.0, 1: 0.0}
    for r in sorted(y.collect(), key=lambda r: r.t):
        d[r.chan] = (r.v + 7 * d[r.chan]) / 8
        assert abs(by[r.chan, r.t] - (r.v - d[r.chan])) < 1e-9


def test_chain_of_friends_takes_few_rounds(spark, monkeypatch):
    cand = spark.range(200).selectExpr("0L as beam", "id as rid", "double(id % 7) as sn", "id * 3 as sampno", "5 as idt", "1 as boxcar", "1L as dm")
    cuts, real = [], clusters.cut
    monkeypatch.setattr(clusters, "cut", lambda df: cuts.append(1) or real(df))
    box = clusters.friends_of_friends(cand, 4, 2).collect()
    assert len(box) == 1 and (box[0].t0, box[0].t1, box[0].ncands, box[0].rid) == (0, 597, 200, 6)
    assert len(cuts) < 3 * 10


def test_nearest_first_then_dm(spark):
    from pulsegrid.operators import candidates as C

    left = spark.createDataFrame([(1, 100, 5.0, 0)], "lid long, t long, dm double, beam int")
    right = spark.createDataFrame([(1, 101, 50.0, 0), (2, 105, 5.0, 0)], "rid long, t long, dm double, beam int")
    assert C.nearest_then_dm(left, right, 60, 3, ["beam"]).count() == 0
    assert [r.rid for r in C.nearest_in_time_and_dm(left, right, 60, 3, ["beam"]).collect()] == [2]


def test_covariance_divides_by_one_less(spark):
    x = spark.createDataFrame([(0, t, 0, v) for t, v in enumerate((1, 2, 6))] + [(1, t, 0, v) for t, v in enumerate((2, 2, 5))], "beam int, t long, chan int, v long")
    got = {(r.a, r.b): r.cov for r in spectra.beam_covariance(x, 64).collect()}
    want = np.cov([[1, 2, 6], [2, 2, 5]])
    assert all(abs(got[a, b] - want[a, b]) < 1e-9 for a, b in ((0, 0), (0, 1), (1, 1)))
    assert abs(spectra.covariance(x.filter("beam = 0"), 64, 0).first().cov - want[0, 0]) < 1e-9


def test_a_replay_reads_its_table_once(spark, tmp_path):
    """Files of a span each, oldest first, from one pass over the table, however many there are."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    x = spark.range(0, 60, numPartitions=2).selectExpr("id * 7 as t", "id as v").mapInArrow(seen, "t long, v long")
    search.replay(x, "t", 10, f"{tmp_path}/in")
    assert read.value == 60
    files = sorted(tmp_path.glob("in/*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    times = [[r.t for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert all(len({t // 10 for t in ts}) == 1 for ts in times)
    assert sorted(sum(times, [])) == [7 * k for k in range(60)] and [max(ts) for ts in times] == sorted(max(ts) for ts in times)


def test_micro_batches_grow_with_rows_not_with_spans(spark, tmp_path):
    x = spark.range(4000).selectExpr("id * if(id < 2000, 1, 1000) as t", "id as v").union(spark.createDataFrame([(None, 1)], "t long, v long"))
    for rows, most in ((500, 9), (1 << 20, 4)):
        search.replay(x, "t", 10, f"{tmp_path}/{rows}", rows=rows)
        files = sorted(tmp_path.glob(f"{rows}/*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        ends = [(f[0], f[1], f[2]) for f in (spark.read.parquet(str(p)).selectExpr("min(t)", "max(t)", "count(*)").first() for p in files)]
        assert 4 <= len(files) <= most and sum(n for *_, n in ends) == 4000
        assert all(a[1] // 10 < b[0] // 10 for a, b in zip(ends, ends[1:], strict=False))


def test_stream_of_an_empty_table(spark):
    x = samples(spark).limit(0)
    stream, folder = search.replayed(x, "t", 70)
    assert search.run_with_state(search.search(stream, NF, F0, DF, ND), folder).count() == 0


def test_state_has_no_more_partitions_than_cores(spark, tmp_path):
    was = spark.conf.get(search.PARTITIONS)
    spark.conf.set(search.PARTITIONS, 50)
    try:
        x = samples(spark, 20)
        search.replay(x, "t", 10, f"{tmp_path}/in")
        search.run_with_state(search.search(search.as_stream(spark, f"{tmp_path}/in", x.schema), NF, F0, DF, ND), str(tmp_path))
        assert spark.conf.get(search.PARTITIONS) == "50"
        assert len([p for p in (tmp_path / "state/state/0").iterdir() if p.name.isdigit()]) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(search.PARTITIONS, was)


def test_density_clusters_by_brute_force_over_blocks(spark, monkeypatch):
    """Blocks of any width give the same; rids that repeat across beams, clusters over many blocks, border rows between two, nulls, negative times."""
    rng = np.random.default_rng(5)
    t = np.concatenate([rng.integers(-60, 400, 260), np.arange(500, 620, 4), [700, 705, 710, 711, 712, 705, 690, 691]])
    rows = [(int(rng.integers(2)) if k < 260 else 0, int(x) * 8 + (int(rng.integers(3)) if k < 260 else 0), int(x), int(rng.integers(4)) if k < 260 else 1, int(rng.integers(5)) if k < 260 else 1) for k, x in enumerate(t)]
    eps, least = 5, 3
    close = [[a[1] != b[1] and a[0] == b[0] and sum((x - y) ** 2 for x, y in zip(a[2:], b[2:], strict=True)) <= eps * eps for b in rows] for a in rows]
    near = {}
    for a, met in zip(rows, close, strict=True):
        near.setdefault(a[1], []).extend(b[1] for b, yes in zip(rows, met, strict=True) if yes)
    core = {r for r, met in near.items() if len(met) + 1 >= least}
    label = {r: r for r in core}
    for _ in rows:
        label = {r: min([label[r], *(label[b] for b in near[r] if b in core)]) for r in core}
    want = [(r, label[r], True) for r in core] + [(r, min(label[b] for b in near[r] if b in core), False) for r in near if r not in core and any(b in core for b in near[r])]
    assert any(not c for *_, c in want) and max(sum(x == k for _, x, _ in want) for k in core) > 20
    schema = "beam int, rid long, sampno long, boxcar int, dm long"
    cand = spark.createDataFrame([*rows, (None, 1, 500, 1, 1), (0, 2, 500, None, 1)], schema)
    for width in (1, 33, 4096):
        assert rows_of(clusters.density_clusters(cand, eps, least, width)) == sorted(want)
    assert clusters.density_clusters(cand.limit(0), eps, least).count() == 0


def rows_of(df):
    return sorted((r.rid, r.cluster, r.core) for r in df.collect())


def test_pairs_of_a_dense_burst_stay_in_a_task(spark, monkeypatch):
    """400 rows at one place are 79,800 pairs; what is written between the steps grows with the rows."""
    cand = spark.range(400).selectExpr("0L as beam", "id as rid", "4090 + id % 3 as sampno", "1 as boxcar", "1L as dm")
    written, real = [], clusters.cut
    monkeypatch.setattr(clusters, "cut", lambda df: written.append(df.count()) or real(df))
    assert rows_of(clusters.density_clusters(cand, 6, 3)) == [(k, 0, True) for k in range(400)]
    assert sum(written) <= 10 * 400


def test_strongest_of_a_dense_burst(spark, monkeypatch):
    """Two bursts of 300 rows, over the end of a block: what is written between the steps grows with the rows, not the pairs."""
    cand = spark.range(600).selectExpr("id div 300 as beam", "id as rid", "double(id % 7) as sn", "4094 + id % 4 as sampno", "1 as boxcar", "1L as dm")
    written, real = [], clusters.cut
    monkeypatch.setattr(clusters, "cut", lambda df: written.append(df.count()) or real(df))
    got = clusters.strongest_of_clusters(cand, clusters.density_clusters(cand, 6, 3))
    assert rows(got.select("cluster", "rid", "sn", "n")) == [(0, 6, 6.0, 300), (300, 300, 6.0, 300)]
    assert sum(written) <= 20 * 600
