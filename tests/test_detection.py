import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars
from pulsegrid.operators import candidates as C
from pulsegrid.operators import channels, dedisperse, search
from pulsegrid.sources import filterbank


def test_noise_of_tree_and_boxcar(spark):
    nf, f0, df, nd, widths = 16, 0.976, 0.001, 16, (1, 3, 8)
    table = {(r.idt, r.width): r.sigma for r in search.noise_table(spark, nf, f0, df, nd, widths).collect()}
    levels, depth = dedisperse.tree(nf, f0, df, nd), dedisperse.depths(nf, f0, df, nd)
    x = np.random.default_rng(1).normal(size=(nf, 60_000))
    out = dedisperse.SampleTree(levels, depth, float).push(x)[:, 100:]
    total = np.cumsum(np.pad(out, ((0, 0), (1, 0))), axis=1)
    for d in (0, 1, 7, 15):
        for w in widths:
            assert np.std(total[d, w:] - total[d, :-w]) == pytest.approx(table[d, w], rel=0.06)
    # by adding up each sample's weight
    for spread in range(1, 9):
        for width in range(1, 9):
            assert search.spread_variance(spread, width) == (np.convolve(np.ones(spread), np.ones(width)) ** 2).sum()


def test_kernel_edges(spark):
    best = spark.createDataFrame([(0, t, w, s) for t, w, s in ((3, 1, 9.0), (4, 8, 12.0), (31, 1, 10.0), (33, 1, 11.0), (39, 1, 99.0), (40, 2, 8.5), (71, 1, 9.0), (70, 1, 8.0))], "beam int, t long, width int, sn double")
    got = sorted((r.start, r.end, r.sn, r.discarded) for r in search.kernel_islands(best, 8.0, 40, 4).collect())
    assert got == [(3, 4, 12.0, True), (40, 40, 8.5, False), (70, 71, 9.0, False)]


def test_leap_seconds_and_intervals(spark):
    at = lambda day: spark.range(1).select(scalars.leap_seconds(F.lit(day))).first()[0]
    assert [at(d) for d in (41316, 41317, 57753.9, 57754.0, 60000)] == [0, 10, 36, 37, 37]
    bat = int((57754 * 86400 + 36.5) * 1e6)
    assert spark.range(1).select(scalars.atomic_to_mjd(F.lit(bat))).first()[0] == pytest.approx(57754 + 0.5 / 86400, abs=1e-9)
    left = spark.createDataFrame([(1, 10, 0), (2, 200, 0), (3, 1, 0)], "lid long, t long, ant int")
    right = spark.createDataFrame([(7, 5, 0)], "rid long, t long, ant int")
    assert sorted((r.lid, r.rid, r.age) for r in C.as_of_within(left, right, ["ant"], 60, strict=False).collect()) == [(1, 7, 5), (2, None, None), (3, None, None)]
    with pytest.raises(Exception, match="nothing within the interval at 200"):
        C.as_of_within(left.filter("lid = 2"), right, ["ant"], 60).collect()


def test_candidate_files(spark, tmp_path):
    rows = [(9.5, 3, 0.03, 2, 5, 66.0, 1, 58000.25, "J1", "J1,J2"), (6.0, 1, 0.01, 1, 2, 68.0, 2, 58000.5, None, None), (8.0, 2, 0.02, 1, 2, 69.0, 2, 58000.5, None, None)]
    cand = spark.createDataFrame(rows, "sn double, sampno long, secs double, boxcar int, idt int, dm double, beamno int, mjd double, main string, names string")
    filterbank.write_by_identity(cand, f"{tmp_path}/split")
    known = spark.read.text(f"{tmp_path}/split/known=true").collect()
    assert [r.value.split()[0] for r in known] == ["J1"] and known[0].value.endswith("J1,J2") and spark.read.text(f"{tmp_path}/split/known=false").count() == 2
    merged = cand.select("*", F.lit(1).alias("t0"), F.lit(4).alias("t1"), F.lit(2).alias("i0"), F.lit(6).alias("i1"), F.lit(12).alias("ncands"))
    filterbank.write_clusters(merged, f"{tmp_path}/fof", merged=True)
    back = filterbank.read_merged(spark, f"{tmp_path}/fof").orderBy("sampno").collect()
    assert [(r.sn, r.sampno, r.mjd, r.t1, r.ncands) for r in back] == [(6.0, 1, 58000.5, 4, 12), (8.0, 2, 58000.5, 4, 12), (9.5, 3, 58000.25, 4, 12)]
    filterbank.write_clusters(merged, f"{tmp_path}/dbs", merged=False)
    assert {len(r.value.split()) for r in spark.read.text(f"{tmp_path}/dbs").collect()} == {8}
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "a.cand").write_text("# header\n10 5 0.1 1 2 66.5 3\n")
    (tmp_path / "deep" / "er" / "b.cand").write_text("7.5 4 0.1 1 2 69 3 58001\n6.5 4 0.1 1 2 69 3 58001\n")
    (tmp_path / "deep" / "er" / "c.cand").write_text("")
    (tmp_path / "deep" / "d.txt").write_text("1 1 1 1 1 1 1\n")
    every = filterbank.collect_candidates(spark, f"{tmp_path}/deep")
    assert sorted(r.sn for r in every.collect()) == [6.5, 7.5, 10.0]
    assert [r.sn for r in filterbank.of_known_pulsar(every).collect()] == [7.5, 10.0]


def test_channels(spark):
    at = spark.createDataFrame([(800.4,), (805.6,), (799.4,), (802.0,)], "f double").select(channels.channel_at(F.col("f"), 800.0, 1.0, 6).alias("c")).collect()
    assert [r.c for r in at] == [0, None, None, 2]
    axis = spark.createDataFrame([(k, 800.0 + k, k == 4) for k in range(7)], "chan int, freq double, mask boolean")
    assert sorted(map(tuple, channels.scrunched_axis(axis, 3).collect())) == [(0, 801.0, False), (1, 804.0, True)]
