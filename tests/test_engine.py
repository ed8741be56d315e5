"""Operators that SQL cannot express, against brute force and round trips."""

import numpy as np
import pytest

from pulsegrid.operators import clusters, dedisperse, transforms
from pulsegrid.sources import filterbank


def test_tree_delays_stay_within_their_delay():
    for nf in (5, 16, 64):
        levels = dedisperse.tree(nf, 1.0, 0.005, 16)
        for d in range(16):
            parts = dedisperse.trace(levels, d)
            assert sorted(c for c, _, _ in parts) == list(range(nf))
            assert all(0 <= e and e + s <= d for _, e, s in parts)
            assert min(s for _, _, s in parts) == 0


def _closed(boxes, reach, idt_reach):
    again = True
    while again:
        again = False
        for x in boxes:
            near = [y for y in boxes if y is not x and y[0] == x[0] and x[3] - reach <= y[4] and y[3] <= x[4] + reach and x[5] - idt_reach <= y[6] and y[5] <= x[6] + idt_reach]
            if near:
                y = near[0]
                best = max(x, y, key=lambda z: (z[2], -z[1]))
                merged = [x[0], best[1], best[2], min(x[3], y[3]), max(x[4], y[4]), min(x[5], y[5]), max(x[6], y[6]), x[7] + y[7]]
                boxes = [z for z in boxes if z is not x and z is not y] + [merged]
                again = True
                break
    return boxes


def test_friends_of_friends_against_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(2)), k, float(rng.integers(50)), int(rng.integers(600)), int(rng.integers(1, 8)), int(rng.integers(12))) for k in range(150)]
    for reach, idt_reach in ((4, 2), (12, 1)):
        boxes = _closed([[b, k, s, t, t, i, i, 1] for b, k, s, t, w, i in rows], reach, idt_reach)
        got = clusters.friends_of_friends(spark.createDataFrame(rows, "beam int, rid long, sn double, sampno long, boxcar int, idt int"), reach, idt_reach).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, boxes))


def test_friends_are_points_at_first(spark):
    rows = [(0, 1, 9.0, 10, 6, 3), (0, 2, 8.0, 20, 6, 3)]
    assert clusters.friends_of_friends(spark.createDataFrame(rows, "beam int, rid long, sn double, sampno long, boxcar int, idt int"), 4, 2).count() == 2


def test_clusters_of_an_empty_table(spark):
    none = spark.createDataFrame([], "beam int, rid long, sn double, sampno long, boxcar int, idt int, dm long")
    assert clusters.friends_of_friends(none).count() == clusters.density_clusters(none, 6, 3).count() == 0


def test_image_of_one_visibility_is_a_wave(spark):
    vis = spark.createDataFrame([(0, 2.0, 0.0, 1.0, 0.0)], "t int, u double, v double, re double, im double")
    got = {(r.x, r.y): r.v for r in transforms.image(transforms.uv_grid(vis, 8, 1.0), 8).collect()}
    assert all(abs(v - 2 * np.cos(2 * np.pi * 2 * (x - 4) / 8)) < 1e-9 for (x, _), v in got.items())


def test_strongest_component_goes(spark):
    a, b = np.arange(1, 5), np.arange(1, 9)
    rows = [(0, int(t), int(c), float(a[c] * b[t])) for c in range(4) for t in range(8)]
    assert all(abs(r.v) < 1e-9 for r in transforms.remove_strongest(spark.createDataFrame(rows, "beam int, t long, chan int, v double"), 8).collect())


def test_filterbank_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    for bits, kind, top in ((8, np.uint8, 256), (32, np.float32, 9)):
        x = rng.integers(0, top, (2, 50, 16)).astype(kind)
        paths = [tmp_path / f"{bits}-{k}.fil" for k in range(2)]
        for p, beam in zip(paths, x, strict=True):
            p.write_bytes(filterbank.header_bytes({"nchans": 16, "nbits": bits, "nifs": 1, "tsamp": 0.001, "fch1": 1448.0, "foff": -1.0, "source_name": "s"}) + beam.tobytes())
        rows = filterbank.read_filterbank(spark, ",".join(map(str, paths)), step="7", start="3", end="45").orderBy("beam", "t").collect()
        assert [(r.beam, r.t) for r in rows] == [(b, t) for b in range(2) for t in range(3, 45)]
        assert all(r.vals == x[r.beam, r.t].astype(float).tolist() for r in rows)


def test_filterbank_of_two_bits(spark, tmp_path):
    (tmp_path / "x.fil").write_bytes(filterbank.header_bytes({"nchans": 8, "nbits": 2}) + bytes([0b11100100, 0b00011011]))
    assert filterbank.read_filterbank(spark, str(tmp_path / "x.fil")).first().vals == [0, 1, 2, 3, 3, 2, 1, 0]


def test_candidates_round_trip(spark, tmp_path):
    cand = spark.createDataFrame([(10.5, 3, 0.5, 2, 7, 4.25, 1, 58000.5)], filterbank.CANDIDATE)
    filterbank.write_candidates(cand, str(tmp_path / "c"))
    assert filterbank.read_candidates(spark, str(tmp_path / "c")).collect() == cand.collect()
    (tmp_path / "d.cand").write_text("# sn sampno\n10.5 3 0.5 2 7 4.25 1\n")
    assert filterbank.read_candidates(spark, str(tmp_path / "d.cand")).first().mjd == 0


def test_tree_follows_the_dispersion_curve():
    nf, nd, f0, df = 336, 1024, 1113.0, 1.0
    levels = dedisperse.tree(nf, f0, df, nd)
    for d in (0, 1, 17, 500, 1023):
        parts = sorted(dedisperse.trace(levels, d))
        assert [c for c, _, _ in parts] == list(range(nf))
        for c, own, shift in parts:
            # a channel's part of the curve ends at its lower edge, within the rounding of nine levels
            assert abs(own + shift - d * dedisperse.share(f0, f0 + (c + 1) * df, f0, f0 + nf * df)) <= 10


def test_scalar_values(spark):
    from pyspark.sql import functions as F

    from pulsegrid.functions import scalars as f

    assert abs(f.dm_step(0.736, 0.001, 256, 1.7) - 0.4948473447941156) < 1e-12
    row = spark.range(1).select(
        F.bround(f.dm_to_idt(F.lit(100.0), 0.736, 0.001, 256, 1.7)).alias("idt"), f.strict_sexagesimal(F.lit(123456.789)).alias("deg"), f.strict_sexagesimal(F.lit(-123456.789)).alias("neg"),
        f.degrees_to_sexagesimal(F.lit(-12.5)).alias("back"), f.triangular_index(F.lit(106), F.lit(71), 256).alias("tri"), f.separation(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("sep"),
        f.mjd(F.lit("2018-03-19 12:00:00").cast("timestamp")).alias("mjd"), f.mjd_to_timestamp(F.lit(58196.5)).cast("string").alias("ts"), f.coerced(F.lit("x1")).alias("none"), f.divisors(F.lit(12)).alias("div"),
        f.parse_hms(F.lit("-01:30:00")).alias("hours"), f.format_hms(F.lit(-1.5)).alias("text"), f.finite(F.lit(float("nan"))).alias("nan"), f.channel_of(F.lit(2), F.lit(8)).alias("chan"),
        F.array(*f.file_parts(F.lit("/d/20180319131558/ak02/beam07.fil"))[:2]).alias("parts"), F.array(*f.magnitude_and_angle(F.lit(3.0), F.lit(4.0))).alias("polar"),
    ).first()
    assert row.idt == 202 and abs(row.deg - 12.58244) < 1e-5 and abs(row.neg + 12.58244) < 1e-5 and row.back == -123000 and row.tri == 15726 and abs(row.sep - 90) < 1e-9
    assert row.mjd == 58196.5 and row.ts == "2018-03-19 12:00:00" and row.none is None and row.div == [1, 2, 3, 4, 6, 12] and row.hours == -1.5 and row.text == "-01:30:00.00"
    assert row.nan is None and row.chan == 19 and row.parts == ["ak02", "20180319131558"] and row.polar[0] == 5
    with pytest.raises(Exception, match="sexagesimal"):
        spark.range(1).select(f.strict_sexagesimal(F.lit(126400.0))).collect()


def test_boxcars_over_gaps(spark):
    from pulsegrid.operators.spectra import boxcars, high_pass

    series = spark.createDataFrame([(0, 0, 1), (0, 100, 1), (0, 101, 2)], "beam int, t long, v long")
    assert sorted((r.t, r.s) for r in boxcars(series, (2,), 64).collect()) == [(0, 1), (100, 1), (101, 3)]
    # blocks smaller and larger than the data give the same sums, and the same high-pass
    rng = np.random.default_rng(2)
    many = spark.createDataFrame([(b, int(t), int(v)) for b in range(2) for t, v in zip(np.flatnonzero(rng.random(300) < 0.7), rng.integers(-9, 9, 300), strict=False)], "beam int, t long, v long")
    one, other = (sorted(map(tuple, boxcars(many, (1, 7, 32), n).collect())) for n in (40, 1000))
    assert one == other
    x = many.selectExpr("beam", "t", "0 as chan", "v")
    one, other = (sorted((r.beam, r.t, round(r.v, 9)) for r in high_pass(x, 5.0, n).collect()) for n in (16, 1000))
    assert one == other and sorted((r.beam, r.t, r.v) for r in high_pass(x, 0, 16).collect()) == sorted((r.beam, r.t, float(r.v)) for r in x.collect())


def test_multibeam_takes_steps_not_spread(spark):
    from pulsegrid.operators.candidates import collapse_beams

    rows = [(1, 5.0, 7, 0, 0), (2, 9.0, 7, 4, 1), (3, 6.0, 7, 8, 2), (4, 5.0, 8, 0, 0), (5, 6.0, 8, 6, 1), (6, 5.0, 9, 20, 0), (7, 6.0, 9, 0, 1)]
    got = collapse_beams(spark.createDataFrame(rows, "rid long, sn double, sampno long, dm int, beam int")).collect()
    assert sorted(r.rid for r in got) == [2, 7]


def test_rescale_rules(spark):
    from pulsegrid.operators import spectra as S

    m = [(0, 0, 0, 4, 100.0, 9.0, 0.1), (0, 1, 0, 4, 128.0, 0.0, 0.0), (0, 2, 0, 4, 500.0, 18.0, 0.0), (0, 3, 0, 4, 128.0, 18.0, 0.0), (0, 3, 1, 0, None, None, None)]
    stats = spark.createDataFrame(m, "beam int, chan int, blk long, n long, mean double, std double, kurt double")
    got = {(r.chan, r.blk): (r.scale, r.offset) for r in S.rescale_table(S.flag_channels(stats, 100, 100, 9, 1)).collect()}
    # flags reach [chan - 1, chan + 1), so channel 3 sees the bad channel 2, and keeps its flag where it has no samples
    assert got == {(0, 0): (2.0, -36.0), (1, 0): (1.0, 0.0), (2, 0): (0.0, 0.0), (3, 0): (0.0, 0.0), (3, 1): (0.0, 0.0)}


def test_filterbank_sink_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (2, 40, 8)).astype(float)
    rows = spark.createDataFrame([(b, t, x[b, t].tolist()) for b in range(2) for t in range(40)], "beam int, t long, vals array<double>")
    files = filterbank.write_filterbank(rows, str(tmp_path), {"nchans": 8, "nbits": 8, "nifs": 1, "tsamp": 0.5, "fch1": 1448.0, "foff": -1.0, "tstart": 58000.0}, 16).collect()
    assert len(files) == 6
    for f in files:
        head, _ = filterbank.read_header(f.file)
        assert head["nsamples"] == f.rows and abs(head["tstart"] - 58000 - f["first"] * 0.5 / 86400) < 1e-12
        back = filterbank.read_filterbank(spark, f.file).orderBy("t").collect()
        assert [r.vals for r in back] == x[f.beam, f["first"] : f["first"] + f.rows].tolist()


def test_headers_and_parsets(spark, tmp_path):
    (tmp_path / "h").write_text("HDR_SIZE 16384 # bytes\nFREQS 1,2,3\nALONE\n\nNAME a b\nFREQS 4,5\n")
    (tmp_path / "p").write_text("# nothing\na.b = [x,y]\nc=1 # one\nno line\n")
    got = {r.key: (r.value, r.comment) for r in filterbank.read_header_lines(filterbank.text_lines(spark, str(tmp_path / "h"))).collect()}
    assert got == {"HDR_SIZE": ("16384", "bytes"), "FREQS": ("4,5", None), "NAME": ("a b", None)}
    assert {r.key: r["values"] for r in filterbank.read_parset_lines(filterbank.text_lines(spark, str(tmp_path / "p"))).collect()} == {"a.b": ["x", "y"], "c": ["1"]}


def test_candidate_files_with_odd_blanks(spark, tmp_path):
    (tmp_path / "d.cand").write_text("# sn\n\n  10.5   3 0.5\t2 7 4.25 1 58000.5 9 9\n   \n11 4 0.5 2 7 4.25 1\n")
    assert [(r.sn, r.sampno, r.mjd) for r in filterbank.weakest_first(filterbank.read_candidates(spark, str(tmp_path / "d.cand"))).collect()] == [(10.5, 3, 58000.5), (11.0, 4, 0.0)]
    cand = spark.createDataFrame([(10.5, 3, 0.5, 2, 7, 4.25, 1, 58000.5)], filterbank.CANDIDATE)
    filterbank.write_candidates(cand, str(tmp_path / "n"), negative=True)
    back = filterbank.read_candidates(spark, str(tmp_path / "n")).first()
    assert back.idt == -7 and back.dm == -4.25 and back.sn == 10.5


def test_dada_blocks(spark, tmp_path):
    from pulsegrid.sources import dada

    x = np.arange(24, dtype="<f4").reshape(4, 2, 3)
    x[1, 0, 1], x[2, 1, 2] = np.nan, np.inf
    head = b"HDR_SIZE 5000 # bytes\nSHAPE 9\nDTYPE <f4\n"
    path = tmp_path / "a.dada"
    path.write_bytes((head + b"#" * 4200 + b"\nSHAPE 2,3\n").ljust(5000, b"\0") + x.tobytes() + b"12345")  # a header of over 4096 bytes, its last SHAPE counts
    assert dada.read_header(str(path))["SHAPE"] == "2,3"
    got = {(r.block, r.i): r.v for r in dada.read_dada(spark, str(path), blocks="3").collect()}
    assert got == {(b, i): (None if not np.isfinite(v) else float(v)) for b in range(4) for i, v in enumerate(x[b].ravel())}
    assert sorted({r.block for r in dada.read_dada(spark, str(path), step="2", blocks="1").collect()}) == [0, 2]
    (tmp_path / "b.dada").write_bytes(b"HDR_SIZE 64\nSHAPE 4\n".ljust(64, b"\0"))
    assert dada.read_dada(spark, str(tmp_path / "b.dada")).count() == 0
    (tmp_path / "c.dada").write_bytes(b"HDR_SIZE 64\n".ljust(64, b"\0"))
    with pytest.raises(Exception, match="SHAPE"):
        dada.read_dada(spark, str(tmp_path / "c.dada")).count()


def test_delay_of_a_sample_is_a_slope_of_phase(spark):
    from pulsegrid.operators import voltages as V

    rng = np.random.default_rng(5)
    x = rng.normal(size=65) + 1j * rng.normal(size=65)
    rows = [(a, 0, t, float(v.real), float(v.imag)) for a, shift in ((0, 0), (1, 1)) for t, v in enumerate(np.roll(x, shift)[:64])]
    fine = V.fine_channels(spark.createDataFrame(rows, "ant int, chan int, t long, re double, im double"), 64, 0)
    one = {r.fine: complex(r.re, r.im) for r in fine.filter("ant = 0").collect()}
    assert np.allclose([one[k] for k in range(64)], np.fft.fftshift(np.fft.fft(x[:64])))
    vis = [(k, float(np.cos(2.0 * k + 0.5)), float(np.sin(2.0 * k + 0.5))) for k in range(40)]
    fit = V.phase_slope(spark.createDataFrame(vis, "chan int, re double, im double").selectExpr("1 as a", "*"), ["a"]).first()
    assert abs(fit.slope - 2.0) < 1e-9 and abs(fit.intercept - 0.5) < 1e-9
    turned = V.delayed(fine.filter("ant = 0"), spark.createDataFrame([(0, 0.25)], "ant int, us double"), 1.0, 0.5, 0.0).collect()
    assert all(abs(complex(r.re, r.im) - one[r.fine] * np.exp(2j * np.pi * 0.25 * 0.5 * r.fine)) < 1e-9 for r in turned)


def test_rows_that_do_not_match_are_errors(spark):
    from pulsegrid.operators import candidates as C
    from pulsegrid.operators import imaging, voltages

    a, b = spark.createDataFrame([(1, 7, 2.0), (2, 8, 3.0)], "row int, blid int, v double"), spark.createDataFrame([(1, 7, 1.0), (2, 9, 1.0)], "row int, blid int, v double")
    assert voltages.row_difference(a.filter("row = 1"), b.filter("row = 1"), "row", "blid", "v").first().v == 1.0
    for bad in (b, b.filter("row = 1")):
        with pytest.raises(Exception, match="keys differ in row 2"):
            voltages.row_difference(a, bad, "row", "blid", "v").collect()
    sky = spark.createDataFrame([(1, 10.0, 0.0)], "rid int, ra double, dec double")
    with pytest.raises(Exception, match="no source near pointing 1"):
        C.nearest_source(sky, spark.createDataFrame([("x", 50.0, 0.0)], "name string, ra double, dec double"), 5.0).collect()
    with pytest.raises(Exception, match="out of range for baseline 3"):
        imaging.uv_cells(spark.createDataFrame([(3, 9.0, 0.0)], "blid int, uu double, vv double"), [1.0, 2.0], 1.0, 1.0, 16).collect()


def test_image_boxcars_of_ones(spark):
    from pulsegrid.operators import imaging

    images = spark.range(10).selectExpr("0 as idm", "0 as x", "0 as y", "id as t", "1.0d as v")
    for weight, want in (("sum", lambda n, w: n), ("avg", lambda n, w: n / w), ("sqrt", lambda n, w: n / w**0.5)):
        got = {r.t: r.s for r in imaging.image_boxcars(images, 3, weight, 4).collect()}
        assert all(np.allclose(got[t], [want(min(t + 1, w), w) for w in (1, 2, 3)]) for t in range(10))
    best = imaging.image_candidates(imaging.image_boxcars(images, 3, "sqrt", 4), 3, 1.5).collect()
    assert {(r.t, r.width) for r in best} == {(t, 3) for t in range(2, 10)}


def test_a_jump_of_integrations_is_an_error(spark):
    from pulsegrid.streaming import blocks

    rows = spark.createDataFrame([(0,), (3,), (65536 + 1,), (65536 + 2,)], "integ long")
    assert sorted(map(tuple, blocks.with_gaps(rows, 1 << 20).collect())) == [(0, 0), (3, 2), (65537, 65533), (65538, 0)]
    with pytest.raises(Exception, match="jump before integration 65537"):
        blocks.with_gaps(rows, 100).collect()
