import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import uvfits, voltages


@pytest.fixture(scope="module")
def vis(tmp_path_factory):
    rng = np.random.default_rng(1)
    nt, nbl, chans = 11, 6, 4
    n = nt * nbl
    columns = {c: rng.normal(size=n).astype(np.float32) for c in ("UU", "VV", "WW")}
    columns |= {"DATE": 2458000.5 + np.repeat(np.arange(nt), nbl) * 1e-5, "BASELINE": np.tile([257, 258, 259, 514, 515, 771], nt).astype(np.float32), "SOURCE": np.full(n, 2.0), "INTTIM": np.full(n, 0.5)}
    data = rng.normal(size=(n, chans, 2, 3)).astype(np.float32)
    path = tmp_path_factory.mktemp("uv") / "a.uvfits"
    path.write_bytes(uvfits.group_bytes(columns, data, 2458000.0))
    return str(path), columns, data, nbl


def test_uvfits_round_trip(spark, vis):
    path, columns, data, nbl = vis
    got = uvfits.read_uvfits(spark, path, rows=10).orderBy("row").collect()
    assert [r.row for r in got] == list(range(66))
    assert np.allclose([r.date for r in got], columns["DATE"], rtol=0, atol=1e-9)
    assert [r.baseline for r in got] == columns["BASELINE"].tolist() and {r.source for r in got} == {2}
    assert np.array_equal(np.array([r.uu for r in got], np.float32), columns["UU"])
    for k, c in enumerate(("re", "im", "wt")):
        assert np.array_equal(np.array([r[c] for r in got], np.float32), data[..., k].reshape(66, -1))


def test_uvfits_filters_cut_partitions(spark, vis):
    path, columns, _, nbl = vis
    every = uvfits.read_uvfits(spark, path, rows=10)
    date = float(2458000.5 + 8.5e-5)
    late = every.filter(F.col("date") > date)
    assert every.rdd.getNumPartitions() == 7 and late.rdd.getNumPartitions() == 2
    assert late.count() == 2 * nbl and every.filter(F.col("date") <= date).count() == 9 * nbl
    assert every.filter("baseline in (258, 771) and row < 12").count() == 4
    assert every.filter(F.col("row") == 30).rdd.getNumPartitions() == 1
    assert every.filter("baseline = 257 and uu > 0").count() == int((columns["UU"][::6] > 0).sum())


def test_uvfits_short_tails(spark, vis, tmp_path):
    path, _, _, nbl = vis
    blocks = uvfits.time_blocks(uvfits.read_uvfits(spark, path), 4, nbl)
    assert blocks.count() == 8 * nbl and blocks.agg(F.max("blk")).first()[0] == 1
    lay = uvfits.layout(path)
    cut = tmp_path / "cut.uvfits"
    cut.write_bytes(open(path, "rb").read()[: lay.start + 20 * lay.size + 7])
    assert uvfits.read_uvfits(spark, f"{path},{cut}").count() == 86
    with pytest.raises(ValueError):
        uvfits.layout(__file__) if (tmp_path / "x").write_bytes(b" " * 2880) else None


@pytest.mark.parametrize("mode", [0, 2, 3])
def test_voltage_ranges_in_all_modes(spark, tmp_path, mode):
    rng = np.random.default_rng(mode)
    n, channels = 96, 3
    top = {0: 32767, 2: 7, 3: 1}[mode]
    x = rng.integers(-top, top + 1, (n, channels, 2)).astype(np.int16)
    if mode == 3:
        x = np.where(x < 0, -1, 1).astype(np.int16)
    words = voltages.pack(x, mode)
    assert np.array_equal(voltages.unpack(words, mode), x)
    path = tmp_path / "ak02.vcraft"
    path.write_bytes(b"\0" * 128 + words.tobytes() + b"\1\2\3")
    (tmp_path / "ak02.vcraft.hdr").write_text(f"HDR_SIZE 128\nCRAFT_MODE {mode + 4}\nNBITS 4\nFREQS 800.5,801.5,810.5 # MHz\nANT ak02 # name\n")
    for start, count in ((0, None), (0, 1), (5, 30), (17, 3), (n - 1, 10)):
        options = {"start": start, "words": 4} | ({} if count is None else {"samples": count})
        got = voltages.read_voltages(spark, str(path), **options).collect()
        want = x[start : None if count is None else start + count]
        assert len(got) == want.shape[0] * channels
        assert all((r.re, r.im) == tuple(x[r.t, r.chan]) and r.t >= start and r.freq == (800.5, 801.5, 810.5)[r.chan] and r.ant == "ak02" for r in got)
    assert voltages.read_voltages(spark, str(path), words=1).rdd.getNumPartitions() == n // voltages.PER_WORD[mode]


def test_voltage_mode_one_is_an_error(spark, tmp_path):
    (tmp_path / "b").write_bytes(b"\0" * 64)
    (tmp_path / "b.hdr").write_text("HDR_SIZE 0\nCRAFT_MODE 1\nFREQS 800\n")
    with pytest.raises(Exception, match="cannot be unpacked"):
        voltages.read_voltages(spark, str(tmp_path / "b")).count()
