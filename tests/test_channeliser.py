import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import channeliser as C


def frame(spark, x):
    return spark.createDataFrame([(0, t, float(v.real), float(v.imag)) for t, v in enumerate(x)], "beam int, t long, re double, im double")


def series(df, n):
    out = np.zeros(n, complex)
    for r in df.collect():
        out[r.t] = r.re + 1j * r.im
    return out


def commutator(x, c, paths, num, den):
    """The same filterbank as a shift register that takes in `stride` samples a frame."""
    stride, k = paths * den // num, len(c)
    register, out = list(x[k - stride : 0 : -1]), []
    for f in range((len(x) - k) // stride):
        at = k - stride + f * stride
        register = [x[at + j] for j in range(stride, 0, -1)] + register[: k - stride]
        sums = [sum(register[p + t * paths] * c[k - 1 - p - t * paths] for t in range(k // paths)) for p in range(paths)]
        turn = f * (paths - stride) % paths
        turned = sums[::-1][turn:] + sums[::-1][:turn]
        out.append(np.fft.fft(turned))
    return np.array(out)


def test_polyphase_against_a_shift_register(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=700) + 1j * rng.normal(size=700), C.prototype(32, 4)
    want = commutator(x, c, 32, 32, 27)
    for block in (1, 5, 1000):
        got = C.polyphase(frame(spark, x), ["beam"], c, 32, 32, 27, block).collect()
        assert len(got) == want.size
        assert all(abs(r.re + 1j * r.im - want[r.frame, r.chan]) < 1e-9 for r in got)
    with pytest.raises(ValueError):
        C.polyphase(frame(spark, x), ["beam"], c, 32, 31, 27)
    assert C.polyphase(frame(spark, x[:100]), ["beam"], c, 32, 32, 27).count() == 0


def test_a_tone_stays_in_its_channel(spark):
    paths, c = 32, C.prototype(32, 8)
    x = np.exp(2j * np.pi * (5.1 / paths) * np.arange(3000))
    got = C.polyphase(frame(spark, x), ["beam"], c, paths, 32, 27)
    power = {r.chan: r.p for r in got.groupBy("chan").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("p")).collect()}
    assert max(power, key=power.get) == 5 and sum(p for k, p in power.items() if k not in (4, 5, 6)) < 1e-3 * power[5]
    phase = [np.angle(r.re + 1j * r.im) for r in got.filter("chan = 5").orderBy("frame").collect()]
    step = np.angle(np.exp(1j * np.diff(phase)))  # a tone 0.1 channel off the middle turns evenly from frame to frame
    assert np.allclose(step, 2 * np.pi * 0.1 * 27 / 32, atol=1e-6)


def test_chirped_impulse_comes_back_as_one_sample(spark):
    n, dm, f_mid, bw = 2048, 20.0, 1320.5, 1.0
    half = 3 * C.sweep(dm, f_mid, bw)
    x = np.zeros(n, complex)
    x[900] = 1
    spread = np.fft.ifft(np.fft.fft(x) * np.conj(C.dispersion(n, dm, f_mid, bw)))
    assert np.abs(spread).max() < 0.3
    want = None
    for block in (64, 333, 5000):
        y = series(C.dedisperse_coherently(frame(spark, spread), ["beam"], dm, f_mid, bw, half, n, block=block), n)
        assert np.argmax(np.abs(y)) == 900 and abs(y[900]) > 0.9 and np.abs(np.delete(y, 900)).max() < 0.1
        want = y if want is None else want
        assert np.allclose(y, want, atol=1e-12)


def test_ripple_is_taken_off(spark):
    c, n = C.prototype(32, 8), 1024
    gain = C.ripple(c, 32, 32, 27, n)
    assert gain[0] == pytest.approx(1) and gain.min() < 0.9
    x = np.zeros(n, complex)
    x[500] = 1
    rippled = np.fft.ifft(np.fft.fft(x) * gain)
    y = series(C.dedisperse_coherently(frame(spark, rippled), ["beam"], 0.0, 1320.5, 1.0, 200, n, gain, block=100), n)
    assert abs(y[500]) > 0.99 and np.abs(np.delete(y, 500)).max() < 0.01 < np.abs(np.delete(rippled, 500)).max()
